"""Near-duplicate embeddings: codes by iterative quantisation, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected, slices, stored

#: Vectors (at most) that the rotation is learned from, iterations, rotations, and bits of a substring table.
SAMPLE, ITERATIONS, ROTATIONS, BITS = 4096, 40, 3, 16
#: Share of differing bits up to which two codes are candidates. At cosine 0.98 the expected share is 0.064.
NEAR = 0.14
#: Members of a table's bucket, and vectors of a component, that one group compares; larger ones are cut into blocks.
BUCKET, BLOCK = 4096, 256


def learn_rotations(x: np.ndarray, rotations: int = ROTATIONS, iterations: int = ITERATIONS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and projections onto balanced codes: principal directions, each time rotated from another random start.

    Iterative quantisation: signs of the rotated data are the nearest corners of a cube; the rotation that best brings the
    data to those corners solves a Procrustes problem; repeat.
    """
    mean = x.mean(axis=0)
    centred = x - mean
    _, _, axes = np.linalg.svd(centred.T @ centred)
    axes = axes.T
    data, rng, found = centred @ axes, np.random.default_rng(seed), []
    for _ in range(rotations):
        turn = np.linalg.qr(rng.standard_normal((x.shape[1],) * 2))[0]
        for _ in range(iterations):
            corners = np.where(data @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(corners.T @ data)
            turn = right.T @ left.T
        found.append(axes @ turn)
    return mean, np.concatenate(found, axis=1)


def codes_of(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Codes as rows of whole 16-bit substrings, filled up with zero bits."""
    bits = np.packbits((x - mean) @ projection >= 0, axis=1)
    if bits.shape[1] % 2:
        bits = np.pad(bits, ((0, 0), (0, 1)))
    return np.ascontiguousarray(bits).view(np.uint16)


def _search(codes: np.ndarray, ids: np.ndarray, near) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what `near` connects, at most one a member: a search from each unseen member."""
    left, out = np.arange(len(ids)), []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            k = front.pop()
            hit = near(codes[left], codes[k])
            if hit.any():
                found, left = left[hit], left[~hit]
                out.append((np.full(len(found), ids[k]), ids[found]))
                front.extend(found.tolist())
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows that come sorted by `keys`."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        if not t.num_rows:
            continue
        k = np.stack([t.column(c).to_numpy() for c in keys], 1)
        cut = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1]).tolist()
        for a, b in zip(cut, cut[1:]):
            yield t.slice(a, b - a)
        held = t.slice(cut[-1])
    if held is not None and held.num_rows:
        yield held


def _blocks(rows: DataFrame, key: str, counts: DataFrame, size: int) -> DataFrame:
    """Adds i and j: rows of a key with more than `size` rows are dealt to blocks, and each pair of blocks is a group."""
    blocks = stored(counts.where(F.col("n") > size).select(F.col(key).alias("k"), F.ceil(F.col("n") / size).cast("int").alias("blocks")), "blocks")
    rows = rows.join(blocks, rows[key] == blocks.k, "left")
    other = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("mine", F.coalesce(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.lit(0)))
    rows = rows.withColumn("other", F.explode(other)).withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    return rows.drop("k", "blocks", "other")


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate links within each bucket of a substring table."""
    for g in _groups(batches, ["bucket", "i", "j"]):
        if g.num_rows < 2:
            continue
        raw = np.stack([np.frombuffer(c, np.uint16) for c in g.column("code").to_pylist()])
        most = NEAR * 16 * raw.shape[1]
        near = lambda many, one: np.bitwise_count(many ^ one).sum(axis=1, dtype=np.int64) <= most
        for a, b in _search(raw, g.column("node").to_numpy(), near):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=LINKS)


FOUND = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])


def _reranked(least: float):
    """Exact cosines within each component or pair of its blocks: for each node its sum of linked copies, and links that connect."""

    def run(batches):
        for g in _groups(batches, ["comp", "i", "j"]):
            if g.num_rows < 2:
                continue
            rows = g.column("unit").to_pylist()
            unit = np.zeros((len(rows), max(map(len, rows))))
            for k, u in enumerate(rows):
                unit[k, : len(u)] = u
            node, copies, mine, part = (g.column(c).to_numpy() for c in ("node", "copies", "mine", "part"))
            i, j = g.column("i")[0].as_py(), g.column("j")[0].as_py()
            linked = (unit @ unit.T >= least) & (part[:, None] == part[None, :])
            np.fill_diagonal(linked, False)
            if i != j:
                linked &= mine[:, None] != mine[None, :]
            links = linked @ copies
            to = np.full(len(node), -1, np.int64)
            left = np.ones(len(node), bool)
            for s in range(len(node)):  # one link a member leads to the member it was found from
                if left[s]:
                    left[s], front = False, [s]
                    while front:
                        k = front.pop()
                        hit = np.flatnonzero(linked[k] & left)
                        left[hit], to[hit] = False, node[k]
                        front.extend(hit.tolist())
            keep = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(links[keep]), pa.array(to[keep], mask=to[keep] < 0)], schema=FOUND)

    return run


def near_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row (vec_id, embedding, label).

    Vectors link within equal labels at a cosine of `least` or more, computed in double precision. Rows of equal label and
    vector are one class with a number of copies. Codes of learned rotations go to one table for each 16-bit substring; codes
    that share a bucket and differ in few bits connect to candidate components, to which alone the vectors are sent; every pair
    within is compared exactly. So retrieval can miss a link only between components.

    A null label, and a vector that is null, empty, zero or holds a null or non-finite component, link with nothing (0, own id,
    kept). Vectors of different lengths don't link. Repeated rows count as other vectors of the same id. Null ids stay.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.coalesce(
        F.col("label").isNotNull() & (F.size("v") > 0) & F.exists("v", lambda x: x != 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False),
    )
    # -0.0 and 0.0 are one value; the digest stands for label and vector from here on.
    sig = F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.transform("v", lambda x: (x + F.lit(0.0)).cast("string"))), 256)
    rows = rows.withColumn("sig", F.when(fine, sig))
    classes = rows.where(F.col("sig").isNotNull()).groupBy("sig").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"), F.first("label").alias("label"))
    # Divided by the largest component first: no overflow, whatever the scale.
    classes = classes.withColumn("peak", F.array_max(F.transform("v", F.abs))).withColumn("v", F.expr("transform(v, x -> x / peak)"))
    classes = classes.withColumn("norm", F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + x * x))"))
    classes = classes.select(F.monotonically_increasing_id().alias("node"), "sig", "rep", "copies", F.xxhash64("label", F.size("v")).alias("part"), F.expr("transform(v, x -> x / norm)").alias("unit"))
    classes = stored(classes, "vectors")
    size, n = classes.agg(F.max(F.size("unit")), F.count("*")).first()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    chosen = F.pmod(F.xxhash64("sig", F.lit(3)), F.lit(1_000_000)) < max(1, int(1_000_000 * min(1.0, SAMPLE / n)))
    sample = classes.where(chosen).orderBy("sig").limit(2 * SAMPLE).select("unit").toPandas()["unit"]
    x = np.zeros((max(1, len(sample)), size))
    for k, u in enumerate(sample):
        x[k, : len(u)] = u
    mean, projection = learn_rotations(x)

    def tables(batches):
        schema = pa.schema([("bucket", pa.int64()), ("node", pa.int64()), ("code", pa.binary())])
        for b in slices(batches, 2048):
            v = np.zeros((b.num_rows, size))
            for k, u in enumerate(b.column("unit").to_pylist()):
                v[k, : len(u)] = u
            codes = codes_of(v, mean, projection)
            t = codes.shape[1]
            part = b.column("part").to_numpy(zero_copy_only=False)
            mixed = part[:, None] * np.int64(0x2545F4914F6CDD1D) + (np.arange(t, dtype=np.int64)[None, :] << BITS) + codes
            raw = [c.tobytes() for c in codes]
            yield pa.RecordBatch.from_arrays([pa.array(mixed.ravel()), pa.array(np.repeat(b.column("node").to_numpy(), t)), pa.array([r for r in raw for _ in range(t)], pa.binary())], schema=schema)

    coded = stored(classes.select("node", "part", "unit").mapInArrow(tables, "bucket long, node long, code binary"), "codes")
    cut = _blocks(coded, "bucket", coded.groupBy("bucket").agg(F.count("*").alias("n")), BUCKET).select("bucket", "i", "j", "node", "code")
    cut = cut.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    comps = connected(cut.mapInArrow(_candidates, "a long, b long")).select(F.col("node").alias("x"), F.col("root").alias("comp"))
    comps = stored(comps, "candidates")
    sent = classes.join(comps, classes.node == comps.x).select("comp", "node", "copies", "part", "unit")
    sent = _blocks(sent, "comp", comps.groupBy("comp").agg(F.count("*").alias("n")), BLOCK).select("comp", "i", "j", "node", "copies", "mine", "part", "unit")
    sent = sent.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    found = stored(sent.mapInArrow(_reranked(least), "node long, links long, to long"), "found")
    links = found.groupBy(F.col("node").alias("y")).agg(F.sum("links").alias("links"))
    roots = connected(found.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b"))).select(F.col("node").alias("x"), "root")
    known = classes.select("node", "sig", "rep", "copies").join(links, F.col("node") == F.col("y"), "left").join(roots, F.col("node") == F.col("x"), "left")
    known = stored(known.select("sig", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "linked")
    least_id = stored(known.groupBy(F.col("root").alias("r")).agg(F.min("rep").alias("component_id")), "component")
    named = stored(known.join(least_id, F.col("root") == F.col("r")).select(F.col("sig").alias("s"), "n_links", "component_id"), "named")
    out = rows.select("vec_id", "sig").join(named, F.col("sig") == F.col("s"), "left")
    component = F.when(F.col("s").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
