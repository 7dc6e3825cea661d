"""SimHash near-duplicates found with fuzzy keys from the perfect Golay code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected, slices, stored

#: Members of a bucket that one group compares; a larger bucket is cut into blocks, and each pair of blocks is a group.
BLOCK = 4096
#: Up to this many members a bucket is compared shift by shift; beyond, by search from each member in turn.
SHIFTED = 64
#: Bits of the three segments of a fingerprint, and the pairs of segments whose keys are joined.
SEGMENTS, PAIRS = (21, 21, 22), ((0, 1), (0, 2), (1, 2))
#: Fixed value: generator polynomial of the [23, 12, 7] Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def fingerprint(text: str, size: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all shingles; 0 for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - size + 1].tolist()
    ends = (ends[size - 1:] - 1).tolist()
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 8192):  # very long texts a part at a time
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at:at + 8192], ends[at:at + 8192])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * ones > n).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, size: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for every row. Null text is a text without words."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in slices(batches):
            fp = np.array([fingerprint(t or "", size, seed) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], schema=schema)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, fp long")


def _remainder(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for bit in range(22, 10, -1):
        x ^= np.where(x >> bit & 1, GENERATOR << (bit - 11), 0)
    return x


def golay_errors() -> np.ndarray:
    """For each syndrome the error patterns of at most four bits: 1 or 6 of them, -1 where there is none.

    The code is perfect, so one pattern has up to three bits. If it has three, the five patterns of four bits and it part the
    23 positions between them. Hence two words that differ in at most two bits have a codeword in common within four bits.
    """
    from itertools import combinations

    table, filled = np.full((2048, 6), -1, np.int64), np.zeros(2048, np.int64)
    for weight in range(5):
        patterns = np.array([sum(1 << i for i in c) for c in combinations(range(23), weight)], np.int64)
        for s, e in zip(_remainder(patterns).tolist(), patterns.tolist()):
            table[s, filled[s]] = e
            filled[s] += 1
    return table


_TABLES: list = []


def _codewords(words: np.ndarray) -> np.ndarray:
    """Up to six 12-bit indices of the codewords within four bits of each 23-bit word, else -1."""
    if not _TABLES:
        _TABLES.append(golay_errors())
    errors = _TABLES[0][_remainder(words)]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints and the row of each: pairs of Golay indices of two of three segments.

    Four differing bits leave two segments with at most two each (pigeonhole), and those share an index each.
    """
    u, at, index = fp.view(np.uint64), 0, []
    for bits in SEGMENTS:
        index.append(_codewords(((u >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64)))
        at += bits
    keys, rows = [], []
    for p, (a, b) in enumerate(PAIRS):
        both = (np.int64(p) << 24) | (index[a][:, :, None] << 12) | index[b][:, None, :]
        both = np.where((index[a][:, :, None] < 0) | (index[b][:, None, :] < 0), -1, both).reshape(len(fp), -1)
        row, col = np.nonzero(both >= 0)
        keys.append(both[row, col])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 4096):
        fp = b.column("fp").to_numpy(zero_copy_only=False)
        key, row = fuzzy_keys(fp)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], names=["key", "fp"])


def _near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= most


def group_links(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected within one group, at most one for each member: a search from each unseen one."""
    left, a, b = fp, [], []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            hit = _near(left, x, most)
            if hit.any():
                found, left = left[hit], left[~hit]
                a.append(np.full(len(found), x))
                b.append(found)
                front.extend(found.tolist())
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _link_rows(most: int):
    """Links within groups that come sorted by group; holds one group of at most about two blocks at a time."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(group: np.ndarray, fp: np.ndarray):
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.concatenate([start, [len(group)]]))
        a, b = [], []
        small = np.repeat(size <= SHIFTED, size)
        left = (np.repeat(start + size, size) - np.arange(len(group)))[small]  # members of the group from here on
        at, shift = np.flatnonzero(small), 1
        while len(at := at[left > shift]):
            left = left[left > shift]
            hit = _near(fp[at], fp[at + shift], most)
            a.append(fp[at[hit]])
            b.append(fp[at[hit] + shift])
            shift += 1
        for s, n in zip(start[size > SHIFTED], size[size > SHIFTED]):
            x, y = group_links(fp[s:s + n], most)
            a.append(x)
            b.append(y)
        if a:
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    def run(batches):
        held_g, held_f = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
        for batch in batches:
            g = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "i", "j")], 1)
            held_g, held_f = np.concatenate([held_g, g]), np.concatenate([held_f, batch.column("fp").to_numpy(zero_copy_only=False)])
            cut = np.flatnonzero((held_g != held_g[-1]).any(axis=1)) if len(held_g) else []
            if len(cut):
                k = int(cut[-1]) + 1
                yield from linked(_ids(held_g[:k]), held_f[:k])
                held_g, held_f = held_g[k:], held_f[k:]
        if len(held_g):
            yield from linked(_ids(held_g), held_f)

    return run


def _ids(rows: np.ndarray) -> np.ndarray:
    """A number for each run of equal rows."""
    return np.concatenate([[0], np.cumsum((rows[1:] != rows[:-1]).any(axis=1))])


def near_links(classes: DataFrame, most: int = 4) -> DataFrame:
    """Links (a, b) between different fingerprints `fp` that connect all at `most` (four or less) differing bits."""
    if most > 4:
        raise ValueError("three segments of two errors each cover at most four differing bits")
    keys = stored(classes.select("fp").mapInArrow(_key_rows, "key long, fp long"), "keys")
    hot = keys.groupBy("key").count().where(F.col("count") > BLOCK)
    hot = stored(hot.select(F.col("key").alias("hot"), F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "hot-keys")
    split = keys.join(hot, keys.key == hot.hot, "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = split.withColumn("mine", F.coalesce(mine, F.lit(0))).withColumn("other", other)
    split = split.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")
    grouped = split.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    return grouped.mapInArrow(_link_rows(most), "a long, b long")


def simhash_groups(docs: DataFrame, size: int = 4, most: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row: fingerprints link at `most` or fewer differing bits.

    Equal fingerprints are one class, so exact copies cost one row after a map-side combined group. Null, empty and blank
    texts have fingerprint zero and link like any other. Repeated rows stay; component_id is the smallest doc_id reachable
    (null ids don't count, unless there is no other). An empty table gives no rows; other columns are ignored.
    """
    fps = stored(fingerprints(docs, size, seed), "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    roots = connected(near_links(classes, most))
    joined = classes.join(roots, classes.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    joined = stored(joined, "rooted")
    least = stored(joined.groupBy(F.col("root").alias("r")).agg(F.min("rep").alias("component_id")), "component")
    named = stored(joined.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id"), "named")
    out = fps.join(named, fps.fp == named.f, "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, size: int = 4, most: int = 4, seed: int = 42) -> DataFrame:
    """The rows of `docs`, whole, of which each group keeps exactly one: that of the smallest id, then of the least hash of text.

    Rows are named by id and text, so rows of equal id but other text are judged apart. Rows without an id are compared like
    any other and stay only where their group has no id. Of rows that repeat id and text, the least by all columns stays.
    Columns of any name are carried along.
    """
    named = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["text"].cast("string")).alias("h"))
    schema = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in slices(batches):
            fp = np.array([fingerprint(t or "", size, seed) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("h"), pa.array(fp)], schema=schema)

    fps = named.select("id", "h", F.col("row.text").cast("string").alias("text")).mapInArrow(run, "id long, h long, fp long")
    fps = stored(fps.groupBy("id", "h", "fp").agg((F.count("*") > 1).alias("several")), "fingerprints")
    rep = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "h", "several")).alias("rep")
    classes = stored(fps.groupBy("fp").agg(rep), "classes")
    roots = connected(near_links(classes, most))
    joined = classes.join(roots, classes.fp == roots.node, "left").select(F.coalesce("root", "fp").alias("root"), "rep")
    kept = joined.groupBy("root").agg(F.min("rep").alias("rep"))
    kept = stored(kept.select(F.col("rep.id").alias("kept"), F.col("rep.h").alias("kept_h"), F.col("rep.several").alias("several")), "kept")
    found = named.join(kept, F.col("id").eqNullSafe(F.col("kept")) & (F.col("h") == F.col("kept_h")))
    single, more = found.where("not several").select("row"), found.where("several")
    more = more.groupBy("id", "h").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return single.unionByName(more).select("row.*")
