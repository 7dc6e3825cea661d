"""Exact top-k inner products: blocks of documents, ordered for each query by their summed term maxima, scored until none can still enter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored

#: Vectors (at most) that the order of documents is learned from, and levels of its tree.
SAMPLE, DEPTH = 8192, 9
#: Documents of a block and (expected) of a shard, summaries of a page, and queries that meet one copy of a shard or a page.
BLOCK, SHARD, PAGE, PART = 64, 32_768, 4096, 65_536
#: Queries that one round scores at a time.
ROUND = 512
#: Integers below which sums are exact in single and in double precision.
SINGLE, DOUBLE = float(1 << 24), float(1 << 53)
LONGEST = (1 << 63) - 1


def learn_order(x: np.ndarray, depth: int = DEPTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level of a tree the directions and medians that halve its nodes: alike vectors end in one leaf."""
    at, levels = np.zeros(len(x), np.int64), []
    for level in range(depth):
        ways, cuts = np.zeros((1 << level, x.shape[1])), np.zeros(1 << level)
        for node in range(1 << level):
            own = x[at == node]
            if len(own) > 1:
                ways[node] = np.linalg.eigh(np.cov(own.T, bias=True).reshape(x.shape[1], -1))[1][:, -1]
                cuts[node] = np.median(own @ ways[node])
        levels.append((ways, cuts))
        at = 2 * at + (np.einsum("ij,ij->i", x, ways[at]) > cuts[at])
    return levels


def places(x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Leaf of each vector, and its place along the last direction."""
    at, along = np.zeros(len(x), np.int64), np.zeros(len(x))
    for ways, cuts in levels:
        along = np.einsum("ij,ij->i", x, ways[at])
        at = 2 * at + (along > cuts[at])
    return at, along


def matrix(rows: list, size: int = 0) -> np.ndarray:
    """Vectors as rows; what a shorter one lacks is zero."""
    out = np.zeros((len(rows), max([size, *map(len, rows)])))
    for k, r in enumerate(rows):
        out[k, :len(r)] = r
    return out


def quantised(rows: list) -> np.ndarray:
    """floor(256 x) of every component, as whole doubles."""
    return np.floor(256.0 * matrix(rows)) + 0.0


def packed(x: np.ndarray) -> bytes:
    """Whole numbers in single precision where that holds them exactly."""
    return np.ascontiguousarray(x, "<f4" if np.abs(x).max(initial=0.0) < SINGLE else "<f8").tobytes()


def unpacked(raw: bytes, rows: int, size: int) -> np.ndarray:
    return np.frombuffer(raw, "<f4" if len(raw) == 4 * rows * size else "<f8").reshape(rows, size) if raw else np.zeros((rows, size))


def wide(x: np.ndarray, size: int) -> np.ndarray:
    return x if x.shape[1] >= size else np.pad(x, ((0, 0), (0, size - x.shape[1])))


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers; what passes their range stays at its end."""
    size = max(q.shape[1], v.shape[1])
    q, v = wide(q, size), wide(v, size)
    most = float(np.abs(q).sum(axis=1).max(initial=0.0)) * float(np.abs(v).max(initial=0.0))
    if most < SINGLE:
        return (q.astype("<f4", copy=False) @ v.astype("<f4", copy=False).T).astype(np.int64)
    if most < DOUBLE:
        return (q.astype("<f8") @ v.astype("<f8").T).astype(np.int64)
    whole = lambda x: np.array([[int(c) for c in r] for r in x], object).reshape(x.shape)
    return np.clip(whole(q) @ whole(v).T, -LONGEST, LONGEST).astype(np.int64)


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Summed term maxima: no document of a block scores higher. Rounding can only raise them."""
    size = max(q.shape[1], high.shape[1])
    q, high, low = (wide(x, size).astype("<f8") for x in (q, high, low))
    with np.errstate(over="ignore", invalid="ignore"):  # a bound beyond all doubles is none
        most = np.abs(q).sum(axis=1)[:, None] * np.maximum(np.abs(high), np.abs(low)).max(axis=1, initial=0.0)[None, :]
        out = np.maximum(q, 0.0) @ high.T + np.minimum(q, 0.0) @ low.T + np.where(most < DOUBLE, 0.0, 1e-9 * most)
    return np.where(np.isnan(out), np.inf, np.maximum(out, -float(LONGEST)))


class Best:
    """The k highest (score, id) of each query so far, and the score that a block must reach."""

    def __init__(self, queries: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.query, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.queries = queries

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        self.new.append((query, score, doc))

    def settle(self, order: np.ndarray) -> None:
        """Keep the k best; `order` ranks documents by id."""
        if not self.new:
            return
        q, s, d = (np.concatenate([x, *new]) for x, new in zip((self.query, self.score, self.doc), zip(*self.new)))
        by = np.lexsort((order[d], -s, q))
        q, s, d = q[by], s[by], d[by]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        self.query, self.score, self.doc = (x[rank < self.k] for x in (q, s, d))
        last = rank == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], s[last])
        self.new = []


class Shard:
    """A range of documents as blocks: term maxima and minima, and a forward index of whole vectors for each."""

    def __init__(self, blocks: list[dict]):
        self.ids = [np.frombuffer(b["ids"], "<i8") for b in blocks]
        self.none = [np.frombuffer(b["none"], "?") for b in blocks]
        self.forward = [unpacked(b["forward"], b["rows"], b["size"]) for b in blocks]
        size = max(b["size"] for b in blocks)
        self.high = np.concatenate([wide(unpacked(b["high"], 1, b["size"]), size) for b in blocks]).astype("<f8")
        self.low = np.concatenate([wide(unpacked(b["low"], 1, b["size"]), size) for b in blocks]).astype("<f8")
        self.first = np.concatenate([[0], np.cumsum([len(i) for i in self.ids])])
        every, none = np.concatenate(self.ids), np.concatenate(self.none)
        self.every, self.every_none, self.order = every, none, np.empty(len(every), np.int64)
        self.order[np.lexsort((every, none))] = np.arange(len(every))

    def search(self, q: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> tuple[Best, int]:
        """The best of each query (vectors `q`, ids `own`) that reach `least`, and how many pairs of query and block were scored.

        Blocks are taken in the order of their bounds, one, then twice as many as before, until the next bound of a query is
        below its k-th score. A block may hold an equal score of smaller id, so an equal bound is still looked at.
        """
        limit = bounds(q, self.high, self.low)
        order = np.argsort(-limit, axis=1, kind="stable")
        sorted_limit = np.take_along_axis(limit, order, axis=1)
        best, done, step, scored = Best(len(q), k, least), 0, 1, 0
        while done < len(self.ids):
            at = slice(done, done + step)
            wanted = sorted_limit[:, at] >= best.least[:, None]
            if not wanted.any():
                break
            who, which = np.nonzero(wanted)
            block = order[:, at][who, which]
            by = np.argsort(block, kind="stable")
            who, block = who[by], block[by]
            cuts = np.flatnonzero(np.diff(block, prepend=-1, append=-1)).tolist()
            for a, b in zip(cuts, cuts[1:]):
                k0, some = int(block[a]), who[a:b]
                score = products(q[some], self.forward[k0])
                keep = (score >= best.least[some][:, None]) & ((self.ids[k0][None, :] != own[some][:, None]) | self.none[k0][None, :])
                x, y = np.nonzero(keep)
                best.add(some[x], score[x, y], y + self.first[k0])
            scored += len(who)
            best.settle(self.order)
            done, step = done + step, 2 * step
        return best, scored


BLOCKS = "shard long, block int, rows int, size int, ids binary, none binary, forward binary, high binary, low binary, middle binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Block rows of one partition, whose rows come in order of place."""
    shard, number, held = TaskContext.get().partitionId(), 0, None

    def made(t: pa.Table) -> list:
        v = quantised(t.column("e").to_pylist())
        ids = t.column("vec_id")
        return [
            shard, number, len(v), v.shape[1], ids.fill_null(0).to_numpy().astype("<i8").tobytes(), ids.is_null().to_numpy().tobytes(), packed(v),
            packed(v.max(axis=0)), packed(v.min(axis=0)), packed(np.floor(v.mean(axis=0))),
        ]

    schema = pa.schema([("shard", pa.int64()), ("block", pa.int32()), ("rows", pa.int32()), ("size", pa.int32()), *((n, pa.binary()) for n in ("ids", "none", "forward", "high", "low", "middle"))])
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        rows, whole = [], t.num_rows - t.num_rows % BLOCK
        for a in range(0, whole, BLOCK):
            rows.append(made(t.slice(a, BLOCK)))
            number += 1
        held = t.slice(whole)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    if held is not None and held.num_rows:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(made(held), schema)], schema=schema)


def finite(e: Column) -> Column:
    return F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * 256) < float("inf"))), F.lit(False))


def build_index(rows: DataFrame, copies: int) -> DataFrame:
    """Block rows of all documents (vec_id, e): ordered by a tree learned on a bounded sample, then cut into ranges.

    Of equal vectors the `copies` smallest ids are kept: no query can have use for more of them.
    """
    rank = F.row_number().over(Window.partitionBy("e").orderBy(F.col("vec_id").asc_nulls_last()))
    rows = stored(rows.withColumn("_n", rank).where(F.col("_n") <= copies).drop("_n"), "vectors")
    n, size = rows.agg(F.count("*"), F.max(F.size("e"))).first()
    chosen = F.pmod(F.xxhash64("vec_id", "e"), F.lit(1_000_000)) < max(1, int(1_000_000 * min(1.0, SAMPLE / max(n, 1))))
    sample = matrix(rows.where(chosen).limit(2 * SAMPLE).select("e").toPandas()["e"].tolist(), size or 0)
    peak = np.abs(sample).max(initial=1e-300)
    levels = learn_order(sample / peak, max(0, min(DEPTH, len(sample).bit_length() - 3))) if size else []

    def placed(batches):
        schema = pa.schema([("vec_id", pa.int64()), ("e", pa.list_(pa.float64())), ("leaf", pa.int64()), ("along", pa.float64())])
        for b in slices(batches, 4096):
            leaf, along = places(matrix(b.column("e").to_pylist(), size)[:, :size] / peak, levels)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("e"), pa.array(leaf), pa.array(along)], schema=schema)

    ordered = rows.mapInArrow(placed, "vec_id long, e array<double>, leaf long, along double")
    ordered = ordered.repartitionByRange(-(-max(n, 1) // SHARD), "leaf", "along", "vec_id").sortWithinPartitions("leaf", "along", "vec_id")
    return stored(ordered.mapInArrow(_blocks, BLOCKS), "blocks")


def _met(batches: Iterator[pa.RecordBatch], make: Callable, use: Callable) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (at, part, kind): the items of a key (kind 0) are held, its queries (kind 1) stream past them."""
    key, items, made = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy() for c in ("at", "part", "kind")], 1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
        for a, b in zip(cuts, cuts[1:]):
            if key != (own := (k[a, 0], k[a, 1])):
                key, items, made = own, [], None
            run = batch.slice(a, b - a)
            if k[a, 2] == 0:
                items += run.column("item").to_pylist()
                continue
            if not items:
                continue
            made = make(items) if made is None else made
            for c in range(0, run.num_rows, ROUND):
                yield use(made, run.slice(c, ROUND).column("query").to_pylist())


def meet(items: DataFrame, queries: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Bring the items (at, item) and the queries (at, query) of a key together; a key with many queries is dealt to parts, each
    with the items of the key."""
    queries = stored(queries, "asked")
    parts = queries.groupBy(F.col("at").alias("to")).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    parts = stored(parts, "parts")
    left = items.join(parts, F.col("at") == F.col("to")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = queries.join(parts, F.col("at") == F.col("to")).withColumn("part", F.pmod(F.xxhash64("query.q"), F.col("parts")).cast("int"))
    left = left.select("at", "part", F.lit(0).alias("kind"), "item", F.lit(None).cast(queries.schema["query"].dataType).alias("query"))
    right = right.select("at", "part", F.lit(1).alias("kind"), F.lit(None).cast(items.schema["item"].dataType).alias("item"), "query")
    both = left.unionByName(right).repartition("at", "part").sortWithinPartitions("at", "part", "kind")
    return both.mapInArrow(run, schema)


class Summaries:
    """Bounds and middles of whole shards."""

    def __init__(self, rows: list[dict]):
        size = max(r["size"] for r in rows)
        self.shards = np.array([r["shard"] for r in rows])
        self.high, self.low, self.middle = (np.concatenate([wide(unpacked(r[c], 1, r["size"]), size) for r in rows]).astype("<f8") for c in ("high", "low", "middle"))


def _vectors(queries: list[dict]) -> np.ndarray:
    return quantised([x["e"] for x in queries])


def _nearest(batches):
    """For each query the shard whose middle scores highest."""
    schema = pa.schema([("q", pa.int64()), ("near", pa.int64()), ("score", pa.float64())])

    def use(s: Summaries, queries: list[dict]) -> pa.RecordBatch:
        v = _vectors(queries)
        size = max(v.shape[1], s.middle.shape[1])
        score = wide(v, size) @ wide(s.middle, size).T
        top = score.argmax(axis=1)
        return pa.RecordBatch.from_arrays([pa.array([x["q"] for x in queries]), pa.array(s.shards[top]), pa.array(score[np.arange(len(top)), top])], schema=schema)

    yield from _met(batches, Summaries, use)


def _reaching(batches):
    """Pairs of query and shard whose bound reaches the query's k-th score, without the shard searched first."""
    schema = pa.schema([("q", pa.int64()), ("to", pa.int64())])

    def use(s: Summaries, queries: list[dict]) -> pa.RecordBatch:
        keep = bounds(_vectors(queries), s.high, s.low) >= np.array([x["least"] for x in queries])[:, None]
        keep &= s.shards[None, :] != np.array([x["near"] for x in queries])[:, None]
        a, b = np.nonzero(keep)
        q = np.array([x["q"] for x in queries])
        return pa.RecordBatch.from_arrays([pa.array(q[a]), pa.array(s.shards[b])], schema=schema)

    yield from _met(batches, Summaries, use)


FOUND = "q long, query_id long, vec_id long, score long"


def _searched(k: int):
    schema = pa.schema([(n, pa.int64()) for n in ("q", "query_id", "vec_id", "score")])

    def use(s: Shard, queries: list[dict]) -> pa.RecordBatch:
        own = np.array([x["vec_id"] for x in queries], np.int64)
        best, _ = s.search(_vectors(queries), own, np.array([x["least"] for x in queries], np.int64), k)
        q = np.array([x["q"] for x in queries], np.int64)
        docs = pa.array(s.every[best.doc], mask=s.every_none[best.doc])
        return pa.RecordBatch.from_arrays([pa.array(q[best.query]), pa.array(own[best.query]), docs, pa.array(best.score)], schema=schema)

    def run(batches):
        yield from _met(batches, Shard, use)

    return run


def top_inner_products(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, the k rows of other ids (vec_id,
    embedding) with the highest integer inner products of floor(256 x), ties to the smaller id.

    Vectors are ordered by likeness and cut into blocks, blocks into shards. A query first searches the shard whose middle is
    nearest; its k-th score there decides which other shards it is sent to at all, by their summed term maxima; in each shard
    blocks are scored in the order of their bounds until these fall below the k-th score. So results are exact, and a shard's
    vectors travel once, however many queries meet them.

    Vectors that are null or hold a null or non-finite component (256 x included) take no part; an empty one scores zero.
    Components that a shorter vector lacks are zero. Rows of equal id and vector count once; rows of one id with other vectors
    are each a query, and never candidates for each other. Rows without an id are candidates, after all others at equal score.
    Scores beyond 64 bits stay at the end of the range. An empty table, or one without such ids, gives no rows.
    """
    e = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("e")).where(finite(F.col("e"))).distinct()
    rows = stored(rows, "rows")
    blocks = build_index(rows, k + 1)
    asked = rows.where(F.col("vec_id") % every == 0).select(F.monotonically_increasing_id().alias("q"), "vec_id", "e")
    asked = stored(asked, "queries")

    parts = blocks.groupBy("shard").agg(F.max("size").alias("size"), *(F.collect_list(F.struct("size", c)).alias(c) for c in ("high", "low", "middle")))
    summaries = stored(parts.mapInArrow(_summed, "shard long, size int, high binary, low binary, middle binary"), "summaries")
    page = F.col("shard") - F.col("shard") % PAGE
    pages = summaries.select(page.alias("at"), F.struct("shard", "size", "high", "low", "middle").alias("item"))
    last = blocks.agg(F.max("shard")).first()[0] or 0
    every_page = F.explode(F.sequence(*(F.lit(x).cast("long") for x in (0, last, PAGE))))
    at_pages = lambda q, *more: q.select(every_page.alias("at"), F.struct("q", "e", *more).alias("query"))
    near = meet(pages, at_pages(asked), _nearest, "q long, near long, score double")
    near = near.groupBy(F.col("q").alias("of")).agg(F.max_by("near", "score").alias("near"))
    asked = stored(asked.join(near, F.col("q") == F.col("of")).drop("of"), "queries")
    shards = blocks.select(F.col("shard").alias("at"), F.struct("rows", "size", "ids", "none", "forward", "high", "low").alias("item"))
    question = lambda least: F.struct("q", "vec_id", "e", least.alias("least")).alias("query")
    none = F.lit(-LONGEST)
    first = stored(meet(shards, asked.select(F.col("near").alias("at"), question(none)), _searched(k), FOUND), "first")
    kth = first.groupBy(F.col("q").alias("of")).agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    asked = stored(asked.join(kth, F.col("q") == F.col("of"), "left").withColumn("least", F.coalesce("kth", none)).drop("of", "kth"), "queries")
    pairs = stored(meet(pages, at_pages(asked, "least", "near"), _reaching, "q long, to long"), "pairs")
    pairs = pairs.withColumnRenamed("q", "of").join(asked, F.col("of") == F.col("q"))
    rest = meet(shards, pairs.select(F.col("to").alias("at"), question(F.col("least"))), _searched(k), FOUND)
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bounds and middle of each shard from those of its blocks."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            high, low, middle = (np.concatenate([wide(unpacked(x[c], 1, x["size"]), row["size"]) for x in row[c]]).astype("<f8") for c in ("high", "low", "middle"))
            out.append([row["shard"], row["size"], packed(high.max(axis=0)), packed(low.min(axis=0)), packed(np.floor(middle.mean(axis=0)))])
        names = [("shard", pa.int64()), ("size", pa.int32()), ("high", pa.binary()), ("low", pa.binary()), ("middle", pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), names)], names=[n for n, _ in names])
