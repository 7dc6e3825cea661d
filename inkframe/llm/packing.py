"""Best-fit packing by a grouping genetic algorithm on islands."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import slices, stored

#: Pieces that one island packs at a time (expected), islands of a pool, packings of an island, generations between migrations.
POOL, ISLANDS, POPULATION, GENERATIONS, EPOCHS = 16_384, 2, 3, 6, 2
#: Share of a sequence that may stay empty in a bin that is kept; bins below go to the next, smaller round of pools.
WASTE = 1 / 256


class Bins:
    """Open space of bins by exact gap: one bit for each gap that some bin has, so that best fit is one shift."""

    def __init__(self, capacity: int, gaps: np.ndarray):
        self.capacity, self.at, self.mask, self.gaps = capacity, {}, 0, gaps.tolist()
        for k, g in enumerate(self.gaps):
            self.at.setdefault(g, []).append(k)
        for g in self.at:
            self.mask |= 1 << g

    def best_fit(self, length: int) -> int:
        """The fullest bin that takes `length`, or a new one."""
        left = self.mask >> length
        if left:
            gap = length + (left & -left).bit_length() - 1
            k = self.at[gap].pop()
            if not self.at[gap]:
                self.mask ^= 1 << gap
        else:
            gap, k = self.capacity, len(self.gaps)
            self.gaps.append(gap)
        gap -= length
        self.gaps[k] = gap
        self.at.setdefault(gap, []).append(k)
        self.mask |= 1 << gap
        return k


def refit(lens: np.ndarray, bins: np.ndarray, loose: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    """Keep the bins of pieces that aren't `loose`, and best-fit the loose ones in the given order."""
    out = np.full(len(lens), -1, np.int64)
    held = np.flatnonzero(~loose)
    names, out[held] = np.unique(bins[held], return_inverse=True)
    room = Bins(capacity, capacity - np.bincount(out[held], lens[held], len(names)).astype(np.int64))
    for i in order:
        out[i] = room.best_fit(int(lens[i]))
    return out


def fitness(lens: np.ndarray, bins: np.ndarray, capacity: int) -> float:
    """Falkenauer's: the mean squared fill of the bins, so one full and one empty bin beat two halves."""
    fill = np.bincount(bins, lens) / capacity
    fill = fill[fill > 0]
    return float((fill * fill).mean()) if len(fill) else 1.0


def decreasing(lens: np.ndarray, among: np.ndarray, rng: np.random.Generator, noise: float = 0.0) -> np.ndarray:
    return among[np.argsort(-lens[among] * (1 + noise * rng.random(len(among))), kind="stable")]


def crossover(lens: np.ndarray, one: np.ndarray, other: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Inject well-filled bins of `other` whole, dissolve bins of `one` that hold a piece of them, best-fit the displaced."""
    fill = np.bincount(other, lens)
    chosen = (fill >= np.median(fill[fill > 0])) & (rng.random(len(fill)) < 0.5)
    injected = chosen[other]
    touched = np.zeros(one.max() + 1, bool)
    touched[one[injected]] = True
    loose = touched[one] & ~injected
    mixed = np.where(injected, one.max() + 1 + other, one)
    return refit(lens, mixed, loose, decreasing(lens, np.flatnonzero(loose), rng), capacity)


def mutate(lens: np.ndarray, bins: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Dissolve the emptiest bins and a few others, and best-fit their pieces anew."""
    fill = np.bincount(bins, lens).astype(float)
    open_ = np.flatnonzero((fill > 0) & (fill < capacity))
    if not len(open_):
        return bins
    worst = open_[np.argsort(fill[open_])[: max(2, len(open_) // 10)]]
    gone = np.zeros(len(fill), bool)
    gone[worst] = True
    gone[rng.integers(0, len(fill), max(2, len(fill) // 50))] = True
    loose = gone[bins]
    return refit(lens, bins, loose, decreasing(lens, np.flatnonzero(loose), rng, 0.1), capacity)


def evolve(lens: np.ndarray, guests: list[np.ndarray], capacity: int, seed: int, generations: int = GENERATIONS) -> np.ndarray:
    """The best packing of one island after some generations. `guests`: packings that came from other islands."""
    rng = np.random.default_rng(seed)
    everything, none = np.ones(len(lens), bool), np.zeros(len(lens), np.int64)
    people = [np.asarray(g, np.int64) for g in guests]
    while len(people) < POPULATION:
        people.append(refit(lens, none, everything, decreasing(lens, np.arange(len(lens)), rng, 0.0 if not people else 0.15), capacity))
    least = -(-int(lens.sum()) // capacity)
    people.sort(key=lambda b: -fitness(lens, b, capacity))
    for _ in range(generations):
        if people[0].max() + 1 <= least:
            break
        a, b = rng.choice(len(people), 2, replace=False) if len(people) > 1 else (0, 0)
        child = mutate(lens, crossover(lens, people[min(a, b)], people[max(a, b)], capacity, rng), capacity, rng)
        people = sorted([*people, child], key=lambda x: -fitness(lens, x, capacity))[:POPULATION]
    return people[0]


def _evolve_rows(capacity: int, epoch: int):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                lens = np.array(row["lens"], np.int64)
                guests = [g["bins"] for g in row["guests"] or [] if g["bins"] is not None]
                best = evolve(lens, guests, capacity, row["pool"] * 1000 + row["island"] * 10 + epoch)
                yield pa.RecordBatch.from_pydict(
                    {"pool": [row["pool"]], "island": [row["island"]], "score": [fitness(lens, best, capacity)], "bins": [best.tolist()]},
                    schema=pa.schema([("pool", pa.int64()), ("island", pa.int32()), ("score", pa.float64()), ("bins", pa.list_(pa.int32()))]),
                )

    return run


def pack_pools(items: DataFrame, pools: int, capacity: int) -> DataFrame:
    """One round: uid, length, bin (smallest uid in it), fill. Pieces are dealt to pools by hash; islands are tasks.

    Between the epochs each island gets the best packing of its own and of the island before it in its ring.
    """
    dealt = items.withColumn("pool", F.pmod(F.xxhash64(F.lit(pools), "uid"), F.lit(pools)))
    pool = dealt.groupBy("pool").agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("x"))
    pool = stored(pool.select("pool", F.col("x.uid").alias("uids"), F.col("x.length").alias("lens")), "pools")
    ring = pool.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    shape, elite = "pool long, island int, score double, bins array<int>", None
    for epoch in range(EPOCHS):
        ready = ring.select("pool", "island", "lens")
        if elite is None:
            ready = ready.withColumn("guests", F.lit(None).cast("array<struct<bins:array<int>>>"))
        else:
            moved = elite.select("pool", F.explode(F.array("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))).alias("island"), "score", "bins")
            moved = moved.groupBy("pool", "island").agg(F.collect_list(F.struct("bins")).alias("guests"))
            ready = ready.join(moved, ["pool", "island"], "left")
        ready = ready.repartition("pool", "island").select("pool", "island", "lens", "guests")
        elite = stored(ready.mapInArrow(_evolve_rows(capacity, epoch), shape), "elite")
    best = elite.groupBy("pool").agg(F.max_by("bins", F.struct("score", "island")).alias("bins"))
    each = pool.join(best, "pool").select("pool", F.explode(F.arrays_zip("uids", "lens", "bins")).alias("x"))
    each = each.select("pool", F.col("x.uids").alias("uid"), F.col("x.lens").alias("length"), F.col("x.bins").alias("b"))
    w = Window.partitionBy("pool", "b")  # at most `capacity` pieces
    return each.select("uid", "length", F.min("uid").over(w).alias("bin"), F.sum("length").over(w).alias("fill"))


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """uid, bin for items (uid, length), lengths from 1 to `capacity`, in as few bins as found.

    Pools of bounded size evolve apart; well-filled bins stay and the pieces of the others meet again in fewer pools, until
    one pool is left or the number of pieces no longer halves. The last round keeps everything.
    """
    kept, n = None, items.count()
    while True:
        pools = max(1, round(n / POOL))
        done = stored(pack_pools(items, pools, capacity), "packed")
        well = F.col("fill") >= capacity * (1 - WASTE)
        left = 0 if pools == 1 else done.where(~well).count()
        last = pools == 1 or left == 0 or left > 0.5 * n
        now = (done if last else done.where(well)).select("uid", "bin")
        kept = now if kept is None else kept.unionByName(now)
        if last:
            return kept
        items, n = done.where(~well).select("uid", "length"), left


PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of at most `capacity` ids of every document; the first is the shorter one. uid tells rows apart."""
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        uid = TaskContext.get().partitionId() << 40
        for b in slices(batches):
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = memoryview(enc.ids(text or "") + end)
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    size = (n % capacity or capacity) if at == 0 else capacity
                    rows.append((uid, doc_id, k, at, size, zlib.crc32(ids[4 * at:4 * (at + size)])))
                    uid, at, k = uid + 1, at + size, k + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(docs.mapInArrow(run, PIECES), "pieces")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: all documents packed into sequences.

    Null or empty text is the end id alone. Repeated rows and null doc_ids are packed as documents of their own. A piece of
    full length is its own sequence. Sequence ids are any numbers; offsets run from 0 without gaps in uid order. A text of any
    length is cut into as many pieces as it needs, all full but the first. An empty table gives no rows.
    """
    pieces = token_pieces(docs, path, capacity, end_id)
    bins = stored(pack(pieces.where(F.col("length") < capacity).select("uid", "length"), capacity), "bins")
    full = pieces.where(F.col("length") == capacity).withColumn("bin", F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.where(F.col("length") < capacity).join(bins, "uid")
    before = Window.partitionBy("bin").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)  # at most `capacity` pieces
    rest = rest.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    out = ["doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset"]
    return full.select(out).unionByName(rest.select(out))
