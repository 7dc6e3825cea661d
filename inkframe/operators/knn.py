"""Nearest exemplars, never from the query's own event, and the votes over them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import SHIFTS, moved, ready, unit
from ..session import cut_lineage
from ..sources import snapshots
from .ordered import dealt, first_n

POOL, K = 25, 5
# Rows that a classifier keeps to compare with; a shipped model has some 3,300.
EXEMPLARS = 4096
# Samples that are prepared and compared at a time: what a task holds doesn't depend on how many a batch has.
BLOCK = 128
# Where exemplars have no bound: values (of prepared samples) that a task holds, and exemplars that these meet at a time.
HELD, TILE = 1 << 22, 4096


def chosen_exemplars(samples: DataFrame, limit: int = EXEMPLARS) -> DataFrame:
    """At most `limit` samples to compare with, as many of each label as there are, in a fixed scattered order of ids.

    Labels take turns: the first of each, then the second of each, until the limit. The group limit runs before the
    shuffle, so a hot label costs each task `limit` rows.
    """
    scattered = F.pmod(F.col("sample_id") * 40503, F.lit(65536))
    turns = first_n(samples, ["label"], [scattered, F.col("sample_id")], limit, "_turn")
    return turns.orderBy("_turn", "label").limit(limit).drop("_turn")


NEAR = ["query", "rank", "ex", "label", "d", "d_shift"]


def _compared(
    batches: Iterator[pa.RecordBatch], matrix: np.ndarray, ex: np.ndarray, label: np.ndarray, source: np.ndarray, pool: int, side: int
) -> Iterator[pa.RecordBatch]:
    """The `pool` nearest rows of `matrix` for each sample of other sources."""
    label, squares = pa.array(label, pa.int32(), from_pandas=True), (matrix * matrix).sum(1)
    for batch in batches:
        v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), side * side)
        own = batch.column("source").to_numpy(zero_copy_only=False)
        for at in range(0, len(batch), BLOCK):
            a = ready(v[at:at + BLOCK], side)
            d = 2 * a @ matrix.T
            np.subtract((a * a).sum(1)[:, None] + squares[None, :], d, out=d)
            np.round(np.maximum(d, 0, out=d), 9, out=d)
            d[own[at:at + BLOCK, None] == source[None, :]] = np.inf
            near = np.argsort(d, axis=1, kind="stable")[:, :pool].copy()
            picked, best = matrix[near], np.full(near.shape, np.inf)
            for dx, dy in SHIFTS:
                m = unit(moved(a.reshape(-1, side, side), dx, dy).reshape(len(a), -1))
                best = np.minimum(best, ((picked - m[:, None, :]) ** 2).sum(2))
            rows, place = np.nonzero(np.isfinite(np.take_along_axis(d, near, 1)))
            flat = near[rows, place]
            yield pa.RecordBatch.from_arrays([
                batch.column("sample_id").take(pa.array(rows + at)).cast(pa.int64()), pa.array(place + 1, pa.int32()), pa.array(ex[flat], pa.int64()),
                label.take(pa.array(flat)), pa.array(d[rows, flat]), pa.array(np.round(best[rows, place], 9)),
            ], names=NEAR)


class Nearest:
    """The `pool` nearest exemplars of other sources for each prepared sample, of all that have passed; equals go to the smaller id."""

    def __init__(self, a: np.ndarray, source: list, pool: int, side: int):
        self.a, self.pool, self.side, self.squares = np.column_stack([a, np.full(len(a), -1.0)]), pool, side, (a * a).sum(1)
        self.codes: dict = {}
        # A null source is no one's own.
        self.own = np.array([-2 if s is None else self.codes.setdefault(s, len(self.codes)) for s in source], np.int64)
        self.d, self.shift = (np.full((len(a), pool), np.inf) for _ in range(2))
        self.ex, self.label = (np.zeros((len(a), pool), np.int64) for _ in range(2))
        self.none = np.zeros((len(a), pool), bool)

    def meet(self, m: np.ndarray, ex: np.ndarray, label: np.ndarray, none: np.ndarray, source: list) -> None:
        """Exemplars pass: prepared, with their ids, labels, which of these are null, and sources."""
        of = np.array([self.codes.get(s, -1) for s in source], np.int64)
        beside = np.column_stack([m, (m * m).sum(1) / 2]).T
        for at in range(0, len(self.a), BLOCK):
            self._meet(slice(at, at + BLOCK), m, beside, ex, label, none, of)

    def _meet(self, at: slice, m: np.ndarray, beside: np.ndarray, ex: np.ndarray, label: np.ndarray, none: np.ndarray, of: np.ndarray) -> None:
        squares, own, least, last = self.squares[at], self.own[at], self.d[at, -1], self.ex[at, -1]
        # Half of what a squared distance takes from the sample's square: the more, the nearer.
        s = self.a[at] @ beside
        enough = (squares - least) / 2
        if np.isinf(least).any():
            s[own[:, None] == of[None, :]] = -np.inf
            if s.shape[1] > self.pool:
                enough = np.maximum(enough, np.partition(s, -self.pool, axis=1)[:, -self.pool])
        # Whatever may be as near once it is rounded is looked at.
        row, col = np.nonzero(s >= (enough - 1e-9)[:, None])
        d = np.round(np.maximum(squares[row] - 2 * s[row, col], 0), 9)
        nearer = (d < least[row]) | ((d == least[row]) & np.isfinite(d) & (ex[col] < last[row]))
        nearer &= own[row] != of[col]
        row, col, d = row[nearer], col[nearer], d[nearer]
        if not len(row):
            return
        rows, group = np.unique(row, return_inverse=True)
        held, size = rows + at.start, len(rows) * self.pool
        of_row = np.concatenate([np.repeat(np.arange(len(rows)), self.pool), group])
        d, ids = np.concatenate([self.d[held].ravel(), d]), np.concatenate([self.ex[held].ravel(), ex[col]])
        order = np.lexsort((ids, d, of_row))
        count = np.bincount(of_row)
        place = np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count)
        kept = order[place < self.pool]
        shift = np.concatenate([self.shift[held].ravel(), np.full(len(col), np.inf)])
        new = kept[kept >= size] - size
        moved_row, which = np.unique(group[new], return_inverse=True)
        shift[size + new] = np.round(self._shifted(held[moved_row], which, m[col[new]]), 9)
        self.d[held], self.ex[held], self.shift[held] = (x[kept].reshape(-1, self.pool) for x in (d, ids, shift))
        self.label[held] = np.concatenate([self.label[held].ravel(), label[col]])[kept].reshape(-1, self.pool)
        self.none[held] = np.concatenate([self.none[held].ravel(), none[col]])[kept].reshape(-1, self.pool)

    def _shifted(self, rows: np.ndarray, which: np.ndarray, picked: np.ndarray) -> np.ndarray:
        """The least squared distance of each picked exemplar to sample `rows[which]` moved one pixel each way."""
        side, best = self.side, np.full(len(picked), np.inf)
        wide = np.pad(self.a[rows, :-1].reshape(-1, side, side), ((0, 0), (1, 1), (1, 1)))
        for dx, dy in SHIFTS:
            m = unit(wide[:, 1 + dy:1 + dy + side, 1 + dx:1 + dx + side].reshape(len(rows), -1))
            best = np.minimum(best, ((picked - m[which]) ** 2).sum(1))
        return best

    def found(self, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(ids), TILE):
            here = slice(at, at + TILE)
            row, place = np.nonzero(np.isfinite(self.d[here]))
            ex, label, none, d, shift = (x[here][row, place] for x in (self.ex, self.label, self.none, self.d, self.shift))
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[here][row], pa.int64()), pa.array(place + 1, pa.int32()), pa.array(ex), pa.array(label, pa.int32(), mask=none), pa.array(d), pa.array(shift),
            ], names=NEAR)


PREPARED = "sample_id bigint, source string, label int, v binary"


def _prepared(samples: DataFrame, tasks: int, side: int) -> DataFrame:
    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                b = batch.slice(at, BLOCK)
                v = ready(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(b), side * side), side)
                packed = pa.array([row.tobytes() for row in v], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("sample_id", "source", "label")), packed], names=["sample_id", "source", "label", "v"])

    label = F.col("label").cast("int") if "label" in samples.columns else F.lit(None).cast("int")
    kept = samples.select(F.col("sample_id").cast("bigint").alias("sample_id"), F.col("source").cast("string").alias("source"), label.alias("label"), F.col("v").cast("array<double>").alias("v"))
    return cut_lineage(kept.repartition(tasks, "sample_id").mapInArrow(prepare, PREPARED))


def _all_compared(batches: Iterator[pa.RecordBatch], pool: int, side: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (task, passing): the samples of a task are held, the exemplars pass."""
    vectors = lambda t: np.frombuffer(b"".join(t.column("v").to_pylist())).reshape(t.num_rows, side * side)
    asked, passing, near, ids = [], [], None, None

    def met() -> None:
        nonlocal near, ids, asked, passing
        if near is None:
            t = pa.Table.from_batches(asked)
            ids, near, asked = t.column("sample_id").to_numpy(), Nearest(vectors(t), t.column("source").to_pylist(), pool, side), []
        t = pa.Table.from_batches(passing)
        label = t.column("label")
        near.meet(vectors(t), t.column("sample_id").to_numpy(), label.fill_null(0).to_numpy(), label.is_null().to_numpy(), t.column("source").to_pylist())
        passing = []

    task = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column("task").to_numpy(), batch.column("passing").to_numpy()], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:]):
            if task is not None and key[a, 0] != task:
                if passing and (asked or near is not None):
                    met()
                if near is not None:
                    yield from near.found(ids)
                asked, passing, near, ids = [], [], None, None
            task = key[a, 0]
            if not key[a, 1]:
                asked.append(batch.slice(a, b - a))
                continue
            while a < b and (asked or near is not None):
                part = batch.slice(a, min(b - a, TILE - sum(len(p) for p in passing)))
                passing.append(part)
                a += len(part)
                if sum(len(p) for p in passing) == TILE:
                    met()
    if passing and (asked or near is not None):
        met()
    if near is not None:
        yield from near.found(ids)


def _all_neighbours(samples: DataFrame, exemplars: DataFrame, pool: int, side: int) -> DataFrame:
    """`neighbours` among any number of exemplars. Samples are dealt to tasks, which hold them with the nearest so far while all
    exemplars pass, so the work is samples times exemplars, and a task's memory is that of its samples."""
    spark = samples.sparkSession
    at_work = spark.sparkContext.defaultParallelism
    known = _prepared(exemplars, at_work, side)
    asked = known if exemplars is samples else _prepared(samples, at_work, side)
    tasks = -(-asked.count() // max(1, HELD // (side * side)))
    tasks = max(1, -(-tasks // at_work)) * at_work
    each = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))
    own = F.pmod(F.xxhash64("sample_id"), F.lit(tasks)).cast("int")
    both = asked.select(own.alias("task"), F.lit(0).alias("passing"), "*").unionByName(known.select(each.alias("task"), F.lit(1).alias("passing"), "*"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _all_compared(batches, pool, side)

    met = dealt(both, tasks, "task").sortWithinPartitions("task", "passing")
    return met.mapInArrow(compare, "query bigint, rank int, ex bigint, label int, d double, d_shift double")


def neighbours(
    samples: DataFrame, exemplars: DataFrame | None = None, *, pool: int = POOL, side: int = 8, limit: int | None = EXEMPLARS
) -> DataFrame:
    """The `pool` nearest exemplars per sample: `(query, rank, ex, label, d, d_shift)`.

    Exemplars are given, or chosen from the samples themselves; those of a sample's own `source` don't count for it. `d` is
    squared distance; `d_shift` the least over the query moved one pixel each way. A classifier's exemplars are a fixed number,
    so their one matrix goes to every task, and samples are prepared and compared where they are, a block at a time in one Python
    worker: no shuffle, work in proportion to the samples, and memory that doesn't follow them. More exemplars than `limit` are refused.
    Without a limit (None) every sample meets all exemplars, by default all samples: beyond `EXEMPLARS` of them, samples are dealt
    to tasks that all exemplars pass.
    """
    spark = samples.sparkSession
    model = exemplars if exemplars is not None else samples if limit is None else chosen_exemplars(samples, limit)
    most = EXEMPLARS if limit is None else limit
    known = model.select("sample_id", "source", "label", "v").limit(most + 1).toPandas()
    if len(known) > most:
        if limit is None:
            return _all_neighbours(samples, model, pool, side)
        raise ValueError(f"more than {limit} exemplars")
    known = known.sort_values("sample_id", ignore_index=True)
    if not len(known):
        return samples.limit(0).select(*[F.lit(None).cast(t).alias(c) for c, t in zip(NEAR, ("bigint", "int", "bigint", "int", "double", "double"))])
    matrix = ready(np.stack(known["v"].to_numpy()), side)
    sent = spark.sparkContext.broadcast((matrix, known["sample_id"].to_numpy(), known["label"].to_numpy(), known["source"].to_numpy()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _compared(batches, *sent.value, pool, side)

    asked = samples.select("sample_id", "source", F.col("v").cast("array<double>").alias("v"))
    return asked.mapInArrow(compare, "query bigint, rank int, ex bigint, label int, d double, d_shift double")


def _stamp(*columns: str) -> Column:
    """A text that changes when any row of a group does, whatever their order."""
    sums = [F.sum(F.xxhash64(*columns, F.lit(k)).cast("decimal(38,0)")).cast("string") for k in (0, 1)]
    return F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums)


def cached_neighbours(
    samples: DataFrame, path: str, exemplars: DataFrame | None = None, *, pool: int = POOL, side: int = 8, limit: int | None = None
) -> DataFrame:
    """`neighbours` of all samples from the table at `path`, in which only what changed is computed anew.

    Samples are compared with all exemplars given, or with all samples; with a `limit`, as many are chosen from the samples.
    Rows are kept by event with a stamp of the event's samples, of the exemplars and of the options. An event whose stamp
    is the stored one is read; others are compared with the exemplars and stored. Exemplars that are the samples, or chosen from
    them, change with them, and then every event does; with given ones a changed event is computed alone.
    """
    spark = samples.sparkSession
    model = exemplars if exemplars is not None else samples if limit is None else chosen_exemplars(samples, limit)
    model = cut_lineage(model.select("sample_id", "source", "label", "v"))
    of_model = f"{model.agg(_stamp('sample_id', 'source', 'label', 'v')).first()[0]}|{pool}|{side}"
    key = F.col("source").cast("string")
    stamps = samples.groupBy(key.alias("key")).agg(F.concat_ws("|", _stamp("sample_id", "label", "v"), F.lit(of_model)).alias("stamp"))
    stamps = cut_lineage(stamps)
    known = snapshots.manifest(spark, path).filter((F.col("version") == (snapshots.latest_version(spark, path) or 0)) & F.col("folder").isNotNull())
    known = known.select(F.col("key").alias("_key"), F.col("stamp").alias("_stamp"))
    changed = cut_lineage(stamps.join(known, F.col("key").eqNullSafe(F.col("_key")) & (F.col("stamp") == F.col("_stamp")), "left_anti"))
    if not changed.isEmpty() or not snapshots.latest_version(spark, path):
        asked = samples.join(changed.select("key"), key.eqNullSafe(F.col("key")), "left_semi")
        near = neighbours(asked, model, pool=pool, side=side, limit=limit)
        event = asked.select(F.col("sample_id").alias("query"), key.alias("source"))
        snapshots.write(near.join(event, "query").select(*NEAR, "source"), path, "source", stamps=changed)
    now = stamps.select(F.col("key").alias("_now"))
    return snapshots.read(spark, path).join(now, F.col("source").eqNullSafe(F.col("_now")), "left_semi").select(*NEAR)


def classify_against(queries: DataFrame, exemplars: DataFrame, *, k: int = K, pool: int = POOL, side: int = 8) -> DataFrame:
    """New bitmaps `(sample_id, v)` read with a model's exemplars `(label, v)`: `(query, predicted, conf)`, one row each.

    Without exemplars the reading is null and its confidence 0. Exemplars are numbered by `ex` if they have it.
    """
    number = F.col("ex") if "ex" in exemplars.columns else F.col("sample_id")
    model = exemplars.select(number.cast("bigint").alias("sample_id"), F.lit(1).alias("source"), F.col("label").cast("int").alias("label"), "v")
    asked = queries.select("sample_id", F.lit(0).alias("source"), "v")
    read = classify(neighbours(asked, model, pool=pool, side=side), k)
    return queries.select(F.col("sample_id").alias("query")).join(read, "query", "left").na.fill(0.0, ["conf"])


def classify(near: DataFrame, k: int = K) -> DataFrame:
    """Weighted vote of the `k` nearest after the shift re-score: `(query, predicted, conf)`.

    Equal votes go to the label met first, that is the nearer neighbour's.
    """
    best = first_n(near, ["query"], [F.col("d_shift"), F.col("rank")], k, "place")
    votes = best.groupBy("query", "label").agg(
        F.round(F.sum(1 / (F.sqrt("d_shift") + F.lit(1e-6))), 9).alias("w"), F.min("place").alias("first")
    )
    won = F.max(F.struct("w", (-F.col("first")).alias("m"), "label"))
    return votes.groupBy("query").agg(won.alias("b"), F.sum("w").alias("total")).select(
        "query", F.col("b.label").alias("predicted"), F.round(F.col("b.w") / F.col("total"), 6).alias("conf")
    )


def leave_one_event_out(samples: DataFrame, **options) -> DataFrame:
    """Every sample classified from the exemplars of other events only, in one job."""
    votes = classify(neighbours(samples, **options))
    return votes.join(samples.select(F.col("sample_id").alias("query"), "source", "label"), "query")


# The polls that are compared.
RULE_KS = (5, 9, 15, 21, 25)


def class_counts(samples: DataFrame) -> DataFrame:
    """Training-side count per label for each event held out: `(source, label, n)`.

    Samples are counted before anything is joined; a row per event and label is left.
    """
    per = samples.groupBy("source", "label").agg(F.count(F.lit(1)).alias("own"))
    totals = per.groupBy(F.col("label")).agg(F.sum("own").alias("all_n"))
    # Totals ride along as a map of ten entries instead of a join of every event with every label.
    packed = totals.agg(F.map_from_entries(F.collect_list(F.struct("label", "all_n")))).scalar()
    own = per.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("label", "own"))).alias("own"))
    return own.withColumn("t", packed).select("source", "own", F.explode("t").alias("label", "all_n")).select(
        "source", "label", (F.col("all_n") - F.coalesce(F.element_at("own", F.col("label")), F.lit(0))).alias("n")
    )


def poll(near: DataFrame, samples: DataFrame, ks: Sequence[int] = RULE_KS) -> DataFrame:
    """All voting rules over one neighbour table: `(rule, query, correct, conf)`.

    Share and margin for each `k`, and the share balanced by class size for the first.
    """
    truth = samples.select(F.col("sample_id").alias("query"), "source", F.col("label").alias("truth"))
    x = near.join(truth, "query").join(class_counts(samples), ["source", "label"])
    w = 1 / (F.sqrt("d") + F.lit(1e-6))

    def upto(k: int, weight: Column) -> Column:
        return F.round(F.sum(F.when(F.col("rank") <= k, weight)), 9)

    sums = {f"s{k}": upto(k, w) for k in ks}
    sums["b"] = upto(ks[0], w / F.greatest(F.lit(1), F.col("n")))
    votes = x.groupBy("query", "truth", "label").agg(
        F.min("rank").alias("first"), *[v.alias(n) for n, v in sums.items()]
    )

    def outcome(col: str, rule: str, margin: bool) -> Column:
        ranked = F.array_sort(F.collect_list(F.when(
            F.col(col).isNotNull(), F.struct((-F.col(col)).alias("w"), "first", "label"))))
        top, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
        won = -top["w"] + (F.coalesce(second["w"], F.lit(0.0)) if margin else F.lit(0.0))
        return F.struct(
            F.lit(rule).alias("rule"), (top["label"] == F.col("truth")).alias("correct"),
            F.round(won / F.sum(col), 6).alias("conf"),
        )

    rules = [outcome(f"s{k}", f"{k} {'margin' if m else 'share'}", m) for k in ks for m in (False, True)]
    rules.append(outcome("b", f"{ks[0]} balanced", False))
    packed = votes.groupBy("query", "truth").agg(F.array(*rules).alias("r"))
    return packed.select("query", F.inline("r"))


def rule_accuracy(polled: DataFrame) -> DataFrame:
    return polled.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("right"))


