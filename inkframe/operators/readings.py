"""Which cells are offered, which reader is asked, and what comes of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.readings import PREFILL_GATE, prefill_tag, reconcile
from ..functions.rounding import half_up
from .ordered import first_n

NEGLIGIBLE_INK = 0.008


def ink_floor(cells: DataFrame, floor: float = NEGLIGIBLE_INK) -> DataFrame:
    """Drop a cell only when box and strip are both below the floor."""
    return cells.filter(~((F.col("ink") < floor) & (F.col("tally_ink") < floor)))


def offered(cells: DataFrame) -> DataFrame:
    """Keep cells somebody must look at, and say which hold tally marks only."""
    return cells.withColumn("tally_only", ~F.col("has_value") & F.col("tally_marked")).filter(
        F.col("has_value") | F.col("tally_only")
    )


def route_readers(cells: DataFrame) -> DataFrame:
    """The tally counts only beside an empty box; digits only in a written one."""
    return (
        cells.withColumn("tally", F.when(F.col("tally_only"), F.col("tally")))
        .withColumn("digits", F.when(F.col("has_value"), F.col("digits")))
    )


def with_reading(cells: DataFrame, **options) -> DataFrame:
    """Add `value`, `confidence` and `source`; null where nothing may be said."""
    r = reconcile(F.col("tally"), F.col("tally_conf"), F.col("digits"), F.col("digit_conf"), **options)
    return cells.withColumn("_r", r).select(*cells.columns, "_r.value", "_r.confidence", "_r.source")


def prefilled(cells: DataFrame, gate: float = PREFILL_GATE) -> DataFrame:
    """Readings trusted enough to stand in the reviewer's box, with the note beside them."""
    return with_reading(cells).filter(F.col("confidence") >= gate).withColumn(
        "tag", prefill_tag(F.col("source"))
    )


def unstack(df: DataFrame, key: str, settings: Sequence[float], names: Sequence[str],
            keep: Sequence[str] = ()) -> DataFrame:
    """Turn columns `<name>_<i>` into one row per setting, named by `key`."""
    rows = F.array(*[
        F.struct(F.lit(s).alias(key), *[F.col(f"{n}_{i}").alias(n) for n in names])
        for i, s in enumerate(settings)
    ])
    return df.select(*keep, F.inline(rows))


def gate_coverage(readings: DataFrame, gates: Sequence[float]) -> DataFrame:
    """Filled and split counts at each gate, in one pass over the readings."""
    def passes(i: int) -> Column:
        return F.col("confidence") >= gates[i]

    aggs = [F.count(F.lit(1)).alias("total")]
    for i in range(len(gates)):
        aggs.append(F.count_if(passes(i)).alias(f"filled_{i}"))
        aggs.append(F.count_if(passes(i) & (F.col("source") == "split")).alias(f"split_{i}"))
    return unstack(readings.agg(*aggs), "gate", gates, ["filled", "split"], ["total"])


def reader_agreement(cells: DataFrame, truth: DataFrame, *, digit_gate: float = 0.9) -> DataFrame:
    """Both readers against the typed sheet, per event and (event null) over all."""
    keys = ["event", "card", "item_row"]
    d = F.when(F.col("digit_conf") >= digit_gate, F.col("digits"))
    x = cells.withColumn("d", d).join(truth, keys, "left")
    t, n = F.col("tally"), F.col("n")
    both = t.isNotNull() & F.col("d").isNotNull()
    same, split = both & (t == F.col("d")), both & (t != F.col("d")) & n.isNotNull()
    tests = {
        "both_read": both,
        "agreed": same,
        "agreed_scored": same & n.isNotNull(),
        "agreed_right": same & (t == n),
        "digits_scored": F.col("d").isNotNull() & n.isNotNull(),
        "digits_right": F.col("d") == n,
        "tally_scored": t.isNotNull() & n.isNotNull(),
        "tally_right": t == n,
        "split_scored": split,
        "split_tally": split & (t == n),
        "split_digits": split & (F.col("d") == n),
        "split_middle": split & (half_up((t + F.col("d")) / 2) == n),
    }
    per_event = x.groupBy("event").agg(*[F.count_if(c).alias(k) for k, c in tests.items()])
    # Totals come from the per-event rows, not from a second expansion of the cells.
    return per_event.rollup("event").agg(*[F.sum(k).alias(k) for k in tests])


def digits_to_number(pred: DataFrame, most: int = 3) -> DataFrame:
    """Digits of a cell in order to its number, trusted as its worst digit; null past `most` digits."""
    keys = ["source", "cell"]
    # All digits are counted; only the few of a cell that can be read are gathered.
    whole = pred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("digits"), F.min("conf").alias("_least"), F.bool_or(F.col("predicted").isNull()).alias("_lost")
    )
    few = first_n(pred, keys, [F.col("k"), F.col("predicted"), F.col("conf")], most)
    parts = F.array_sort(F.collect_list(F.struct("rn", "predicted")))
    text = few.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["predicted"].cast("string")), "").alias("_text"))
    readable = (F.col("digits") <= most) & ~F.col("_lost")
    return whole.join(text, keys).select(
        *keys, "digits", F.when(readable, F.col("_text").cast("bigint")).alias("value"),
        F.when(readable, F.col("_least")).alias("confidence"),
    )
