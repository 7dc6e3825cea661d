"""Rules as violation queries: a rule is kept exactly when it returns no rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.taxonomy import MAX_VOLUNTEERS, taxonomy


def _broken(df: DataFrame, rules: dict[str, Column], keep: list[str]) -> DataFrame:
    """One pass over `df`; a row comes out once per rule it breaks."""
    tagged = F.array_compact(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in rules.items()]))
    return df.select(F.explode(tagged).alias("rule"), *keep)


def cell_map_violations(cells: DataFrame, width: int, height: int) -> DataFrame:
    """Rules a calibrated cell map must keep. Groups are the cells of one page side."""
    items = F.broadcast(
        taxonomy(cells.sparkSession).select(
            "item_row", F.col("side").alias("_side"), F.col("printed_column").alias("_column")
        )
    )
    same_row = Window.partitionBy("page", "item_row")
    stacked = Window.partitionBy("page", "printed_column").orderBy("total_y", "cell")
    x = (
        cells.join(items, "item_row", "left")
        .withColumn("_n", F.count(F.lit(1)).over(same_row))
        .withColumn("_bar", F.lag(F.col("total_y") + F.col("total_h") * F.lit(0.5)).over(stacked))
    )
    rules: dict[str, Column] = {
        "unknown row": F.col("_side").isNull(),
        "wrong side": F.col("side") != F.col("_side"),
        "wrong column": F.col("printed_column") != F.col("_column"),
        "row twice": F.col("_n") > 1,
        "boxes overlap": F.col("total_y") < F.col("_bar"),
    }
    for box in ("total", "tally"):
        bx, by, bw, bh = (F.col(f"{box}_{c}") for c in "xywh")
        rules[f"{box} without area"] = (bw <= 0) | (bh <= 0)
        rules[f"{box} off the page"] = (bx < 0) | (by < 0) | (bx + bw > width) | (by + bh > height)
    return _broken(x, rules, ["page", "cell"])


def event_violations(events: DataFrame, values: DataFrame) -> DataFrame:
    """Rules on event fields and on the values that would be written."""
    none = F.lit(None).cast("bigint")
    event_rules = {
        "date": ~F.coalesce(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)),
        "shoreline": F.coalesce(F.length("shoreline"), F.lit(0)) < 1,
        "volunteers": ~F.col("volunteers").between(1, MAX_VOLUNTEERS),
        "pounds": F.col("pounds") < 0,
    }
    of_events = _broken(events, event_rules, ["event"]).withColumn("card", none).withColumn("item_row", none)
    items = F.broadcast(taxonomy(values.sparkSession).select("item_row", F.lit(True).alias("_known")))
    keys = ["event", "card", "item_row"]
    counted = values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("value").alias("value"),
        F.bool_or(F.col("value") != F.floor("value")).alias("_fraction"),
        F.min("confidence").alias("_lo"), F.max("confidence").alias("_hi"),
        F.bool_or(~F.col("source").isin("recognized", "accepted", "corrected", "manual")).alias("_odd"),
    )
    value_rules = {
        "not an item row": F.col("_known").isNull(),
        "card number": ~F.col("card").between(1, MAX_VOLUNTEERS),
        "negative value": F.col("value") < 0,
        "fraction": F.col("_fraction"),
        "confidence": (F.col("_lo") < 0) | (F.col("_hi") > 1),
        "source": F.col("_odd"),
        "formula column": F.col("card") == 0,
        "row twice": F.col("_n") > 1,
    }
    of_values = _broken(counted.join(items, "item_row", "left"), value_rules, keys)
    return of_events.unionByName(of_values)


def tagged_values(values: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Values with what the rules need beside them, and the rules: conditions that no value to be written may meet.

    Same rules as `event_violations`, as conditions on rows, so that they can be counted by the pass that writes.
    """
    items = F.broadcast(taxonomy(values.sparkSession).select(F.col("item_row").alias("_item"), F.lit(True).alias("_known")))
    same = Window.partitionBy("event", "card", "item_row")
    rows = values.withColumn("_n", F.count(F.lit(1)).over(same)).join(items, F.col("item_row") == F.col("_item"), "left")
    rules = {
        "not an item row": F.col("_known").isNull(),
        "formula column": F.col("card") == 0,
        "card number": ~F.coalesce(F.col("card").between(1, MAX_VOLUNTEERS), F.lit(False)),
        "negative value": F.col("value") < 0,
        "fraction": F.col("value") != F.floor("value"),
        "row twice": F.col("_n") > 1,
    }
    return rows, rules


def refuse_if_any(violations: DataFrame) -> DataFrame:
    """Pass an empty violation table through; fail the job on the first row of any other."""
    message = F.concat(F.lit("rule broken: "), F.col("rule"))
    return violations.withColumn("rule", F.when(F.col("rule").isNotNull(), F.raise_error(message)))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
