"""Scoring predictions and readings against what is known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.readings import tally_shape
from .ordered import running
from .readings import unstack

# Fixed value: thresholds the precision table is reported at.
CURVE_THRESHOLDS = (0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0)

# Fixed value: target precisions of the reachability table.
TARGETS = (0.8, 0.85, 0.9, 0.95, 0.99, 1.0)


def precision_curve(
    pred: DataFrame, thresholds: Sequence[float] = CURVE_THRESHOLDS
) -> DataFrame:
    """Answered, right, whole cells answered and whole cells right at each threshold.

    A cell counts only if every digit of it passes, so digits are reduced to one row per
    cell; the digit counts ride along in the same aggregation.
    """
    right = F.col("predicted") == F.col("label")
    per_cell = [F.min("conf").alias("worst"), F.bool_and(right).alias("all_right")]
    total = [F.sum("digits").alias("digits")]
    for i, t in enumerate(thresholds):
        per_cell.append(F.count_if(F.col("conf") >= t).alias(f"a{i}"))
        per_cell.append(F.count_if((F.col("conf") >= t) & right).alias(f"r{i}"))
        whole = F.col("worst") >= t
        total += [
            F.sum(f"a{i}").alias(f"answered_{i}"), F.sum(f"r{i}").alias(f"right_{i}"),
            F.count_if(whole).alias(f"whole_cells_{i}"),
            F.count_if(whole & F.col("all_right")).alias(f"cells_right_{i}"),
        ]
    cells = pred.groupBy("source", "cell").agg(F.count(F.lit(1)).alias("digits"), *per_cell)
    out = unstack(
        cells.agg(*total), "threshold", thresholds,
        ["answered", "right", "whole_cells", "cells_right"], ["digits"],
    )
    return out.withColumn(
        "precision", F.when(F.col("answered") > 0, F.round(F.col("right") / F.col("answered"), 6))
    )


def confusion_matrix(pred: DataFrame, classes: Sequence[int] = tuple(range(10))) -> DataFrame:
    """Truth by row, prediction by column (`p0`, `p1`, ...)."""
    return pred.groupBy("label").agg(
        *[F.count_if(F.col("predicted") == c).alias(f"p{c}") for c in classes]
    )


def worst_confusions(pred: DataFrame, n: int = 8) -> DataFrame:
    """The most frequent wrong pairs; ties by label and prediction."""
    return (
        pred.filter(F.col("label") != F.col("predicted"))
        .groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "label", "predicted").limit(n)
    )


def class_recall(pred: DataFrame, by: str) -> DataFrame:
    """Digits and right digits per class, or per event."""
    right = F.col("predicted") == F.col("label")
    return pred.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(right).alias("right")
    ).withColumn("recall", F.round(F.col("right") / F.col("n"), 6))


def reachable_precision(
    scored: DataFrame, keys: Sequence[str] = (), targets: Sequence[float] = TARGETS
) -> DataFrame:
    """Most answers obtainable at each target precision over every observed threshold.

    `scored` has `conf` in 0..1 and `correct`. Equal confidences are counted first; the
    running sums from the most confident down go in a thousand bands of confidence.
    """
    counts = (
        scored.groupBy(*keys, "conf")
        .agg(F.count(F.lit(1)).alias("_n"), F.count_if("correct").alias("_r"))
        .withColumn("_band", -F.floor(F.col("conf") * 1000).cast("bigint"))
    )
    cum = running(
        counts, keys, ["_band"], [F.desc("conf")], {"answered": F.col("_n"), "right": F.col("_r")}
    )
    aggs = [
        F.max(
            F.when(
                F.col("right") / F.col("answered") >= t,
                F.struct("answered", "right", F.col("conf").alias("gate")),
            )
        ).alias(f"best_{i}")
        for i, t in enumerate(targets)
    ]
    return unstack(
        cum.groupBy(*keys).agg(*aggs), "target", targets, ["best"], list(keys)
    ).select(*keys, "target", "best.answered", "best.right", "best.gate")


def accuracy_by_shape(tallies: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Answered tallies scored by how much was counted and how much ink was left over."""
    x = tallies.filter(F.col("count").isNotNull()).join(truth, list(keys))
    return x.groupBy(tally_shape(F.col("count"), F.col("explained")).alias("shape")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("count") == F.col("n_typed")).alias("right")
    )


def cut_verdict(pieces: Column, truth_length: Column) -> Column:
    """Were as many digits cut out as the typed number has?"""
    return (
        F.when(pieces == truth_length, "right").when(pieces == 0, "none")
        .when(pieces > truth_length, "over").otherwise("under")
    )


def segmentation_accuracy(cells: DataFrame, truth: DataFrame) -> DataFrame:
    """Cells cut right, over, under or not at all, per event and (event null) over all."""
    length = F.length(F.col("n").cast("string"))
    x = cells.filter("has_value").join(truth, ["event", "card", "item_row"])
    verdicts = ["right", "over", "under", "none"]
    v = cut_verdict(F.col("pieces"), length)
    per_event = x.withColumn("v", v).groupBy("event").agg(
        F.count(F.lit(1)).alias("cells"), *[F.count_if(F.col("v") == k).alias(f"cut_{k}") for k in verdicts]
    )
    names = ["cells", *[f"cut_{k}" for k in verdicts]]
    return per_event.rollup("event").agg(*[F.sum(n).alias(n) for n in names])


def review_list_recall(cells: DataFrame, typed: DataFrame) -> DataFrame:
    """How much shorter the review list is with the mark test, and what that costs."""
    keys = ["event", "card", "item_row"]
    now = F.col("has_value") | F.col("tally_marked")
    x = cells.select(*keys, F.lit(True).alias("listed"), now.alias("now")).join(
        typed.select(*keys, F.lit(True).alias("is_typed")), keys, "full"
    )
    listed, is_typed = F.col("listed").isNotNull(), F.col("is_typed").isNotNull()
    return x.groupBy("event").agg(
        F.count_if(listed).alias("before"),
        F.count_if(listed & F.col("now")).alias("after"),
        F.count_if(is_typed).alias("typed"),
        F.count_if(is_typed & ~listed).alias("missed_before"),
        F.count_if(is_typed & listed & ~F.col("now")).alias("dropped_by_rule"),
    ).withColumn(
        "shorter_pct",
        F.when(F.col("before") > 0, F.round((1 - F.col("after") / F.col("before")) * 100, 4)),
    )
