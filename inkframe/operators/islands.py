"""Runs, bands, peaks and clusters along a page axis. Groups are page-sized, never corpus-sized."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(flagged: DataFrame, keys: Sequence[str], pos: str = "i", max_gap: int = 0) -> DataFrame:
    """Number the runs of flagged positions; a run goes on across at most `max_gap` blanks."""
    w = Window.partitionBy(*keys).orderBy(pos)
    opens = F.coalesce(F.col(pos) - F.lag(pos).over(w) > max_gap + 1, F.lit(True))
    return flagged.withColumn("_o", opens.cast("int")).withColumn(
        "run", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_o")


def run_bounds(flagged: DataFrame, keys: Sequence[str], pos: str = "i", max_gap: int = 0) -> DataFrame:
    """`(keys, start, end, n)` of each run."""
    return runs(flagged, keys, pos, max_gap).groupBy(*keys, "run").agg(
        F.min(pos).alias("start"), F.max(pos).alias("end"), F.count(F.lit(1)).alias("n")
    ).drop("run")


def thin_runs(flagged: DataFrame, keys: Sequence[str], max_run: int, carry: Sequence[str] = ()) -> DataFrame:
    """Positions in runs no longer than `max_run`, with their run's bounds."""
    x = runs(flagged, keys)
    whole = Window.partitionBy(*keys, "run")
    return (
        x.withColumn("start", F.min("i").over(whole)).withColumn("end", F.max("i").over(whole))
        .filter(F.col("end") - F.col("start") + 1 <= max_run)
        .select(*keys, "i", "start", "end", *carry)
    )


def bands(profile: DataFrame, bar: float = 0.5, min_size: int = 8) -> DataFrame:
    """Stretches of a coverage profile above `bar`, at least `min_size` long."""
    b = run_bounds(profile.filter(F.col("v") > bar).select("page", "i"), ["page"])
    return b.filter(F.col("n") >= min_size)


def upper_median(values: Column) -> Column:
    """`sorted[n >> 1]` of an array."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def peaks(profile: DataFrame, min_sep: int = 6, factor: float = 1.8) -> DataFrame:
    """Local maxima clear of the median, the strongest first, each at least `min_sep` from those kept."""
    w = Window.partitionBy("page").orderBy("i")
    bar = profile.groupBy("page").agg((upper_median(F.collect_list("v")) * F.lit(factor)).alias("_bar"))
    near = profile.withColumn("_p", F.lag("v").over(w)).withColumn("_n", F.lead("v").over(w))
    candidates = near.join(bar, "page").filter(
        (F.col("v") >= F.col("_bar")) & (F.col("v") >= F.col("_p")) & (F.col("v") >= F.col("_n"))
    )
    strongest = F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("m"), "i")))
    kept = F.aggregate(
        strongest, F.array().cast("array<bigint>"),
        lambda acc, c: F.when(
            F.forall(acc, lambda k: F.abs(k - c["i"]) >= min_sep), F.concat(acc, F.array(c["i"]))
        ).otherwise(acc),
    )
    return candidates.groupBy("page").agg(kept.alias("k")).select("page", F.explode("k").alias("i"))


def stacked_boxes(cells: DataFrame) -> DataFrame:
    """Neighbouring TOTAL boxes of a printed column: midpoints between them and their overlap."""
    w = Window.partitionBy("page", "printed_column").orderBy("total_y", "cell")
    end = F.col("total_y") + F.col("total_h")
    prev_end, next_y = F.lag(end).over(w), F.lead("total_y").over(w)
    return cells.select(
        "page", "cell",
        F.coalesce(F.floor((prev_end + F.col("total_y")) / 2 + 0.5), F.greatest(F.lit(0), F.col("total_y") - 8)).cast("bigint").alias("band_top"),
        F.coalesce(F.floor((end + next_y) / 2 + 0.5), end + 8).cast("bigint").alias("band_bottom"),
        F.greatest(F.lit(0), F.coalesce(prev_end - F.col("total_y"), F.lit(0))).cast("bigint").alias("overlap"),
    )


def search_clusters(
    profile: DataFrame, count: int, *, fractions: Sequence[float], gaps: Sequence[int], min_size: int = 6,
    slack: float = 12.0,
) -> DataFrame:
    """Threshold and merge distance under which a profile falls into exactly `count` clusters.

    Among plausible fits (no cluster mostly blank, none far taller than the rest) the one with
    the smallest tallest cluster wins, earlier settings first; then any fit of the right count,
    marked suspect; else an even split. Runs are found once per threshold. Merge distances
    are tried on the few runs, not on the profile.
    """
    c = F.col
    stat = lambda q: F.get(F.array_sort(F.collect_list("v")), F.floor(F.count(F.lit(1)) * F.lit(q)).cast("int"))
    levels = profile.groupBy("page").agg(stat(0.1).alias("lo"), stat(0.97).alias("hi"), F.count(F.lit(1)).alias("len"))
    by_i = Window.partitionBy("page").orderBy("i")
    sums = profile.withColumn("sum_to", F.sum("v").over(by_i.rowsBetween(Window.unboundedPreceding, 0)))
    grid = F.array(*[F.struct(F.lit(k).alias("f_no"), F.lit(f).alias("f")) for k, f in enumerate(fractions)])
    x = sums.join(levels, "page").select("*", F.inline(grid))
    x = x.withColumn("thr", c("lo") + (c("hi") - c("lo")) * c("f")).filter(c("v") >= c("thr"))
    flagged = runs(x, ["page", "f_no"]).groupBy("page", "f_no", "thr", "len", "run").agg(
        F.min("i").alias("a"), F.max("i").alias("b"), F.max("sum_to").alias("sum_b"),
        F.min(c("sum_to") - c("v")).alias("sum_a"),
    )
    tried = flagged.withColumn("gap", F.explode(F.array(*[F.lit(int(g)) for g in gaps])))
    w = Window.partitionBy("page", "f_no", "gap").orderBy("a")
    opens = F.coalesce(c("a") - F.lag("b").over(w) - 1 > c("gap"), F.lit(True)).cast("int")
    merged = tried.withColumn("_o", opens).withColumn("cl", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    clusters = merged.groupBy("page", "f_no", "gap", "cl", "thr", "len").agg(
        F.min("a").alias("a"), F.max("b").alias("b"), (F.max("sum_b") - F.min("sum_a")).alias("ink")
    )
    # A cluster that reaches the end within the merge distance is taken to run to the end.
    open_end = c("len") - 1 - c("b") <= c("gap")
    size = F.when(open_end, c("len") - c("a")).otherwise(c("b") - c("a"))
    ok = size >= min_size
    clusters = clusters.withColumn("_ok", ok).withColumn("b", F.when(open_end, c("len") - 1).otherwise(c("b")))
    height = F.when(c("_ok"), c("b") - c("a"))
    fits = clusters.groupBy("page", "f_no", "gap").agg(
        F.count_if("_ok").alias("n"), F.max(height).alias("tallest"), upper_median(F.collect_list(height)).alias("mid"),
        F.bool_and(~c("_ok") | (c("ink") / (height + 1) >= c("thr") * F.lit(0.9))).alias("solid"),
    )
    # Once a merge distance gives too few, larger ones are not looked at.
    past = F.min(F.when(c("n") < count, c("gap"))).over(Window.partitionBy("page", "f_no"))
    exact = fits.withColumn("_past", past).filter(
        (c("n") == count) & (c("_past").isNull() | (c("gap") < c("_past")))
    ).withColumn("plausible", c("solid") & (c("tallest") <= c("mid") * F.lit(2.2) + slack))
    order = F.struct("tallest", "f_no", "gap")
    chosen = exact.groupBy("page").agg(
        F.min(F.when(c("plausible"), order)).alias("best"),
        F.min(F.when(~c("plausible"), F.struct("f_no", "gap", "tallest"))).alias("suspect"),
    )
    kind = F.when(c("best").isNotNull(), "fit").when(c("suspect").isNotNull(), "suspect").otherwise("even split")
    pick = lambda f: F.coalesce(F.col(f"best.{f}"), F.col(f"suspect.{f}"))
    return levels.select("page").join(chosen, "page", "left").select(
        "page", kind.alias("kind"), pick("f_no").cast("bigint").alias("f_no"), pick("gap").cast("bigint").alias("gap"),
        pick("tallest").alias("tallest"),
    )
