"""Counting tallies from their pen strokes, and the tests around that."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.readings import tally_confidence
from .islands import thin_runs, upper_median

# Fixed values of the counter.
MIN_EXPLAINED, MAX_ANGLE_SPREAD, LENGTH_TOLERANCE = 0.9, 30, 1.9
BASELINE_TOLERANCE, GROUP_GAP_RATIO, BAR_REACH = 0.85, 1.85, 4
MIN_DENSITY, BAR_DENSITY, MAX_INK = 0.62, 0.4, 6000
RULE_COVERAGE, RULE_MARGIN, RULE_CROWD, RULE_EVIDENCE, RULE_WIDTH, RULE_FRINGE = 0.55, 0.2, 0.3, 0.5, 6, 2
EDGE_INK = 6
ROW_ESCAPE, ESCAPE_SLACK, ESCAPE_GAP = 0.35, 1, 1
ANGLE_STEP, MAX_GAP, MIN_LENGTH, MIN_MEMBERS = 4, 8, 11, 4

FIELDS = ("mid_x", "k", "length", "ink", "angle", "max_y", "min_x", "max_x")


def _most(a: Column) -> Column:
    return F.array_max(a)


def _least(a: Column) -> Column:
    return F.array_min(a)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda s, v: s + v)


def strip_strokes(segments: DataFrame) -> DataFrame:
    """One row per strip with its solid strokes of like length, left to right, grouped, and its bars.

    A strip is taken apart into at most some hundred segments, so they fit one row, and all
    that follows needs no further shuffle.
    """
    overrun = F.col("overrun") if "overrun" in segments.columns else F.lit(0).cast("bigint")

    def gather(kind: str, density: float) -> Column:
        solid = (F.col("kind") == kind) & (F.col("ink") >= F.col("length") * F.lit(density))
        return F.array_sort(F.collect_list(F.when(solid, F.struct(*FIELDS, overrun.alias("overrun")))))

    x = segments.groupBy("strip").agg(
        gather("stroke", MIN_DENSITY).alias("upright"), gather("bar", BAR_DENSITY).alias("others")
    )
    x = x.withColumn("typical", upper_median(F.transform("upright", lambda s: s["length"])))
    like = F.filter("upright", lambda s: (s["length"] >= F.col("typical") / F.lit(LENGTH_TOLERANCE))
                    & (s["length"] <= F.col("typical") * F.lit(LENGTH_TOLERANCE)))
    x = x.withColumn("strokes", like)
    gaps = F.zip_with(
        F.slice("strokes", 2, F.greatest(F.size("strokes"), F.lit(1))), F.slice("strokes", 1, F.greatest(F.size("strokes") - 1, F.lit(0))),
        lambda b, a: b["mid_x"] - a["mid_x"],
    )
    x = x.withColumn("gaps", gaps).withColumn("unit", upper_median(F.col("gaps")))
    # Group number of each stroke: one more after every gap wider than the usual.
    numbers = F.aggregate(
        "gaps", F.array(F.lit(0)),
        lambda acc, g: F.concat(acc, F.array(
            F.element_at(acc, -1) + F.when(g > F.col("unit") * F.lit(GROUP_GAP_RATIO), 1).otherwise(0)
        )),
    )
    return x.withColumn("group_no", F.when(F.size("strokes") > 0, numbers).otherwise(F.array().cast("array<int>")))


def _groups(x: DataFrame) -> DataFrame:
    """Add `groups` (stroke positions) and `crossed` (per bar, the groups it crosses)."""
    numbers = F.array_distinct("group_no")
    members = F.transform(numbers, lambda g: F.transform(
        F.filter(F.arrays_zip("strokes", "group_no"), lambda z: z["group_no"] == g), lambda z: z["strokes"]["mid_x"]
    ))
    x = x.withColumn("groups", members)
    crossed = F.transform("others", lambda bar: F.array_compact(F.transform(
        "groups",
        lambda grp, gi: F.when(
            F.size(F.filter(grp, lambda m: (m >= bar["min_x"] - BAR_REACH) & (m <= bar["max_x"] + BAR_REACH))) >= 2, gi
        ),
    )))
    return x.withColumn("crossed", crossed)


def crossbars(segments: DataFrame) -> DataFrame:
    """Per bar of a strip: how many groups it crosses by two strokes or more, and which, if one."""
    x = _groups(strip_strokes(segments))
    bars = x.select("strip", F.explode(F.arrays_zip("others", "crossed")).alias("z"))
    n = F.size("z.crossed")
    return bars.select(
        "strip", F.col("z.others.k").alias("k"), n.cast("bigint").alias("groups_crossed"),
        F.when(n == 1, F.get("z.crossed", F.lit(0))).cast("bigint").alias("group_no"),
    )


def count_tallies(segments: DataFrame, strips: DataFrame, strip_height: int = 0) -> DataFrame:
    """Counts, or the first reason to decline: `strips` has `raw_ink`, `clipped` and thinned `ink`.

    Segments may have an `overrun` (see `row_overrun`): where a stroke's is `escape_bar(strip_height)` lines or more, it comes
    from the row above, and what the strip shows is not its own tally.
    """
    escape = escape_bar(strip_height)
    x = strips.join(_groups(strip_strokes(segments)), "strip", "left")
    good = F.filter(F.arrays_zip("others", "crossed"), lambda z: F.size(z["crossed"]) == 1)
    x = x.withColumn("good", good)
    sizes = F.transform("groups", lambda g, gi: F.size(g) + F.size(
        F.filter("good", lambda z: F.get(z["crossed"], F.lit(0)) == gi)))
    x = x.withColumn("sizes", sizes)
    strokes = F.coalesce(F.size("strokes"), F.lit(0))
    n_strokes = F.greatest(strokes, F.lit(0))
    ink = _sum(F.transform("strokes", lambda s: s["ink"])) + _sum(F.transform("good", lambda z: z["others"]["ink"]))
    explained = F.round(ink / F.col("ink"), 6)
    tilt = F.transform("strokes", lambda s: F.when(s["angle"] > 0, s["angle"] - 90).otherwise(s["angle"] + 90))
    feet = F.transform("strokes", lambda s: s["max_y"])
    ragged = F.exists(
        F.transform("sizes", lambda n, i: F.when(i == F.size("sizes") - 1, n > 5).otherwise(n != 5)), lambda b: b
    )
    reason = (
        F.when(F.col("raw_ink") == 0, "no ink").when(F.col("raw_ink") > MAX_INK, "too dense")
        .when(F.col("clipped"), "runs off the strip").when(F.col("ink") == 0, "no ink")
        .when(n_strokes < 1, "no strokes")
        .when(F.exists("strokes", lambda s: s["overrun"] >= escape) if escape > 0 else F.lit(False), "ink continues past the row")
        .when(_most(tilt) - _least(tilt) > MAX_ANGLE_SPREAD, "strokes not parallel")
        .when(_most(feet) - _least(feet) > F.col("typical") * F.lit(BASELINE_TOLERANCE), "no common baseline")
        .when(explained < MIN_EXPLAINED, "unexplained ink").when(ragged, "ragged groups").otherwise("")
    )
    x = x.withColumn("reason", reason).withColumn("explained", explained)
    count = F.when(F.col("reason") == "", _sum(F.transform("sizes", lambda n: n.cast("bigint"))))
    looked = ~F.col("reason").isin("no ink", "too dense", "runs off the strip", "no strokes")
    x = x.withColumn("count", count)
    return x.select(
        "strip", "count", "reason",
        F.when(looked, strokes).otherwise(0).cast("bigint").alias("strokes"),
        F.when(F.col("reason").isin("unexplained ink", "ragged groups", ""), F.size("good")).otherwise(0).cast("bigint").alias("bars"),
        F.when(F.col("reason").isin("unexplained ink", "ragged groups", ""),
               F.array_join(F.transform("sizes", lambda n: n.cast("string")), ",")).otherwise("").alias("group_sizes"),
        F.when(F.col("reason").isin("unexplained ink", "ragged groups", ""), F.col("explained")).otherwise(0.0).alias("explained"),
        F.when(F.col("count").isNotNull(), tally_confidence(F.col("count"), F.col("explained"))).otherwise(0.0).alias("confidence"),
    )


def escape_bar(strip_height: int) -> int:
    """Lines of ink above the row from which on a stroke is another row's."""
    return int(strip_height * ROW_ESCAPE + 0.5)


def row_overrun(
    strokes: DataFrame, context: DataFrame, strip_top: int, *, slack: int = ESCAPE_SLACK, gap: int = ESCAPE_GAP
) -> DataFrame:
    """Strokes with `overrun`: the lines above `strip_top` that each one's ink carries on through without a break.

    `strokes` (strip, k, angle, min_y, max_y, mid_x) are in the frame of `context`, the 0/1 lines (strip, y, px) of the strip and
    of what lies around it, one a line without gaps. Ink is followed line by line upwards from the stroke's own end, to the
    nearest set pixel within `slack` columns of the last one; after more than `gap` lines without any the stroke has ended.
    Only lines passed above the strip's edge count, so a mark that stands by itself over the row is never reached. A stroke that
    lies flat, or without a context, has 0. A strip's lines are bounded by paper and meet its strokes in one row.
    """
    lines = context.groupBy("strip").agg(F.array_sort(F.collect_list(F.struct("y", "px"))).alias("_l"))
    lines = lines.select(F.col("strip").alias("_strip"), F.get("_l", F.lit(0))["y"].alias("_first"), F.col("_l.px").alias("_px"))
    sin, cos = F.round(F.sin(F.radians("angle")), 12), F.round(F.cos(F.radians("angle")), 12)
    start = F.floor(F.col("mid_x") + (F.col("min_y") - (F.col("min_y") + F.col("max_y")) / 2) * cos / sin + F.lit(0.5))
    first = F.struct(start.cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("run"), F.lit(0).alias("missed"))

    def up(s: Column, y: Column) -> Column:
        line = F.get("_px", (y - F.col("_first")).cast("int"))

        def at(x: Column) -> Column:
            return F.when((x >= 0) & (F.get(line, x.cast("int")) != 0), x)

        near = [s["x"], *(s["x"] + d * side for d in range(1, slack + 1) for side in (-1, 1))]
        found = F.when(s["missed"] <= gap, F.coalesce(*map(at, near)))
        hit = found.isNotNull()
        return F.struct(
            F.coalesce(found, s["x"]).alias("x"), (s["run"] + F.when(hit & (y < strip_top), 1).otherwise(0)).alias("run"),
            F.when(hit, 0).otherwise(s["missed"] + 1).alias("missed"),
        )

    above = F.sequence(F.col("min_y") - 1, F.col("_first"), F.lit(-1).cast("bigint"))
    traced = F.when((F.abs(sin) >= 1e-3) & (F.col("min_y") > F.col("_first")), F.aggregate(above, first, up)["run"])
    joined = strokes.join(lines, F.col("strip") == F.col("_strip"), "left")
    return joined.select(*strokes.columns, F.coalesce(traced, F.lit(0).cast("bigint")).alias("overrun"))


def decline_reasons(tallies: DataFrame) -> DataFrame:
    """How often each reason to decline came up."""
    return tallies.filter(F.col("count").isNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def strongest_line(
    ink: DataFrame, *, half_band: int = 2, step: int = ANGLE_STEP, max_gap: float = MAX_GAP,
    min_length: float = MIN_LENGTH, min_members: int = MIN_MEMBERS, max_ink: int = MAX_INK,
) -> DataFrame:
    """The longest unbroken straight run of ink per page: `(page, angle, band, length, reason)`.

    `ink` is `(page, x, y)`. Every page with ink has a row. A page denser than `max_ink` is declined
    as 'too dense' and one without a run as 'no line', with nulls; so what is voted on fits one row. Opening every pixel to every angle and band would carry the ink
    through a shuffle more than a hundred times over; gathered once, it is voted on in Arrow
    batches. Of equal runs the first angle and band wins.
    """
    counts = ink.groupBy("page").agg(F.count(F.lit(1)).alias("n"))
    few = counts.filter(F.col("n") <= max_ink).select("page")
    packed = ink.join(few, "page", "left_semi").groupBy("page").agg(
        F.collect_list(F.col("x").cast("int")).alias("x"), F.collect_list(F.col("y").cast("int")).alias("y")
    )
    angles = np.arange(0, 180, step)
    cos, sin = np.round(np.cos(np.deg2rad(angles)), 12), np.round(np.sin(np.deg2rad(angles)), 12)
    around = np.arange(-half_band, half_band + 1)

    def longest(x: np.ndarray, y: np.ndarray) -> tuple[int, int, float] | None:
        u = np.round(x * cos[:, None] + y * sin[:, None], 6)
        band = np.floor(y * cos[:, None] - x * sin[:, None] + 0.5).astype(np.int64)
        a = np.repeat(np.arange(len(angles)), len(x) * len(around))
        b = (band[:, :, None] + around).ravel()
        u = np.repeat(u.ravel(), len(around))
        order = np.lexsort((u, b, a))
        a, b, u = a[order], b[order], u[order]
        new_band = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        new_run = new_band | np.r_[True, u[1:] - u[:-1] > max_gap]
        starts = np.flatnonzero(new_run)
        ends = np.r_[starts[1:], len(u)] - 1
        members = np.diff(np.r_[np.flatnonzero(new_band), len(u)])[np.cumsum(new_band)[starts] - 1]
        span = np.where(members >= min_members, np.round(u[ends] - u[starts], 6), -1.0)
        k = int(np.argmax(span))
        return (int(angles[a[starts[k]]]), int(b[starts[k]]), float(span[k])) if span[k] >= min_length else None

    def run(batches):
        for pdf in batches:
            found = [(p, longest(x, y)) for p, x, y in zip(pdf["page"], pdf["x"], pdf["y"], strict=True)]
            yield pd.DataFrame([(p, *f) for p, f in found if f], columns=["page", "angle", "band", "length"])

    lines = packed.mapInPandas(run, "page bigint, angle bigint, band bigint, length double")
    reason = F.when(F.col("n") > max_ink, "too dense").when(F.col("angle").isNull(), "no line").otherwise("")
    return counts.join(lines, "page", "left").select("page", "angle", "band", "length", reason.alias("reason"))


def vertical_rules(mask: DataFrame, width: int, height: int) -> DataFrame:
    """Columns of a strip that hold a printed vertical line: `(page, x)`.

    A column inked through the top or bottom margin, crowded lines aside, in a run no wider
    than a rule; two columns either side go with it.
    """
    margin = int(height * RULE_MARGIN + 0.5)
    inked = F.aggregate("px", F.lit(0).cast("bigint"), lambda a, v: a + v)
    part = F.when(F.col("y") < margin, 0).when(F.col("y") >= height - margin, 1)
    calm = mask.withColumn("part", part).filter(F.col("part").isNotNull() & (inked < width * RULE_CROWD))
    cols = calm.select("page", "part", F.posexplode("px").alias("i", "v")).groupBy("page", "part", "i").agg(
        F.sum("v").alias("n"), F.count(F.lit(1)).alias("rows")
    )
    full = cols.filter(
        (F.col("rows") >= max(4.0, margin * RULE_EVIDENCE)) & (F.col("n") >= F.col("rows") * F.lit(RULE_COVERAGE))
    ).select("page", F.col("i").cast("bigint").alias("i")).distinct()
    thin = thin_runs(full, ["page"], RULE_WIDTH)
    return thin.select(
        "page", F.explode(F.sequence(F.col("i") - RULE_FRINGE, F.col("i") + RULE_FRINGE)).alias("x")
    ).distinct()


def touches_side(mask: DataFrame, rules: DataFrame, width: int, edge: int = 3) -> DataFrame:
    """Does ink sit against the left or right side, columns of printed rules aside?"""
    sides = mask.select("page", F.posexplode("px").alias("x", "v")).filter(
        (F.col("v") != 0) & ((F.col("x") < edge) | (F.col("x") >= width - edge))
    ).select("page", F.col("x").cast("bigint").alias("x"))
    free = sides.join(rules, ["page", "x"], "left_anti").groupBy("page").agg(
        F.count_if(F.col("x") < edge).alias("left_ink"), F.count_if(F.col("x") >= width - edge).alias("right_ink")
    )
    all_pages = mask.select("page").distinct()
    x = all_pages.join(free, "page", "left").na.fill(0, ["left_ink", "right_ink"])
    return x.withColumn("touches", (F.col("left_ink") >= EDGE_INK) | (F.col("right_ink") >= EDGE_INK))
