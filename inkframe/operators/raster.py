"""Page rasters as scanline tables `(page, y, px ARRAY<SMALLINT>)`, 0 black to 255 paper.

Row-wise work stays inside a line's array and needs no shuffle. Work across lines uses windows
ordered by `y` within a page, whose size is the page height, never the corpus.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import half_up

def _by_y():
    return Window.partitionBy("page").orderBy("y")


def _at(arr: Column, i: Column) -> Column:
    """Element `i` (0-based), null outside."""
    return F.when(i >= 0, F.get(arr, i.cast("int")))


def _total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0).cast("bigint"), lambda a, v: a + v)


# ---------------------------------------------------------------- profiles
def row_profile(lines: DataFrame, x0: int = 0, x1: int | None = None) -> DataFrame:
    """Mean darkness per line over columns `x0..x1-1`. No shuffle."""
    part = F.slice("px", x0 + 1, (F.lit(x1) if x1 else F.size("px")) - x0)
    return lines.select(
        "page", F.col("y").alias("i"), ((F.size(part) * 255 - _total(part)) / F.size(part)).alias("v")
    )


def col_profile(lines: DataFrame, y0: int = 0, y1: int | None = None) -> DataFrame:
    """Mean darkness per column over lines `y0..y1-1`; summed before it is shuffled."""
    part = lines.filter(F.col("y") >= y0)
    if y1 is not None:
        part = part.filter(F.col("y") < y1)
    return (
        part.select("page", F.posexplode("px").alias("i", "p"))
        .groupBy("page", F.col("i").cast("bigint").alias("i"))
        .agg((F.sum(F.lit(255).cast("bigint") - F.col("p")) / F.count(F.lit(1))).alias("v"))
    )


def decimate(profile: DataFrame, factor: int = 4) -> DataFrame:
    """Box averages of `factor` neighbours; an incomplete last box is dropped."""
    return (
        profile.groupBy("page", F.floor(F.col("i") / factor).cast("bigint").alias("i"))
        .agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") == factor).drop("_n")
    )


# ---------------------------------------------------------------- rectangles
def clamped(rects: DataFrame) -> DataFrame:
    """Whole-pixel bounds of `(x, y, w, h)`, cut at zero; the far side is cut by the page itself."""
    return (
        rects.withColumn("x0", F.greatest(F.lit(0), F.floor("x")).cast("bigint"))
        .withColumn("y0", F.greatest(F.lit(0), F.floor("y")).cast("bigint"))
        .withColumn("x1", F.ceil(F.col("x") + F.col("w")).cast("bigint"))
        .withColumn("y1", F.ceil(F.col("y") + F.col("h")).cast("bigint"))
    )


def _dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    return df if tasks is None else df.repartition(tasks, *keys)


def ink_fraction(lines: DataFrame, rects: DataFrame, threshold: int = 170, tasks: int | None = None) -> DataFrame:
    """Share of pixels darker than `threshold` per `(page, cell)`.

    Rectangles are opened to one row per line they touch, so the join is on `(page, y)`;
    pixels outside the rectangles are never exploded. `tasks` are those that lines and cells are dealt to, else the session's.
    """
    touched = clamped(rects).filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))).select(
        "page", "cell", "x0", "x1", F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y")
    )
    part = F.slice("px", F.col("x0").cast("int") + 1, (F.col("x1") - F.col("x0")).cast("int"))
    counts = (
        _dealt(touched, tasks, "page", "y").join(_dealt(lines, tasks, "page", "y"), ["page", "y"])
        .select("page", "cell", F.size(part).alias("n"), F.size(F.filter(part, lambda v: v < threshold)).alias("dark"))
    )
    counts = (
        _dealt(counts, tasks, "page", "cell").groupBy("page", "cell").agg(F.sum("dark").alias("dark"), F.sum("n").alias("n"))
    )
    fraction = F.when(F.coalesce("n", F.lit(0)) > 0, F.col("dark") / F.col("n")).otherwise(0.0)
    return _dealt(rects.select("page", "cell"), tasks, "page", "cell").join(counts, ["page", "cell"], "left").select(
        "page", "cell", F.round(fraction, 9).alias("ink")
    )


def without_excluded(rects: DataFrame, exclusions: DataFrame, tile: int = 16) -> DataFrame:
    """Drop rectangles overlapping an exclusion on their page (touching edges do not count).

    Both sides are laid on tiles and met by equality on `(page, tile)`; the exact test is a
    condition of that join.
    """
    def tiles(df: DataFrame, x: str, y: str, w: str, h: str) -> DataFrame:
        def span(a: str, b: str) -> Column:
            first = F.floor(F.col(a) / tile)
            last = F.floor((F.col(a) + F.col(b)) / tile)
            return F.sequence(first, F.greatest(first, last))

        return df.withColumn("tx", F.explode(span(x, w))).withColumn("ty", F.explode(span(y, h)))

    ex = exclusions.select("page", *[F.col(c).alias(f"e{c}") for c in "xywh"])
    hit = (
        (F.col("x") < F.col("ex") + F.col("ew")) & (F.col("x") + F.col("w") > F.col("ex"))
        & (F.col("y") < F.col("ey") + F.col("eh")) & (F.col("y") + F.col("h") > F.col("ey"))
    )
    laid = tiles(rects, "x", "y", "w", "h")
    bad = laid.join(tiles(ex, "ex", "ey", "ew", "eh"), ["page", "tx", "ty"]).filter(hit)
    return rects.join(bad.select("page", "cell").distinct(), ["page", "cell"], "left_anti")


def crop_region(cells: DataFrame, page_w: int, page_h: int, margin: int = 16) -> DataFrame:
    """The piece of page shown for a cell, and the TOTAL box in its coordinates."""
    c = F.col
    left = F.least(c("tally_x"), c("total_x")) - margin
    right = c("total_x") + c("total_w") * F.lit(1.15) + margin
    top = F.least(c("tally_y"), c("total_y")) - margin
    bottom = F.greatest(c("tally_y") + c("tally_h"), c("total_y") + c("total_h")) + margin
    x = F.greatest(F.lit(0), F.floor(left)).cast("bigint")
    y = F.greatest(F.lit(0), F.floor(top)).cast("bigint")
    return cells.select(
        "page", "cell", x.alias("x"), y.alias("y"),
        (F.least(F.lit(page_w), F.ceil(right)) - x).cast("bigint").alias("w"),
        (F.least(F.lit(page_h), F.ceil(bottom)) - y).cast("bigint").alias("h"),
        (c("total_x") - x).alias("box_x"), (c("total_y") - y).alias("box_y"),
        half_up(c("tally_h") * F.lit(0.6)).alias("context_margin"),
    )


def alignment_window(cells: DataFrame, page_w: int, page_h: int, pad: int = 72, side: int = 8) -> DataFrame:
    """Bounds of a page's cells, padded up by `pad` and by `side` elsewhere, cut at the page."""
    c = F.col
    g = cells.groupBy("page").agg(
        F.min(F.least("total_x", "tally_x")).alias("_x0"), F.min(F.least("total_y", "tally_y")).alias("_y0"),
        F.max(F.greatest(c("total_x") + c("total_w"), c("tally_x") + c("tally_w"))).alias("_x1"),
        F.max(F.greatest(c("total_y") + c("total_h"), c("tally_y") + c("tally_h"))).alias("_y1"),
    )
    x, y = F.greatest(F.lit(0), c("_x0") - side), F.greatest(F.lit(0), c("_y0") - pad)
    return g.select(
        "page", x.alias("x"), y.alias("y"), (F.least(F.lit(page_w), c("_x1") + side) - x).alias("w"),
        (F.least(F.lit(page_h), c("_y1") + side) - y).alias("h"),
    )


def block_spans(cells: DataFrame) -> DataFrame:
    """x-span of each printed block of a page."""
    return cells.groupBy("page", F.col("printed_column").alias("block")).agg(
        F.min("tally_x").alias("x0"), F.max(F.col("total_x") + F.col("total_w")).alias("x1")
    )


# ---------------------------------------------------------------- grey levels
def histogram(lines: DataFrame) -> DataFrame:
    """`(page, v, n, seen, total)`: at most 256 rows per page, counted before the shuffle."""
    h = lines.select("page", F.explode("px").alias("v")).groupBy("page", "v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("page").orderBy("v")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return h.select(
        "page", F.col("v").cast("bigint").alias("v"), "n", F.sum("n").over(upto).alias("seen"),
        F.sum("n").over(Window.partitionBy("page")).alias("total"),
        F.sum(F.col("v").cast("bigint") * F.col("n")).over(upto).alias("weighted"),
        F.sum(F.col("v").cast("bigint") * F.col("n")).over(Window.partitionBy("page")).alias("all_weighted"),
    )


def paper_level(lines: DataFrame) -> DataFrame:
    """First level whose cumulative count passes half the pixels."""
    h = histogram(lines)
    return h.filter(F.col("seen") > F.floor(F.col("total") / 2)).groupBy("page").agg(F.min("v").alias("paper"))


def _between() -> Column:
    w_b, w_f = F.col("seen"), F.col("total") - F.col("seen")
    m_b = F.col("weighted") / w_b
    m_f = (F.col("all_weighted") - F.col("weighted")) / F.nullif(w_f, F.lit(0))
    return w_b * w_f * (m_b - m_f) * (m_b - m_f)


def _otsu() -> Column:
    """Best-separating level of a page's histogram rows; 0 where there is only one level."""
    scored = F.struct(F.round(_between(), 6).alias("b"), (-F.col("v")).alias("m"))
    return F.coalesce(-F.max(F.when(_between().isNotNull(), scored))["m"], F.lit(0))


def otsu_threshold(lines: DataFrame) -> DataFrame:
    """Level separating ink from paper best; the first of equals."""
    return histogram(lines).groupBy("page").agg(_otsu().alias("otsu"))


def ink_threshold(lines: DataFrame) -> DataFrame:
    """Relative threshold: -1 where a page has no contrast. One histogram serves all three levels."""
    def stat(rank: Column) -> Column:
        return F.min(F.when(F.col("seen") > rank, F.col("v")))

    levels = histogram(lines).groupBy("page").agg(
        stat(F.floor(F.col("total") / 2)).alias("paper"),
        stat(F.floor(F.col("total") * F.lit(0.02))).alias("dark"), _otsu().alias("otsu"),
    )
    limit = F.greatest(F.lit(30), F.least(F.col("paper") - 45, F.col("otsu"), F.lit(200)))
    return levels.withColumn("threshold", F.when(F.col("paper") - F.col("dark") < 25, -1).otherwise(limit))


def composite(lines: DataFrame, group: Column, quantile: float, tasks: int | None = None) -> DataFrame:
    """Order statistic per pixel over all pages of a group: `(grp, y, x, v)`.

    Pixels are counted by level first, so a group of any number of pages comes down to at
    most 256 rows per pixel. With `tasks`, a group's lines of one height meet before they are opened, dealt to that many.
    """
    counts = (
        _dealt(lines.select(group.alias("grp"), "y", "px"), tasks, "grp", "y").select("grp", "y", F.posexplode("px").alias("x", "v"))
        .groupBy("grp", "y", F.col("x").cast("bigint").alias("x"), F.col("v").cast("bigint").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    at = Window.partitionBy("grp", "y", "x")
    k = F.sum("n").over(at)
    seen = F.sum("n").over(at.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    rank = F.least(k - 1, F.floor(k * F.lit(quantile)).cast("bigint"))
    return (
        counts.withColumn("_seen", seen).withColumn("_rank", rank)
        .filter(F.col("_seen") > F.col("_rank"))
        .groupBy("grp", "y", "x").agg(F.min("v").alias("v"))
    )


# ---------------------------------------------------------------- banners and masks
def banner_rows(lines: DataFrame, blocks: DataFrame, frac: float = 0.5) -> DataFrame:
    """`(page, block, y, banner)`: lines of a block darker than paper for more than half of it."""
    ink = F.greatest(F.lit(60), F.col("paper") - 60)
    part = F.slice("px", F.col("x0").cast("int") + 1, (F.col("x1") - F.col("x0")).cast("int"))
    dark = F.size(F.filter(part, lambda v: v < ink))
    x = lines.join(paper_level(lines), "page").join(blocks, "page")
    return x.select(
        "page", "block", "y", (dark > (F.col("x1") - F.col("x0")) * F.lit(frac)).alias("banner")
    )


def mask_overlap(a: DataFrame, b: DataFrame, keys: list[str], position: list[str], over: DataFrame) -> DataFrame:
    """Two sets of positions for each key of `over`: what both have, either has, only the first has, and the share.

    A key of which both are empty has a share of 1.
    """
    both = a.select(*keys, *position, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*keys, *position, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    ).groupBy(*keys, *position).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    sums = both.groupBy(*keys).agg(
        F.sum(F.col("_a") * F.col("_b")).alias("inter"), F.count(F.lit(1)).alias("uni"),
        F.sum(F.col("_a") * (1 - F.col("_b"))).alias("minus"),
    )
    filled = over.select(*keys).distinct().join(sums, keys, "left").na.fill(0, ["inter", "uni", "minus"])
    return filled.withColumn("iou", F.when(F.col("uni") == 0, 1.0).otherwise(F.round(F.col("inter") / F.col("uni"), 6)))


def banner_overlap(banners: DataFrame, reference: DataFrame) -> DataFrame:
    """Page score: the worst block's overlap with the blank form; 0 where no block has a banner.

    `banners` is `(page, block, y, banner)`, `reference` is `(block, y, banner)` of the blank.
    """
    ref = reference.select("block", "y", F.col("banner").alias("_ref"))
    x = banners.join(ref, ["block", "y"])
    a, b = F.col("banner"), F.col("_ref")
    per_block = x.groupBy("page", "block").agg(
        F.count_if(a & b).alias("i"), F.count_if(a | b).alias("u"), F.bool_or(b).alias("checked")
    ).withColumn("iou", F.when(F.col("u") > 0, F.col("i") / F.col("u")).otherwise(1.0))
    return per_block.groupBy("page").agg(
        F.round(F.coalesce(F.min(F.when(F.col("checked"), F.col("iou"))), F.lit(0.0)), 6).alias("overlap")
    )


def classify_side(lines: DataFrame, threshold: int = 150) -> DataFrame:
    """Cheap side guess from two bands of the page, and whether they agree. One pass over the lines."""
    w, h = F.size("px"), F.col("_h")
    x0, x1 = F.floor(w * F.lit(0.05)).cast("int"), F.least(w, F.ceil(w * F.lit(0.05) + w * F.lit(0.9)).cast("int"))
    part = F.slice("px", x0 + 1, x1 - x0)
    x = lines.select(
        "page", "y", F.count(F.lit(1)).over(Window.partitionBy("page")).alias("_h"), F.size(part).alias("n"),
        F.size(F.filter(part, lambda v: v < threshold)).alias("dark"),
    )

    def band(f0: float, f1: float) -> Column:
        top = h * F.lit(f0)
        inside = (F.col("y") >= F.floor(top)) & (F.col("y") < F.ceil(top + h * F.lit(f1 - f0)))
        share = F.sum(F.when(inside, F.col("dark"))) / F.sum(F.when(inside, F.col("n")))
        return F.round(F.coalesce(share, F.lit(0.0)), 9)

    g = x.groupBy("page").agg(band(0.04, 0.06).alias("banner"), band(0.9, 0.97).alias("footer"))
    by_banner = F.when(F.col("banner") > 0.45, "back").otherwise("front")
    by_footer = F.when(F.col("footer") > 0.05, "front").otherwise("back")
    return g.withColumn("side", by_banner).withColumn("agree", by_banner == by_footer)


def best_side(fits: DataFrame, bar: float = 0.75) -> DataFrame:
    """Choose among fit attempts `(page, attempt, side, turns, overlap)`.

    Attempt 0 is the guessed side, 1 the other, 2.. the turned ones. A later stage is asked
    only if what stands is under the bar, and replaces it only if strictly better.
    """
    def stage(cond: Column) -> Column:
        # The first of the best: highest overlap, then lowest attempt.
        return F.max(F.when(cond, F.struct(
            "overlap", (-F.col("attempt")).alias("m"), "side", "turns")))

    g = fits.groupBy("page").agg(
        stage(F.col("attempt") == 0).alias("own"), stage(F.col("attempt") == 1).alias("other"),
        stage(F.col("attempt") >= 2).alias("turned"),
    )
    def better(now: Column, later: Column) -> Column:
        return F.when((now["overlap"] < bar) & (later["overlap"] > now["overlap"]), later).otherwise(now)

    after = better(F.col("own"), F.col("other"))
    g = g.withColumn("_a", after).withColumn("_b", better(F.col("_a"), F.col("turned")))
    return g.select(
        "page", F.col("_b.side").alias("side"), F.col("_b.turns").alias("turns"),
        F.col("_b.overlap").alias("overlap"), (F.col("_b.overlap") >= bar).alias("trusted"),
    )


# ---------------------------------------------------------------- neighbourhoods
def _stack(col: str, r: int, combine) -> Column:
    """Fold the lines within `r` of each line, elementwise."""
    near = F.collect_list(col).over(_by_y().rowsBetween(-r, r))
    return F.aggregate(
        F.slice(near, 2, 2 * r + 1), F.element_at(near, 1), lambda acc, line: F.zip_with(acc, line, combine)
    )


def _along(df: DataFrame, col: str, r: int) -> DataFrame:
    """Maximum within `r` along the line, into `_m`: the window doubles, it is not rescanned."""
    pad = F.array_repeat(F.lit(0).cast("smallint"), r)
    x, size = df.withColumn("_m", F.concat(pad, F.col(col), pad)), 1
    while size < 2 * r + 1:
        step = min(size, 2 * r + 1 - size)
        ahead = F.slice("_m", step + 1, F.size("_m"))
        x = x.withColumn("_m", F.zip_with("_m", ahead, lambda a, b: F.greatest(a, b)))
        size += step
    return x.withColumn("_m", F.slice("_m", 1, F.size(col)))


def local_max(lines: DataFrame, r: int = 9) -> DataFrame:
    """Maximum filter of radius `r`, along lines and then across them."""
    rows = _along(lines, "px", r)
    return rows.select("page", "y", _stack("_m", r, lambda a, b: F.greatest(a, b)).alias("px"))


def dilate(mask: DataFrame, r: int = 2) -> DataFrame:
    """Grow a 0/1 mask by `r`; the same filter as `local_max`."""
    return local_max(mask, r)


def stencil3(lines: DataFrame) -> DataFrame:
    """3x3 blur with weights 1-2-1 by 1-2-1, outside counted as 0; truncated to whole levels."""
    px = F.col("px")
    along = F.transform(
        px, lambda v, i: F.coalesce(_at(px, i - 1), F.lit(0)) + v * 2 + F.coalesce(_at(px, i + 1), F.lit(0))
    )
    rows = lines.select("page", "y", along.alias("px"))
    zero = F.transform("px", lambda v: F.lit(0))
    up, down = F.coalesce(F.lag("px").over(_by_y()), zero), F.coalesce(F.lead("px").over(_by_y()), zero)
    x = rows.withColumn("_u", up).withColumn("_d", down)
    out = F.zip_with(
        F.zip_with("_u", "_d", lambda a, b: a + b), "px", lambda s, v: F.floor((s + v * 2) / 16).cast("bigint")
    )
    return x.select("page", "y", out.alias("px"))


def raw_ink(lines: DataFrame, depth: int = 22, window: int = 9) -> DataFrame:
    """1 where a pixel is at least `depth` below its local paper level.

    The line itself rides along with the filter, so nothing is joined back.
    """
    paper = _along(lines, "px", window).withColumn("_p", _stack("_m", window, lambda a, b: F.greatest(a, b)))
    ink = F.zip_with("_p", "px", lambda p, v: F.when(p - v >= depth, 1).otherwise(0).cast("smallint"))
    return paper.select("page", "y", ink.alias("px"))


def ink_mask(
    lines: DataFrame, *, depth: int = 22, window: int = 9, rule_frac: float = 0.5, rule_thick: int = 6,
    wall_frac: float = 0.5, wall_thick: int = 6, wall_edge: float = 0.25,
) -> DataFrame:
    """Ink with printed rules (thin dark lines) and walls (thin dark columns near a side) struck.

    Rules are found in the windows the lines already stand in. Walls need column sums, which
    come down to one short list per page before they are joined.
    """
    from .islands import thin_runs

    raw = raw_ink(lines, depth, window)
    dark = _total(F.col("px")) >= F.size("px") * F.lit(rule_frac)
    # Lines of one run of equal darkness share the count of changes before them.
    x = raw.withColumn("_dark", dark)
    x = x.withColumn("_turn", F.coalesce(F.col("_dark") != F.lag("_dark").over(_by_y()), F.lit(True)).cast("int"))
    x = x.withColumn("_run", F.sum("_turn").over(_by_y().rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("_long", F.count(F.lit(1)).over(Window.partitionBy("page", "_run")))
    x = x.withColumn("_rule", F.col("_dark") & (F.col("_long") <= rule_thick))
    cols = (
        raw.select("page", F.size("px").alias("w"), F.posexplode("px").alias("i", "v"))
        .groupBy("page", "i").agg(F.sum("v").alias("n"), F.count(F.lit(1)).alias("h"), F.max("w").alias("w"))
        .filter(F.col("n") >= F.col("h") * F.lit(wall_frac))
    )
    edge = F.greatest(F.lit(2), half_up(F.col("w") * F.lit(wall_edge)))
    walls = thin_runs(cols.select("page", F.col("i").cast("bigint").alias("i"), "w"), ["page"], wall_thick, carry=["w"])
    walls = walls.filter((F.col("start") < edge) | (F.col("end") >= F.col("w") - edge))
    walls = walls.groupBy("page").agg(F.collect_list("i").alias("_walls"))
    struck = F.transform(
        "px",
        lambda v, i: F.when(
            F.col("_rule") | F.coalesce(F.array_contains("_walls", i.cast("bigint")), F.lit(False)),
            F.lit(0).cast("smallint"),
        ).otherwise(v),
    )
    return x.join(walls, "page", "left").select("page", "y", struck.alias("px"))


# ---------------------------------------------------------------- geometry
def quarter_turn(lines: DataFrame, turns: int) -> DataFrame:
    """Exact clockwise quarter turns.

    A page's lines meet in one row and are read the other way; pixels are never rows.
    """
    t = turns % 4
    if t == 0:
        return lines
    ordered = F.array_sort(F.collect_list(F.struct("y", "px")))
    pages = lines.groupBy("page").agg(F.transform(ordered, lambda s: s["px"]).alias("_l"))
    pages = pages.withColumn("_w", F.size(F.get("_l", F.lit(0))))
    if t == 2:
        return pages.select("page", F.posexplode(F.reverse("_l")).alias("y", "px")).select(
            "page", F.col("y").cast("bigint").alias("y"), F.reverse("px").alias("px")
        )
    # One output line per source column: for one turn bottom to top, for three from the right.
    stack = F.reverse("_l") if t == 1 else F.col("_l")
    column = F.col("y") if t == 1 else F.col("_w") - 1 - F.col("y")
    opened = pages.select("page", stack.alias("_l"), "_w", F.explode(F.sequence(F.lit(0), F.col("_w") - 1)).alias("y"))
    return opened.select(
        "page", F.col("y").cast("bigint").alias("y"), F.transform("_l", lambda line: F.get(line, column)).alias("px")
    )


def _with_next(lines: DataFrame) -> DataFrame:
    return lines.withColumn("_next", F.lead("px").over(_by_y()))


def _mixed():
    """Pixels `lo..hi` of target lines, each mixed from two source lines, bilinear and truncated.

    Target pixel `i` lies at `cx + (i-cx)*c + kx` along the upper line `a` and `cy - (i-cx)*s + ky - y0`
    of the way to the lower line `b`. Whole Arrow batches are gathered at once.
    """
    @F.pandas_udf("array<smallint>")
    def mix(a: pd.Series, b: pd.Series, at: pd.DataFrame) -> pd.Series:
        lo, n = at["lo"].to_numpy(), (at["hi"] - at["lo"] + 1).to_numpy()
        both = (a.notna() & b.notna()).to_numpy()
        width = np.array([len(v) if ok else 0 for v, ok in zip(a, both, strict=True)])
        upper, lower = np.zeros((2, len(a), max(int(width.max(initial=0)), 2)))
        for r in np.flatnonzero(both):
            upper[r, : width[r]], lower[r, : width[r]] = a.iat[r], b.iat[r]
        row = np.repeat(np.arange(len(a)), n)
        ends = np.cumsum(n)
        i = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + lo[row]
        p = {c: at[c].to_numpy()[row] for c in ("cx", "c", "kx", "cy", "s", "ky", "y0")}
        x = p["cx"] + (i - p["cx"]) * p["c"] + p["kx"]
        y = p["cy"] - (i - p["cx"]) * p["s"] + p["ky"]
        x0 = np.floor(x).astype(np.int64)
        fx, fy = x - x0, y - p["y0"]
        inside = (x0 >= 0) & (x0 + 1 < width[row])
        x0 = np.where(inside, x0, 0)
        v = (
            upper[row, x0] * (1 - fx) * (1 - fy) + upper[row, x0 + 1] * fx * (1 - fy)
            + lower[row, x0] * (1 - fx) * fy + lower[row, x0 + 1] * fx * fy
        )
        out = np.where(inside, np.floor(v), 255).astype(np.int16)
        return pd.Series(np.split(out, ends[:-1]) if len(ends) else [], dtype=object)

    return mix


def resample(lines: DataFrame, fits: DataFrame, width: int, height: int) -> DataFrame:
    """Bring pages to reference size by per-axis `scale*i + offset`, bilinear, truncated.

    `fits` is `(page, sx, ox, sy, oy)`. Target lines meet the source line above them by equality;
    the line below came along in the same window. Outside the page is paper.
    """
    target = fits.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn(
        "_t", F.col("sy") * F.col("y") + F.col("oy")
    ).withColumn("_y0", F.floor("_t").cast("bigint"))
    source = _with_next(lines).select("page", F.col("y").alias("_y0"), F.col("px").alias("_a"), F.col("_next").alias("_b"))
    x = target.join(source, ["page", "_y0"], "left")
    zero = F.lit(0.0)
    at = F.struct(
        F.lit(0).alias("lo"), F.lit(width - 1).alias("hi"), zero.alias("cx"), F.col("sx").alias("c"), F.col("ox").alias("kx"),
        zero.alias("cy"), zero.alias("s"), F.col("_t").alias("ky"), F.col("_y0").cast("double").alias("y0"),
    )
    return x.select("page", F.col("y").cast("bigint").alias("y"), _mixed()("_a", "_b", at).alias("px"))


def rotate(lines: DataFrame, angles: DataFrame) -> DataFrame:
    """Small rotation about the page centre, bilinear, truncated; `angles` is `(page, deg)`.

    A target line crosses few source lines. It is cut where the source line changes, each piece
    meets its source line by equality, and the pieces are put together again in order.
    """
    size = lines.groupBy("page").agg(F.count(F.lit(1)).alias("h"), F.max(F.size("px")).alias("w"))
    geo = angles.join(size, "page").select(
        "page", "h", "w", F.cos(F.radians("deg")).alias("c"), F.sin(F.radians("deg")).alias("s"),
        (F.col("w") / 2).alias("cx"), (F.col("h") / 2).alias("cy"),
    )
    ky = (F.col("y") - F.col("cy")) * F.col("c")
    sy = F.col("cy") - (F.col("x") - F.col("cx")) * F.col("s") + ky
    target = geo.withColumn("y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("h") - 1))).withColumn(
        "x", F.explode(F.sequence(F.lit(0), F.col("w") - 1))
    )
    pieces = target.groupBy("page", "y", F.floor(sy).cast("bigint").alias("_y0")).agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), *[F.first(c).alias(c) for c in ("c", "s", "cx", "cy")]
    )
    source = _with_next(lines).select("page", F.col("y").alias("_y0"), F.col("px").alias("_a"), F.col("_next").alias("_b"))
    at = F.struct(
        "lo", "hi", "cx", "c", ((F.col("y") - F.col("cy")) * F.col("s")).alias("kx"), "cy", "s", ky.alias("ky"),
        F.col("_y0").cast("double").alias("y0"),
    )
    part = pieces.join(source, ["page", "_y0"], "left").select("page", "y", "lo", _mixed()("_a", "_b", at).alias("_p"))
    line = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("lo", "_p"))), lambda s: s["_p"]))
    return part.groupBy("page", "y").agg(line.alias("px"))


def moments(lines: DataFrame) -> DataFrame:
    """Ink mass (255-v), centre and shear of each page, from sums taken per line. A page without ink has no centre and no shear."""
    ink = F.transform("px", lambda v: F.lit(255).cast("bigint") - v)
    per_line = lines.select(
        "page", "y", _total(ink).alias("s"), _total(F.transform(ink, lambda v, i: v * i)).alias("sx")
    )
    g = per_line.groupBy("page").agg(
        F.sum("s").alias("mass"), F.sum("sx").alias("_sx"), F.sum(F.col("s") * F.col("y")).alias("_sy"),
        F.sum(F.col("sx") * F.col("y")).alias("_sxy"), F.sum(F.col("s") * F.col("y") * F.col("y")).alias("_syy"),
    )
    cx, cy = (F.when(F.col("mass") > 0, F.col(c) / F.col("mass")) for c in ("_sx", "_sy"))
    g = g.withColumn("_safe", F.greatest("mass", F.lit(1)))
    mu11 = F.col("_sxy") - F.col("_sx") * F.col("_sy") / F.col("_safe")
    mu02 = F.col("_syy") - F.col("_sy") * F.col("_sy") / F.col("_safe")
    return g.select(
        "page", "mass", F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"),
        F.round(F.when(mu02 > 1e-6, mu11 / mu02).otherwise(0.0), 6).alias("skew"),
    )


# ---------------------------------------------------------------- alignment
def skew_angle(lines: DataFrame, width: int, height: int, max_deg: float = 2.0, step: float = 0.1, sub: int = 4) -> DataFrame:
    """Angle whose sheared row profile varies most; the first of equals.

    A page's lines, thinned to every `sub`-th pixel, meet in one row: one shuffle of a sixteenth of
    the raster, where a row per line and angle would be several times the raster. Under one
    angle all pixels between two columns move by the same number of rows, so each angle
    is a few differences of running sums. Sums are whole numbers, so equal is equal.
    """
    w, h = width // sub, height // sub
    steps = int(round(2 * max_deg / step)) + 1
    moves = []
    for k in range(steps):
        shift = np.floor((np.arange(w) - w / 2) * np.tan(np.deg2rad(-max_deg + k * step)) + 0.5).astype(int)
        cuts = np.flatnonzero(np.r_[True, np.diff(shift) != 0, True])
        moves.append([(int(shift[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    def scores(ink: np.ndarray) -> tuple[int, int]:
        sums = np.concatenate([np.zeros((h, 1), np.int64), np.cumsum(ink, axis=1)], axis=1)
        best = (-1, 0)
        for k, parts in enumerate(moves):
            rows = np.zeros(h, np.int64)
            for s, a, b in parts:
                if abs(s) < h:
                    rows[max(s, 0) : h + min(s, 0)] += (sums[:, b] - sums[:, a])[max(-s, 0) : h - max(s, 0)]
            score = int((rows * rows).sum() * h - rows.sum() ** 2)
            best = max(best, (score, -k))
        return best

    def run(batches):
        for pdf in batches:
            found = [scores(255 - np.asarray(px, np.int64).reshape(h, w)) for px in pdf["px"]]
            yield pd.DataFrame({
                "page": pdf["page"], "deg": [round(-max_deg - k * step, 6) for _, k in found], "score": [v for v, _ in found],
            })

    thin = F.slice(F.filter("px", lambda v, i: i % sub == 0), 1, w) if sub > 1 else F.col("px")
    small = lines.filter((F.col("y") % sub == 0) & (F.col("y") < h * sub)).select("page", "y", thin.alias("px"))
    ordered = F.array_sort(F.collect_list(F.struct("y", "px")))
    packed = small.groupBy("page").agg(F.flatten(F.transform(ordered, lambda s: s["px"])).alias("px"))
    return packed.mapInPandas(run, "page bigint, deg double, score bigint")


def profile_arrays(profile: DataFrame, name: str = "a") -> DataFrame:
    """A page's profile as one array, in order. Its length is the page's, so one row holds it."""
    ordered = F.array_sort(F.collect_list(F.struct("i", "v")))
    return profile.groupBy("page").agg(F.transform(ordered, lambda s: s["v"]).alias(name))


def _scores(ref: np.ndarray, page: np.ndarray, i0: int, i1: int, scale: float, offsets: np.ndarray) -> np.ndarray:
    """Correlation of a reference window with the page sampled at `scale*i + offset`, per offset."""
    t = scale * np.arange(i0, i1)[None, :] + offsets[:, None]
    t0 = np.floor(t).astype(int)
    ok = (t0 >= 0) & (t0 + 1 < len(page))
    t0 = np.clip(t0, 0, max(len(page) - 2, 0))
    f = t - np.floor(t)
    b = np.where(ok, page[t0] * (1 - f) + page[t0 + 1] * f, 0.0)
    a = np.where(ok, ref[i0:i1][None, :], 0.0)
    n = ok.sum(axis=1)
    with np.errstate(all="ignore"):
        cov = (a * b).sum(1) - a.sum(1) * b.sum(1) / n
        var = ((a * a).sum(1) - a.sum(1) ** 2 / n) * ((b * b).sum(1) - b.sum(1) ** 2 / n)
        score = np.where(var > 1e-9, cov / np.sqrt(np.maximum(var, 1e-300)), -1.0)
    # Rounded, so that equal fits tie and the first of them is kept.
    return np.where(n < (i1 - i0) * 0.6, -1.0, np.round(score, 9))


def _search(ref, page, i0, i1, scales, offsets, unit: float) -> tuple[float, float, float]:
    grid = np.stack([_scores(ref, page, i0, i1, s, offsets / unit) for s in scales])
    k = int(np.argmax(grid))
    return scales[k // len(offsets)], offsets[k % len(offsets)], float(grid.flat[k])


def fit_axis(
    pairs: DataFrame, i0: int, i1: int, *, max_scale: float = 0.06, scale_step: float = 0.004,
    max_offset: float = 360, coarse: int = 4, fine_scale: float = 0.005, fine_scale_step: float = 0.0005,
    fine_offset: float = 8, fine_offset_step: float = 0.5,
) -> DataFrame:
    """`(page, ref, v)` arrays to the best `(scale, offset, score)`, coarse grid and then fine.

    The grid has thousands of points per page and each needs the whole profile, so opening it to
    rows would multiply the data by the grid. A page's two profiles sit in one row; the grid is
    scored on them in Arrow batches, and nothing is shuffled.
    """
    def box(a: np.ndarray) -> np.ndarray:
        n = len(a) // coarse
        return a[: n * coarse].reshape(n, coarse).mean(axis=1)

    def run(batches):
        coarse_scales = 1 - max_scale + scale_step * np.arange(int(round(2 * max_scale / scale_step)) + 1)
        coarse_offsets = np.arange(-max_offset, max_offset + 1e-9, coarse)
        ds = fine_scale_step * np.arange(-round(fine_scale / fine_scale_step), round(fine_scale / fine_scale_step) + 1)
        do = fine_offset_step * np.arange(-round(fine_offset / fine_offset_step), round(fine_offset / fine_offset_step) + 1)
        for pdf in batches:
            out = []
            for page, ref, v in zip(pdf["page"], pdf["ref"], pdf["v"], strict=True):
                ref, v = np.asarray(ref), np.asarray(v)
                s, o, _ = _search(box(ref), box(v), i0 // coarse, i1 // coarse, coarse_scales, coarse_offsets, coarse)
                out.append((page, *_search(ref, v, i0, i1, s + ds, o + do, 1)))
            yield pd.DataFrame(out, columns=["page", "scale", "offset", "score"])

    return pairs.select("page", "ref", "v").mapInPandas(run, "page bigint, scale double, offset double, score double")


def best_shift(pairs: DataFrame, max_shift: int = 40) -> DataFrame:
    """Whole shift maximising the product of two normalised profiles; the first of equals.

    Both profiles of a page sit in one row, so all shifts are one correlation, and no shuffle.
    """
    def unit(a) -> np.ndarray:
        a = np.asarray(a) - np.mean(a)
        return a / (np.sqrt((a * a).sum()) or 1.0)

    def run(batches):
        for pdf in batches:
            out = []
            for page, ref, v in zip(pdf["page"], pdf["ref"], pdf["v"], strict=True):
                a, b = unit(ref), unit(v)
                full = np.round(np.correlate(b, a, "full"), 9)  # entry len(a)-1 is shift 0
                lo, hi = max(-max_shift, 1 - len(a)), min(max_shift, len(b) - 1)
                part = full[len(a) - 1 + lo : len(a) + hi]
                k = int(np.argmax(part))
                out.append((page, k + lo, float(part[k])))
            yield pd.DataFrame(out, columns=["page", "shift", "score"])

    found = pairs.select("page", "ref", "v").mapInPandas(run, "page bigint, shift bigint, score double")
    return found.withColumn("score", F.round("score", 6))


# ---------------------------------------------------------------- digits
def normalise(ink: DataFrame, inner: int = 20, side: int = 28) -> DataFrame:
    """Set pixels `(page, x, y)` to a `side` by `side` coverage bitmap `(page, x, y, v)`.

    The ink's bounding box is scaled to fit `inner`, each target cell takes the covered share of
    its source cells, and the centre of mass goes to the middle. A digit's pixels are
    shuffled once: its box and its mass are windows over them, not joins.
    """
    c = F.col
    page = Window.partitionBy("page")
    x = ink
    for axis, size in (("x", "w"), ("y", "h")):
        x = x.withColumn(f"_{axis}0", F.min(axis).over(page)).withColumn(
            size, F.max(axis).over(page) - F.min(axis).over(page) + 1
        )
    scale = F.lit(float(inner)) / F.greatest("w", "h")
    for target, size in (("tw", "w"), ("th", "h")):
        x = x.withColumn(target, F.greatest(F.lit(1), half_up(c(size) * scale)))

    def cells(axis: str, size: str, target: str) -> Column:
        """Target cells a source position falls into: one when shrinking, several when growing."""
        r = c(axis) - c(f"_{axis}0")
        last = F.floor(((r + 1) * c(target) - 1) / c(size)).cast("bigint")
        return F.sequence(F.least(last, F.ceil(r * c(target) / c(size)).cast("bigint")), last)

    def width(cell: str, size: str, target: str) -> Column:
        lo = F.floor(c(cell) * c(size) / c(target))
        return F.greatest(F.lit(1), F.floor((c(cell) + 1) * c(size) / c(target)) - lo)

    covered = (
        x.withColumn("tx", F.explode(cells("x", "w", "tw"))).withColumn("ty", F.explode(cells("y", "h", "th")))
        .groupBy("page", "tx", "ty", "w", "h", "tw", "th").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("v", c("n") / (width("tx", "w", "tw") * width("ty", "h", "th")) * 255)
    )
    cx, cy = (F.sum(c(t) * c("v")).over(page) / F.sum("v").over(page) for t in ("tx", "ty"))
    half = side / 2
    placed = covered.select(
        "page", (c("tx") + half_up(F.round(half - cx, 9))).alias("x"), (c("ty") + half_up(F.round(half - cy, 9))).alias("y"),
        F.least(F.lit(255), half_up(F.round("v", 9))).alias("v"),
    )
    return placed.filter(c("x").between(0, side - 1) & c("y").between(0, side - 1))
