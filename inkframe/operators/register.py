"""Bring scanned pages onto a form's reference, and judge whether that worked."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import half_up
from ..session import cut_lineage
from . import raster

#: Fixed value: banner overlap below which a page is not trusted.
BAR = 0.75
#: Fewest lines that a page must show of the grid for its columns to be fitted.
LEAST_LINES = 32


@dataclass(frozen=True)
class Target:
    """One side's reference: size, window of the grid, its profiles there, printed blocks and their banner lines."""

    side: str
    width: int
    height: int
    x: int
    y: int
    w: int
    h: int
    rows: list[float]
    cols: list[float]
    blocks: list[tuple[str, int, int]]
    banners: list[tuple[str, int, bool]] = field(repr=False)


def target(side: str, image: DataFrame, cells: DataFrame, *, pad: int = 72, beside: int = 8) -> Target:
    """The target of a blank form's lines `(y, px)` and cell map; one page, so its profiles fit the driver."""
    lines = image.select(F.lit(0).cast("bigint").alias("page"), F.col("y").cast("bigint").alias("y"), "px")
    height, width = lines.agg(F.count(F.lit(1)), F.max(F.size("px"))).first()
    mine = cells.withColumn("page", F.lit(0).cast("bigint"))
    win = raster.alignment_window(mine, width, height, pad, beside).first()
    spans = raster.block_spans(mine)
    rows = raster.profile_arrays(raster.row_profile(lines, win["x"], win["x"] + win["w"])).first()["a"]
    cols = raster.profile_arrays(raster.col_profile(lines, win["y"], win["y"] + win["h"])).first()["a"]
    banners = raster.banner_rows(lines, spans).filter(F.col("y").between(win["y"], win["y"] + win["h"] - 1)).collect()
    return Target(
        side, width, height, win["x"], win["y"], win["w"], win["h"], list(rows), list(cols),
        [(r["block"], r["x0"], r["x1"]) for r in spans.orderBy("block").collect()],
        [(r["block"], r["y"], r["banner"]) for r in banners],
    )


def register_side(lines: DataFrame, to: Target, width: int, height: int, *, sub: int = 4) -> tuple[DataFrame, DataFrame]:
    """Level pages of one size and fit them onto one target: `(page, deg, sx, ox, sy, oy, overlap)`, and their lines there.

    The y-fit comes first; the x-fit looks only at the lines where it placed the grid, and is left out where they are few.
    Overlap is that of the banners, not the correlation that placed the page: a fit is not its own evidence.
    """
    skew = raster.skew_angle(lines, width, height, sub=sub).select("page", "deg")
    level = cut_lineage(raster.rotate(lines, skew))
    spark = lines.sparkSession

    def pairs(profile: DataFrame, ref: list[float]) -> DataFrame:
        return raster.profile_arrays(profile, "v").withColumn("ref", F.array(*[F.lit(float(v)) for v in ref]))

    down = raster.fit_axis(pairs(raster.row_profile(level), to.rows), to.y, to.y + to.h)
    top = F.greatest(F.lit(0), half_up(F.col("sy") * to.y + F.col("oy")))
    down = down.select("page", F.col("scale").alias("sy"), F.col("offset").alias("oy")).withColumn("_top", top)
    down = down.withColumn("_end", F.least(F.lit(height), half_up(F.col("sy") * (to.y + to.h) + F.col("oy"))))
    down = cut_lineage(down)
    placed = level.join(down.filter(F.col("_end") - F.col("_top") > LEAST_LINES).select("page", "_top", "_end"), "page")
    grid = placed.filter((F.col("y") >= F.col("_top")) & (F.col("y") < F.col("_end"))).select("page", "y", "px")
    across = raster.fit_axis(pairs(raster.col_profile(grid), to.cols), to.x, to.x + to.w, max_scale=0.03, max_offset=200)
    across = across.select("page", F.col("scale").alias("sx"), F.col("offset").alias("ox"))
    fits = cut_lineage(down.drop("_top", "_end").join(across, "page", "left").na.fill({"sx": 1.0, "ox": 0.0}))
    placed = cut_lineage(raster.resample(level, fits, to.width, to.height))
    blocks = F.array(*[F.struct(F.lit(b).alias("block"), F.lit(x0).alias("x0"), F.lit(x1).alias("x1")) for b, x0, x1 in to.blocks])
    spans = fits.select("page", F.inline(blocks))
    seen = raster.banner_rows(placed, spans).filter(F.col("y").between(to.y, to.y + to.h - 1))
    blank = spark.createDataFrame(to.banners, "block string, y bigint, banner boolean")
    overlap = raster.banner_overlap(seen, blank)
    return skew.join(fits, "page").join(overlap, "page", "left").na.fill(0.0, ["overlap"]), placed


def register_pages(
    lines: DataFrame, front: Target, back: Target, width: int, height: int, *, bar: float = BAR, sub: int = 4
) -> tuple[DataFrame, DataFrame]:
    """Register pages `(page, y, px)` of one scan size against the side and turn that fit best.

    Returns `(page, side, turns, deg, sx, ox, sy, oy, overlap, trusted)` and the registered lines `(page, y, px)`. The
    cheap guess of the side is tried first, the other side only on pages that stay under `bar`, and quarter turns only
    on those that fail both; so each step works on what is left. A page under the bar is returned, but not trusted. Tilt is
    measured on every `sub`-th pixel, which suits scans; pages of a few hundred pixels want 1.
    """
    lines = cut_lineage(lines.select("page", F.col("y").cast("bigint").alias("y"), "px"))
    sides = {"front": front, "back": back}
    guess = cut_lineage(raster.classify_side(lines).select("page", "side"))
    fits, images = [], []

    def attempt(pages: DataFrame, number: int, side: str, turns: int) -> None:
        mine = lines.join(pages.select("page"), "page", "left_semi")
        w, h = (height, width) if turns % 2 else (width, height)
        found, placed = register_side(raster.quarter_turn(mine, turns), sides[side], w, h, sub=sub)
        marked = found.select(
            F.col("page"), F.lit(number).alias("attempt"), F.lit(side).alias("side"), F.lit(turns).alias("turns"),
            "deg", "sx", "ox", "sy", "oy", "overlap",
        )
        fits.append(cut_lineage(marked))
        images.append(placed.withColumn("attempt", F.lit(number)))

    def so_far() -> DataFrame:
        out = fits[0]
        for f in fits[1:]:
            out = out.unionByName(f)
        return out

    def failing() -> DataFrame:
        return cut_lineage(raster.best_side(so_far(), bar).filter(~F.col("trusted")).select("page"))

    for side in sides:
        attempt(guess.filter(F.col("side") == side), 0, side, 0)
    left = failing()
    if not left.isEmpty():
        for side in sides:
            attempt(guess.filter(F.col("side") != side).join(left, "page", "left_semi"), 1, side, 0)
        left = failing()
    if not left.isEmpty():
        for turns in (1, 2, 3):
            for k, side in enumerate(sides):
                attempt(left, 2 * turns + k, side, turns)
    best = raster.best_side(so_far(), bar)
    chosen = cut_lineage(so_far().join(best.select("page", "side", "turns", "trusted"), ["page", "side", "turns"]).withColumn(
        "_first", F.row_number().over(raster.Window.partitionBy("page").orderBy("attempt"))).filter("_first = 1").drop("_first"))
    placed = images[0]
    for image in images[1:]:
        placed = placed.unionByName(image)
    placed = placed.join(chosen.select("page", "attempt"), ["page", "attempt"], "left_semi").select("page", "y", "px")
    return chosen.select("page", "side", "turns", "deg", "sx", "ox", "sy", "oy", "overlap", "trusted"), placed
