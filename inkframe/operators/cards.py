"""From registered pages, or from the image files themselves, to cards whose cells are cut, judged and read."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.readings import PREFILL_GATE
from ..functions.rounding import half_up
from ..functions.taxonomy import taxonomy
from ..session import cut_lineage
from ..sources import pages as scans
from . import components, knn, pairing, raster, readings, register
from .ordered import id_chunk, numbered

#: Crops of a cell: the box, the tally strip, and the strip without the lines that neighbouring rows reach into.
BOX, STRIP, BAND = 0, 1, 2
#: A crop's number is (page * ROWS + item row) * KINDS + kind.
ROWS, KINDS = 1024, 4
#: Share of a box's width and height that is cut away before digits are looked for, and the least of it.
INSET_X, INSET_Y, INSET_LEAST = 0.06, 0.08, 3
#: Most digits of a number, and pixels of a digit's bitmap along one side.
MOST_DIGITS, SIDE = 3, 28

FITS = (
    "page bigint, side string, turns int, deg double, sx double, ox double, sy double, oy double, overlap double, trusted boolean"
)


@dataclass(frozen=True)
class ReadCards:
    """What a scan comes to. Pages carry their fit; cells are in order of their card; problems name pages that a person must look at."""

    pages: DataFrame
    cards: DataFrame
    cells: DataFrame
    problems: DataFrame


def crop_number(page: Column, item_row: Column, kind: Column | int) -> Column:
    return ((page * ROWS + item_row) * KINDS + F.lit(kind)).cast("bigint")


def cell_regions(maps: DataFrame, exclusions: DataFrame | None = None) -> DataFrame:
    """`(side, item_row, kind, x0, y0, x1, y1)`: whole-pixel crops of a map's cells; a cell whose box overlaps an exclusion has none."""
    cells = maps
    if exclusions is not None:
        boxes = maps.select(F.col("side").alias("page"), F.col("item_row").alias("cell"), *[F.col(f"total_{a}").alias(a) for a in "xywh"])
        left = raster.without_excluded(boxes, exclusions.withColumnRenamed("side", "page"))
        cells = maps.join(left.select(F.col("page").alias("side"), F.col("cell").alias("item_row")), ["side", "item_row"], "left_semi")

    def region(kind: int, box: str, inset: Column) -> Column:
        low = [F.greatest(F.lit(0), half_up(F.col(f"{box}_{a}"))) for a in "xy"]
        high = [half_up(F.col(f"{box}_{a}") + F.col(f"{box}_{s}")) for a, s in ("xw", "yh")]
        ends = [low[0], low[1] + inset, high[0], high[1] - inset]
        return F.struct(F.lit(kind).alias("kind"), *[e.cast("bigint").alias(n) for e, n in zip(ends, ("x0", "y0", "x1", "y1"))])

    none = F.lit(0).cast("bigint")
    # A strip too low to lose its edges stays whole.
    cut = half_up(F.col("tally_h") * F.lit(components.STRIP_INSET)).cast("bigint")
    cut = F.when(F.col("tally_h") - 2 * cut >= 8, cut).otherwise(none)
    parts = F.array(region(BOX, "total", none), region(STRIP, "tally", none), region(BAND, "tally", cut))
    return cells.select("side", "item_row", F.inline(parts))


def _dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    return df if tasks is None else df.repartition(tasks, *keys)


def cut_crops(placed: DataFrame, pages: DataFrame, regions: DataFrame, tasks: int | None = None) -> DataFrame:
    """Lines `(page, y, px)` of pages `(page, side)` cut to their side's regions: `(crop, page, item_row, kind, y, px)`.

    Pages meet their side once; a line is then cut where it stands, and only its cut pieces travel on. The regions are a form's
    cell map, so Spark sends them to every task; were they large, lines would go to them by side, dealt to `tasks` if given.
    """
    lines = placed.join(pages.select("page", "side"), "page")
    here = (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    piece = F.slice("px", F.col("x0").cast("int") + 1, F.greatest(F.lit(0), F.col("x1") - F.col("x0")).cast("int"))
    cut = _dealt(lines, tasks, "side").join(_dealt(regions, tasks, "side"), "side").filter(here).select(
        crop_number(F.col("page"), F.col("item_row"), F.col("kind")).alias("crop"), "page", "item_row", "kind",
        (F.col("y") - F.col("y0")).alias("y"), piece.alias("px"),
    )
    return cut.filter(F.size("px") > 0)


def judge_cells(crops: DataFrame, tasks: int | None = None) -> DataFrame:
    """`(page, item_row, ink, tally_ink, has_value, tally_marked)` of cells with more than negligible ink.

    A cell's lines, which paper bounds, meet once, dealt to `tasks` if given; its shares of ink are taken and its crops looked at there.
    """
    def share(kind: int) -> Column:
        dark = F.sum(F.when(F.col("kind") == kind, F.size(F.filter("px", lambda v: v < 170))))
        return F.coalesce(F.round(dark / F.sum(F.when(F.col("kind") == kind, F.size("px"))), 9), F.lit(0.0))

    def lines(kind: int) -> Column:
        return F.collect_list(F.when(F.col("kind") == kind, F.struct("y", "px")))

    cells = _dealt(crops, tasks, "page", "item_row").groupBy("page", "item_row").agg(
        share(BOX).alias("ink"), share(STRIP).alias("tally_ink"), lines(BOX).alias("box"), lines(BAND).alias("band"))
    looked = F.inline(F.array(*[
        F.struct(crop_number(F.col("page"), F.col("item_row"), kind).alias("crop"), F.col(name).alias("r")) for kind, name in ((BOX, "box"), (BAND, "band"))
    ]))
    looked = readings.ink_floor(cells).select(F.col("ink").alias("box_ink"), "tally_ink", looked).withColumnRenamed("crop", "page")
    marks, cell = components.crop_marks(looked), F.floor(F.col("page") / KINDS)
    marks = marks.withColumn("kind", F.col("page") % KINDS).withColumn("item_row", cell % ROWS).withColumn("page", F.floor(cell / ROWS))
    return components.cell_verdict(_dealt(marks, tasks, "page", "item_row"), ["page", "item_row"], F.col("kind") == BOX, F.col("kind") == BAND)


def crop_sizes(crops: DataFrame) -> DataFrame:
    """`(crop, w, h)`."""
    return crops.groupBy("crop").agg(F.max(F.size("px")).cast("bigint").alias("w"), F.count(F.lit(1)).alias("h"))


def digit_bitmaps(boxes: DataFrame) -> DataFrame:
    """Digits of box crops `(crop, y, px)`: `(crop, j, digits, v)`, from left to right, `v` a bitmap of 28 by 28 levels.

    `digits` is how many the crop has. Crops of more than three, which no one writes, come without bitmaps.
    """
    lines = boxes.select(F.col("crop").alias("page"), "y", "px")
    sizes = crop_sizes(boxes).withColumnRenamed("crop", "page")
    levels = raster.ink_threshold(lines).select("page", "threshold").join(sizes, "page")
    lines = lines.join(levels, "page")
    by_x, by_y = (F.greatest(F.lit(INSET_LEAST), half_up(F.col(s) * F.lit(f))) for s, f in (("w", INSET_X), ("h", INSET_Y)))
    inside = (F.col("y") >= by_y) & (F.col("y") < F.col("h") - by_y)
    dark = F.transform("px", lambda v, i: F.when(
        inside & (v <= F.col("threshold")) & (i >= by_x) & (i < F.col("w") - by_x), 1).otherwise(0).cast("smallint"))
    pieces = components.components(lines.select("page", "y", dark.alias("px")))
    pieces = pieces.join(sizes.select("page", F.col("h").alias("crop_h")), "page")
    pieces = pieces.withColumnsRenamed({"page": "crop", "label": "k"})
    found = cut_lineage(components.merge_fragments(components.shape_filter(pieces, F.col("crop_h"))))
    found = found.withColumn("digits", F.count(F.lit(1)).over(raster.Window.partitionBy("crop")))
    few = found.filter(F.col("digits") <= MOST_DIGITS).withColumn("digit", F.col("crop") * KINDS + F.col("j"))
    on_line = lines.join(few, F.col("page") == F.col("crop")).filter(F.col("y").between(F.col("min_y"), F.col("max_y")))
    ink = on_line.select("digit", "y", F.posexplode("px").alias("x", "v"), "min_x", "max_x", "threshold").filter(
        F.col("x").between(F.col("min_x"), F.col("max_x")) & (F.col("v") <= F.col("threshold")))
    ink = ink.select(F.col("digit").alias("page"), F.col("x").cast("bigint").alias("x"), "y")
    at = (F.col("y") * SIDE + F.col("x")).cast("int")
    levels = raster.normalise(ink, side=SIDE).groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct(at, "v"))).alias("_m"))
    places = F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))
    bitmap = F.transform(places, lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0)).cast("double"))
    levels = levels.select(F.col("page").alias("_digit"), bitmap.alias("v"))
    return found.withColumn("_digit", F.col("crop") * KINDS + F.col("j")).join(levels, "_digit", "left").select("crop", "j", "digits", "v")


def read_numbers(boxes: DataFrame, exemplars: DataFrame, k: int = knn.K) -> DataFrame:
    """Numbers of box crops: `(crop, digits, digit_conf)`; null where no digit, too many, or one that can't be read."""
    digits = cut_lineage(digit_bitmaps(boxes).filter(F.col("v").isNotNull()))
    asked = digits.select((F.col("crop") * KINDS + F.col("j")).alias("sample_id"), "v")
    read = knn.classify_against(asked, exemplars, k=k, side=SIDE)
    crop = F.floor(F.col("query") / KINDS)
    pred = read.select(F.lit(0).alias("source"), crop.alias("cell"), (F.col("query") % KINDS).alias("k"), "predicted", "conf")
    numbers = readings.digits_to_number(pred, MOST_DIGITS)
    return numbers.select(F.col("cell").alias("crop"), F.col("value").alias("digits"), F.col("confidence").alias("digit_conf"))


def read_cells(
    placed: DataFrame, pages: DataFrame, maps: DataFrame, *, exclusions: DataFrame | None = None, exemplars: DataFrame | None = None,
    tallies: Callable[[DataFrame], DataFrame] | None = None, gate: float = PREFILL_GATE, k: int = knn.K,
    tasks: int | None = None,
) -> DataFrame:
    """Cells somebody must look at on registered lines `(page, y, px)` of trusted pages `(page, side)`.

    `maps` are validated cell maps of all sides in whole pixels, as `read_cell_map` gives them; `exclusions` their regions without
    cells. One row a cell: `(page, item_row, ink, tally_ink, has_value, tally_only, tally, tally_conf, digits, digit_conf, value,
    confidence, source)`. Cells with next to no ink, and those in which nobody wrote, have none. `exemplars` read the written boxes;
    `tallies` takes the lines `(strip, y, px)` of strips beside an empty box and gives `(strip, count, confidence)`; without
    either the reading is null, and the cell is offered all the same. A value below the gate is left out, as a wrong number costs more
    than none. Pages of no known side, and blank pages, have no cells. `tasks` are those that lines and cells are dealt to, else the
    session's; they are for maps of many sides.
    """
    none, no_trust = F.lit(None).cast("bigint"), F.lit(0.0)
    crops = cut_crops(placed, pages, cell_regions(maps, exclusions), tasks)
    read_on = tallies is not None or exemplars is not None
    # Readers come back to the crops; without any, both are passed through once.
    crops = cut_lineage(crops) if read_on else crops
    cells = readings.offered(judge_cells(crops, tasks)).drop("tally_marked")
    cells = cut_lineage(cells) if read_on else cells

    def of(kind: int, which: str) -> DataFrame:
        return crops.filter(F.col("kind") == kind).join(cells.filter(which).select("page", "item_row"), ["page", "item_row"], "left_semi")

    cells = cells.withColumn("_box", crop_number(F.col("page"), F.col("item_row"), BOX))
    cells = cells.withColumn("_strip", crop_number(F.col("page"), F.col("item_row"), STRIP))
    if tallies is None:
        cells = cells.withColumn("tally", none).withColumn("tally_conf", no_trust)
    else:
        counted = tallies(of(STRIP, "tally_only").select(F.col("crop").alias("strip"), "y", "px"))
        counted = counted.select(F.col("strip").alias("_strip"), F.col("count").cast("bigint").alias("tally"), F.col("confidence").alias("tally_conf"))
        cells = cells.join(counted, "_strip", "left")
    if exemplars is None:
        cells = cells.withColumn("digits", none).withColumn("digit_conf", no_trust)
    else:
        numbers = read_numbers(of(BOX, "has_value"), exemplars, k)
        cells = cells.join(numbers.withColumnRenamed("crop", "_box"), "_box", "left")
    read = readings.with_reading(readings.route_readers(cells.na.fill(0.0, ["tally_conf", "digit_conf"])))
    sure = F.col("confidence") >= gate
    return read.select(
        "page", "item_row", "ink", "tally_ink", "has_value", "tally_only", "tally", "tally_conf", "digits", "digit_conf",
        *[F.when(sure, F.col(c)).alias(c) for c in ("value", "confidence", "source")],
    )


def assemble(pages: DataFrame, cells: DataFrame, maps: DataFrame) -> ReadCards:
    """Pages `(page, event, page_no, side, overlap, trusted)` paired into cards, with the cells of their trusted sides.

    Cells are named by the items of the form, and rows that it doesn't print are left out. `picture` is the piece of the page to show beside a cell.
    """
    spark = pages.sparkSession
    feed = pages.select("event", "page_no", "side", "overlap")
    trusted = pages.filter("trusted").select("event", "page_no")
    paired = pairing.pair_pages(feed)
    cards = pairing.unread_sides(paired, trusted).join(paired.select("event", "card_no", "front_page", "back_page"), ["event", "card_no"])
    shown = raster.crop_region(
        maps.withColumn("page", F.col("side")).withColumn("cell", F.col("item_row")), F.col("page_w"), F.col("page_h"))
    shown = shown.select(F.col("page").alias("side"), F.col("cell").alias("item_row"), F.struct("x", "y", "w", "h").alias("picture"))
    items = F.broadcast(taxonomy(spark).select("item_row", "item_name", "section"))
    named = cells.join(pages.select("page", "event", "page_no", "side"), "page").join(items, "item_row").join(shown, ["side", "item_row"], "left")
    in_order = pairing.card_cells(paired, trusted, named.drop("page", "side"))
    return ReadCards(pages, cards, in_order, pairing.pairing_problems(feed))


def register_scans(lines: DataFrame, front: register.Target, back: register.Target, **options) -> tuple[DataFrame, DataFrame]:
    """`register.register_pages` for lines `(page, y, px)` of pages of any sizes. A scanner has a few, and each size is a run of its own."""
    spark = lines.sparkSession
    sizes = cut_lineage(lines.groupBy("page").agg(F.max(F.size("px")).alias("w"), F.count(F.lit(1)).alias("h")))
    fits, placed = spark.createDataFrame([], FITS), spark.createDataFrame([], "page bigint, y bigint, px array<smallint>")
    for size in sizes.select("w", "h").distinct().orderBy("w", "h").collect():
        mine = lines.join(sizes.filter((F.col("w") == size["w"]) & (F.col("h") == size["h"])).select("page"), "page", "left_semi")
        found, image = register.register_pages(mine, front, back, size["w"], size["h"], **options)
        fits, placed = fits.unionByName(found), placed.unionByName(image.select("page", "y", F.col("px").cast("array<smallint>").alias("px")))
    return fits, placed


def read_scans(
    spark: SparkSession, path: str, front: register.Target, back: register.Target, maps: DataFrame, *,
    suffixes: Sequence[str] = scans.SUFFIXES, bar: float = register.BAR, sub: int = 4, **options,
) -> ReadCards:
    """Image files under `path`, one folder an event, to read cards: numbered, decoded, registered, cut, judged, read and paired.

    `options` are those of `read_cells`. A file that can't be decoded keeps its number and comes back as a problem of kind
    `unreadable-image`, and a page that lies on neither side's reference is paired by its best guess, brings no cells and is a
    `misaligned-page`. A folder without images gives no rows.
    """
    images = scans.read_pages(spark, path, suffixes)
    numbers = scans.page_numbers(spark, path, suffixes).withColumn("_all", F.lit(0)).withColumn("_chunk", id_chunk("page_no"))
    # Pages of all events are told apart by one number; what is ordered in one place is a row for some thousand pages of an event.
    ids = cut_lineage(numbered(numbers, ["_all"], ["event", "_chunk"], [F.col("page_no")], "page").drop("_all", "_chunk"))
    lines = scans.to_scanlines(images).join(ids.select("event", "file", "page"), ["event", "file"]).select("page", "y", "px")
    lines = cut_lineage(lines)
    fits, placed = register_scans(lines, front, back, bar=bar, sub=sub)
    pages = cut_lineage(ids.join(fits, "page"))
    cells = cut_lineage(read_cells(placed, pages.filter("trusted"), maps, **options))
    out = assemble(pages, cells, maps)
    lost = scans.rejected_images(images).join(ids, ["event", "file"]).select(
        "event", F.lit("unreadable-image").alias("kind"), F.col("page_no").alias("page"), F.lit(None).cast("bigint").alias("other_page"))
    return ReadCards(out.pages, out.cards, out.cells, out.problems.unionByName(lost))
