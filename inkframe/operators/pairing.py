"""Pages in feed order to two-sided cards, for feeds of any length.

Two neighbouring pages of different side make a card, in either order; a page that
repeats the side before it starts the alternation again, which leaves the page
before it alone when its run had an odd length. So a page's place in its run of
alternating sides decides everything: even places open a card, odd places close one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import CHUNK_WIDTH, id_chunk, numbered

MIN_OVERLAP = 0.75


def placed_pages(pages: DataFrame, *, chunk_width: int = CHUNK_WIDTH) -> DataFrame:
    """Add `card_no`, `opens` and `next_page` to `(event, page_no, side, ...)`.

    Inside a chunk of consecutive page numbers the places are known but for the
    stretch before the chunk's first repeated side; that stretch needs only the
    parity carried in, which is a running sum over one row per chunk.
    """
    keys, parts = ["event"], ["event", "_chunk"]
    inside = Window.partitionBy(*parts).orderBy("page_no")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = (
        pages.withColumn("_chunk", id_chunk("page_no", chunk_width))
        .withColumn("_rn", F.row_number().over(inside))
        .withColumn("_repeats", F.coalesce(F.col("side") == F.lag("side").over(inside), F.lit(False)))
        .withColumn("_reset", F.max(F.when(F.col("_repeats"), F.col("_rn"))).over(upto))
        .withColumn("_next", F.lead("page_no").over(inside))
        .withColumn(
            "_tail_opens",
            F.sum(
                F.when(F.col("_reset").isNotNull() & ((F.col("_rn") - F.col("_reset")) % 2 == 0), 1)
                .otherwise(0)
            ).over(upto),
        )
    )
    head = F.col("_reset").isNull()
    chunks = local.groupBy(*parts).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(head, 1).otherwise(0)).alias("head_n"),
        F.max("_tail_opens").alias("tail_opens"),
        F.max("_reset").alias("last_reset"),
        F.min("page_no").alias("first_page"),
        F.min_by("side", "page_no").alias("first_side"),
        F.max_by("side", "page_no").alias("last_side"),
    )
    along = Window.partitionBy(*keys).orderBy("_chunk")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    starts_afresh = F.coalesce(F.col("first_side") == F.col("prev_side"), F.lit(True))
    carried = (
        chunks.withColumn("prev_side", F.lag("last_side").over(along))
        .withColumn("fresh", starts_afresh)
        .withColumn("prev_reset", F.lag(F.col("last_reset").isNotNull()).over(along))
        # Parity after a chunk is its own where it holds a reset; otherwise it is the
        # carried parity plus its length. Chunks between resets share a segment.
        .withColumn(
            "segment",
            F.sum(F.when(F.col("fresh") | F.coalesce("prev_reset", F.lit(False)), 1).otherwise(0)).over(
                along.rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
        .withColumn("out_len", F.col("n") - F.coalesce(F.col("last_reset") - 1, F.lit(0)))
        .withColumn("prev_len", F.lag("out_len").over(along))
    )
    in_segment = Window.partitionBy("event", "segment").orderBy("_chunk")
    first_in = F.when(F.col("fresh"), F.lit(0)).otherwise(F.col("prev_len"))
    parity = (
        carried.withColumn("_seed", F.first(first_in).over(in_segment))
        .withColumn(
            "_grown",
            F.coalesce(
                F.sum("n").over(in_segment.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .withColumn("odd_in", (F.col("_seed") + F.col("_grown")) % 2)
        .withColumn(
            "opens_here",
            F.col("tail_opens") + F.floor((F.col("head_n") + 1 - F.col("odd_in")) / 2).cast("bigint"),
        )
        .withColumn("cards_before", F.coalesce(F.sum("opens_here").over(before), F.lit(0)))
        .withColumn("next_first", F.lead("first_page").over(along))
        .select(*parts, "odd_in", "head_n", "cards_before", "next_first")
    )
    head_opens = F.floor((F.least(F.col("_rn"), F.col("head_n")) + 1 - F.col("odd_in")) / 2)
    place = F.when(head, F.col("_rn") - 1 + F.col("odd_in")).otherwise(F.col("_rn") - F.col("_reset"))
    return (
        local.join(parity, parts)
        .withColumn("card_no", (F.col("cards_before") + head_opens + F.col("_tail_opens")).cast("bigint"))
        .withColumn("opens", place % 2 == 0)
        .withColumn("next_page", F.coalesce("_next", "next_first"))
        .drop("_chunk", "_rn", "_repeats", "_reset", "_next", "_tail_opens", "odd_in", "head_n",
              "cards_before", "next_first")
    )


def pair_pages(pages: DataFrame, *, chunk_width: int = CHUNK_WIDTH) -> DataFrame:
    """Cards `(event, card_no, front_page, back_page, next_page)`; either side may be null."""
    placed = placed_pages(pages, chunk_width=chunk_width)
    return placed.groupBy("event", "card_no").agg(
        F.max(F.when(F.col("side") == "front", F.col("page_no"))).alias("front_page"),
        F.max(F.when(F.col("side") == "back", F.col("page_no"))).alias("back_page"),
        F.max_by("next_page", "page_no").alias("next_page"),
    )


def missing_sides(cards: DataFrame) -> DataFrame:
    """Sides a card lacks, as `front,back` text; empty where the card is whole."""
    gone = F.concat_ws(
        ",",
        F.when(F.col("front_page").isNull(), "front"),
        F.when(F.col("back_page").isNull(), "back"),
    )
    return cards.withColumn("missing_sides", gone)


def pairing_problems(
    pages: DataFrame, *, min_overlap: float = MIN_OVERLAP, chunk_width: int = CHUNK_WIDTH
) -> DataFrame:
    """`(event, kind, page, other_page)`: misaligned pages, broken sequences, odd feeds."""
    none = F.lit(None).cast("bigint")
    misaligned = pages.filter(F.col("overlap") < min_overlap).select(
        "event", F.lit("misaligned-page").alias("kind"), F.col("page_no").alias("page"),
        none.alias("other_page"),
    )
    lone = pair_pages(pages, chunk_width=chunk_width).filter(
        F.col("front_page").isNull() | F.col("back_page").isNull()
    )
    breaks = lone.select(
        "event", F.lit("sequence-break").alias("kind"),
        F.coalesce("front_page", "back_page").alias("page"), F.col("next_page").alias("other_page"),
    )
    odd = (
        pages.groupBy("event").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") % 2 != 0)
        .select("event", F.lit("odd-page-count").alias("kind"), none.alias("page"), none.alias("other_page"))
    )
    return misaligned.unionByName(breaks).unionByName(odd)


def card_cells(cards: DataFrame, pages: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells of both sides of a card in order of item rows: `(event, card_no, place, side, page_no, item_row, ...)`.

    `pages` are those that may be read, as `trusted_pages` gives them; a side on any other page brings no cells. A card
    has the rows of its form, so it is ordered in one place. Of equal rows the front's comes first.
    """
    side = lambda name, k: F.struct(F.lit(name).alias("side"), F.lit(k).alias("_k"), F.col(f"{name}_page").alias("page_no"))
    sides = cards.select("event", "card_no", F.inline(F.array(side("front", 0), side("back", 1)))).filter(F.col("page_no").isNotNull())
    read = sides.join(pages.select("event", "page_no"), ["event", "page_no"], "left_semi").join(cells, ["event", "page_no"])
    rest = [c for c in cells.columns if c not in ("event", "page_no", "item_row")]
    order = Window.partitionBy("event", "card_no").orderBy("item_row", "_k", *rest)
    place = F.row_number().over(order).cast("bigint").alias("place")
    return read.select("event", "card_no", place, "side", "page_no", "item_row", *rest)


def unread_sides(cards: DataFrame, pages: DataFrame) -> DataFrame:
    """Cards with the sides that bring no cells, absent or not trusted: `(event, card_no, missing_sides)`."""
    ok = pages.select("event", F.col("page_no").alias("_p"), F.lit(True).alias("_ok"))
    x = cards
    for name in ("front", "back"):
        there = ok.withColumnRenamed("_p", f"{name}_page").withColumnRenamed("_ok", f"_{name}")
        x = x.join(there, ["event", f"{name}_page"], "left")
    gone = F.concat_ws(",", *[F.when(F.col(f"_{n}").isNull(), n) for n in ("front", "back")])
    return x.select("event", "card_no", gone.alias("missing_sides"))


def trusted_pages(pages: DataFrame, *, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """Pages that lie well enough on their reference to be cut."""
    return pages.filter(F.col("overlap") >= min_overlap)


def refused_pages(pages: DataFrame, *, min_overlap: float = MIN_OVERLAP, bands: int = 10_000) -> DataFrame:
    """Pages the trust gate turns away, numbered worst first within their event (`worst_rank`).

    An event's pages are numbered inside narrow bands of overlap, and inside a band in chunks of
    equal overlap and near page numbers: a feed of blank sheets scores 0 throughout and is still
    spread. What is ordered per event is one row per band.
    """
    x = (
        pages.filter(F.col("overlap") < min_overlap)
        .withColumn("_band", F.floor(F.col("overlap") * bands).cast("bigint"))
        .withColumn("_ids", id_chunk("page_no"))
    )
    inside = numbered(
        x, ["event", "_band"], ["overlap", "_ids"], [F.col("overlap"), F.col("page_no")], "_r"
    )
    before = Window.partitionBy("event").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    totals = x.groupBy("event", "_band").agg(F.count(F.lit(1)).alias("_n")).select(
        "event", "_band", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    return inside.join(totals, ["event", "_band"]).withColumn(
        "worst_rank", F.col("_r") + F.col("_before")
    ).drop("_r", "_before", "_band", "_ids")
