"""Typed sheets against written cells: normalising, checking, and labelling from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import half_up
from ..functions.taxonomy import taxonomy
from ..functions.text import column_index, column_name, match_key

# Fixed values of the label gates.
LABEL_INK = 0.025
SCAN_FLOOR, SCAN_EVIDENCE = 0.3, 40
CARD_FLOOR, CARD_EVIDENCE = 0.6, 3

KEYS = ["event", "card", "item_row"]


def typed_values(sheet_cells: DataFrame) -> DataFrame:
    """Sheet cells to `(event, card, item_row, n)`.

    Formula cells, the label and sum columns, blanks, non-numbers and counts below one are
    dropped; rows must be printed items. Columns map to cards by letter, never by position.
    """
    n = F.expr("try_cast(value AS DOUBLE)")
    items = F.broadcast(taxonomy(sheet_cells.sparkSession).select("item_row"))
    return (
        sheet_cells.filter(~F.col("is_formula") & ~F.col("col").isin("A", "B"))
        .withColumn("n", half_up(n))
        .filter(n.isNotNull() & ~F.isnan(n) & (F.abs(n) < 1e15) & (F.col("n") > 0))
        .join(items, "item_row", "left_semi")
        .select("event", (column_index(F.col("col")) - 2).alias("card"), "item_row", "n")
    )


def offset_agreement(
    cells: DataFrame, typed: DataFrame, offsets: Sequence[int] = tuple(range(-3, 4)),
    ink: float = LABEL_INK,
) -> DataFrame:
    """Share of written cells whose sheet column, moved by each offset, has a value.

    Cards of one `(event, item_row)` number at most 76, so the sheet side travels as one set
    of card numbers per pair and the cells are shuffled once, not once per offset.
    """
    sheet = typed.filter(F.col("n") > 0).groupBy("event", "item_row").agg(
        F.collect_set("card").alias("cards")
    )
    x = cells.filter(F.col("ink") >= ink).join(sheet, ["event", "item_row"], "left")
    aggs = [F.count(F.lit(1)).alias("written")]
    for i, o in enumerate(offsets):
        hit = F.array_contains("cards", F.col("card") + o)
        aggs.append(F.count_if(hit).alias(f"hits_{i}"))
    per_event = x.groupBy("event").agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(o).cast("bigint").alias("shift"), F.col(f"hits_{i}").alias("hits"))
        for i, o in enumerate(offsets)
    ])
    return per_event.select("event", "written", F.inline(rows)).withColumn(
        "rate", F.round(F.col("hits") / F.col("written"), 6)
    )


def card_evidence(cells: DataFrame, typed: DataFrame, ink: float = LABEL_INK) -> DataFrame:
    """Per card: inked, typed, tally-only, comparable cells and those cut into as many digits."""
    x = cells.join(typed, KEYS, "left")
    inked, has = F.col("ink") >= ink, F.col("n") > 0
    same = F.col("pieces") == F.length(F.col("n").cast("string"))
    return x.groupBy("event", "card").agg(
        F.count_if(inked).alias("inked"),
        F.count_if(has).alias("written"),
        F.count_if(has & ~inked).alias("tally_only"),
        F.count_if(has & inked).alias("comparable"),
        F.count_if(has & inked & same).alias("agree"),
        F.count_if(has & same).alias("candidates"),
        F.count_if(inked & has).alias("hits"),
    )


def gated_cards(
    cells: DataFrame, typed: DataFrame, *, scan_floor: float = SCAN_FLOOR,
    scan_evidence: int = SCAN_EVIDENCE, card_floor: float = CARD_FLOOR,
    card_evidence_min: int = CARD_EVIDENCE,
) -> DataFrame:
    """Card evidence with the two verdicts: is the scan refused, is the card kept?"""
    cards = card_evidence(cells, typed)
    scans = cards.groupBy("event").agg(
        F.sum("inked").alias("evidence"),
        F.round(F.sum("hits") / F.nullif(F.sum("inked"), F.lit(0)), 6).alias("at_zero"),
    ).withColumn(
        "refused", (F.col("evidence") >= scan_evidence) & (F.col("at_zero") < scan_floor)
    )
    rate = F.when(F.col("comparable") > 0, F.round(F.col("agree") / F.col("comparable"), 6)).otherwise(1.0)
    kept = (F.col("comparable") < card_evidence_min) | (F.col("rate") >= card_floor)
    return (
        cards.join(scans, "event")
        .withColumn("rate", rate)
        .withColumn("kept", kept & ~F.col("refused"))
        .withColumn("col", column_name(F.col("card") + 2))
        .withColumn("emitted", F.when(F.col("kept"), F.col("candidates")).otherwise(0))
        .drop("hits", "candidates")
    )


def digit_labels(cells: DataFrame, typed: DataFrame, **gates) -> DataFrame:
    """One labelled digit per box, from kept cards, where boxes and typed digits are as many."""
    kept = gated_cards(cells, typed, **gates).filter("kept").select("event", "card")
    text = F.col("n").cast("string")
    return (
        cells.join(typed.filter(F.col("n") > 0), KEYS)
        .filter(F.col("pieces") == F.length(text))
        .join(kept, ["event", "card"], "left_semi")
        .select(*KEYS, F.col("n").alias("value"), F.posexplode(F.split(text, "")).alias("k", "label"))
        .filter(F.col("label") != "")
        .select(*KEYS, "value", F.col("k").cast("bigint").alias("k"), F.col("label").cast("bigint").alias("label"))
    )


def match_sheets(scans: DataFrame, sheets: DataFrame) -> DataFrame:
    """Scan folders `(name, place, m, d, yy)` to the first sheet file that names place and date, null without one.

    A sheet matches when its normalised name contains the place and one spelling of the date.
    Containment becomes equality: a name gives out its substrings, only of the lengths that
    places (or dates) have, first against places, then place and date together. Sheets
    are reduced to the first name per (place, date) before scans meet them.
    """
    m, d, yy = F.col("m"), F.col("d"), F.col("yy")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    short = F.concat(m.cast("string"), d.cast("string"), yy)
    wanted = scans.withColumn("place_key", match_key(F.col("place"))).withColumn(
        "spelling",
        F.explode(F.array_distinct(F.array(short, F.concat(F.lit("20"), yy, two(m), two(d))))),
    )

    def lengths(col: str):
        # One row with the few distinct lengths; a scalar subquery, not a join.
        return wanted.agg(F.array_sort(F.collect_set(F.length(col)))).scalar()

    def pieces(name, sizes):
        return F.array_distinct(
            F.flatten(
                F.transform(
                    F.filter(sizes, lambda n: n <= F.length(name)),
                    lambda n: F.transform(
                        F.sequence(F.lit(1), F.length(name) - n + 1), lambda i: F.substr(name, i, n)
                    ),
                )
            )
        )

    named = sheets.select("sheet", match_key(F.col("sheet")).alias("key"))
    by_place = named.withColumn("sizes", lengths("place_key")).select(
        "sheet", "key", F.explode(pieces(F.col("key"), F.col("sizes"))).alias("place_key")
    ).join(wanted.select("place_key").distinct(), "place_key", "left_semi")
    digits = F.regexp_extract_all("key", F.lit(r"(\d+)"), F.lit(1))
    runs = F.flatten(F.transform(digits, lambda r: pieces(r, F.col("sizes"))))
    offers = (
        by_place.withColumn("sizes", lengths("spelling"))
        .select("sheet", "place_key", F.explode(F.array_distinct(runs)).alias("spelling"))
        .groupBy("place_key", "spelling").agg(F.min("sheet").alias("sheet"))
    )
    return wanted.join(offers, ["place_key", "spelling"], "left").groupBy("name").agg(F.min("sheet").alias("sheet"))
