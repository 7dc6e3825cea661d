"""Datasheets: cell edits, wide and long forms, provenance, totals and the gate before them."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.readings import REVIEW_THRESHOLD, needs_review
from ..functions.taxonomy import (
    FIRST_DATA_COLUMN,
    HEADER_ROWS,
    LAST_DATA_COLUMN,
    MAX_VOLUNTEERS,
    taxonomy,
)
from ..functions.text import chapter_date, column_index, column_name
from ..sources import snapshots
from . import quality


def header_edits(events: DataFrame) -> DataFrame:
    """Header values under their labels in column A; absent values are not written."""
    number = lambda c: F.col(c).cast("string")
    values = {
        "data_entry_volunteer": ("text", F.nullif(F.col("data_entry_volunteer"), F.lit(""))),
        "club": ("text", F.nullif(F.col("club"), F.lit(""))),
        "date": ("text", chapter_date(F.col("date"))),
        "shoreline": ("text", F.col("shoreline")),
        "volunteers": ("number", number("volunteers")),
        "pounds": ("number", number("pounds")),
        "duration": ("text", F.concat(number("duration_hours"), F.lit(" hours"))),
    }
    rows = F.array(*[
        F.struct(F.lit(f"A{HEADER_ROWS[k]}").alias("ref"), F.lit(kind).alias("kind"), v.alias("value"))
        for k, (kind, v) in values.items()
    ])
    return events.select("event", F.inline(rows)).filter(F.col("value").isNotNull())


def cell_ref(card: Column, item_row: Column) -> Column:
    """Card number and item row to a sheet reference."""
    return F.concat(column_name(card + (FIRST_DATA_COLUMN - 1)), item_row.cast("string"))


def count_edits(values: DataFrame) -> DataFrame:
    """Counts to `(event, ref, kind, value)`; zero and blank are the same and never written."""
    return values.filter(F.col("value") > 0).select(
        "event", cell_ref(F.col("card"), F.col("item_row")).alias("ref"),
        F.lit("number").alias("kind"), F.col("value").cast("string").alias("value"),
    )


def cell_edits(events: DataFrame, values: DataFrame) -> DataFrame:
    """Every write of an event's datasheet."""
    return header_edits(events).unionByName(count_edits(values))


def publish_edits(events: DataFrame, values: DataFrame, path: str) -> int:
    """Write every edit of the events' datasheets as a new version at `path`; its number.

    The rules on values are counted while the edits are written, in the same pass. If one is broken nothing is published, and
    `snapshots.BrokenRule` tells which and how often.
    """
    rows, rules = quality.tagged_values(values)
    broken = {name: F.coalesce(bad, F.lit(False)) for name, bad in rules.items()}
    counts = rows.select(
        "event", cell_ref(F.col("card"), F.col("item_row")).alias("ref"), F.lit("number").alias("kind"),
        F.col("value").cast("string").alias("value"), (F.col("value") > 0).alias("_written"), *[bad.alias(f"_{name}") for name, bad in broken.items()],
    )
    heads = header_edits(events).select("*", F.lit(True).alias("_written"), *[F.lit(False).alias(f"_{name}") for name in broken])
    flags = {name: F.col(f"`_{name}`") for name in broken}
    # Zero and blank are the same and are not written; what breaks a rule is kept up to the count.
    edits = heads.unionByName(counts).filter(F.coalesce(F.col("_written"), F.lit(False)) | reduce(operator.or_, flags.values()))
    return snapshots.write(edits, path, "event", rules=flags, columns=["event", "ref", "kind", "value"])


def read_back(edits: DataFrame) -> DataFrame:
    """Edits back to `(event, card, item_row, value)`, from nothing but the references."""
    col = F.regexp_extract("ref", r"^([A-Z]+)\d+$", 1)
    row = F.regexp_extract("ref", r"^[A-Z]+(\d+)$", 1).cast("bigint")
    return edits.filter((F.col("kind") == "number") & (col != "A")).select(
        "event", (column_index(col) - (FIRST_DATA_COLUMN - 1)).alias("card"), row.alias("item_row"),
        F.col("value").cast("bigint").alias("value"),
    )


def wide_datasheet(values: DataFrame) -> DataFrame:
    """Item by card, one column per volunteer (`C` to `BZ`), the layout of the sheet."""
    letters = [_letters(i) for i in range(FIRST_DATA_COLUMN, LAST_DATA_COLUMN + 1)]
    return (
        values.withColumn("col", column_name(F.col("card") + (FIRST_DATA_COLUMN - 1)))
        .groupBy("event", "item_row").pivot("col", letters).agg(F.sum("value"))
    )


def _letters(i: int) -> str:
    return (chr(64 + (i - 1) // 26) if i > 26 else "") + chr(65 + (i - 1) % 26)


def item_totals(values: DataFrame) -> DataFrame:
    """Totals per item, per section (item null) and over all (section null)."""
    per_item = values.groupBy("item_row").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("cells"))
    named = per_item.join(F.broadcast(taxonomy(values.sparkSession)), "item_row")
    return named.rollup("section", "item_row").agg(
        F.sum("total").alias("total"), F.sum("cells").alias("cells")
    )


def attributed(values: DataFrame, prefilled: DataFrame) -> DataFrame:
    """Untouched machine values keep their confidence; everything else is a person's, at 1."""
    keys = ["event", "card", "item_row"]
    machine = prefilled.select(*keys, F.col("value").alias("_v"), F.col("confidence").alias("_c"))
    same = F.col("_v") == F.col("value")
    return values.join(machine, keys, "left").select(
        *values.columns,
        F.when(same, F.col("_c")).otherwise(1.0).alias("confidence"),
        (~F.coalesce(same, F.lit(False))).alias("corrected"),
    )


def provenance(values: DataFrame, cards: DataFrame) -> DataFrame:
    """The nine audit columns per written value; `cards` has `pages` and `card_type`."""
    items = F.broadcast(taxonomy(values.sparkSession).select("item_row", "item_name"))
    return (
        values.filter(F.col("value") > 0).join(cards, ["event", "card"]).join(items, "item_row", "left")
        .select(
            "event", "card", column_name(F.col("card") + (FIRST_DATA_COLUMN - 1)).alias("col"), "pages",
            "card_type", "item_row", F.coalesce("item_name", F.lit("?")).alias("item_name"), "value",
            F.format_string("%.3f", F.col("confidence")).alias("confidence"),
            F.when(F.col("corrected"), "human").otherwise("recognized").alias("source"),
        )
    )


def card_summary(cells: DataFrame) -> DataFrame:
    """Per card: cells, pages in order, sources met, and whether it is a tally card."""
    tally_only = ~F.col("has_value") & F.col("tally_marked")
    return cells.groupBy("event", "card").agg(
        F.count(F.lit(1)).alias("cells"),
        # Sorted as what they are, numbers as numbers, and only then written out.
        F.array_join(F.transform(F.array_sort(F.collect_set("page_no")), lambda p: p.cast("string")), ", ").alias("pages"),
        F.count_distinct("source").alias("sources"),
        F.when(F.bool_or(tally_only), "tally").otherwise("total").alias("card_type"),
    )


def export_gate(jobs: DataFrame, values: DataFrame) -> DataFrame:
    """Blockers and warnings per job. `jobs` holds the event fields, `values` its card values."""
    low = F.col("confidence") < REVIEW_THRESHOLD
    recognized = F.col("source") == "recognized"
    by_card = values.groupBy("event", "card").agg(
        F.count_if(recognized).alias("scored"),
        F.count_if(recognized & low).alias("low"),
        F.count_if(needs_review(F.col("source"), F.col("confidence"))).alias("pending"),
        F.count_if(F.col("value") > 0).alias("entered"),
    )
    by_event = by_card.groupBy("event").agg(
        F.count(F.lit(1)).alias("cards"),
        F.count_if((F.col("scored") > 0) & (F.col("scored") == F.col("low"))).alias("weak_cards"),
        F.sum("pending").alias("pending"),
        F.sum("entered").alias("entered"),
    )
    x = jobs.join(by_event, "event", "left").na.fill(0, ["cards", "weak_cards", "pending", "entered"])
    vol = F.col("volunteers")
    blockers = F.array_compact(F.array(
        F.when(F.col("alignment_problems") > 0, "alignment"),
        F.when(~F.coalesce(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)), "date"),
        F.when(F.coalesce(F.length("shoreline"), F.lit(0)) < 1, "shoreline"),
        F.when(vol.isNotNull() & ~vol.between(1, MAX_VOLUNTEERS), "volunteers"),
        F.when(F.col("pounds") < 0, "pounds"),
        F.when(F.col("cards") == 0, "no cards"),
        F.when(F.col("entered") == 0, "no values"),
    ))
    warnings = F.array_compact(F.array(
        F.when(vol != F.col("cards"), "card count"),
        F.when(F.coalesce(F.col("pounds"), F.lit(0.0)) == 0, "pounds missing"),
        F.when(F.col("weak_cards") > 0, F.concat(F.lit("weak cards "), F.col("weak_cards").cast("string"))),
        F.when(F.col("pending") > 0, F.concat(F.lit("pending "), F.col("pending").cast("string"))),
    ))
    return x.select(
        "event", (F.size(blockers) == 0).alias("can_export"),
        F.array_join(blockers, "; ").alias("blockers"), F.array_join(warnings, "; ").alias("warnings"),
    )
