"""Cell maps: hand-measured corrections and completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["page", "item_row"]


def apply_overrides(cells: DataFrame, overrides: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Patch the given fields where an override measures them; other fields stay as detected."""
    ov = overrides.select(*KEYS, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_o"))
    x = cells.join(ov, KEYS, "left")
    for f in fields:
        x = x.withColumn(f, F.coalesce(f"_{f}", f))
    return x.withColumn("overridden", F.col("_o").isNotNull()).drop("_o", *[f"_{f}" for f in fields])


def override_errors(cells: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides that name no detected cell."""
    return overrides.join(cells.select(*KEYS), KEYS, "left_anti")


def missing_rows(cells: DataFrame, items: DataFrame) -> DataFrame:
    """Items printed on a page's side that its map lacks."""
    sides = cells.select("page", "side").distinct()
    expected = sides.join(F.broadcast(items.select("side", "item_row")), "side")
    return expected.join(cells.select("page", "side", "item_row"), ["page", "side", "item_row"], "left_anti")
