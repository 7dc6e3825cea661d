"""Windowed quality metrics and progress, the same for a batch and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_metrics(
    events: DataFrame, width: str, slide: str | None = None, *, bar: float = 20.0, late: str | None = None
) -> DataFrame:
    """Readings and covered readings per window and type. `late` sets the watermark of a stream."""
    x = events.withWatermark("ts", late) if late else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return x.groupBy(w.alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= bar).alias("covered")
    ).select(F.col("w.start").alias("start"), "event_type", "n", "covered")


def progress(pages: DataFrame, *, late: str | None = None) -> DataFrame:
    """Pages done per event so far; `total` is what the feed announced."""
    x = pages.withWatermark("ts", late) if late else pages
    return x.groupBy("event").agg(
        F.count(F.lit(1)).alias("done"), F.max("total").alias("total")
    )
