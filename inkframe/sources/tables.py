"""JSON sources and the sinks of cells, samples, models and datasheets. Every schema is declared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import column_name
from . import snapshots

RECT = "struct<x:int,y:int,width:int,height:int>"
CELL_MAP_SCHEMA = (
    f"side string, referenceSize struct<width:int,height:int>, referenceDpi int, exclusions array<{RECT}>, "
    f"cells array<struct<row:int,column:string,total:{RECT},tally:{RECT}>>"
)
OVERRIDES_SCHEMA = ", ".join(
    f"{side} array<struct<row:int,reason:string,total:{RECT},tally:{RECT}>>" for side in ("front", "back")
)
SAMPLES_SCHEMA = (
    "source string, samples array<struct<label:int,bitmap:array<int>,card:int,row:int,value:int,source:string>>"
)
EXEMPLAR_SCHEMA = "k int, digitAccuracy double, trainedOn array<string>, samples array<struct<label:int,b:string>>"


def read_cell_map(spark: SparkSession, path: str, side: str) -> DataFrame:
    """Calibrated cells of one side, one row each; a file that declares another side is an error."""
    maps = spark.read.schema(CELL_MAP_SCHEMA).json(path, multiLine=True)
    checked = F.when(F.col("side") == side, F.col("side")).otherwise(
        F.raise_error(F.concat(F.lit("cell map declares side "), F.col("side")))
    )
    flat = maps.select(checked.alias("side"), "referenceSize", F.explode("cells").alias("c"))
    boxes = [
        F.col(f"c.{box}.{field}").alias(f"{box}_{short}")
        for box in ("total", "tally") for field, short in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h"))
    ]
    return flat.select(
        "side", F.col("c.row").alias("item_row"), F.col("c.column").alias("printed_column"), *boxes,
        F.col("referenceSize.width").alias("page_w"), F.col("referenceSize.height").alias("page_h"),
    )


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """Rectangles of a side that hold no cells."""
    maps = spark.read.schema(CELL_MAP_SCHEMA).json(path, multiLine=True)
    return maps.select("side", F.explode("exclusions").alias("e")).select(
        "side", "e.x", "e.y", F.col("e.width").alias("w"), F.col("e.height").alias("h")
    )


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Hand-measured corrections of both sides, null where nothing was measured."""
    raw = spark.read.schema(OVERRIDES_SCHEMA).json(path, multiLine=True)
    sides = F.array(*[
        F.struct(F.lit(s).alias("side"), F.col(s).alias("list")) for s in ("front", "back")
    ])
    flat = raw.select(F.inline(sides)).select("side", F.explode("list").alias("o"))
    boxes = [
        F.col(f"o.{box}.{field}").alias(f"{box}_{short}")
        for box in ("total", "tally") for field, short in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h"))
    ]
    return flat.select("side", F.col("o.row").alias("item_row"), F.col("o.reason").alias("reason"), *boxes)


def label_key(key: Column, event: Column) -> list[Column]:
    """`scan:card:row` or `card:row` taken apart into event, card and item row."""
    parts = F.split(key, ":")
    n = F.size(parts)
    # A scan name may hold colons itself; card and row are the last two parts.
    scan = F.when(n > 2, F.array_join(F.slice(parts, 1, n - 2), ":")).otherwise(event)
    return [
        scan.alias("event"), F.get(parts, n - 2).try_cast("int").alias("card"), F.get(parts, n - 1).try_cast("int").alias("item_row")
    ]


def read_labels(spark: SparkSession, path: str, field: str = "labels") -> DataFrame:
    """Labels kept as `{"scan:card:row": value}` or `{"card:row": value}`, one row per label."""
    raw = spark.read.schema(f"event string, {field} map<string,string>").json(path, multiLine=True)
    x = raw.select("event", F.explode(field).alias("key", "value"))
    return x.select(*label_key(F.col("key"), F.col("event")), "value", F.col("value").try_cast("int").alias("n"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Training samples of all files; the source is the record's, else the file's, else its name."""
    raw = spark.read.schema(SAMPLES_SCHEMA).json(path, multiLine=True)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    x = raw.select(F.col("source").alias("_file"), stem.alias("_stem"), F.explode("samples").alias("s"))
    source = F.coalesce("s.source", "_file", "_stem")
    return x.select(
        source.alias("source"), "s.card", F.col("s.row").alias("item_row"), "s.label", "s.value",
        F.transform("s.bitmap", lambda v: v.cast("double")).alias("v"),
    )


def read_exemplars(spark: SparkSession, path: str) -> DataFrame:
    """Exemplars of a shipped model: labels and raw bytes, opened to arrays."""
    raw = spark.read.schema(EXEMPLAR_SCHEMA).json(path, multiLine=True)
    x = raw.select("k", F.posexplode("samples").alias("ex", "s")).select(
        "k", F.col("ex").cast("bigint").alias("ex"), "s.label", F.hex(F.unbase64("s.b")).alias("_hex")
    )
    pairs = F.sequence(F.lit(0), F.floor(F.length("_hex") / 2).cast("int") - 1)
    byte = F.transform(pairs, lambda i: F.conv(F.substr("_hex", i * 2 + 1, F.lit(2)), 16, 10).cast("double"))
    return x.select("k", "ex", "label", byte.alias("v"))


def _replace(rows: DataFrame, path: str, by: str, fmt: str) -> None:
    """Replace the folders of the values of `by` that come up, and leave the others alone.

    Rows of a value meet before they are written, so that it gets few files; large values are split by Spark.
    """
    gathered = rows.hint("rebalance", F.col(by))
    gathered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).format(fmt).save(path)


def write_cells(cells: DataFrame, path: str) -> int:
    """Freeze cells by event, so that any number of rules can be scored on them later; the number of the version.

    Events that come up are replaced and others stay. A version counts once its manifest is there: see `snapshots`.
    """
    return snapshots.write(cells, path, "event")


def rescore(spark: SparkSession, path: str, events: list[str] | None = None, version: int | None = None) -> DataFrame:
    """Frozen cells of the last version or another; only the named events' folders are opened."""
    return snapshots.read(spark, path, version=version, keys=events)


def write_samples(labels: DataFrame, path: str) -> None:
    """Labelled digits as JSON lines, by source."""
    _replace(labels, path, "source", "json")


def write_prefills(prefills: DataFrame, path: str) -> None:
    """Pre-filled cells as JSON, for reading by eye."""
    prefills.write.mode("overwrite").json(path)


def write_exemplars(samples: DataFrame, path: str, k: int = 5, accuracy: float | None = None) -> None:
    """A model as `read_exemplars` reads it: k, accuracy, training sources, and exemplars as raw bytes in base64.

    A model is one JSON record, and so one row: it holds the exemplars that a reader compares with, a bounded number.
    A value that is no whole number from 0 to 255 is refused.
    """
    fits = F.forall("v", lambda x: x.isNotNull() & (x == F.floor(x)) & x.between(0, 255))
    checked = F.when(fits, F.col("v")).otherwise(F.raise_error(F.lit("an exemplar's value is no whole number from 0 to 255")))
    hexes = F.array_join(F.transform(checked, lambda x: F.lpad(F.hex(x.cast("bigint")), 2, "0")), "")
    packed = samples.select("source", F.col("label").cast("int").alias("label"), F.base64(F.unhex(hexes)).alias("b"))
    model = packed.agg(
        F.lit(k).alias("k"), F.lit(accuracy).cast("double").alias("digitAccuracy"), F.array_sort(F.collect_set("source")).alias("trainedOn"),
        F.transform(F.array_sort(F.collect_list(F.struct("source", "label", "b"))), lambda s: F.struct(s["label"].alias("label"), s["b"].alias("b"))).alias("samples"),
    )
    model.write.mode("overwrite").json(path)


def write_datasheet(edits: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Datasheet edits by event."""
    _replace(edits, path, "event", fmt)


def card_column(cards: DataFrame) -> DataFrame:
    """Name each card's sheet column."""
    return cards.withColumn("col", column_name(F.col("card") + 2))
