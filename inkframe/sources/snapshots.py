"""Versioned snapshots of a table: data first, then one manifest file that names it, so a reader never sees half a version."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

VERSION = "snapshot_version"
#: A version has one row without a folder, which holds its schema, and one for each key: which version's folder has its rows.
MANIFEST = "version int, key string, folder int, rows bigint, stamp string, key_column string, table_schema string"


class BrokenRule(ValueError):
    """Rows break a rule, so nothing was published."""

    def __init__(self, counts: dict[str, int]):
        super().__init__("rule broken: " + ", ".join(f"{k} ({n} rows)" for k, n in sorted(counts.items())))
        self.counts = counts


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """What every complete version holds; no rows where nothing is published yet."""
    try:
        return spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").json(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        # Not from a list of Python's, which starts a worker on every core.
        return spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in (column.split() for column in MANIFEST.split(", "))])


def versions(spark: SparkSession, path: str) -> DataFrame:
    """`(version, keys, rows)` of every complete version."""
    return manifest(spark, path).groupBy("version").agg(F.count("folder").alias("keys"), F.sum(F.when(F.col("folder").isNotNull(), F.col("rows"))).alias("rows"))


def latest_version(spark: SparkSession, path: str) -> int | None:
    return manifest(spark, path).agg(F.max("version")).first()[0]


def write(
    rows: DataFrame, path: str, by: str, *, stamps: DataFrame | None = None, rules: dict[str, Column] | None = None,
    columns: Sequence[str] | None = None, whole: bool = False,
) -> int:
    """Publish a version in which the values of `by` that come up are replaced and others stay (none if `whole`); its number.

    Rows are written to a folder of their own, then a manifest of one file, by rename, which is the commit: what fails before leaves
    the last version as it was. `rules` are conditions that no row may meet; they are counted in the pass that writes, and
    if any is met nothing is published and `BrokenRule` tells how often. Only `columns` are written, rows may have others for
    the rules. `stamps` (key, stamp) names the keys that this version replaces, those without rows too, and a text to keep with
    each. One writer at a time.
    """
    spark = rows.sparkSession
    columns = list(columns or rows.columns)
    if VERSION in columns:
        raise ValueError(f"a column named {VERSION}")
    before = latest_version(spark, path)
    number = (before or 0) + 1
    seen = Observation()
    counts = [F.count_if(bad).alias(name) for name, bad in (rules or {}).items()]
    staged = rows.observe(seen, F.count(F.lit(1)).alias("rows written"), *counts).select(*columns)
    folder = f"{path}/data/{VERSION}={number}"
    staged.hint("rebalance", F.col(by)).write.mode("overwrite").partitionBy(by).parquet(folder)
    written = spark.read.schema(staged.schema).parquet(folder)
    if rules and not written.isEmpty():  # of no rows Spark has no counts
        broken = {name: n for name, n in seen.get.items() if name in rules and n}
        if broken:
            raise BrokenRule(broken)
    found = written.groupBy(F.col(by).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    if stamps is None:
        found = found.withColumn("stamp", F.lit(None).cast("string"))
    else:
        named = stamps.select(F.col("key").cast("string").alias("of"), "stamp")
        found = named.join(found, F.col("of").eqNullSafe(F.col("key")), "left").select(F.col("of").alias("key"), F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"), "stamp")
    found = found.select("key", F.lit(number).alias("folder"), "rows", "stamp")
    if before is not None and not whole:
        old = manifest(spark, path).filter((F.col("version") == before) & F.col("folder").isNotNull()).select("key", "folder", "rows", "stamp")
        gone = found.select(F.col("key").alias("new"))
        found = found.unionByName(old.join(gone, F.col("key").eqNullSafe(F.col("new")), "left_anti"))
    head = spark.range(1).select(*[F.lit(None).cast(t).alias(c) for c, t in (("key", "string"), ("folder", "int"), ("rows", "bigint"), ("stamp", "string"))], F.lit(staged.schema.json()).alias("table_schema"))
    told = found.withColumn("table_schema", F.lit(None).cast("string")).unionByName(head)
    told = told.select(F.lit(number).alias("version"), "key", "folder", "rows", "stamp", F.lit(by).alias("key_column"), "table_schema")
    told.coalesce(1).write.mode("overwrite").json(f"{path}/manifest/v{number:08d}")
    return number


def read(spark: SparkSession, path: str, *, version: int | None = None, keys: Sequence | None = None) -> DataFrame:
    """The rows of a version, the last by default; only the folders of its keys, or of the `keys` named, are opened."""
    number = latest_version(spark, path) if version is None else version
    known = manifest(spark, path).filter(F.col("version") == (-1 if number is None else number))
    head = known.filter("folder is null").first()
    if head is None:
        raise ValueError(f"{path} has no version {number}" if number is not None else f"nothing is published in {path}")
    shape, by = StructType.fromJson(json.loads(head["table_schema"])), head["key_column"]
    data = spark.read.schema(StructType(shape.fields).add(VERSION, IntegerType())).option("basePath", f"{path}/data").parquet(f"{path}/data")
    if keys is not None:
        data = data.filter(F.col(by).isin(list(keys)))
    own = known.filter("folder is not null").select(F.col("key").alias("_key"), F.col("folder").alias("_folder"))
    rows = data.join(own, (F.col(VERSION) == F.col("_folder")) & F.col(by).cast("string").eqNullSafe(F.col("_key")), "left_semi")
    return rows.select(*shape.names)
