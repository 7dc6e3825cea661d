"""Draft saves: last value after a pause, and latest wins."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["file_name", "file_size", "card_count", "cell_count"]


def debounced(saves: DataFrame, keys: list[str], *, quiet: str = "400 milliseconds", late: str = "10 seconds") -> DataFrame:
    """The last save of every burst, once nothing follows it for `quiet`."""
    return (
        saves.withWatermark("ts", late).groupBy(F.session_window("ts", quiet).alias("w"), *keys)
        .agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("saved_at"), F.count(F.lit(1)).alias("saves"))
        .drop("w")
    )


def without_resends(saves: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """One row per save, however often it is sent within the watermark."""
    return saves.withWatermark("ts", late).dropDuplicatesWithinWatermark(["save_id"])


def latest(drafts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key. A maximum, not a window, so it combines before the shuffle."""
    rest = [c for c in drafts.columns if c not in keys and c not in order]
    newest = F.max(F.struct(*order, *rest)).alias("_n")
    return drafts.groupBy(*keys).agg(newest).select(*keys, *[f"_n.{c}" for c in [*order, *rest]])


#: Batches that lie beside the base before they are merged into it.
MERGE_EVERY = 64


def _log(spark: SparkSession, path: str, after: int) -> DataFrame | None:
    """Batches later than `after`; none where nothing was ever written."""
    try:
        rows = spark.read.option("basePath", f"{path}/log").parquet(f"{path}/log")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return rows.filter(F.col("batch") > after).drop("batch")


def _head(spark: SparkSession, path: str) -> int:
    """The last batch that the base holds: the largest number that a pointer file names."""
    try:
        found = spark.read.schema("upto bigint").option("recursiveFileLookup", "true").json(f"{path}/heads").agg(F.max("upto")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = None
    return -1 if found is None else found


def _current(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame | None:
    head = _head(spark, path)
    log = _log(spark, path, head)
    base = spark.read.parquet(f"{path}/base/upto={head}") if head >= 0 else None
    if base is None or log is None:
        whole = base if log is None else log
    else:
        whole = base.unionByName(log, allowMissingColumns=True)
    return None if whole is None else latest(whole, keys, order)


def compact(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> int:
    """Merge all batches into a new base of one row a key, then point at it; the last batch that it holds.

    The pointer is one file, written last: until it is there readers take the old base and the batches. Batches that a base
    holds are never read again, and a replay of one is left out.
    """
    head = _head(spark, path)
    try:
        last = spark.read.option("basePath", f"{path}/log").parquet(f"{path}/log").agg(F.max("batch")).first()[0]
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return head
    if last is None or last <= head:
        return head
    _current(spark, path, keys, order).write.mode("overwrite").parquet(f"{path}/base/upto={last}")
    spark.range(1).select(F.lit(last).cast("bigint").alias("upto")).coalesce(1).write.mode("overwrite").json(f"{path}/heads/upto-{last:012d}")
    return last


def upsert_into(path: str, keys: list[str], order: list[str], merge_every: int = MERGE_EVERY):
    """A `foreachBatch` function keeping the latest row per key.

    Each batch goes to a folder of its own, overwritten if the batch is replayed; after `merge_every` of them they are merged
    into one base, so readers (`read_latest`) open the base and fewer batches than that, however long the stream runs.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        head = _head(batch.sparkSession, path)
        if batch_id <= head:  # a replay of what the base holds
            return
        latest(batch, keys, order).write.mode("overwrite").parquet(f"{path}/log/batch={batch_id}")
        if batch_id - head >= merge_every:
            compact(batch.sparkSession, path, keys, order)

    return write


def read_latest(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row per key over the base and the batches since."""
    rows = _current(spark, path, keys, order)
    if rows is None:
        raise ValueError(f"nothing was written to {path}")
    return rows


def matching(drafts: DataFrame, opened: DataFrame) -> DataFrame:
    """Drafts saved for exactly the file and extraction now opened. They are offered, not applied."""
    return drafts.join(opened.select(*KEYS).distinct(), KEYS, "left_semi")
