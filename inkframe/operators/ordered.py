"""Ordered computations over groups of any size.

A plain window puts a whole group into one task. Here the ordering of a group is
cut into chunks by a column that never decreases along the order (an id divided by
a width, a day, a value bucket). Rows are windowed inside `(keys, chunk)`, the
chunk totals - one short row per chunk - are windowed along the group, and the
carries are joined back. The big side is shuffled once, by `(keys, chunk)`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_WIDTH = 4096


#: Rows that a task is given where the number of tasks is to follow the input.
TASK_ROWS = 250_000


def tasks_for(df: DataFrame, rows: int | None = None) -> int:
    """Tasks that `df` asks for at `rows` each, no fewer than run at once. Of a stored table only the footers are read."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // (rows or TASK_ROWS)))


def dealt(df: DataFrame, tasks: int, column: str) -> DataFrame:
    """Rows whose `column`, an int, is k go to task k; before Spark 4.1, by ranges of it, which may put two values into one task."""
    if hasattr(df, "repartitionById"):
        return df.repartitionById(tasks, column)
    return df.repartitionByRange(tasks, column)


def id_chunk(column: str, width: int = CHUNK_WIDTH) -> Column:
    """An order-preserving chunk number for an integer position column."""
    return F.floor(F.col(column) / F.lit(width)).cast("bigint")


def running(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Sequence[str],
    order: Sequence[Column],
    sums: dict[str, Column],
) -> DataFrame:
    """Inclusive running sums of each expression in `sums`, per group, in order.

    `chunk` names columns of `df` which sort the same way as `order` does.
    """
    parts = [*keys, *chunk]
    inside = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df
    for name, expr in sums.items():
        local = local.withColumn(name, F.sum(expr).over(inside))
    totals = df.groupBy(*parts).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    before = (
        Window.partitionBy(*keys)
        .orderBy(*chunk)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(
        *parts, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_c_{n}") for n in sums]
    )
    joined = local.join(carry, parts)
    for name in sums:
        joined = joined.withColumn(name, F.col(name) + F.col(f"_c_{name}"))
    return joined.drop(*[f"_c_{n}" for n in sums])


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Sequence[str],
    order: Sequence[Column],
    name: str = "rn",
) -> DataFrame:
    """1-based position of each row in its group, for groups of any size."""
    return running(df, keys, chunk, order, {name: F.lit(1).cast("bigint")})


def batched(
    df: DataFrame, keys: Sequence[str], chunk: Sequence[str], order: Sequence[Column], per: int, name: str = "batch"
) -> DataFrame:
    """Number consecutive batches of `per` rows in each group, from 0; `place` is the row's place in its own."""
    x = numbered(df, keys, chunk, order, "_rn")
    return x.withColumn(name, F.floor((F.col("_rn") - 1) / per).cast("bigint")).withColumn(
        "place", (F.col("_rn") - 1) % per
    ).drop("_rn")


def first_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rn"
) -> DataFrame:
    """First `n` rows per group; the group limit runs before the shuffle as well as after."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def order_statistic(
    df: DataFrame, keys: Sequence[str], value: str, quantile: float, chunk_width: float = 64.0
) -> DataFrame:
    """`sorted(values)[min(n-1, floor(n*q))]` per group, exact.

    Values are counted before they are shuffled; the running count over the distinct
    values goes chunk by chunk, so neither a hot group nor many distinct values
    end up in one task.
    """
    counts = (
        df.groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_chunk", F.floor(F.col(value) / F.lit(chunk_width)).cast("bigint"))
    )
    cum = running(counts, keys, ["_chunk"], [F.col(value)], {"_seen": F.col("_n")})
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    rank = F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(quantile)).cast("bigint"))
    return (
        cum.join(totals, list(keys))
        .filter((F.col("_seen") > rank) & (F.col("_seen") - F.col("_n") <= rank))
        .select(*keys, "n", F.col(value))
    )
