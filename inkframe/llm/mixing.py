"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Share of a source in the mix is its share of documents to this power, so large sources give way to small ones.
POWER = 0.7
#: Rows of the table of rates up to which it is broadcast; beyond, both sides are salted.
BROADCAST, SALTS = 10_000, 16
#: Largest mean of copies: beyond, e to its negative is too small for a double.
LARGEST = 500.0


def uniform(*parts: Column | str) -> Column:
    """A number from 0 to 1 (excluded) from the first 52 bits of the MD5 of the parts, which any engine can repeat."""
    return bits52(*parts).cast("double") / F.lit(float(1 << 52))


def bits52(*parts: Column | str) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("long")


def target_rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER, size: int | None = None) -> DataFrame:
    """source, n, rate: mean copies of a document of each source, so that the mix of `size` documents (default: as many as
    there are) has the target weights. Sources without a weight are left out; without any `weights` all follow `power`."""
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(power))
    elif weights:
        weight = F.element_at(F.create_map(*(F.lit(x) for k, v in sorted(weights.items()) for x in (k, float(v)))), F.col("source"))
    else:
        weight = F.lit(None).cast("double")
    n = stored(n.withColumn("weight", F.coalesce(weight, F.lit(0.0))), "sources")
    every, total = n.agg(F.sum("n"), F.sum("weight")).first()
    if not every or not total:
        return n.select("source", "n", F.lit(0.0).alias("rate"))
    wanted = float(every if size is None else size)
    return n.select("source", "n", (F.col("weight") / F.lit(float(total)) * F.lit(wanted) / F.col("n")).alias("rate"))


def with_copies(docs: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """row (all columns of `docs`), copies: the Poisson distribution of the source's rate inverted at a hash of the id."""
    most = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int")
    steps = F.aggregate(
        F.sequence(F.lit(1), most),
        F.struct(F.exp(-F.col("rate")).alias("p"), F.exp(-F.col("rate")).alias("c"), F.array(F.exp(-F.col("rate"))).alias("cdf")),
        lambda s, k: F.struct(
            (s.p * F.col("rate") / k).alias("p"), (s.c + s.p * F.col("rate") / k).alias("c"),
            F.concat(s.cdf, F.array(s.c + s.p * F.col("rate") / k)).alias("cdf"),
        ),
        lambda s: s.cdf,
    )
    rates = stored(rates.select(F.col("source").alias("of"), "rate", steps.alias("cdf")), "rates")
    n, top = rates.agg(F.count("*"), F.max("rate")).first()
    if (top or 0.0) > LARGEST:
        raise ValueError(f"a source would be repeated {top:.0f} times; the most is {LARGEST:.0f}")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    if n <= BROADCAST:
        joined = rows.join(F.broadcast(rates), F.col("row.source").eqNullSafe(F.col("of")))
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("row.doc_id"), F.lit(SALTS)))
        each = rates.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(each, F.col("row.source").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("of_salt")))
    u = uniform(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), F.lit(str(seed)))
    return joined.withColumn("u", u).select("row", F.size(F.filter("cdf", lambda c: c <= F.col("u"))).alias("copies"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER, size: int | None = None, seed: int = 42) -> DataFrame:
    """row (all columns of `docs`), copy, shuffle_key: each document as often as its draw says, in globally random order.

    The order is that of `shuffle_key`, a hash of id, copy and seed: a range-partitioned sort, so the files that Spark writes
    are in the order of the mix. Draws depend on the id and the seed alone: repeated rows get the same number of copies each.
    A null source is a source; a null id counts as empty; texts aren't looked at. An empty table gives no rows. Only `doc_id`
    and `source` are used, other columns are carried along whatever their names.
    """
    drawn = with_copies(docs, target_rates(docs, weights, power, size), seed).where("copies > 0")
    drawn = drawn.select("row", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    key = bits52(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), F.col("copy").cast("string"), F.lit(f"{seed}-order"))
    return drawn.withColumn("shuffle_key", key).orderBy("shuffle_key", "row.doc_id")


def oracle(power: float = POWER, seed: int = 42) -> str:
    """The same rows in SQL, over `documents`."""
    return f"""
with s as (select source, count(*) as n, power(cast(count(*) as double), {power}) as w from documents group by source),
r as (select source, w / (select sum(w) from s) * (select cast(sum(n) as double) from s) / n as rate from s),
c as (
  select source, k, sum(exp(-rate + case when k = 0 then 0 else k * ln(rate) end - lgamma(k + 1))) over (partition by source order by k) as cdf
  from (select source, rate, unnest(range(0, cast(ceil(rate + 12 * sqrt(rate) + 20) as bigint) + 1)) as k from r)
),
d as (
  select doc_id, source,
    cast(cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || '|{seed}'), 1, 13) as bigint) as double) / 4503599627370496.0 as u
  from documents
),
n as (select d.doc_id, d.source, count(*) as copies from d join c on d.source is not distinct from c.source and c.cdf <= d.u group by d.doc_id, d.source),
e as (select doc_id, source, unnest(range(0, copies)) as copy from n)
select doc_id, source, cast(copy as integer) as copy,
  cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || '|' || cast(copy as varchar) || '|{seed}-order'), 1, 13) as bigint) as shuffle_key
from e
"""
