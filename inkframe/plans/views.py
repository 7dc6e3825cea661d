"""The given tables seen in the shapes the operators read.

Each view is written twice: as a DataFrame, and as SQL for the other engine. Every view
reads its tables whole, and grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import tasks_for

# Shape of one page raster in the derived views.
PAGE_W, PAGE_H = 32, 50

SQL: dict[str, tuple[tuple[str, ...], str]] = {}


def with_views(sql: str, *names: str) -> str:
    """Prefix `sql` with the named views and what they rest on."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in SQL[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({SQL[n][1].strip()})" for n in order)
    text = sql.strip()
    if text.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{text[14:].lstrip()}"
    if text.upper().startswith("WITH"):
        return f"WITH {ctes},\n{text[4:].lstrip()}"
    return f"WITH {ctes}\n{text}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(column: str) -> Column:
    return F.col(column).cast("bigint")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of a table dealt by `keys` to as many tasks as they ask for, so that what a task groups doesn't grow with the table."""
    return rows.repartition(tasks_for(rows), *keys)


# ------------------------------------------------------------------ page feed
SQL["seq"] = ((), """
  SELECT user_id AS event, event_id AS page_no,
         CASE WHEN event_type IN ('click','purchase','view') THEN 'front' ELSE 'back' END AS side,
         ((event_id * 37) % 101) / 100e0 AS overlap
  FROM events""")


def seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("event"),
        F.col("event_id").alias("page_no"),
        F.when(F.col("event_type").isin("click", "purchase", "view"), "front").otherwise("back").alias("side"),
        (((F.col("event_id") * 37) % 101) / F.lit(100.0)).alias("overlap"),
    )


# ------------------------------------------------------------------ rasters
SQL["ras_px"] = ((), f"""
  SELECT l_suppkey AS page, l_partkey % {PAGE_W} AS x, CAST(l_quantity AS BIGINT) - 1 AS y,
         CAST(max(CAST(floor(l_extendedprice) AS BIGINT)) % 256 AS BIGINT) AS v
  FROM lineitem GROUP BY ALL""")
SQL["raster"] = (("ras_px",), f"""
  SELECT p.page, gx.x, gy.y, coalesce(r.v, 255) AS v
  FROM (SELECT DISTINCT page FROM ras_px) p
  CROSS JOIN (SELECT CAST(range AS BIGINT) AS x FROM range({PAGE_W})) gx
  CROSS JOIN (SELECT CAST(range AS BIGINT) AS y FROM range({PAGE_H})) gy
  LEFT JOIN ras_px r ON r.page = p.page AND r.x = gx.x AND r.y = gy.y""")


def scanlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(page, y, px)`: one row per raster line, missing pixels and lines are paper.

    A line is one aggregation buffer, a slot per column, and lines are dealt to as many tasks as the table asks for: a task holds
    some thousand buffers, and a hot page is spread by its lines. A page's few lines then meet, and those
    that are absent are filled in there: the table is read once.
    """
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("page"),
        (F.col("l_partkey") % PAGE_W).alias("x"),
        (whole("l_quantity") - 1).alias("y"),
        F.floor("l_extendedprice").cast("int").alias("v"),
    )
    slots = [F.max(F.when(F.col("x") == i, F.col("v"))).alias(f"p{i}") for i in range(PAGE_W)]
    height = F.sequence(F.lit(0).cast("bigint"), F.lit(PAGE_H - 1).cast("bigint"))
    px = F.array(*[F.coalesce(F.col(f"p{i}") % 256, F.lit(255)).cast("smallint") for i in range(PAGE_W)])
    n = tasks_for(li)
    there = li.repartition(n, "page", "y").groupBy("page", "y").agg(*slots).select("page", "y", px.alias("px"))
    pages = there.repartition(n, "page").groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("y", "px"))).alias("m"))
    blank = F.array_repeat(F.lit(255).cast("smallint"), PAGE_W)
    filled = F.transform(height, lambda y: F.struct(y.alias("y"), F.coalesce(F.try_element_at("m", y), blank).alias("px")))
    return pages.select("page", F.inline(filled))


def pixels(lines: DataFrame) -> DataFrame:
    """Long form of scanlines."""
    return lines.select("page", "y", F.posexplode("px").alias("x", "v")).select(
        "page", F.col("x").cast("bigint").alias("x"), "y", F.col("v").cast("bigint").alias("v")
    )


SQL["mask"] = (("raster",), "SELECT page, x, y FROM raster WHERE v < 170")

# ------------------------------------------------------------------ cell maps
SQL["cells_map"] = ((), """
  SELECT p_partkey AS cell, p_partkey // 20 AS page, 18 + p_partkey % 93 AS item_row,
         CASE WHEN p_size % 2 = 0 THEN 'left' ELSE 'right' END AS printed_column,
         CASE WHEN p_partkey % 93 < 34 THEN 'front' ELSE 'back' END AS side,
         14 + (p_partkey * 7) % 14 AS total_x, (p_partkey * 5) % 46 AS total_y,
         CAST(2 + p_size % 4 AS BIGINT) AS total_w, CAST(3 + p_size % 6 AS BIGINT) AS total_h,
         (p_partkey * 3) % 8 AS tally_x, (p_partkey * 5) % 46 AS tally_y,
         CAST(4 + p_size % 5 AS BIGINT) AS tally_w, CAST(3 + p_size % 6 AS BIGINT) AS tally_h
  FROM part""")


def cells_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), whole("p_size")
    return table(spark, sf_dir, "part").select(
        k.alias("cell"),
        F.floor(k / 20).cast("bigint").alias("page"),
        (k % 93 + 18).alias("item_row"),
        F.when(s % 2 == 0, "left").otherwise("right").alias("printed_column"),
        F.when(k % 93 < 34, "front").otherwise("back").alias("side"),
        (F.lit(14) + (k * 7) % 14).alias("total_x"), ((k * 5) % 46).alias("total_y"),
        (s % 4 + 2).alias("total_w"), (s % 6 + 3).alias("total_h"),
        ((k * 3) % 8).alias("tally_x"), ((k * 5) % 46).alias("tally_y"),
        (s % 5 + 4).alias("tally_w"), (s % 6 + 3).alias("tally_h"),
    )


SQL["excl"] = ((), """
  SELECT s_suppkey AS page, (s_suppkey * 11) % 26 AS x, (s_suppkey * 13) % 45 AS y,
         CAST(3 + s_nationkey % 4 AS BIGINT) AS w, CAST(4 + s_nationkey % 5 AS BIGINT) AS h
  FROM supplier""")


def excl(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("s_suppkey"), whole("s_nationkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("page"), ((k * 11) % 26).alias("x"), ((k * 13) % 45).alias("y"),
        (n % 4 + 3).alias("w"), (n % 5 + 4).alias("h"),
    )


# ------------------------------------------------------------------ readings and sheets
SQL["readings"] = ((), """
  SELECT event, card, item_row, ink, tally_ink, has_value, tally_marked, h, q,
         CASE WHEN h % 4 = 0 THEN NULL ELSE q END AS tally,
         (pk % 100) / 100e0 AS tally_conf,
         CASE WHEN h % 3 = 0 THEN NULL WHEN h % 7 < 4 THEN q WHEN h % 7 = 4 THEN q + 1
              WHEN h % 7 = 5 THEN q * 2 + 3 ELSE greatest(q - 2, 0) END AS digits,
         (h % 100) / 100e0 AS digit_conf,
         CASE WHEN h % 9 = 0 THEN 0 WHEN h % 9 = 1 THEN length(CAST(q AS VARCHAR)) + 1
              WHEN h % 9 = 2 THEN length(CAST(q AS VARCHAR)) - 1
              ELSE length(CAST(q AS VARCHAR)) END AS pieces
  FROM (
    SELECT *, pk * 31 + card * 17 + q * 7 AS h FROM (
      SELECT l_suppkey AS event, 1 + l_orderkey % 76 AS card, 18 + l_partkey % 93 AS item_row,
             max(l_partkey) AS pk, max(CAST(l_quantity AS BIGINT)) AS q, max(l_discount) AS ink,
             max(l_tax) AS tally_ink, max(l_linestatus) = 'F' AS has_value,
             max(l_returnflag) <> 'R' AS tally_marked
      FROM lineitem GROUP BY ALL))""")


def readings(spark: SparkSession, sf_dir: str, by: tuple[str, ...] = ("event", "card", "item_row")) -> DataFrame:
    """One row per `(event, card, item_row)` with what two readers said of it; rows are dealt `by` these, or by some of them.

    Flags are reduced as booleans: a maximum over strings would turn the aggregation into a sort.
    """
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("event"), (F.col("l_orderkey") % 76 + 1).alias("card"), (F.col("l_partkey") % 93 + 18).alias("item_row"),
        "l_partkey", whole("l_quantity").alias("q"), "l_discount", "l_tax", "l_linestatus", "l_returnflag",
    )
    base = dealt(li, *by).groupBy("event", "card", "item_row").agg(
        F.max("l_partkey").alias("pk"),
        F.max("q").alias("q"),
        F.max("l_discount").alias("ink"),
        F.max("l_tax").alias("tally_ink"),
        F.bool_and(F.col("l_linestatus") == "F").alias("has_value"),
        F.bool_and(F.col("l_returnflag") != "R").alias("tally_marked"),
    )
    h, q = F.col("h"), F.col("q")
    n = F.length(q.cast("string")).cast("bigint")
    return base.withColumn("h", F.col("pk") * 31 + F.col("card") * 17 + q * 7).select(
        "event", "card", "item_row", "ink", "tally_ink", "has_value", "tally_marked", "h", "q",
        F.when(h % 4 != 0, q).alias("tally"),
        ((F.col("pk") % 100) / F.lit(100.0)).alias("tally_conf"),
        F.when(h % 3 == 0, None).when(h % 7 < 4, q).when(h % 7 == 4, q + 1)
        .when(h % 7 == 5, q * 2 + 3).otherwise(F.greatest(q - 2, F.lit(0))).alias("digits"),
        ((h % 100) / F.lit(100.0)).alias("digit_conf"),
        F.when(h % 9 == 0, 0).when(h % 9 == 1, n + 1).when(h % 9 == 2, n - 1).otherwise(n).alias("pieces"),
    )


SQL["typed"] = (("readings",), """
  SELECT event, card, item_row,
         CASE WHEN h % 11 < 8 THEN q WHEN h % 11 = 8 THEN q + 1 ELSE q + 10 END AS n
  FROM readings WHERE h % 6 <> 0""")


def typed_of(readings_df: DataFrame) -> DataFrame:
    """The hand-typed sheet belonging to the readings: mostly equal, some off, some absent."""
    h, q = F.col("h"), F.col("q")
    return readings_df.filter(h % 6 != 0).select(
        "event", "card", "item_row",
        F.when(h % 11 < 8, q).when(h % 11 == 8, q + 1).otherwise(q + 10).alias("n"),
    )


SQL["sheet_cells"] = (("readings",), """
  SELECT event, 1 + card + h % 2 AS col_no, item_row,
         CASE h % 13 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN '-' || CAST(q AS VARCHAR)
              WHEN 3 THEN CAST(q AS VARCHAR) || '.5' ELSE CAST(q AS VARCHAR) END AS value,
         h % 17 = 0 AS is_formula
  FROM readings""")


def sheet_cells(readings_df: DataFrame) -> DataFrame:
    """Raw sheet cells; `col` holds letters, as a sheet has them."""
    from ..functions.text import column_name

    h, q = F.col("h"), F.col("q").cast("string")
    return readings_df.select(
        "event", column_name(F.col("card") + 1 + h % 2).alias("col"), "item_row",
        F.when(h % 13 == 0, "").when(h % 13 == 1, "n/a").when(h % 13 == 2, F.concat(F.lit("-"), q))
        .when(h % 13 == 3, F.concat(q, F.lit(".5"))).otherwise(q).alias("value"),
        (h % 17 == 0).alias("is_formula"),
    )


# ------------------------------------------------------------------ digit predictions
SQL["pred"] = ((), """
  SELECT l_suppkey AS source, l_orderkey AS cell, l_linenumber AS k, l_partkey % 10 AS label,
         CASE WHEN (l_partkey * 7 + l_suppkey) % 10 < 7 THEN l_partkey % 10
              ELSE (l_partkey + CAST(l_quantity AS BIGINT)) % 10 END AS predicted,
         (CAST(floor(l_extendedprice) AS BIGINT) % 1001) / 1000e0 AS conf
  FROM lineitem""")


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified digits: truth, prediction and confidence, with the cell each digit belongs to."""
    p = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("source"), F.col("l_orderkey").alias("cell"),
        F.col("l_linenumber").alias("k"), (p % 10).alias("label"),
        F.when((p * 7 + F.col("l_suppkey")) % 10 < 7, p % 10)
        .otherwise((p + whole("l_quantity")) % 10).alias("predicted"),
        ((F.floor("l_extendedprice").cast("bigint") % 1001) / F.lit(1000.0)).alias("conf"),
    )


# ------------------------------------------------------------------ pen strokes
SQL["seg0"] = ((), """
  SELECT l_orderkey AS strip, CAST(l_linenumber AS BIGINT) AS k,
         max(l_partkey) * 31 + max(CAST(l_quantity AS BIGINT)) * 7 + CAST(l_linenumber AS BIGINT) AS h,
         max(l_returnflag) = 'R' AS is_bar
  FROM lineitem GROUP BY l_orderkey, l_linenumber""")
SQL["segments"] = (("seg0",), """
  SELECT strip, k, CASE WHEN is_bar THEN 'bar' ELSE 'stroke' END AS kind,
         CASE WHEN h % 19 = 0 THEN 50 ELSE 84 + h % 13 END AS angle,
         CASE WHEN h % 23 = 0 THEN 5 ELSE 20 + h % 7 END AS length,
         CASE WHEN h % 23 = 0 THEN 4 ELSE 19 + h % 7 END AS ink,
         CASE WHEN is_bar THEN k * 10 - 22 ELSE k * 10 + h % 3 - 1 END AS min_x,
         CASE WHEN is_bar THEN k * 10 + 4 ELSE k * 10 + h % 3 + 1 END AS max_x,
         20 AS min_y, CASE WHEN h % 29 = 0 THEN 70 ELSE 40 + h % 4 END AS max_y,
         k * 10 + h % 3 AS mid_x
  FROM seg0""")
SQL["strips"] = (("segments",), """
  SELECT strip, CAST(sum(ink) + (strip % 5) * 3 AS BIGINT) AS ink,
         CAST(sum(ink) * 3 AS BIGINT) AS raw_ink, strip % 31 = 0 AS clipped
  FROM segments GROUP BY strip""")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight pen strokes taken out of tally strips."""
    base = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("strip"), whole("l_linenumber").alias("k"))
        .agg(
            (F.max("l_partkey") * 31 + F.max(whole("l_quantity")) * 7).alias("_h"),
            F.bool_or(F.col("l_returnflag") == "R").alias("is_bar"),
        )
    )
    h, k, bar = F.col("_h") + F.col("k"), F.col("k"), F.col("is_bar")
    return base.select(
        "strip", "k", F.when(bar, "bar").otherwise("stroke").alias("kind"),
        F.when(h % 19 == 0, 50).otherwise(h % 13 + 84).alias("angle"),
        F.when(h % 23 == 0, 5).otherwise(h % 7 + 20).alias("length"),
        F.when(h % 23 == 0, 4).otherwise(h % 7 + 19).alias("ink"),
        F.when(bar, k * 10 - 22).otherwise(k * 10 + h % 3 - 1).alias("min_x"),
        F.when(bar, k * 10 + 4).otherwise(k * 10 + h % 3 + 1).alias("max_x"),
        F.lit(20).cast("bigint").alias("min_y"),
        F.when(h % 29 == 0, 70).otherwise(h % 4 + 40).alias("max_y"),
        (k * 10 + h % 3).alias("mid_x"),
    )


def strips_of(segments_df: DataFrame) -> DataFrame:
    return segments_df.groupBy("strip").agg(
        (F.sum("ink") + F.max(F.col("strip") % 5) * 3).alias("ink"),
        (F.sum("ink") * 3).alias("raw_ink"),
        (F.max("strip") % 31 == 0).alias("clipped"),
    )


# ------------------------------------------------------------------ digit boxes
SQL["boxes"] = ((), """
  SELECT crop, k, h % 60 AS min_x, h % 60 + h % 23 AS max_x,
         (h // 5) % 20 AS min_y, (h // 5) % 20 + (h // 7) % 38 AS max_y,
         greatest(1, ((h % 23 + 1) * ((h // 7) % 38 + 1) * ((h // 11) % 20)) // 40) AS count
  FROM (SELECT l_orderkey AS crop, CAST(l_linenumber AS BIGINT) AS k,
               max(l_partkey) * 13 + max(CAST(l_quantity AS BIGINT)) * 29 + max(l_suppkey) AS h
        FROM lineitem GROUP BY l_orderkey, l_linenumber)""")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounding boxes of connected ink inside TOTAL-box crops (crop height 58)."""
    base = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("crop"), whole("l_linenumber").alias("k"))
        .agg((F.max("l_partkey") * 13 + F.max(whole("l_quantity")) * 29 + F.max("l_suppkey")).alias("h"))
    )

    def over(n: int) -> Column:
        return F.floor(F.col("h") / n).cast("bigint")

    h = F.col("h")
    area = (h % 23 + 1) * (over(7) % 38 + 1) * (over(11) % 20)
    return base.select(
        "crop", "k", (h % 60).alias("min_x"), (h % 60 + h % 23).alias("max_x"),
        (over(5) % 20).alias("min_y"), (over(5) % 20 + over(7) % 38).alias("max_y"),
        F.greatest(F.lit(1).cast("bigint"), F.floor(area / 40).cast("bigint")).alias("count"),
    )


# ------------------------------------------------------------------ digit vectors
SQL["samples"] = ((), """
  SELECT vec_id AS sample_id, vec_id // 100 AS source, label,
         list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v
  FROM embeddings""")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled vectors; the 64 values are taken as an 8 by 8 bitmap."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.floor(F.col("vec_id") / 100).cast("bigint").alias("source"),
        "label", F.col("embedding").cast("array<double>").alias("v"),
    )


# ------------------------------------------------------------------ file names
SQL["names"] = ((), """
  SELECT o_orderkey AS id, CAST(month(o_orderdate) AS VARCHAR) || '.' || CAST(day(o_orderdate) AS VARCHAR)
         || '.' || CAST(year(o_orderdate) AS VARCHAR)[3:4] || '_' || replace(n_name, '_', '-')
         || '_CH' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0')
         || CASE WHEN o_orderkey % 9 = 0 THEN '.jpg' ELSE '.pdf' END AS fname
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")


def order_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's nation. The joins are Spark's to choose."""
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "o_orderdate", "o_totalprice", "n_name", "c_name")
    )


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    fname = F.concat(
        F.month(d).cast("string"), F.lit("."), F.day(d).cast("string"), F.lit("."),
        F.substring(F.year(d).cast("string"), 3, 2), F.lit("_"), F.regexp_replace("n_name", "_", "-"),
        F.lit("_CH"), F.lpad((k % 100).cast("string"), 2, "0"),
        F.when(k % 9 == 0, ".jpg").otherwise(".pdf"),
    )
    return order_places(spark, sf_dir).select(k.alias("id"), fname.alias("fname"))
