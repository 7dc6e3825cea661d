"""Datasheets, file names and the checks around them."""

import uuid

from pyspark.sql import functions as F

from ..functions import text
from ..operators import export, labels, quality, readings
from ..operators.ordered import tasks_for
from ..session import ensure_checkpoint_dir
from ..sources import tables
from ..sources.tables import label_key
from ..streaming import drafts, metrics
from . import views
from .cells import LETTERS
from .registry import ORACLES, query
from .views import SQL, table, whole, with_views

# ------------------------------------------------------------------ jobs
SQL["jobs"] = ((), """
  SELECT o_orderkey AS event,
         CASE WHEN o_orderkey % 17 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date,
         CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE n_name END AS shoreline,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 80 END AS volunteers,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN -1e0 ELSE CAST(o_orderkey % 40 AS DOUBLE) END AS pounds,
         CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 6 + 1 END AS duration_hours,
         c_name AS data_entry_volunteer, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'Club ' || n_name END AS club,
         CASE WHEN o_orderkey % 13 = 0 THEN 2 ELSE 0 END AS alignment_problems
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
SQL["job_values"] = ((), """
  SELECT l_orderkey AS event, 1 + l_suppkey % 76 AS card, 18 + l_partkey % 93 AS item_row,
         max(CAST(l_quantity AS BIGINT)) - 1 AS value, (max(l_partkey) % 100) / 100e0 AS confidence,
         CASE max(l_returnflag) WHEN 'R' THEN 'manual' ELSE 'recognized' END AS source
  FROM lineitem GROUP BY ALL""")


def jobs(spark, sf_dir):
    k = F.col("o_orderkey")
    day = F.col("o_orderdate")
    return views.order_places(spark, sf_dir).select(
        k.alias("event"),
        F.when(k % 17 == 0, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd")).alias("date"),
        F.when(k % 19 == 0, "").otherwise(F.col("n_name")).alias("shoreline"),
        F.when(k % 5 != 0, k % 80).alias("volunteers"),
        F.when(k % 7 == 0, None).when(k % 23 == 0, -1.0).otherwise((k % 40).cast("double")).alias("pounds"),
        F.when(k % 3 != 0, k % 6 + 1).alias("duration_hours"),
        F.col("c_name").alias("data_entry_volunteer"),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("Club "), "n_name")).alias("club"),
        F.when(k % 13 == 0, 2).otherwise(0).alias("alignment_problems"),
    )


def job_values(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("event"), (F.col("l_suppkey") % 76 + 1).alias("card"),
        (F.col("l_partkey") % 93 + 18).alias("item_row"), "l_partkey", whole("l_quantity").alias("q"), "l_returnflag",
    )
    keys = ["event", "card", "item_row"]
    return views.dealt(li, *keys).groupBy(*keys).agg(
        (F.max("q") - 1).alias("value"),
        ((F.max("l_partkey") % 100) / F.lit(100.0)).alias("confidence"),
        F.when(F.bool_or(F.col("l_returnflag") == "R"), "manual").otherwise("recognized").alias("source"),
    )


@query("q_exportgate", with_views("""WITH c AS (
  SELECT event, card, count(*) FILTER (source = 'recognized') AS scored,
         count(*) FILTER (source = 'recognized' AND confidence < 0.9e0) AS low, count(*) FILTER (value > 0) AS entered
  FROM job_values GROUP BY ALL),
e AS (SELECT event, count(*) AS cards, count(*) FILTER (scored > 0 AND scored = low) AS weak, sum(low) AS pending,
             sum(entered) AS entered FROM c GROUP BY event),
x AS (SELECT j.*, coalesce(cards, 0) AS cards, coalesce(weak, 0) AS weak, coalesce(pending, 0) AS pending,
             coalesce(entered, 0) AS entered FROM jobs j LEFT JOIN e USING (event)),
y AS (SELECT event, concat_ws('; ', CASE WHEN alignment_problems > 0 THEN 'alignment' END,
        CASE WHEN NOT regexp_full_match(date, '\\d{4}-\\d{2}-\\d{2}') THEN 'date' END,
        CASE WHEN shoreline = '' THEN 'shoreline' END,
        CASE WHEN volunteers < 1 OR volunteers > 76 THEN 'volunteers' END,
        CASE WHEN pounds < 0 THEN 'pounds' END,
        CASE WHEN cards = 0 THEN 'no cards' END, CASE WHEN entered = 0 THEN 'no values' END) AS blockers,
      concat_ws('; ', CASE WHEN volunteers <> cards THEN 'card count' END,
        CASE WHEN coalesce(pounds, 0) = 0 THEN 'pounds missing' END,
        CASE WHEN weak > 0 THEN 'weak cards ' || CAST(weak AS VARCHAR) END,
        CASE WHEN pending > 0 THEN 'pending ' || CAST(CAST(pending AS BIGINT) AS VARCHAR) END) AS warnings FROM x)
SELECT event, blockers = '' AS can_export, blockers, warnings FROM y""", "jobs", "job_values"))
def q_exportgate(spark, sf_dir):
    return export.export_gate(jobs(spark, sf_dir), job_values(spark, sf_dir))


REF = LETTERS.format(i="(card + 2)") + " || CAST(item_row AS VARCHAR)"
CHAPTER = """CASE WHEN regexp_full_match(date, '\\d{4}-\\d{2}-\\d{2}') THEN
  CAST(CAST(date[6:7] AS INTEGER) AS VARCHAR) || '.' || CAST(CAST(date[9:10] AS INTEGER) AS VARCHAR) || '.' || date[3:4]
  ELSE date END"""


@query("q_edits", with_views(f"""
SELECT event, 'A2' AS ref, 'text' AS kind, data_entry_volunteer AS value FROM jobs
UNION ALL SELECT event, 'A4', 'text', club FROM jobs WHERE club <> ''
UNION ALL SELECT event, 'A6', 'text', {CHAPTER} FROM jobs
UNION ALL SELECT event, 'A8', 'text', shoreline FROM jobs
UNION ALL SELECT event, 'A10', 'number', CAST(volunteers AS VARCHAR) FROM jobs WHERE volunteers IS NOT NULL
UNION ALL SELECT event, 'A12', 'number', CAST(pounds AS VARCHAR) FROM jobs WHERE pounds IS NOT NULL
UNION ALL SELECT event, 'A14', 'text', CAST(duration_hours AS VARCHAR) || ' hours' FROM jobs WHERE duration_hours IS NOT NULL
UNION ALL SELECT event, {REF}, 'number', CAST(value AS VARCHAR) FROM job_values WHERE value > 0""", "jobs", "job_values"))
def q_edits(spark, sf_dir):
    return export.cell_edits(jobs(spark, sf_dir), job_values(spark, sf_dir))


@query("q_wide", with_views("""
SELECT event, item_row, """ + ", ".join(
    f'CAST(sum(value) FILTER (card = {i - 2}) AS BIGINT) AS "{export._letters(i)}"' for i in range(3, 79)
) + " FROM reads GROUP BY event, item_row", "reads"))
def q_wide(spark, sf_dir):
    return export.wide_datasheet(readings.with_reading(views.readings(spark, sf_dir, by=("event", "item_row"))))


@query("q_provenance", with_views(f"""
SELECT r.event, r.card, {LETTERS.format(i='(r.card + 2)')} AS col, p.pages, p.card_type, r.item_row,
       coalesce(x.item_name, '?') AS item_name, v AS value,
       format('{{:.3f}}', CASE WHEN r.value = v AND r.confidence >= 0.2e0 THEN r.confidence ELSE 1e0 END) AS confidence,
       CASE WHEN r.value = v AND r.confidence >= 0.2e0 THEN 'recognized' ELSE 'human' END AS source
FROM (SELECT *, CASE WHEN h % 10 = 0 THEN q + 1 ELSE coalesce(value, q) END AS v FROM reads) r
JOIN (SELECT event, card, string_agg(DISTINCT CASE WHEN item_row < 52 THEN 'front' ELSE 'back' END, ', '
             ORDER BY CASE WHEN item_row < 52 THEN 'front' ELSE 'back' END) AS pages,
             CASE WHEN bool_or(NOT has_value AND tally_marked) THEN 'tally' ELSE 'total' END AS card_type
      FROM reads GROUP BY event, card) p ON p.event = r.event AND p.card = r.card
LEFT JOIN taxonomy x ON x.item_row = r.item_row
WHERE v > 0""", "reads", "taxonomy"))
def q_provenance(spark, sf_dir):
    r = readings.with_reading(views.readings(spark, sf_dir))
    final = F.when(F.col("h") % 10 == 0, F.col("q") + 1).otherwise(F.coalesce("value", "q"))
    values = r.select("event", "card", "item_row", final.alias("value"))
    machine = readings.prefilled(views.readings(spark, sf_dir))
    page = F.when(F.col("item_row") < 52, "front").otherwise("back")
    cards = export.card_summary(r.withColumn("page_no", page)).select("event", "card", "pages", "card_type")
    return export.provenance(export.attributed(values, machine), cards)


@query("q_roundtrip", with_views("""
SELECT event, count(*) AS written, count(*) AS read_back, 0 AS differing
FROM readings GROUP BY event""", "readings"))
def q_roundtrip(spark, sf_dir):
    """Write `card*1000+row` everywhere, read it back from the references, compare both ways."""
    keys = ["event", "card", "item_row"]
    values = views.readings(spark, sf_dir).select(
        *keys, (F.col("card") * 1000 + F.col("item_row")).alias("value")
    )
    back = export.read_back(export.count_edits(values))
    # One pass instead of two set differences: each row is counted on both sides.
    both = values.select("*", F.lit(1).alias("w"), F.lit(0).alias("r")).unionByName(
        back.select("*", F.lit(0).alias("w"), F.lit(1).alias("r"))
    )
    tasks = 2 * tasks_for(table(spark, sf_dir, "lineitem"))
    both = both.repartition(tasks, *keys).groupBy(*keys, "value").agg(F.sum("w").alias("w"), F.sum("r").alias("r"))
    return both.groupBy("event").agg(
        F.sum("w").alias("written"), F.sum("r").alias("read_back"),
        F.sum(F.when(F.col("w") != F.col("r"), 1).otherwise(0)).cast("int").alias("differing"),
    )


@query("q_rollup", with_views("""
SELECT section, item_row, CAST(sum(value) AS BIGINT) AS total, count(*) AS cells
FROM (SELECT x.section, x.item_row, CAST(l_quantity AS BIGINT) AS value
      FROM lineitem JOIN taxonomy x ON x.item_row = 18 + l_partkey % 93)
GROUP BY ROLLUP (section, item_row)""", "taxonomy"))
def q_rollup(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 93 + 18).cast("int").alias("item_row"), whole("l_quantity").alias("value")
    )
    return export.item_totals(li)


# ------------------------------------------------------------------ names
@query("q_strings", with_views(r"""WITH p AS (
  SELECT id, fname, regexp_extract(fname, '(?i)^(\d{1,2})\.(\d{1,2})\.(\d{2,4})[_-](.+?)(?:[_-]CH\d+)?\.pdf$',
                                   ['mm', 'dd', 'yy', 'place']) AS m,
         regexp_matches(fname, '(?i)^(\d{1,2})\.(\d{1,2})\.(\d{2,4})[_-](.+?)(?:[_-]CH\d+)?\.pdf$') AS ok FROM names),
d AS (SELECT id, fname, CASE WHEN ok THEN '20' || m.yy || '-' || lpad(m.mm, 2, '0') || '-' || lpad(m.dd, 2, '0') END AS scan_date,
             CASE WHEN ok THEN trim(regexp_replace(m.place, '[-_]+', ' ', 'g')) END AS place FROM p)
SELECT id, fname, scan_date, place,
       CASE WHEN scan_date IS NULL THEN NULL ELSE CAST(CAST(scan_date[6:7] AS INTEGER) AS VARCHAR) || '.' ||
         CAST(CAST(scan_date[9:10] AS INTEGER) AS VARCHAR) || '.' || scan_date[3:4] END AS chapter_date,
       scan_date || '_' || replace(place, ' ', '-') || '.xlsx' AS suggested,
       lower(regexp_replace(fname, '[^A-Za-z0-9]', '', 'g')) AS match_key
FROM d""", "names"))
def q_strings(spark, sf_dir):
    n = F.col("fname")
    x = views.names(spark, sf_dir).withColumn("scan_date", text.scan_date(n)).withColumn("place", text.scan_place(n))
    return x.withColumn("chapter_date", text.chapter_date(F.col("scan_date"))).withColumn(
        "suggested", text.suggested_filename(F.col("scan_date"), F.col("place"))
    ).withColumn("match_key", text.match_key(n))


@query("q_colname", """WITH RECURSIVE r AS (
  SELECT p_partkey AS id, (p_partkey + 1) * (p_partkey + 1) * (p_partkey + 1) AS idx, (p_partkey + 1) * (p_partkey + 1) * (p_partkey + 1) AS n, '' AS letters FROM part
  UNION ALL
  SELECT id, idx, (n - 1) // 26, chr(CAST(65 + (n - 1) % 26 AS INTEGER)) || letters FROM r WHERE n > 0)
SELECT id, idx, letters, idx AS back FROM r WHERE n = 0""")
def q_colname(spark, sf_dir):
    """The cube of the key and one, so that names of one letter to seven and more come up."""
    k = F.col("p_partkey").cast("bigint") + 1
    x = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (k * k * k).alias("idx"))
    return x.withColumn("letters", text.column_name(F.col("idx"))).withColumn("back", text.column_index(F.col("letters")))


@query("q_age", """WITH s AS (
  SELECT event_id, CAST(floor((epoch_us(date_trunc('day', ts)) - epoch_us(ts)) / 1e6 + 0.5e0) AS BIGINT)
         + 86400 * (1 + event_id % 4) AS s FROM events),
m AS (SELECT *, CAST(floor(s / 60 + 0.5e0) AS BIGINT) AS mi FROM s),
h AS (SELECT *, CAST(floor(mi / 60 + 0.5e0) AS BIGINT) AS ho FROM m),
d AS (SELECT *, CAST(floor(ho / 24 + 0.5e0) AS BIGINT) AS da FROM h)
SELECT event_id, CASE WHEN s < 90 THEN 'just now' WHEN mi < 60 THEN CAST(mi AS VARCHAR) || ' minutes ago'
  WHEN ho < 24 THEN CAST(ho AS VARCHAR) || CASE WHEN ho = 1 THEN ' hour ago' ELSE ' hours ago' END
  ELSE CAST(da AS VARCHAR) || CASE WHEN da = 1 THEN ' day ago' ELSE ' days ago' END END AS age FROM d""")
def q_age(spark, sf_dir):
    """Age of a save, seen from a midnight up to four days later."""
    ts = F.col("ts").cast("timestamp")
    left = F.floor((F.unix_micros(F.date_trunc("day", ts)) - F.unix_micros(ts)) / F.lit(1e6) + 0.5).cast("bigint")
    seconds = left + (F.col("event_id") % 4 + 1) * 86400
    return table(spark, sf_dir, "events").select("event_id", text.describe_age(seconds).alias("age"))


@query("q_props", r"""
SELECT event_type, regexp_extract(props, '"(\w+)": ?(\d+)', 1) AS key, count(*) AS n,
       CAST(sum(CAST(regexp_extract(props, '"(\w+)": ?(\d+)', 2) AS BIGINT)) AS BIGINT) AS total
FROM events GROUP BY ALL""")
def q_props(spark, sf_dir):
    """JSON maps to key and value rows, aggregated."""
    ev = table(spark, sf_dir, "events")
    kv = ev.select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return kv.groupBy("event_type", "key").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("bigint")).alias("total")
    )


@query("q_fuzzy", """WITH base AS (
  SELECT o_orderkey AS k, o_orderdate AS d, n_name AS place
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
scans AS (SELECT DISTINCT lower(regexp_replace(place, '[^A-Za-z0-9]', '', 'g')) AS pk, place || '-' || month(d) || '.' || day(d) || '.' || CAST(year(d) AS VARCHAR)[3:4] AS name,
                 CAST(month(d) AS VARCHAR) || CAST(day(d) AS VARCHAR) || CAST(year(d) AS VARCHAR)[3:4] AS s1,
                 '20' || strftime(d, '%y%m%d') AS s2 FROM base),
sheets AS (SELECT DISTINCT CASE WHEN k % 3 = 0 THEN 'Data ' || strftime(d + to_days(CAST(k % 2 AS INTEGER)), '20%y-%m-%d') || ' ' || place
             ELSE place || ' (' || month(d + to_days(CAST(k % 2 AS INTEGER))) || '_' || day(d + to_days(CAST(k % 2 AS INTEGER))) || '_' || strftime(d, '%y') || ') data' END || '.xlsx' AS sheet FROM base),
keyed AS (SELECT sheet, lower(regexp_replace(sheet, '[^A-Za-z0-9]', '', 'g')) AS key FROM sheets)
SELECT name, min(sheet) AS sheet FROM scans s LEFT JOIN keyed k
  ON contains(k.key, s.pk) AND (contains(k.key, s.s1) OR contains(k.key, s.s2)) GROUP BY name""")
def q_fuzzy(spark, sf_dir):
    """Scan folders matched to datasheet files by place and date in the name."""
    b = views.order_places(spark, sf_dir)
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    yy = F.date_format(d, "yy")
    scans = b.select(
        F.concat("n_name", F.lit("-"), F.month(d).cast("string"), F.lit("."), F.day(d).cast("string"), F.lit("."), yy).alias("name"),
        F.col("n_name").alias("place"), F.month(d).alias("m"), F.day(d).alias("d"), yy.alias("yy"),
    ).distinct()
    e = F.date_add(d.cast("date"), (k % 2).cast("int"))
    sheets = b.select(
        F.when(k % 3 == 0, F.concat(F.lit("Data 20"), F.date_format(e, "yy-MM-dd"), F.lit(" "), "n_name"))
        .otherwise(F.concat("n_name", F.lit(" ("), F.month(e).cast("string"), F.lit("_"), F.day(e).cast("string"), F.lit("_"), yy, F.lit(") data")))
        .alias("s")
    ).select(F.concat("s", F.lit(".xlsx")).alias("sheet")).distinct()
    return labels.match_sheets(scans, sheets)


# ------------------------------------------------------------------ checks
@query("q_quality", with_views(f"""
SELECT 'unknown row' AS rule, page, cell FROM cells_map ANTI JOIN taxonomy USING (item_row)
UNION ALL SELECT 'wrong side', page, cell FROM cells_map c JOIN taxonomy x USING (item_row) WHERE c.side <> x.side
UNION ALL SELECT 'wrong column', page, cell FROM cells_map c JOIN taxonomy x USING (item_row) WHERE c.printed_column <> x.printed_column
UNION ALL SELECT 'row twice', page, cell FROM (SELECT *, count(*) OVER (PARTITION BY page, item_row) AS n FROM cells_map) WHERE n > 1
UNION ALL SELECT 'total without area', page, cell FROM cells_map WHERE total_w <= 0 OR total_h <= 0
UNION ALL SELECT 'tally without area', page, cell FROM cells_map WHERE tally_w <= 0 OR tally_h <= 0
UNION ALL SELECT 'total off the page', page, cell FROM cells_map WHERE total_x < 0 OR total_y < 0 OR total_x + total_w > {views.PAGE_W} OR total_y + total_h > {views.PAGE_H}
UNION ALL SELECT 'tally off the page', page, cell FROM cells_map WHERE tally_x < 0 OR tally_y < 0 OR tally_x + tally_w > {views.PAGE_W} OR tally_y + tally_h > {views.PAGE_H}
UNION ALL SELECT 'boxes overlap', page, cell FROM (
  SELECT page, cell, total_y, lag(total_y + total_h * 0.5e0) OVER (PARTITION BY page, printed_column ORDER BY total_y, cell) AS bar FROM cells_map)
  WHERE total_y < bar""", "cells_map", "taxonomy"))
def q_quality(spark, sf_dir):
    return quality.cell_map_violations(views.cells_map(spark, sf_dir), views.PAGE_W, views.PAGE_H)


@query("q_quality_events", with_views("""
SELECT 'date' AS rule, event, CAST(NULL AS BIGINT) AS card, CAST(NULL AS BIGINT) AS item_row FROM jobs WHERE NOT regexp_full_match(date, '\\d{4}-\\d{2}-\\d{2}')
UNION ALL SELECT 'shoreline', event, NULL, NULL FROM jobs WHERE shoreline = ''
UNION ALL SELECT 'volunteers', event, NULL, NULL FROM jobs WHERE volunteers < 1 OR volunteers > 76
UNION ALL SELECT 'pounds', event, NULL, NULL FROM jobs WHERE pounds < 0
UNION ALL SELECT 'not an item row', event, card, item_row FROM job_values ANTI JOIN taxonomy USING (item_row)
UNION ALL SELECT 'card number', event, card, item_row FROM job_values WHERE card < 1 OR card > 76
UNION ALL SELECT 'negative value', event, card, item_row FROM job_values WHERE value < 0
UNION ALL SELECT 'confidence', event, card, item_row FROM job_values WHERE confidence < 0 OR confidence > 1
UNION ALL SELECT 'source', event, card, item_row FROM job_values WHERE source NOT IN ('recognized','accepted','corrected','manual')
UNION ALL SELECT 'formula column', event, card, item_row FROM job_values WHERE card = 0
UNION ALL SELECT 'row twice', event, card, item_row FROM job_values GROUP BY ALL HAVING count(*) > 1""", "jobs", "job_values", "taxonomy"))
def q_quality_events(spark, sf_dir):
    return quality.event_violations(jobs(spark, sf_dir), job_values(spark, sf_dir))


# ------------------------------------------------------------------ saves, as a batch
def saves(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file_name"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value")
    )


@query("q_latest", """
SELECT file_name, ts, event_id, value FROM (
  SELECT user_id AS file_name, CAST(ts AS TIMESTAMP) AS ts, event_id, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def q_latest(spark, sf_dir):
    """The newest save of each file."""
    return drafts.latest(saves(spark, sf_dir), ["file_name"], ["ts", "event_id"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("q_upsert", ORACLES["q_latest"])
def q_upsert(spark, sf_dir):
    """The same from a folder that batches of saves went to, were merged in, and were replayed to."""
    keys, order = ["file_name"], ["ts", "event_id"]
    path = f"{ensure_checkpoint_dir(spark)}/saves-{uuid.uuid4().hex}"
    write, rows = drafts.upsert_into(path, keys, order, merge_every=2), saves(spark, sf_dir)
    cut = rows.agg((F.min("event_id") + F.max("event_id")) / 2).first()[0]
    write(rows.filter(F.col("event_id") <= cut), 0)
    write(rows.filter(F.col("event_id") > cut), 1)
    write(rows.limit(0), 2)
    write(rows.filter(F.col("event_id") <= cut).withColumn("value", F.lit(-1.0)), 0)  # the base holds it already
    return drafts.read_latest(spark, path, keys, order).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


SQL["frozen"] = ((), """
  SELECT l_suppkey % 25 AS event, l_orderkey % 76 + 1 AS card, l_partkey % 93 + 18 AS item_row, max(CAST(l_quantity AS BIGINT)) AS n, max(l_discount) AS ink
  FROM lineitem GROUP BY ALL""")


@query("q_freeze", with_views("""
WITH big AS (SELECT event FROM frozen GROUP BY event HAVING count(*) * 25 > (SELECT count(*) FROM frozen))
SELECT 1 AS version, * FROM frozen
UNION ALL SELECT 2, event, card, item_row, CASE WHEN event IN (SELECT event FROM big) THEN n + 100 ELSE n END, ink FROM frozen""", "frozen"))
def q_freeze(spark, sf_dir):
    """Cells frozen by event, then the larger events frozen again with other counts; both versions read back."""
    cells = table(spark, sf_dir, "lineitem").groupBy(
        (F.col("l_suppkey") % 25).alias("event"), (F.col("l_orderkey") % 76 + 1).alias("card"), (F.col("l_partkey") % 93 + 18).alias("item_row"),
    ).agg(F.max(whole("l_quantity")).alias("n"), F.max("l_discount").alias("ink"))
    path = f"{ensure_checkpoint_dir(spark)}/cells-{uuid.uuid4().hex}"
    tables.write_cells(cells, path)
    frozen = tables.rescore(spark, path)
    every = frozen.count()
    big = frozen.groupBy("event").count().filter(F.col("count") * 25 > every).select("event")
    tables.write_cells(frozen.join(big, "event", "left_semi").withColumn("n", F.col("n") + 100), path)
    return tables.rescore(spark, path, version=1).select(F.lit(1).alias("version"), "*").unionByName(
        tables.rescore(spark, path).select(F.lit(2).alias("version"), "*"))


@query("q_progress", """
SELECT user_id AS event, count(*) AS done, max(event_id % 50) AS total FROM events GROUP BY user_id""")
def q_progress(spark, sf_dir):
    pages = table(spark, sf_dir, "events").select(F.col("user_id").alias("event"), (F.col("event_id") % 50).alias("total"))
    return metrics.progress(pages)


@query("q_debounce", """WITH s AS (
  SELECT user_id AS file_name, CAST(ts AS TIMESTAMP) AS ts, event_id, value FROM events),
b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY file_name ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM s),
g AS (SELECT *, sum(opens) OVER (PARTITION BY file_name ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS burst FROM b)
SELECT file_name, max(ts) AS saved_at, count(*) AS saves FROM g GROUP BY file_name, burst""")
def q_debounce(spark, sf_dir):
    """Bursts of saves with pauses under six hours, and when each ended."""
    out = drafts.debounced(saves(spark, sf_dir), ["file_name"], quiet="6 hours")
    return out.select("file_name", F.col("saved_at").cast("timestamp_ntz").alias("saved_at"), "saves")


@query("q_label_keys", """
SELECT event_id, 'scan ' || user_id || ':x' AS event, CAST(event_id % 60 AS INTEGER) AS card, CAST(18 + event_id % 83 AS INTEGER) AS item_row FROM events""")
def q_label_keys(spark, sf_dir):
    """Label keys, of scan names that hold a colon themselves, taken apart."""
    ev = table(spark, sf_dir, "events")
    key = F.concat(F.lit("scan "), F.col("user_id").cast("string"), F.lit(":x:"), (F.col("event_id") % 60).cast("string"),
                   F.lit(":"), (F.col("event_id") % 83 + 18).cast("string"))
    return ev.select("event_id", *label_key(key, F.lit(None)))
