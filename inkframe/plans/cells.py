"""Offered cells, their readings, and how good those are."""

from pyspark.sql import functions as F

from ..functions.readings import needs_review
from ..functions.taxonomy import ITEMS
from ..operators import evaluate, export, labels, readings
from . import views
from .registry import query
from .views import SQL, with_views

GATES = [0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.17, 0.15, 0.1]  # Fixed values of the gate table.


def _quoted(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


SQL["taxonomy"] = ((), "SELECT * FROM (VALUES " + ", ".join(
    f"({r}, {_quoted(n)}, {_quoted(s)}, {_quoted(side)}, {_quoted(c)})" for r, n, s, side, c in ITEMS
) + ") t(item_row, item_name, section, side, printed_column)")

SQL["reads"] = (("readings",), """
  SELECT *,
    CASE WHEN tally IS NOT NULL AND digits IS NOT NULL THEN
           CASE WHEN tally = digits THEN tally
                WHEN abs(tally - digits) <= greatest(tally, digits) * 0.35e0 THEN (tally + digits + 1) // 2 END
         ELSE coalesce(tally, digits) END AS value,
    CASE WHEN tally IS NOT NULL AND digits IS NOT NULL THEN
           CASE WHEN tally = digits THEN 0.99e0
                WHEN abs(tally - digits) <= greatest(tally, digits) * 0.35e0 THEN 0.17e0 END
         WHEN tally IS NOT NULL THEN least(tally_conf, 0.97e0)
         WHEN digits IS NOT NULL THEN least(digit_conf, 0.86e0) END AS confidence,
    CASE WHEN tally IS NOT NULL AND digits IS NOT NULL THEN
           CASE WHEN tally = digits THEN 'agreed'
                WHEN abs(tally - digits) <= greatest(tally, digits) * 0.35e0 THEN 'split' END
         WHEN tally IS NOT NULL THEN 'tally' WHEN digits IS NOT NULL THEN 'digits' END AS source
  FROM readings""")


@query("q_floor", with_views("""
SELECT event, card, item_row, NOT has_value AS tally_only,
       CASE WHEN NOT has_value THEN tally END AS tally, CASE WHEN has_value THEN digits END AS digits
FROM readings
WHERE NOT (ink < 0.008e0 AND tally_ink < 0.008e0) AND (has_value OR tally_marked)""", "readings"))
def q_floor(spark, sf_dir):
    cells = readings.offered(readings.ink_floor(views.readings(spark, sf_dir)))
    return readings.route_readers(cells).select("event", "card", "item_row", "tally_only", "tally", "digits")


@query("q_reconcile", with_views("""
SELECT event, card, item_row, value, confidence, source,
       CASE source WHEN 'digits' THEN 'read: check it' WHEN 'agreed' THEN 'counted twice: check it'
            ELSE 'counted: check it' END AS tag
FROM reads WHERE confidence >= 0.2e0""", "reads"))
def q_reconcile(spark, sf_dir):
    return readings.prefilled(views.readings(spark, sf_dir)).select(
        "event", "card", "item_row", "value", "confidence", "source", "tag"
    )


@query("q_review", with_views("""
SELECT event, card, item_row, confidence,
       CASE h % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'corrected' WHEN 2 THEN 'manual' ELSE 'recognized' END AS value_source
FROM reads WHERE h % 5 > 2 AND confidence < 0.9e0""", "reads"))
def q_review(spark, sf_dir):
    h = F.col("h")
    source = F.when(h % 5 == 0, "accepted").when(h % 5 == 1, "corrected").when(h % 5 == 2, "manual").otherwise("recognized")
    x = readings.with_reading(views.readings(spark, sf_dir)).withColumn("value_source", source)
    return x.filter(needs_review(F.col("value_source"), F.col("confidence"))).select(
        "event", "card", "item_row", "confidence", "value_source"
    )


@query("q_gate", with_views(f"""
SELECT gate, (SELECT count(*) FROM reads) AS total, count(*) FILTER (confidence >= gate) AS filled,
       count(*) FILTER (confidence >= gate AND source = 'split') AS split
FROM reads, (SELECT unnest([{', '.join(f'{g}e0' for g in GATES)}]) AS gate) GROUP BY gate""", "reads"))
def q_gate(spark, sf_dir):
    return readings.gate_coverage(readings.with_reading(views.readings(spark, sf_dir)), GATES)


@query("q_sources", with_views("""
SELECT source, count(*) AS n FROM reads WHERE source IS NOT NULL GROUP BY source""", "reads"))
def q_sources(spark, sf_dir):
    """Readings offered, by the reader they came from."""
    x = readings.with_reading(views.readings(spark, sf_dir)).filter(F.col("source").isNotNull())
    return x.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


AGREEMENT = ["both_read", "agreed", "agreed_scored", "agreed_right", "digits_scored", "digits_right",
             "tally_scored", "tally_right", "split_scored", "split_tally", "split_digits", "split_middle"]


@query("q_agreement", with_views("""WITH x AS (
  SELECT r.event, tally, CASE WHEN digit_conf >= 0.9e0 THEN digits END AS d, n
  FROM readings r LEFT JOIN typed t USING (event, card, item_row))
SELECT event,
  count(*) FILTER (tally IS NOT NULL AND d IS NOT NULL) AS both_read,
  count(*) FILTER (tally = d) AS agreed,
  count(*) FILTER (tally = d AND n IS NOT NULL) AS agreed_scored,
  count(*) FILTER (tally = d AND tally = n) AS agreed_right,
  count(*) FILTER (d IS NOT NULL AND n IS NOT NULL) AS digits_scored,
  count(*) FILTER (d = n) AS digits_right,
  count(*) FILTER (tally IS NOT NULL AND n IS NOT NULL) AS tally_scored,
  count(*) FILTER (tally = n) AS tally_right,
  count(*) FILTER (tally <> d AND n IS NOT NULL) AS split_scored,
  count(*) FILTER (tally <> d AND tally = n) AS split_tally,
  count(*) FILTER (tally <> d AND d = n) AS split_digits,
  count(*) FILTER (tally <> d AND floor((tally + d) / 2 + 0.5e0) = n) AS split_middle
FROM x GROUP BY ROLLUP (event)""", "typed"))
def q_agreement(spark, sf_dir):
    r = views.readings(spark, sf_dir)
    return readings.reader_agreement(r, views.typed_of(r))


@query("q_score", with_views("""
SELECT r.event, r.card, r.item_row, r.value, t.n AS typed,
       CASE WHEN r.value IS NULL THEN 'declined' WHEN t.n IS NULL THEN 'unscored'
            WHEN r.value = t.n THEN 'right' ELSE 'wrong' END AS verdict
FROM reads r LEFT JOIN typed t USING (event, card, item_row)""", "reads", "typed"))
def q_score(spark, sf_dir):
    """Machine reading against the typed value; unmatched stays unscored, declined is not wrong."""
    r = views.readings(spark, sf_dir)
    keys = ["event", "card", "item_row"]
    verdict = (
        F.when(F.col("value").isNull(), "declined").when(F.col("typed").isNull(), "unscored")
        .when(F.col("value") == F.col("typed"), "right").otherwise("wrong")
    )
    x = readings.with_reading(r).join(views.typed_of(r).withColumnRenamed("n", "typed"), keys, "left")
    return x.select(*keys, "value", "typed", verdict.alias("verdict"))


@query("q_recall_list", with_views("""
SELECT coalesce(r.event, t.event) AS event,
  count(r.event) AS before, count(*) FILTER (r.has_value OR r.tally_marked) AS after,
  count(t.event) AS typed, count(*) FILTER (t.event IS NOT NULL AND r.event IS NULL) AS missed_before,
  count(*) FILTER (t.event IS NOT NULL AND NOT (r.has_value OR r.tally_marked)) AS dropped_by_rule,
  CASE WHEN count(r.event) > 0 THEN
    round((1 - (count(*) FILTER (r.has_value OR r.tally_marked)) / count(r.event)) * 100, 4) END AS shorter_pct
FROM (SELECT * FROM readings WHERE NOT (ink < 0.008e0 AND tally_ink < 0.008e0)) r
FULL JOIN typed t ON r.event = t.event AND r.card = t.card AND r.item_row = t.item_row
GROUP BY 1""", "typed"))
def q_recall_list(spark, sf_dir):
    r = views.readings(spark, sf_dir)
    return evaluate.review_list_recall(readings.ink_floor(r), views.typed_of(r))


@query("q_segacc", with_views("""
SELECT r.event, count(*) AS cells,
  count(*) FILTER (pieces = length(CAST(n AS VARCHAR))) AS cut_right,
  count(*) FILTER (pieces <> 0 AND pieces > length(CAST(n AS VARCHAR))) AS cut_over,
  count(*) FILTER (pieces <> 0 AND pieces < length(CAST(n AS VARCHAR))) AS cut_under,
  count(*) FILTER (pieces = 0) AS cut_none
FROM readings r JOIN typed t USING (event, card, item_row) WHERE has_value GROUP BY ROLLUP (event)""", "typed"))
def q_segacc(spark, sf_dir):
    r = views.readings(spark, sf_dir)
    return evaluate.segmentation_accuracy(r, views.typed_of(r))


LETTERS = """(CASE WHEN {i} > 702 THEN chr(CAST(65 + (({i} - 703) // 676) % 26 AS INTEGER)) ELSE '' END ||
  CASE WHEN {i} > 26 THEN chr(CAST(65 + (({i} - 27) // 26) % 26 AS INTEGER)) ELSE '' END ||
  chr(CAST(65 + ({i} - 1) % 26 AS INTEGER)))"""


@query("q_typed", with_views("""
SELECT s.event, s.col_no - 2 AS card, s.item_row,
       CAST(floor(TRY_CAST(value AS DOUBLE) + 0.5e0) AS BIGINT) AS n
FROM sheet_cells s SEMI JOIN taxonomy x ON s.item_row = x.item_row
WHERE NOT is_formula AND col_no > 2 AND TRY_CAST(value AS DOUBLE) IS NOT NULL
  AND floor(TRY_CAST(value AS DOUBLE) + 0.5e0) > 0""", "sheet_cells", "taxonomy"))
def q_typed(spark, sf_dir):
    return labels.typed_values(views.sheet_cells(views.readings(spark, sf_dir)))


@query("q_offset", with_views("""
SELECT r.event, (SELECT count(*) FROM readings z WHERE z.event = r.event AND z.ink >= 0.025e0) AS written,
       CAST(o.shift AS BIGINT) AS shift, count(t.n) AS hits,
       round(count(t.n) / (SELECT count(*) FROM readings z WHERE z.event = r.event AND z.ink >= 0.025e0), 6) AS rate
FROM readings r CROSS JOIN (SELECT unnest([-3, -2, -1, 0, 1, 2, 3]) AS shift) o
LEFT JOIN typed t ON t.event = r.event AND t.item_row = r.item_row AND t.card = r.card + o.shift AND t.n > 0
WHERE r.ink >= 0.025e0 GROUP BY r.event, o.shift""", "typed"))
def q_offset(spark, sf_dir):
    r = views.readings(spark, sf_dir)
    return labels.offset_agreement(r, views.typed_of(r))


SQL["card_gate"] = (("readings", "typed"), """
  SELECT c.*, s.evidence, s.at_zero, s.evidence >= 40 AND s.at_zero < 0.3e0 AS refused,
         CASE WHEN comparable > 0 THEN round(agree / comparable, 6) ELSE 1e0 END AS rate
  FROM (SELECT r.event, r.card,
          count(*) FILTER (ink >= 0.025e0) AS inked, count(*) FILTER (n > 0) AS written,
          count(*) FILTER (n > 0 AND ink < 0.025e0) AS tally_only,
          count(*) FILTER (n > 0 AND ink >= 0.025e0) AS comparable,
          count(*) FILTER (n > 0 AND ink >= 0.025e0 AND pieces = length(CAST(n AS VARCHAR))) AS agree,
          count(*) FILTER (n > 0 AND pieces = length(CAST(n AS VARCHAR))) AS candidates
        FROM readings r LEFT JOIN typed t USING (event, card, item_row) GROUP BY r.event, r.card) c
  JOIN (SELECT r.event, count(*) FILTER (ink >= 0.025e0) AS evidence,
          round(count(*) FILTER (n > 0 AND ink >= 0.025e0) / nullif(count(*) FILTER (ink >= 0.025e0), 0), 6) AS at_zero
        FROM readings r LEFT JOIN typed t USING (event, card, item_row) GROUP BY r.event) s ON s.event = c.event""")
KEPT = "(comparable < 3 OR rate >= 0.6e0) AND NOT refused"


@query("q_labelgate", with_views(f"""
SELECT event, card, inked, written, tally_only, comparable, agree, CAST(evidence AS BIGINT) AS evidence,
       at_zero, refused, rate, {KEPT} AS kept, {LETTERS.format(i='(card + 2)')} AS col,
       CASE WHEN {KEPT} THEN candidates ELSE 0 END AS emitted
FROM card_gate""", "card_gate"))
def q_labelgate(spark, sf_dir):
    r = views.readings(spark, sf_dir)
    return labels.gated_cards(r, views.typed_of(r))


@query("q_labels", with_views(f"""
SELECT r.event, r.card, r.item_row, n AS value, k - 1 AS k, CAST(CAST(n AS VARCHAR)[k] AS BIGINT) AS label
FROM readings r JOIN typed t USING (event, card, item_row)
JOIN (SELECT event, card FROM card_gate WHERE {KEPT}) g ON g.event = r.event AND g.card = r.card
CROSS JOIN range(1, 20) ks(k)
WHERE n > 0 AND pieces = length(CAST(n AS VARCHAR)) AND k <= length(CAST(n AS VARCHAR))""", "card_gate"))
def q_labels(spark, sf_dir):
    r = views.readings(spark, sf_dir)
    return labels.digit_labels(r, views.typed_of(r))


@query("q_class_balance", with_views(f"""
SELECT label, count(*) AS n FROM (
  SELECT CAST(CAST(n AS VARCHAR)[k] AS BIGINT) AS label
  FROM readings r JOIN typed t USING (event, card, item_row)
  JOIN (SELECT event, card FROM card_gate WHERE {KEPT}) g ON g.event = r.event AND g.card = r.card
  CROSS JOIN range(1, 20) ks(k)
  WHERE n > 0 AND pieces = length(CAST(n AS VARCHAR)) AND k <= length(CAST(n AS VARCHAR)))
GROUP BY label""", "card_gate"))
def q_class_balance(spark, sf_dir):
    r = views.readings(spark, sf_dir)
    return labels.digit_labels(r, views.typed_of(r)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("q_cardsum", with_views("""
SELECT event, card, count(*) AS cells,
       array_to_string(list_transform(list_sort(list(DISTINCT CASE WHEN item_row < 52 THEN card * 2 - 1 ELSE card * 2 END)),
                                      lambda p: CAST(p AS VARCHAR)), ', ') AS pages,
       count(DISTINCT source) AS sources,
       CASE WHEN bool_or(NOT has_value AND tally_marked) THEN 'tally' ELSE 'total' END AS card_type
FROM reads GROUP BY event, card""", "reads"))
def q_cardsum(spark, sf_dir):
    page = F.when(F.col("item_row") < 52, F.col("card") * 2 - 1).otherwise(F.col("card") * 2)
    cells = readings.with_reading(views.readings(spark, sf_dir)).withColumn("page_no", page)
    return export.card_summary(cells)


@query("q_union", with_views("""
SELECT event, card, item_row, value, 'front' AS side FROM reads WHERE item_row < 52
UNION ALL
SELECT event, card, item_row, value, 'back' FROM reads WHERE item_row >= 52""", "reads"))
def q_union(spark, sf_dir):
    """Both sides of every card in one list."""
    x = readings.with_reading(views.readings(spark, sf_dir)).select("event", "card", "item_row", "value")
    front = x.filter(F.col("item_row") < 52).withColumn("side", F.lit("front"))
    back = x.filter(F.col("item_row") >= 52).withColumn("side", F.lit("back"))
    return front.unionByName(back)
