"""Scoring digit predictions."""

from pyspark.sql import functions as F

from ..operators import evaluate, ordered, readings
from . import views
from .registry import query
from .views import with_views


def _doubles(values) -> str:
    return ", ".join(f"{float(v)}e0" for v in values)


@query("q_curve", with_views(f"""WITH t AS (SELECT unnest([{_doubles(evaluate.CURVE_THRESHOLDS)}]) AS threshold),
d AS (SELECT threshold, count(*) AS digits, count(*) FILTER (conf >= threshold) AS answered,
             count(*) FILTER (conf >= threshold AND predicted = label) AS right_n
      FROM pred CROSS JOIN t GROUP BY threshold),
c AS (SELECT source, cell, min(conf) AS worst, bool_and(predicted = label) AS ok FROM pred GROUP BY source, cell),
w AS (SELECT threshold, count(*) FILTER (worst >= threshold) AS whole_cells,
             count(*) FILTER (worst >= threshold AND ok) AS cells_right
      FROM c CROSS JOIN t GROUP BY threshold)
SELECT threshold, digits, answered, right_n AS "right", whole_cells, cells_right,
       CASE WHEN answered > 0 THEN round(right_n / answered, 6) END AS precision
FROM d JOIN w USING (threshold)""", "pred"))
def q_curve(spark, sf_dir):
    return evaluate.precision_curve(views.pred(spark, sf_dir))


@query("q_confusion", with_views("""
SELECT label, """ + ", ".join(f"count(*) FILTER (predicted = {i}) AS p{i}" for i in range(10)) + """
FROM pred GROUP BY label""", "pred"))
def q_confusion(spark, sf_dir):
    return evaluate.confusion_matrix(views.pred(spark, sf_dir))


@query("q_worst_confusions", with_views("""
SELECT label, predicted, count(*) AS n FROM pred WHERE label <> predicted
GROUP BY ALL ORDER BY n DESC, label, predicted LIMIT 8""", "pred"))
def q_worst_confusions(spark, sf_dir):
    return evaluate.worst_confusions(views.pred(spark, sf_dir))


@query("q_recall", with_views("""
SELECT label, count(*) AS n, count(*) FILTER (predicted = label) AS "right",
       round(count(*) FILTER (predicted = label) / count(*), 6) AS recall
FROM pred GROUP BY label""", "pred"))
def q_recall(spark, sf_dir):
    return evaluate.class_recall(views.pred(spark, sf_dir), "label")


@query("q_event_accuracy", with_views("""
SELECT source, count(*) AS n, count(*) FILTER (predicted = label) AS "right",
       round(count(*) FILTER (predicted = label) / count(*), 6) AS recall
FROM pred GROUP BY source""", "pred"))
def q_event_accuracy(spark, sf_dir):
    return evaluate.class_recall(views.pred(spark, sf_dir), "source")


REACHABLE = """
SELECT {keys} target, max(answered) AS answered, max_by("right", answered) AS "right", max_by(conf, answered) AS gate
FROM (SELECT {keys} conf, CAST(sum(n) OVER w AS BIGINT) AS answered, CAST(sum(r) OVER w AS BIGINT) AS "right"
      FROM (SELECT {keys} conf, count(*) AS n, count(*) FILTER (correct) AS r FROM scored GROUP BY ALL)
      WINDOW w AS ({part} ORDER BY conf DESC)) c
JOIN (SELECT unnest([{targets}]) AS target) t ON "right" / answered >= target GROUP BY ALL"""


@query("q_reachable", with_views("""WITH scored AS (SELECT conf, predicted = label AS correct FROM pred)""" + REACHABLE.format(
    keys="", part="", targets=_doubles(evaluate.TARGETS)) + """
UNION ALL SELECT target, NULL, NULL, NULL FROM (SELECT unnest([""" + _doubles(evaluate.TARGETS) + """]) AS target)
WHERE target > (SELECT max(p) FROM (SELECT sum(CASE WHEN correct THEN 1 ELSE 0 END) OVER w / count(*) OVER w AS p
  FROM scored WINDOW w AS (ORDER BY conf DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))""", "pred"))
def q_reachable(spark, sf_dir):
    x = views.pred(spark, sf_dir).select("conf", (F.col("predicted") == F.col("label")).alias("correct"))
    return evaluate.reachable_precision(x)


@query("q_number", with_views("""
SELECT source, cell, count(*) AS digits,
       CASE WHEN count(*) <= 3 THEN CAST(string_agg(CAST(predicted AS VARCHAR), '' ORDER BY k, predicted, conf) AS BIGINT) END AS value,
       CASE WHEN count(*) <= 3 THEN min(conf) END AS confidence
FROM pred GROUP BY source, cell""", "pred"))
def q_number(spark, sf_dir):
    """Digits of a cell put together; more than three is no number, the worst digit is its trust."""
    return readings.digits_to_number(views.pred(spark, sf_dir))


@query("q_topn", """
SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn
FROM orders QUALIFY rn <= 3""")
def q_topn(spark, sf_dir):
    """First N pages per group."""
    orders = views.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    x = ordered.first_n(orders, ["o_custkey"], [F.col("o_orderkey")], 3)
    return x.withColumn("rn", F.col("rn").cast("bigint"))


@query("q_quantile", """
SELECT event_type, n, sorted[CAST(least(n - 1, floor(n * 0.2e0)) AS BIGINT) + 1] AS value
FROM (SELECT event_type, count(*) AS n, list_sort(list(value)) AS sorted FROM events GROUP BY event_type)""")
def q_quantile(spark, sf_dir):
    ev = views.table(spark, sf_dir, "events").select("event_type", "value")
    return ordered.order_statistic(ev, ["event_type"], "value", 0.2, chunk_width=1.0)


@query("q_tumble", """
SELECT 'day' AS kind, CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n,
       count(*) FILTER (value >= 20e0) AS covered
FROM events GROUP BY ALL
UNION ALL
SELECT 'sliding', start, event_type, count(*), count(*) FILTER (value >= 20e0)
FROM (SELECT date_trunc('hour', ts) - INTERVAL 6 HOUR * (k - 1) - INTERVAL 1 HOUR * (hour(ts) % 6) AS start, event_type, value
      FROM events, range(1, 5) r(k)) GROUP BY ALL""")
def q_tumble(spark, sf_dir):
    """Counts and coverage per event type, by day and by sliding day every six hours."""
    from ..streaming.metrics import window_metrics

    ev = views.table(spark, sf_dir, "events")
    return window_metrics(ev, "1 day").select(F.lit("day").alias("kind"), "*").unionByName(
        window_metrics(ev, "1 day", "6 hours").select(F.lit("sliding").alias("kind"), "*")
    )
