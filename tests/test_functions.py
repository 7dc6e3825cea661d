"""Pure functions on worked cases."""

from pyspark.sql import functions as F

from inkframe.functions import readings, taxonomy, text, vectors
from inkframe.operators import export, quality


def test_reconcile_branches(spark):
    rows = [
        (None, 0.0, None, 0.0, None), (7, 0.8, 7, 0.4, (7, 0.99, "agreed")), (10, 0.8, 13, 0.9, (12, 0.17, "split")),
        (2, 0.9, 9, 0.9, None), (4, 0.99, None, 0.0, (4, 0.97, "tally")), (None, 0.0, 5, 0.95, (5, 0.86, "digits")),
        (None, 0.0, 5, 0.3, (5, 0.3, "digits")),
    ]
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i int, t bigint, tc double, d bigint, dc double")
    r = readings.reconcile(F.col("t"), F.col("tc"), F.col("d"), F.col("dc"))
    got = {x.i: tuple(x.r) if x.r else None for x in df.select("i", r.alias("r")).collect()}
    assert got == {i: r[4] for i, r in enumerate(rows)}
    alone = readings.reconcile(F.col("t"), F.col("tc"), F.col("d"), F.col("dc"), digits_alone=False)
    assert df.filter("i = 5").select(alone.alias("r")).first().r is None


def test_columns_both_ways(spark):
    df = spark.range(1, 18279).select(F.col("id"), text.column_name(F.col("id")).alias("n"))
    df = df.withColumn("back", text.column_index(F.col("n")))
    assert df.filter("id <> back").count() == 0
    named = {r.id: r.n for r in df.filter(F.col("id").isin(1, 3, 26, 27, 78, 702, 703)).collect()}
    assert named == {1: "A", 3: "C", 26: "Z", 27: "AA", 78: "BZ", 702: "ZZ", 703: "AAA"}


def test_names_and_ages(spark):
    names = ["9.6.25_Ocean-Beach_CH12.pdf", "11.2.2024-Mission_Bay.PDF", "holiday.pdf"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select(text.scan_date(F.col("n")).alias("d"), text.scan_place(F.col("n")).alias("p")).collect()
    assert [tuple(r) for r in got] == [("2025-09-06", "Ocean Beach"), ("2024-11-02", "Mission Bay"), (None, None)]
    one = spark.range(1)
    assert one.select(text.chapter_date(F.lit("2025-09-06"))).first()[0] == "9.6.25"
    assert one.select(text.chapter_date(F.lit("soon"))).first()[0] == "soon"
    assert one.select(text.suggested_filename(F.lit("2025-08-02"), F.lit(" Ocean  Beach! "))).first()[0] == "2025-08-02_Ocean-Beach.xlsx"
    assert one.select(text.suggested_filename(F.lit("2025-08-02"), F.lit("!"))).first()[0] == "2025-08-02_Cleanup.xlsx"
    ages = {0: "just now", 89: "just now", 120: "2 minutes ago", 3600: "1 hour ago", 7200: "2 hours ago", 86400: "1 day ago", 5 * 86400: "5 days ago"}
    df = spark.createDataFrame([(k,) for k in ages], "s bigint")
    assert {r.s: r.a for r in df.select("s", text.describe_age(F.col("s")).alias("a")).collect()} == ages


def test_taxonomy(spark):
    t = taxonomy.taxonomy(spark)
    assert t.count() == 83 and t.filter("side = 'front'").count() == 32
    assert t.filter("item_row = 62").first().item_name.startswith("Fishing Line")


def test_round_trip_of_cards(spark):
    rows = [("e", c, r, c * 1000 + r) for c in (1, 2, 7, 75, 76) for r in taxonomy.ITEM_ROWS]
    df = spark.createDataFrame(rows, "event string, card bigint, item_row bigint, value bigint")
    back = {tuple(r) for r in export.read_back(export.count_edits(df)).collect()}
    assert back == set(rows)


def test_refusing(spark):
    empty = spark.createDataFrame([], "rule string, page bigint")
    assert quality.refuse_if_any(empty).count() == 0
    bad = spark.createDataFrame([("row twice", 1)], "rule string, page bigint")
    try:
        quality.refuse_if_any(bad).collect()
    except Exception as e:
        assert "row twice" in str(e)
    else:
        raise AssertionError("a broken rule must fail the job")


def test_unit_norm_of_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert [r[0] for r in df.select(vectors.unit_norm(F.col("v"))).collect()] == [[0.0, 0.0], [0.6, 0.8]]
