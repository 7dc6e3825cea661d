"""Chunked running sums, numbering and order statistics against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from inkframe.operators import evaluate, ordered, pairing


@pytest.mark.parametrize("width", [1, 4, 1000])
def test_running_and_numbered(spark, width):
    rng = random.Random(5)
    rows = [(k, p, rng.randint(0, 9)) for k in range(4) for p in sorted(rng.sample(range(200), 60))]
    df = spark.createDataFrame(rows, "k bigint, p bigint, v bigint").withColumn("c", ordered.id_chunk("p", width))
    out = ordered.running(df, ["k"], ["c"], [F.col("p")], {"s": F.col("v"), "rn": F.lit(1)})
    got = {(r.k, r.p): (r.s, r.rn) for r in out.collect()}
    for k in range(4):
        s = 0
        for i, (_, p, v) in enumerate(r for r in rows if r[0] == k):
            s += v
            assert got[(k, p)] == (s, i + 1)


@pytest.mark.parametrize("q", [0.0, 0.02, 0.2, 0.5, 0.97, 1.0])
def test_order_statistic(spark, q):
    rng = random.Random(int(q * 100))
    data = {k: [float(rng.choice([0, 0, 0, 1.5, rng.randint(0, 500)])) for _ in range(n)] for k, n in enumerate([1, 2, 7, 300])}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k int, v double")
    got = {r.k: r.v for r in ordered.order_statistic(df, ["k"], "v", q, chunk_width=8.0).collect()}
    for k, vs in data.items():
        assert got[k] == sorted(vs)[min(len(vs) - 1, int(len(vs) * q))]


def test_reachable_precision_brute(spark):
    rng = random.Random(3)
    rows = [(round(rng.random(), 2), rng.random() < 0.8) for _ in range(400)]
    df = spark.createDataFrame(rows, "conf double, correct boolean")
    got = {r.target: r.answered for r in evaluate.reachable_precision(df).collect()}
    for target in evaluate.TARGETS:
        best = None
        for t in {c for c, _ in rows}:
            ans = [ok for c, ok in rows if c >= t]
            if sum(ans) / len(ans) >= target:
                best = max(best or 0, len(ans))
        assert got[target] == best


def test_refused_pages_rank_through_ties(spark):
    rng = random.Random(8)
    rows = [(e, p, rng.choice([0.0, 0.0, 0.25, round(rng.random(), 5)])) for e in (1, 2) for p in range(0, 30000, 60)]
    df = spark.createDataFrame(rows, "event bigint, page_no bigint, overlap double")
    got = {(r.event, r.page_no): r.worst_rank for r in pairing.refused_pages(df).collect()}
    for e in (1, 2):
        bad = sorted((o, p) for ev, p, o in rows if ev == e and o < 0.75)
        assert [got[(e, p)] for _, p in bad] == list(range(1, len(bad) + 1))
