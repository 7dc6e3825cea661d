import hashlib
import math
from collections import Counter

import fixtures
import oracle
import pytest

from inkframe.llm import mixing, queries

SF_DIR = "/root/testdata/sf0.001"


def draw(doc_id, rate, seed):
    u = int(hashlib.md5(f"{'' if doc_id is None else doc_id}|{seed}".encode()).hexdigest()[:13], 16) / 2**52
    k, p = 0, math.exp(-rate)
    c = p
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def test_copies_invert_the_distribution(spark):
    docs = fixtures.awkward(spark)
    for weights in (None, {"s1": 3.0, "s2": 1.0}):
        rows = docs.collect()
        n = Counter(r["source"] for r in rows)
        w = {s: (c**0.7 if weights is None else weights.get(s, 0.0)) for s, c in n.items()}
        rate = {s: w[s] / sum(w.values()) * 100 / n[s] for s in n}
        want = Counter()
        for r in rows:
            want[r] += draw(r["doc_id"], rate[r["source"]], 42)
        got = Counter(r["row"] for r in mixing.mix_sources(docs, weights, size=100).collect())
        assert got == +want


def test_shares_reach_the_target(spark):
    docs = spark.range(40_000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' else concat('s', id % 7) end as source", "'t' as text")
    weights = {"hot": 1.0, **{f"s{k}": 1.0 for k in range(7)}}
    got = {r["source"]: r["count"] for r in mixing.mix_sources(docs, weights, size=80_000).select("row.source").groupBy("source").count().collect()}
    assert all(abs(n / 10_000 - 1) < 0.05 for n in got.values()) and len(got) == 8


def test_salted_join_gives_the_same(spark, monkeypatch):
    docs = fixtures.documents(spark)
    one = sorted(map(repr, mixing.mix_sources(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST", -1)
    assert sorted(map(repr, mixing.mix_sources(docs).collect())) == one


def test_order_is_global_and_columns_stay(spark):
    got = mixing.mix_sources(spark.read.parquet(f"{SF_DIR}/documents.parquet")).collect()
    keys = [r["shuffle_key"] for r in got]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert mixing.mix_sources(fixtures.awkward(spark)).select("row.*").columns == fixtures.awkward(spark).columns
    assert mixing.mix_sources(fixtures.empty(spark)).count() == 0 and mixing.mix_sources(fixtures.documents(spark), {}).count() == 0


def test_too_many_copies_are_refused(spark):
    with pytest.raises(ValueError, match="the most is"):
        mixing.mix_sources(fixtures.documents(spark), size=1_000_000)


def test_query_equals_sql(spark):
    con = oracle.duck(SF_DIR)
    assert oracle.compare(spark, con, "op4_mixing", queries.BUILDS["op4_mixing"], queries.ORACLES["op4_mixing"], SF_DIR) is None
