"""Without a limit every sample meets all samples of other events, however many there are."""

import numpy as np

from inkframe.functions import vectors
from inkframe.operators import knn
from inkframe.plans import ORACLES

SHAPE = "sample_id bigint, source bigint, label int, v array<double>"


def found(df):
    return sorted(map(tuple, df.collect()))


def test_stored_neighbours_are_the_nearest_of_all_samples(spark, tmp_path):
    """More samples than a classifier keeps as exemplars."""
    n = knn.EXEMPLARS + 300
    v = np.random.default_rng(7).random((n, 64))
    df = spark.createDataFrame([(i, i % 11, i % 10, x.tolist()) for i, x in enumerate(v)], SHAPE).repartition(6)
    got = {}
    for q, rank, ex, *_ in found(knn.cached_neighbours(df, str(tmp_path / "near"))):
        got.setdefault(q, []).append(ex)
    assert len(got) == n and {len(x) for x in got.values()} == {25}
    m, ids = vectors.ready(v, 8), np.arange(n)
    for q in range(0, n, 50):
        d = np.round(((m - m[q]) ** 2).sum(1), 9)
        d[ids % 11 == q % 11] = np.inf
        assert got[q] == np.argsort(d, kind="stable")[:25].tolist()


def test_dealt_samples_meet_the_same_exemplars(spark, monkeypatch):
    """As with one matrix of them: copies, a hot event, events and labels that are null, fewer than asked for, any tiles and tasks."""
    rng = np.random.default_rng(5)
    v = rng.random((400, 64))
    v[50:120] = v[50]
    rows = [(997 * i % 400, None if i % 50 == 3 else 0 if i % 3 else i % 40, None if i % 30 == 4 else i % 10, v[i].tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, SHAPE).repartition(5)
    want = found(knn.neighbours(df))
    few = df.filter("sample_id % 20 = 0")
    want_few = found(knn.neighbours(df, few))
    monkeypatch.setattr(knn, "EXEMPLARS", 15)
    for tile, held in ((7, 64 * 16), (64, 1 << 22), (1000, 1 << 22)):
        monkeypatch.setattr(knn, "TILE", tile)
        monkeypatch.setattr(knn, "HELD", held)
        assert found(knn.neighbours(df, limit=None)) == want
    assert found(knn.neighbours(df, few, limit=None)) == want_few
    assert found(knn.neighbours(df.filter("source = 0"), limit=None)) == []
    assert found(knn.neighbours(df.limit(0), df, limit=None)) == []


def test_what_a_task_holds_does_not_follow_the_exemplars():
    import tracemalloc

    def peak(n):
        rng = np.random.default_rng(n)
        m = vectors.ready(rng.random((500, 64)), 8)
        near = knn.Nearest(m, [None] * 500, 25, 8)
        tracemalloc.start()
        for at in range(0, n, 500):
            near.meet(vectors.ready(rng.random((500, 64)), 8), np.arange(at, at + 500), np.zeros(500, int), np.zeros(500, bool), ["a"] * 500)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(10_000) < 1.2 * peak(1_000)


def test_the_rules_have_no_bound_in_sql():
    assert "LIMIT" not in ORACLES["q_rules"] and "kept_vecs" not in ORACLES["q_rules"]
