"""Neighbours are the exact nearest of the exemplars, and never come from the own event."""

import numpy as np
import pytest

from inkframe.operators import knn


def test_neighbours_are_exact_and_events_are_held_out(spark):
    rng = np.random.default_rng(3)
    # One event and one label hold most of the samples.
    rows = [
        (i, 0 if i % 3 else 1 + i % 4, 7 if i % 2 else i % 10, rng.random(64).tolist()) for i in range(300)
    ]
    df = spark.createDataFrame(rows, "sample_id bigint, source bigint, label int, v array<double>")
    key = lambda r: (r.query, r.rank, r.ex, r.label, r.d, r.d_shift)
    whole = sorted(key(r) for r in knn.neighbours(df).collect())
    given = sorted(key(r) for r in knn.neighbours(df.repartition(7), df).collect())
    assert whole == given
    source = {r[0]: r[1] for r in rows}
    assert all(source[q] != source[e] for q, _, e, *_ in whole)
    v = np.stack([knn_prepared(r[3]) for r in rows])
    d = np.round(((v[:, None] - v[None]) ** 2).sum(2), 9)
    for q in (0, 1, 150, 299):
        others = sorted((d[q, e], e) for e in range(300) if source[e] != source[q])[:25]
        assert [e for _, e in others] == [e for qq, _, e, *_ in whole if qq == q]


def knn_prepared(v):
    from inkframe.functions import vectors

    b = vectors.deskewed(np.array([v]).reshape(1, 8, 8))
    soft = sum(vectors.moved(b, dx, dy) * ((2 - abs(dx)) * (2 - abs(dy))) for dy in (-1, 0, 1) for dx in (-1, 0, 1)) / 16
    return vectors.unit(soft.reshape(1, -1))[0]


def test_exemplars_are_bounded_and_labels_take_turns(spark):
    rows = [(i, 0, 0 if i % 10 else i % 7, [0.0] * 64) for i in range(500)]
    df = spark.createDataFrame(rows, "sample_id bigint, source bigint, label int, v array<double>")
    kept = [r.label for r in knn.chosen_exemplars(df, 30).collect()]
    counts = {k: sum(r[2] == k for r in rows) for k in range(7)}
    assert len(kept) == 30 and all(kept.count(k) >= min(4, counts[k]) for k in counts)
    with pytest.raises(ValueError, match="more than 20"):
        knn.neighbours(df, df, limit=20)


def test_new_bitmaps_are_read_with_a_model(spark):
    rng = np.random.default_rng(4)
    shapes = rng.random((5, 64)) * (rng.random((5, 64)) < 0.3)
    model = [(i, i % 5, (shapes[i % 5] + 0.02 * rng.random(64)).tolist()) for i in range(40)]
    asked = [(100 + i, (shapes[i % 5] + 0.02 * rng.random(64)).tolist()) for i in range(20)]
    exemplars = spark.createDataFrame(model, "ex bigint, label int, v array<double>")
    queries = spark.createDataFrame(asked, "sample_id bigint, v array<double>")
    got = {r.query: (r.predicted, r.conf) for r in knn.classify_against(queries, exemplars).collect()}
    assert {k: v[0] for k, v in got.items()} == {100 + i: i % 5 for i in range(20)} and all(v[1] > 0.9 for v in got.values())
    none = knn.classify_against(queries, exemplars.limit(0)).collect()
    assert len(none) == 20 and all(r.predicted is None and r.conf == 0 for r in none)


def test_equal_votes_go_to_the_nearer_label(spark):
    rows = [(1, 1, 10, 5, 0.1, 0.25), (1, 2, 11, 3, 0.2, 0.25), (1, 3, 12, 8, 0.3, 0.9)]
    near = spark.createDataFrame(rows, "query bigint, rank int, ex bigint, label int, d double, d_shift double")
    assert knn.classify(near).first().predicted == 5
