import numpy as np
import oracle
import pytest

from inkframe.llm import embedding_dups, queries

SF_DIR = "/root/testdata/sf0.001"
SHAPE = "vec_id long, embedding array<float>, label int, sig string, node int"


def expected(rows, least=0.98):
    unit = []
    for _, v, label in rows:
        x = np.array([np.nan if c is None else c for c in v or []], np.float64)
        ok = label is not None and len(x) and np.isfinite(x).all() and (x != 0).any()
        unit.append(x / np.linalg.norm(x / np.abs(x).max()) / np.abs(x).max() if ok else None)
    n = len(rows)
    links = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and rows[i][2] == rows[j][2] and float(unit[i] @ unit[j]) >= least] for i in range(n)]
    out, seen = [], {}
    for i in range(n):
        if i in seen:
            continue
        group, front = {i}, [i]
        while front:
            for j in links[front.pop()]:
                if j not in group:
                    group.add(j)
                    front.append(j)
        for j in group:
            seen[j] = min(rows[k][0] for k in group)
    for i in range(n):
        out.append((rows[i][0], len(links[i]), seen[i], rows[i][0] == seen[i]))
    return sorted(out)


def planted(seed=5, size=32):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for c in range(25):
        centre = rng.standard_normal(size)
        for _ in range(int(rng.integers(1, 40))):
            v = centre + rng.standard_normal(size) * 0.14
            rows.append((k, [float(np.float32(x)) for x in v], c % 3))
            k += 1
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(a, b, c, "s", 1) for a, b, c in rows], SHAPE)


def test_rotation_balances_codes():
    x = np.array([r[1] for r in planted()])
    mean, projection = embedding_dups.learn_rotations(x)
    assert projection.shape == (32, 96)
    for k in range(3):
        turn = projection[:, 32 * k:32 * k + 32]
        assert np.allclose(turn.T @ turn, np.eye(32), atol=1e-8)
    on = ((x - mean) @ projection >= 0).mean(axis=0)
    assert 0.2 < on.min() and on.max() < 0.8


@pytest.mark.parametrize("block", [1024, 7])
def test_recall_and_precision(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dups, "BLOCK", block)
    monkeypatch.setattr(embedding_dups, "BUCKET", max(16, block))
    rows = planted()
    want = {r[0]: r for r in expected(rows)}
    got = [tuple(r) for r in embedding_dups.near_vectors(frame(spark, rows)).collect()]
    assert len(got) == len(rows) and all(n <= want[k][1] for k, n, _, _ in got)
    assert sum(r[1] for r in got) >= 0.97 * sum(r[1] for r in want.values())
    assert np.mean([r == want[r[0]] for r in got]) > 0.9


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.0, 0.0], 2),
        (3, None, 1), (4, [], 1), (6, [0.0, 0.0, 0.0], 1), (7, [nan, 1.0, 0.0], 1), (8, [inf, 0.0, 0.0], 1), (10, [1.0, None, 0.0], 1),
        (11, [1.0, 0.0, 0.0], None), (12, [1.0, 0.0], 1), (13, [-0.0, 1.0, 0.0], 1), (14, [0.0, 1.0, 0.0], 1), (15, [1e30, 0.0, 0.0], 1), (16, [1e-38, 0.0, 0.0], 1),
    ]
    got = sorted(tuple(r) for r in embedding_dups.near_vectors(frame(spark, rows)).collect())
    assert got == expected(rows)
    assert embedding_dups.near_vectors(frame(spark, [])).count() == 0


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.BUILDS["op6_embedding_dups"](spark, SF_DIR).collect())) == expected(rows)


def test_query_equals_sql(spark):
    con = oracle.duck(SF_DIR)
    assert oracle.compare(spark, con, "op6", queries.BUILDS["op6_embedding_dups"], queries.ORACLES["op6_embedding_dups"], SF_DIR) is None


def test_labels_never_mix(spark):
    rows = [(2 * k + c, v, c) for c in (0, 1) for k, v in enumerate(r[1] for r in planted()[:60])]
    got = {r["vec_id"]: r["component_id"] for r in embedding_dups.near_vectors(frame(spark, rows)).collect()}
    assert all(k % 2 == c % 2 for k, c in got.items())
