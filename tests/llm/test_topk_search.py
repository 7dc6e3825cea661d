import numpy as np
import oracle
import pytest

from inkframe.llm import queries, topk_search

SF_DIR = "/root/testdata/sf0.001"
SHAPE = "vec_id long, embedding array<double>, label int, e string, item int, shard int"
NAN, INF = float("nan"), float("inf")


def expected(rows, k=5, every=50):
    """Brute force in Python's integers over distinct rows."""
    fine = {}
    for i, v in rows:
        if v is not None and all(x is not None and abs(x) * 256 < INF for x in v):
            fine[i, tuple(x + 0.0 for x in v)] = [int(np.floor(x * 256)) if abs(x) < 2**52 else int(x) * 256 for x in v]
    out = []
    for (i, _), q in fine.items():
        if i is None or i % every:
            continue
        scored = []
        for (j, _), v in fine.items():
            if j != i:
                s = sum(a * b for a, b in zip(q, v))
                scored.append((-max(-(2**63) + 1, min(2**63 - 1, s)), j is None, j))
        out += [(i, r + 1, j, -s) for r, (s, _, j) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, "e", 2, 3) for i, v in rows], SHAPE)
    return sorted((tuple(r) for r in topk_search.top_inner_products(df, **more).collect()), key=repr)


def clusters(n=900, size=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, size))
    return [(int(k), [float(np.float32(x)) for x in centres[k % 12] + rng.standard_normal(size) * 0.1]) for k in rng.permutation(n)]


@pytest.mark.parametrize(("block", "shard", "page", "part"), [(64, 32768, 4096, 65536), (8, 64, 4, 5)])
def test_equal_to_brute_force(spark, monkeypatch, block, shard, page, part):
    for name, value in (("BLOCK", block), ("SHARD", shard), ("PAGE", page), ("PART", part)):
        monkeypatch.setattr(topk_search, name, value)
    rows = clusters()
    assert found(spark, rows, every=7) == expected(rows, every=7)


def test_awkward_vectors(spark):
    rows = [
        (0, [1.0, 0.5]), (50, [1.0, 0.5]), (100, [0.25, -3.0, 2.0]), (3, None), (4, []), (150, []), (5, [NAN, 1.0]), (200, [INF, 1.0]), (6, [None, 1.0]),
        (7, [1e300, 1.0]), (250, [-1e300, 1.0]), (8, [-0.0, 0.0]), (9, [0.0, 0.0]), (None, [1.0, 0.5]), (None, [9.0, 9.0]), (-50, [0.003, -0.003]),
        (300, [1.0, 0.0]), (300, [0.0, 1.0]), (300, [0.0, 1.0]), (11, [3e13, 3e13]), (350, [2e3, 1.0]), (12, [1e306, 1.0]),
    ]
    assert found(spark, rows) == expected(rows)
    assert found(spark, []) == [] and found(spark, [(1, [1.0])]) == [] and found(spark, [(50, [1.0])]) == []


def test_copies_and_ties_go_to_small_ids(spark):
    """A third of all rows is one vector: queries among the copies see the smallest other ids, and no copy crowds out the index."""
    rows = [(k, [1.0, 2.0, 3.0] if k % 3 else [float(k % 5), 1.0, 0.0]) for k in range(1200)]
    assert found(spark, rows) == expected(rows)


def test_blocks_below_the_kth_score_are_not_scored():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 32)) * 4
    blocks = []
    for c, centre in enumerate(centres):
        v = topk_search.quantised((centre + rng.standard_normal((64, 32)) * 0.05).tolist())
        blocks.append({"rows": 64, "size": 32, "ids": (np.arange(64) + 64 * c).astype("<i8").tobytes(), "none": bytes(64), "forward": topk_search.packed(v),
                       "high": topk_search.packed(v.max(axis=0)), "low": topk_search.packed(v.min(axis=0))})
    shard = topk_search.Shard(blocks)
    q = topk_search.quantised(centres.tolist())
    best, scored = shard.search(q, np.full(40, -1), np.full(40, -topk_search.LONGEST), 5)
    every = np.concatenate(shard.forward).astype(np.int64)
    want = np.sort(q.astype(np.int64) @ every.T, axis=1)[:, -5:]
    assert (np.sort(best.score.reshape(40, 5), axis=1) == want).all() and len(best.query) == 200
    assert scored < 40 * 40 / 4


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for scale in (100, 2**20, 2**40, 2**70):
        q, v = (np.floor(rng.uniform(-1, 1, (4, 7)) * scale) for _ in range(2))
        want = [[max(-topk_search.LONGEST, min(topk_search.LONGEST, sum(int(a) * int(b) for a, b in zip(x, y)))) for y in v] for x in q]
        assert topk_search.products(q, v).tolist() == want
        assert (topk_search.bounds(q, v, v) >= topk_search.products(q, v)).all()


def test_query_equals_sql(spark):
    con = oracle.duck(SF_DIR)
    assert oracle.compare(spark, con, "op11", queries.BUILDS["op11_topk_search"], queries.ORACLES["op11_topk_search"], SF_DIR) is None
