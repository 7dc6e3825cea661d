import re
from collections import Counter

import fixtures
import numpy as np
import oracle
import pytest

from inkframe.llm import queries, source_divergence

SF_DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, least=3, ranks=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")) for lang, source, text in rows]
    docs = [(a, b, [w.translate(LOWER) for w in ws]) for a, b, ws in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(w for d in own for w in set(d[2]))
        kept = {w for w, n in df.items() if n >= least}
        counts = {s: Counter() for s in {d[1] for d in own}}
        for _, s, ws in own:
            counts[s].update(w for w in ws if w in kept)
        every = sum(counts.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(every)
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            parts = {
                "pair": [(-sum(f(p[s][w], p[o][w]) for w in kept), o) for o in counts if o != s],
                "term": [(-f(p[s][w], q[w]), w) for w in kept if counts[s][w] and p[s][w] > q[w]],
            }
            for part, items in parts.items():
                items.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, i, -v, r + 1) for r, (v, i) in enumerate(items[:ranks if part == "term" else None])]
    return sorted(out)


def found(docs, **more):
    return sorted(tuple(r) for r in source_divergence.source_divergence(docs, **more).collect())


def random_rows(seed=4, n=240):
    rng = np.random.default_rng(seed)
    vocabulary = np.array([chr(97 + k % 26) * (1 + k // 26) for k in range(60)] + ["É", "日本", "Don't", "\x85", "x1y"])
    rows = []
    for k in range(n):
        w = rng.choice(vocabulary, int(rng.integers(0, 30)))
        source = "hot" if k % 3 == 0 else f"s{int(rng.integers(0, 9))}"
        rows.append((["en", "de", None][int(rng.integers(0, 3))], source, " ".join(w)))
    return [*rows, ("xx", "alone", "only one document"), ("yy", "a", None), ("yy", "b", "")]


@pytest.mark.parametrize(("held", "part", "block", "dense"), [(1_000_000, 40_000, 1024, 4096), (40, 7, 1024, 0), (200, 20, 3, 0), (200, 20, 4, 4096)])
def test_equal_to_brute_force(spark, monkeypatch, held, part, block, dense):
    """Whether stripes spill often or not, languages are cut or not, and pairs computed for all or for present sources."""
    for name, value in (("HELD", held), ("PART", part), ("BLOCK", block), ("DENSE", dense)):
        monkeypatch.setattr(source_divergence, name, value)
    monkeypatch.setattr("inkframe.llm.source_divergence.slices", lambda batches, rows=256: (b.slice(a, 16) for b in batches for a in range(0, b.num_rows, 16)))
    rows = random_rows()
    docs = spark.createDataFrame([(t, s, lg) for lg, s, t in rows], "text string, source string, lang string").repartition(4)
    assert found(docs) == expected(rows)
    assert found(docs, least=1, ranks=4) == expected(rows, 1, 4)


def test_awkward_documents(spark):
    rows = [(r["lang"], r["source"], r["text"]) for r in fixtures.awkward(spark).collect()]
    assert found(fixtures.awkward(spark), least=2) == expected(rows, 2)
    assert found(fixtures.empty(spark)) == []


def test_large_counts_stay_exact():
    count, whole = np.array([[3 * 10**12, 0, 7]]), np.array([[10**13 + 7, 10**13 + 7, 11]])
    assert source_divergence.share(count, whole).tolist() == [[1 + 10**9 * (c + 1) // w for c, w in zip(count[0].tolist(), whole[0].tolist())]]


def test_kept_terms_of_a_source_are_bounded():
    groups = [{"source": s, "n": 5000, "terms": 300_000} for s in ("a", "b")]
    language = source_divergence.Language(groups, 0, 0, 3)
    for k in range(400):
        names = [f"t{k:03d}{x:03d}" for x in range(600)]
        language.add(names, [["a"]] * 600, [[1 + (k * 600 + x) % 977] for x in range(600)])
    assert language.waiting <= 200_600
    language.settle()
    names, (source, value), _ = language.best[0]
    assert len(names) == 3 and sorted(value, reverse=True) == value.tolist() and names == sorted(names)


def test_query_equals_sql(spark):
    con = oracle.duck(SF_DIR)
    assert oracle.compare(spark, con, "op13", queries.BUILDS["op13_source_divergence"], queries.ORACLES["op13_source_divergence"], SF_DIR) is None
