import re
from collections import Counter

import fixtures
import numpy as np
import oracle
import pytest

from inkframe.llm import collocations, queries

SF_DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, least, covered=80, top=2000):
    """Brute force: every phrase of every piece counted by itself."""
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    some = {x: n for x, n in f.items() if len(x[1]) > 1 and n >= least}
    kept = {}
    for (lang, p), a in some.items():
        cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        inside = any(lg == lang and len(q) > len(p) and 100 * n >= covered * a and any(q[i:i + len(p)] == p for i in range(len(q))) for (lg, q), n in some.items())
        if not inside:
            kept.setdefault(lang, []).append((min(cuts), a, p))
    out = []
    for lang, rows in kept.items():
        rows.sort(key=lambda x: (-x[0][0], -x[1], " ".join(x[2]).encode()))
        out += [(lang, r + 1, " ".join(p), a, s[2], s[3], total[lang], s[0]) for r, (s, a, p) in enumerate(rows[:top])]
    return sorted(out)


def found(docs, **more):
    return sorted(tuple(r) for r in collocations.collocations(docs, **more).collect())


def random_rows(seed=7, n=300):
    rng = np.random.default_rng(seed)
    vocabulary = ["a", "the", "Of", "é", "Éa", "b's", "x y", "\x1cz", "it", "日本"]
    rows = []
    for k in range(n):
        w = rng.choice(vocabulary, int(rng.integers(0, 40)), p=[.3, .2, .1, .1, .05, .05, .05, .05, .05, .05])
        rows.append((["en", None, "de"][k % 3], "".join(x + str(rng.choice([" ", "  ", "\t", ". ", ",", "\r\n", "!? "], p=[.6, .1, .1, .05, .05, .05, .05])) for x in w)))
    return rows


@pytest.mark.parametrize("least", [2, 9, 30])
@pytest.mark.parametrize("chunk", [50, 3_000_000])
def test_equal_to_brute_force(spark, monkeypatch, least, chunk):
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    monkeypatch.setattr(collocations, "SALTS", 3)
    rows = random_rows()
    docs = spark.createDataFrame([(t, lg) for lg, t in rows], "text string, lang string").repartition(5)
    assert found(docs, least=least) == expected(rows, least)
    assert found(docs, least=least, top=7, covered=60) == expected(rows, least, 60, 7)


def test_a_small_filter_only_lets_more_through(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BITS", 4)
    rows = random_rows(8)
    docs = spark.createDataFrame([(t, lg) for lg, t in rows], "text string, lang string")
    assert found(docs, least=9) == expected(rows, 9)


def test_filters_hold_frequent_runs_only(spark):
    docs = spark.createDataFrame([("one two three. three four", "en")] * 5 + [("two three four", "en"), ("one two three", "de")], "text string, lang string")
    pairs = collocations.frequent_grams(docs, 2, 5)
    triples = collocations.frequent_grams(docs, 3, 5, spark.sparkContext.broadcast(pairs))
    chunk = collocations.Chunk()
    chunk.add("en", "one two three four. one two")
    assert collocations.Filter.opened(pairs).passes(chunk.hashes(2)).tolist() == [True, True, True, False, False, True, False, False]
    assert collocations.Filter.opened(triples).passes(chunk.hashes(3)).tolist() == [True] + [False] * 7


def test_windows_lead_and_pad():
    ids = np.array([1, 2, 3, 4, 5, 0, 6, 0], np.int32)
    pairs = np.array([True, True, True, True, False, False, False, False])
    triples = np.array([True, True, False, False, False, False, False, False])
    got = collocations.lead_windows(ids, pairs, triples).T.tolist()
    assert got[:5] == [[1, 2, 3, 4], [2, 3, 4, 0], [3, 4, 0, 0], [4, 5, 0, 0], [5, 0, 0, 0]] and got[6] == [6, 0, 0, 0]


def test_awkward_documents(spark):
    rows = [(r["lang"], r["text"]) for r in fixtures.awkward(spark).collect()]
    assert found(fixtures.awkward(spark), least=2) == expected(rows, 2)
    assert found(fixtures.empty(spark)) == [] and found(fixtures.documents(spark, [None, "", " .. "])) == []


def test_large_counts_stay_exact(spark):
    """2000000 a passes 64 bits where a phrase occurs ten trillion times; the arithmetic of the score does not."""
    a, lr = 9_000_000_000_000, 18_000_000_000_001
    got = spark.sql(f"select cast(cast(2000000 as decimal(7,0)) * cast({a}L as decimal(19,0)) as decimal(38,0)) div cast({lr}L as decimal(38,0)) as x").first().x
    assert got == 2000000 * a // lr


def test_query_equals_sql(spark):
    con = oracle.duck(SF_DIR)
    assert oracle.compare(spark, con, "op12", queries.BUILDS["op12_collocations"], queries.ORACLES["op12_collocations"], SF_DIR) is None
