import hashlib
import random

import fixtures

from inkframe.llm import queries
from inkframe.llm.winnowing import as_text, compare_next, edited, gram_hashes, likeness, winnow

SF_DIR = "/root/testdata/sf0.001"


def slow_winnow(text, k, window):
    h, picked = gram_hashes(text, k).tolist(), []
    window = min(window, len(h))
    for s in range(len(h) - window + 1 if h else 0):
        p = max(i for i in range(s, s + window) if h[i] == min(h[s:s + window]))
        if picked[-1:] != [p]:
            picked.append(p)
    return [h[p] for p in picked], picked


def test_selection_is_the_rightmost_minimum():
    rng = random.Random(2)
    for k, window in [(3, 4), (2, 5), (5, 1), (20, 29), (1, 7)]:
        for _ in range(60):
            text = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 120)))
            got = winnow(text, k, window)
            assert (got[0].tolist(), got[1].tolist()) == slow_winnow(text, k, window)


def test_rolling_hash_names_grams():
    text, seen = "abcabcXabcabcé\U0001f600" * 5, {}
    for i, h in enumerate(gram_hashes(text, 4).tolist()):
        assert seen.setdefault(text[i:i + 4], h) == h
    assert len(set(seen.values())) == len(seen)


def test_match_guarantee():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for _ in range(50):
        common = word(20 + 29 - 1)
        one, other = word(200) + common + word(150), word(90) + common + word(60)
        assert set(winnow(one)[0].tolist()) & set(winnow(other)[0].tolist())


def expected(rows):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (doc_id, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        other = edited(text, after)
        own, changed = winnow(text)[0], winnow(other)[0]
        out.append((doc_id, len(text), hashlib.sha256(other.encode()).hexdigest(), as_text(own), as_text(changed), likeness(own, changed), likeness(own, winnow(after)[0])))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    for docs in (fixtures.awkward(spark), fixtures.documents(spark, ["only one"]), spark.read.parquet(f"{SF_DIR}/documents.parquet")):
        got = compare_next(docs).drop("positions").collect()
        assert sorted(map(tuple, got), key=repr) == expected(docs.collect())
    assert compare_next(fixtures.empty(spark)).count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    got = queries.BUILDS["op1_winnowing"](spark, SF_DIR).drop("positions").collect()
    assert sorted(map(tuple, got), key=repr) == expected(docs)
