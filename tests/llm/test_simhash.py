import random
import re

import fixtures
import numpy as np
import xxhash

from inkframe.llm import queries, simhash
from inkframe.llm.common import connected

SF_DIR = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(rows, most=4):
    fp = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= most:
                root[find(i)] = find(j)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(k)] = min(least.get(find(k), doc_id), doc_id)
    return sorted(((d, f"{fp[k]:016x}", least.get(find(k))) for k, (d, _) in enumerate(rows)), key=repr)


def test_golay_words_within_two_bits_share_a_key():
    rng = np.random.default_rng(1)
    table = simhash.golay_errors()
    assert set((table >= 0).sum(axis=1).tolist()) == {1, 6}
    x = rng.integers(0, 1 << 23, 3000)
    for _ in range(20):
        y = x ^ (1 << rng.integers(0, 23, 3000)) ^ (1 << rng.integers(0, 23, 3000))
        a, b = simhash._codewords(x), simhash._codewords(y)
        assert ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any(axis=(1, 2)).all()


def test_keys_cover_four_bits():
    rng = np.random.default_rng(2)
    x = rng.integers(-(1 << 63), 1 << 63, 2000, dtype=np.int64)
    y = x.copy().view(np.uint64)
    for k in range(len(y)):
        for bit in rng.choice(64, 4, replace=False):
            y[k] ^= np.uint64(1) << np.uint64(bit)
    keys = [set(zip(*map(np.ndarray.tolist, simhash.fuzzy_keys(v)))) for v in (x, y.view(np.int64))]
    assert {row for _, row in keys[0] & keys[1]} == set(range(2000))


def test_groups_are_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = [b for b in base]
    for _ in range(400):  # chains that reach further than one link
        x = rng.choice(fps[-30:] + base)
        for bit in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << bit
        fps.append(x)
    fps = sorted({np.array(x, np.uint64).view(np.int64).item() for x in fps})
    near = {(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 4}
    root = list(range(len(fps)))
    for _ in fps:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    for block in (4096, 16):  # also with buckets cut into blocks
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash, "SHIFTED", min(64, block))
        links = simhash.near_links(spark.createDataFrame([(x,) for x in fps], "fp long"))
        got = {r["node"]: r["root"] for r in connected(links).collect()}
        assert [got.get(x, x) for x in fps] == [fps[r] for r in root]


def test_against_brute_force(spark):
    for docs in (fixtures.awkward(spark), spark.read.parquet(f"{SF_DIR}/documents.parquet")):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert sorted(map(tuple, simhash.simhash_groups(docs).collect()), key=repr) == slow_groups(rows)
    assert simhash.simhash_groups(fixtures.empty(spark)).count() == 0


def test_one_of_each(spark):
    got = simhash.one_of_each(fixtures.awkward(spark))
    assert got.columns == fixtures.awkward(spark).columns
    # null and empty texts are one group; "Hello, world!" is one, whatever its rows; so is the upper-case twin.
    groups = {c for d, _, c in slow_groups([(r["doc_id"], r["text"]) for r in fixtures.awkward(spark).collect() if r["doc_id"] is not None])}
    assert sorted(r["doc_id"] for r in got.collect() if r["doc_id"] is not None) == sorted(groups)
    assert got.where("doc_id is null").count() == 1
    assert simhash.one_of_each(fixtures.empty(spark)).count() == 0


def test_every_group_keeps_exactly_one_row(spark):
    a, b, c = ("".join(f"{w} {w}x " for w in words) for words in ("abcdefgh", "ijklmnop", "qrstuvwx"))
    rows = [(5, a, "1"), (5, b, "2"), (3, a, "3"), (9, b, "4"), (None, c, "5"), (None, c, "6"), (None, a, "7"), (9, b, "8")]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert got == [(0, c), (3, a), (5, b)]


def test_connected(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 30), (30, 31), (31, 32), (32, 33), (40, 41), (41, 42), (42, 40), (7, None)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 30, 31, 32, 33), 1), 8: 8, 9: 8, **dict.fromkeys((40, 41, 42), 40)}
    path = spark.range(300).selectExpr("id as a", "id + 1 as b")
    assert {r["root"] for r in connected(path).collect()} == {0}


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.BUILDS["op8_simhash"](spark, SF_DIR).collect()), key=repr) == slow_groups(rows)
