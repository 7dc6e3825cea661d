import zlib

import fixtures
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from inkframe.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF_DIR = "/root/testdata/sf0.001"


def check(rows, docs, capacity):
    t = Tokenizer.from_file(PATH)
    ids = {}
    for r in docs:
        ids.setdefault(r["doc_id"], []).append(np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4"))
    total = sum(len(x) for v in ids.values() for x in v)
    assert sum(r["length"] for r in rows) == total
    for r in rows:
        assert any(zlib.crc32(x[r["start"]:r["start"] + r["length"]]) == r["ids_crc32"] for x in ids[r["doc_id"]])
        assert r["piece"] == 0 or r["length"] == capacity
        assert 0 < r["length"] <= capacity
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-total // capacity)


def test_best_fit_takes_the_fullest_bin():
    room = packing.Bins(10, np.array([4, 6, 3]))
    assert [room.best_fit(x) for x in (3, 4, 6, 9, 1)] == [2, 0, 1, 3, 3]


def test_crossover_and_mutation_keep_every_piece():
    rng = np.random.default_rng(3)
    lens = rng.integers(1, 100, 400)
    one, other = (packing.refit(lens, np.zeros(400, np.int64), np.ones(400, bool), packing.decreasing(lens, np.arange(400), rng, x), 100) for x in (0.0, 1.0))
    for _ in range(20):
        one = packing.mutate(lens, packing.crossover(lens, one, other, 100, rng), 100, rng)
        assert (one >= 0).all() and np.bincount(one, lens).max() <= 100


def triples():
    """Forty bins' worth of pieces, three to a full bin; best fit decreasing needs 42."""
    rng, lens = np.random.default_rng(3), []
    for _ in range(40):
        a, b = rng.integers(300, 900, 2)
        lens += [a, b, 2048 - a - b]
    return np.array(lens)


def test_evolution_saves_a_bin_that_best_fit_decreasing_does_not(monkeypatch):
    lens = triples()
    everything, none = np.ones(len(lens), bool), np.zeros(len(lens), np.int64)
    first = packing.refit(lens, none, everything, packing.decreasing(lens, np.arange(len(lens)), np.random.default_rng(0)), 2048)
    grown = [packing.evolve(lens, [], 2048, seed, 400) for seed in range(4)]
    assert len(set(first)) == 42 and [len(set(b)) for b in grown] == [41] * 4
    assert all(np.bincount(b, lens).max() <= 2048 for b in grown)
    # An elite that comes from another island brings its bin along; this island alone needs 42.
    assert len(set(packing.evolve(lens, [], 2048, 2, 6))) == 42 and len(set(packing.evolve(lens, [grown[0]], 2048, 2, 6))) == 41
    # Without crossover the same generations save it on two islands of four.
    monkeypatch.setattr(packing, "crossover", lambda lens, one, *_: one)
    assert sorted(len(set(packing.evolve(lens, [], 2048, seed, 400))) for seed in range(4)) == [41, 41, 42, 42]


def least_bins(lens, capacity):
    """The bound of Martello and Toth: pieces over half need a bin each, and small ones only fill what those leave."""
    best = 0
    for a in range(capacity // 2 + 1):
        large, middle = (lens > capacity - a).sum(), lens[(lens <= capacity - a) & (lens > capacity // 2)]
        small = lens[(lens <= capacity // 2) & (lens >= a)].sum()
        best = max(best, large + len(middle) + max(0, -(-(small - (len(middle) * capacity - middle.sum())) // capacity)))
    return best


def test_pools_meet_again(spark, monkeypatch):
    """Seven pools come within 2 % of the bound, even for sizes of which half fit no other of their half."""
    monkeypatch.setattr(packing, "POOL", 1000)
    rng = np.random.default_rng(9)
    rows = [(int(k), int(x)) for k, x in enumerate(rng.integers(1, 2048, 7000))]
    got = packing.pack(spark.createDataFrame(rows, "uid long, length long"), 2048).collect()
    lens, fill = dict(rows), {}
    assert sorted(r["uid"] for r in got) == sorted(lens)
    for r in got:
        fill[r["bin"]] = fill.get(r["bin"], 0) + lens[r["uid"]]
    assert max(fill.values()) <= 2048 and len(fill) <= 1.02 * least_bins(np.array(list(lens.values())), 2048) + 1


def test_awkward_documents(spark):
    for capacity in (8, 2048):
        rows = packing.pack_documents(fixtures.awkward(spark), PATH, capacity).collect()
        check(rows, fixtures.awkward(spark).collect(), capacity)
    assert packing.pack_documents(fixtures.empty(spark), PATH).count() == 0


def test_query(spark):
    rows = queries.BUILDS["op7_packing"](spark, SF_DIR).collect()
    used, least = check(rows, spark.read.parquet(f"{SF_DIR}/documents.parquet").collect(), 2048)
    assert used <= least + 1
