import zlib

import fixtures
import numpy as np

from inkframe.llm import language, queries

SF_DIR = "/root/testdata/sf0.01"


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    x = rng.integers(97, 105, (5, 12)).astype(np.uint8)
    x[2, 7:] = 0
    y = np.array([0, 1, 2, 1, 0])
    net = language.train(x, y, ["a", "b", "c"], steps=1, units=4)
    for name in ("inputs", "recurrent", "inner", "output", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    _, grads = language._gradients(net, x, y)
    for w, g in zip(net.weights(), grads):
        at, step = np.unravel_index(np.abs(g).argmax(), g.shape), 1e-3
        old = w[at]
        w[at] = old + step
        up, _ = language._gradients(net, x, y)
        w[at] = old - step
        down, _ = language._gradients(net, x, y)
        w[at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 1e-3 * max(1, abs(g[at]))


def test_every_position_counts():
    """Pooled probabilities are the mean over all positions of all windows, padding left out."""
    rng = np.random.default_rng(2)
    x = rng.integers(97, 123, (40, language.WINDOW)).astype(np.uint8)
    net = language.train(x, np.arange(40) % 2, ["a", "b"], steps=2)
    text = bytes(rng.integers(97, 123, 3 * language.WINDOW + 17).astype(np.uint8))
    padded = np.frombuffer(text.ljust(4 * language.WINDOW, b"\0"), np.uint8).reshape(4, -1)
    p = language.forward(net, padded)
    want = p.transpose(2, 1, 0).reshape(-1, 2)[: len(text)].mean(axis=0)
    got = language.probabilities(net, [b"", text, b"x" * 700])
    assert np.allclose(got[1], want, atol=1e-5) and (got[0] == 0).all() and abs(got[2].sum() - 1) < 1e-4


def test_held_out_accuracy(spark):
    got = queries.BUILDS["op5_language"](spark, SF_DIR).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert len(got) == len(lang)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"]]
    assert np.mean(held) > 0.97


def test_awkward_documents(spark):
    got = {(r["doc_id"], r["lang_pred"]) for r in language.label_languages(fixtures.awkward(spark)).collect()}
    und = {k for k, v in got if v == "und"}
    assert und == {k for k, t in enumerate(fixtures.TEXTS) if not any(map(str.isalpha, t or ""))}
    assert language.label_languages(fixtures.awkward(spark)).count() == len(fixtures.TEXTS) + 2
    assert language.label_languages(fixtures.empty(spark)).count() == 0
    nothing = language.predict(fixtures.documents(spark), None).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}


def test_keep_known_keeps_rows_whole(spark):
    docs = fixtures.awkward(spark)
    kept = language.keep_known(docs, language.fit(docs), 0.3)
    assert kept.columns == docs.columns
    letters = [r for r in docs.collect() if any(map(str.isalpha, r["text"] or ""))]
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, letters))
