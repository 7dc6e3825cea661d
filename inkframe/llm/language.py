"""Language of texts by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, slices

#: Units of each direction, bytes of a window, windows that a task computes at once.
UNITS, WINDOW, BATCH = 8, 64, 512
#: Bounds of the labelled sample: documents of a language (expected) and windows of a document. Steps and rows of training.
DOCUMENTS, PLACES, STEPS, ROWS = 800, 6, 250, 256


@dataclass
class Network:
    """For both directions and update gate, reset gate and candidate: inputs (2, 3, 256, H) and recurrent (2, 3, H, H)
    weights; bias of the candidate's recurrent part (2, 1, H); output (2H, L) and its bias (L).

    Its squashing function is x / (1 + |x|), which costs a few simple vector operations.
    """

    inputs: np.ndarray
    recurrent: np.ndarray
    inner: np.ndarray
    output: np.ndarray
    bias: np.ndarray
    languages: list[str]

    def weights(self) -> list[np.ndarray]:
        return [self.inputs, self.recurrent, self.inner, self.output, self.bias]


def _both_ways(x: np.ndarray) -> np.ndarray:
    """Bytes by time for each direction: (T, 2, N)."""
    return np.ascontiguousarray(np.stack([x.T, x.T[::-1]], 1)).astype(np.intp)


def _squash(a: np.ndarray) -> np.ndarray:
    below = np.abs(a)
    below += 1
    a /= below
    return a


def _gate(a: np.ndarray) -> np.ndarray:
    a = _squash(a)
    a *= 0.5
    a += 0.5
    return a


def _step(net: Network, now: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """Update and reset gate, recurrent part of the candidate, candidate and next state."""
    z, r, n = (np.stack([net.inputs[0, k].take(now[0], axis=0), net.inputs[1, k].take(now[1], axis=0)]) for k in range(3))
    z += h @ net.recurrent[:, 0]
    r += h @ net.recurrent[:, 1]
    inner = h @ net.recurrent[:, 2]
    inner += net.inner
    z, r = _gate(z), _gate(r)
    n += r * inner
    n = _squash(n)
    new = h - n
    new *= z
    new += n
    return z, r, inner, n, new


def _shares(net: Network, ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Probabilities (L, T, N) from states (T, N, H)."""
    units = ahead.shape[2]
    a = ahead.reshape(-1, units) @ net.output[:units]
    a += back.reshape(-1, units) @ net.output[units:]
    a += net.bias
    a = np.ascontiguousarray(a.T)
    np.clip(a, -30, 30, out=a)
    np.exp(a, out=a)
    a /= a.sum(axis=0)
    return a.reshape(-1, *ahead.shape[:2])


def forward(net: Network, x: np.ndarray) -> np.ndarray:
    """Probabilities (L, T, N) of the language at every position of windows x (N, T)."""
    steps, units = _both_ways(x), net.recurrent.shape[2]
    h = np.zeros((2, len(x), units), np.float32)
    states = np.empty((2, len(steps), len(x), units), np.float32)
    for t, now in enumerate(steps):
        h = _step(net, now, h)[-1]
        states[:, t] = h
    return _shares(net, states[0], np.ascontiguousarray(states[1, ::-1]))


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over the positions that hold bytes, and its gradients by backpropagation through time."""
    steps, units, size = _both_ways(x), net.recurrent.shape[2], len(x)
    h = np.zeros((2, size, units), np.float32)
    kept, before = [], []
    for now in steps:
        before.append(h)
        kept.append(_step(net, now, h))
        h = kept[-1][-1]
    ahead = np.stack([k[-1][0] for k in kept])
    back = np.stack([k[-1][1] for k in kept])[::-1]
    d = _shares(net, np.ascontiguousarray(ahead), np.ascontiguousarray(back)).transpose(1, 2, 0)
    real = (x.T > 0).astype(np.float32)[:, :, None] / max(1, int((x > 0).sum()))
    true = np.broadcast_to(y[None, :, None], (*d.shape[:2], 1))
    chosen = np.take_along_axis(d, true, 2)
    loss = float(-(np.log(chosen + 1e-9) * real).sum())
    np.put_along_axis(d, true, chosen - 1, 2)
    d = d * real
    g_out = np.concatenate([np.einsum("tnu,tnl->ul", ahead, d), np.einsum("tnu,tnl->ul", back, d)])
    d_state = np.stack([d @ net.output[:units].T, (d @ net.output[units:].T)[::-1]], 1)
    g_rec, g_inner = np.zeros_like(net.recurrent), np.zeros_like(net.inner)
    d_in = np.empty((3, 2, len(steps), size, units), np.float32)
    dh = np.zeros_like(h)
    for t in range(len(steps) - 1, -1, -1):
        z, r, inner, n, _ = kept[t]
        dh = dh + d_state[t]
        dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
        dz = dh * (before[t] - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        dr = dn * inner * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        d_inner, dh = dn * r, dh * z
        for k, part in enumerate((dz, dr, d_inner)):
            g_rec[:, k] += before[t].transpose(0, 2, 1) @ part
            dh += part @ net.recurrent[:, k].transpose(0, 2, 1)
        g_inner += d_inner.sum(axis=1, keepdims=True)
        d_in[0, :, t], d_in[1, :, t], d_in[2, :, t] = dz, dr, dn
    g_in = np.zeros_like(net.inputs)
    for way in (0, 1):
        order = np.argsort(steps[:, way].ravel(), kind="stable")
        byte, first = np.unique(steps[:, way].ravel()[order], return_index=True)
        for k in range(3):
            g_in[way, k, byte] = np.add.reduceat(d_in[k, way].reshape(-1, units)[order], first, axis=0)
    return loss, [g_in, g_rec, g_inner, g_out, d.sum(axis=(0, 1))]


def train(x: np.ndarray, y: np.ndarray, languages: list[str], seed: int = 7, units: int = UNITS, steps: int = STEPS) -> Network:
    """Adam over balanced random batches of windows."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    net = Network(
        draw(2, 3, 256, units, by=0.5), draw(2, 3, units, units, by=units**-0.5), np.zeros((2, 1, units), np.float32),
        draw(2 * units, len(languages), by=0.3), np.zeros(len(languages), np.float32), languages,
    )
    of = [np.flatnonzero(y == k) for k in range(len(languages))]
    first, second = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()]
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.choice(o, max(1, ROWS // len(of))) for o in of])
        batch = x[rows].copy()
        short = rng.random(len(rows)) < 0.15
        batch[np.arange(x.shape[1])[None, :] >= np.where(short, rng.integers(4, x.shape[1] + 1, len(rows)), x.shape[1])[:, None]] = 0
        _, grads = _gradients(net, batch, y[rows])
        norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(net.weights(), grads, first, second):
            g = g / max(1.0, norm)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all texts, filled up with zero bytes, and how many each text has. Bytes A-Z count as a-z."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    flat = b"".join(t.ljust(n * WINDOW, b"\0") for t, n in zip(texts, counts.tolist()))
    return np.frombuffer(flat, np.uint8).reshape(-1, WINDOW), counts


def probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probability of each language over all positions of each text; zeros for an empty one."""
    x, counts = windows(texts)
    total = np.zeros((len(x), len(net.languages)), np.float64)
    for at in range(0, len(x), BATCH):
        part = x[at:at + BATCH]
        p = forward(net, part)
        total[at:at + BATCH] = p.sum(axis=1).T
        rest = np.flatnonzero(part[:, -1] == 0)
        total[at + rest] = (p[:, :, rest] * (part[rest].T > 0)).sum(axis=1).T
    ends = np.cumsum(counts)
    sums = np.concatenate([np.zeros((1, total.shape[1])), np.cumsum(total, axis=0)])
    summed = sums[ends] - sums[ends - counts]
    size = np.array([len(t) - t.count(0) for t in texts])
    return summed / np.maximum(size, 1)[:, None]


def is_held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame) -> Network | None:
    """Learn from labelled documents that aren't held out; None if there are none.

    Bounded sample: about `DOCUMENTS` documents of each language chosen by a hash of the id, `PLACES` windows of each, from
    anywhere in the text, cut out by Spark. The driver trains on them. Rows without an id, a language or a text teach nothing;
    repeated rows of one id and text are drawn together and count once; an empty table gives None. Every language named takes a
    row of counts to the driver, so languages are meant to be names, not free text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0) & ~is_held_out())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    rate = F.element_at(F.create_map(*(F.lit(v) for k in languages for v in (k, min(1.0, DOCUMENTS / counts[k])))), F.col("lang"))
    rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < rate * 1_000_000)
    rows = rows.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))))
    begin = F.pmod(F.xxhash64("doc_id", "place"), F.greatest(F.length("text") - WINDOW // 2, F.lit(1))) + 1
    found = rows.select("doc_id", "place", "lang", F.col("text").substr(begin.cast("int"), F.lit(WINDOW)).alias("part")).distinct().toPandas()
    found = found.sort_values(["lang", "doc_id", "place", "part"])
    x = np.zeros((len(found), WINDOW), np.uint8)
    for k, part in enumerate(found["part"]):
        b = part.encode().lower()[:WINDOW]
        x[k, : len(b)] = np.frombuffer(b, np.uint8)
    return train(x, np.searchsorted(languages, found["lang"].to_numpy().astype(str)), languages)


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, from the whole text alone; no shuffle.

    `und` with score 0 if the text is null, has no letters, or nothing could be learned. Equal probabilities: first name.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for b in slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            known = [net is not None and any(map(str.isalpha, t)) for t in texts]
            name, score = ["und"] * len(texts), [0.0] * len(texts)
            some = [k for k, ok in enumerate(known) if ok]
            if some:
                p = probabilities(net, [texts[k].encode().lower() for k in some])
                for k, row in zip(some, p):
                    best = int(row.argmax())
                    name[k], score[k] = net.languages[best], min(1.0, max(0.0, float(row[best])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(name), pa.array(score)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("held_out", is_held_out()).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, net: Network | None, least: float) -> DataFrame:
    """Rows of `docs`, whole, whose text has letters and a language named with a score of `least` or more.

    Judged row by row without a shuffle or join, so repeated and null ids and columns of any name are no matter. Without a
    network (no labelled documents) every row with letters stays.
    """
    @F.pandas_udf("boolean")
    def known(text: pd.Series) -> pd.Series:
        texts = [t or "" for t in text]
        keep = np.array([any(map(str.isalpha, t)) for t in texts], bool)
        if net is not None:
            for at in range(0, len(texts), SLICE):
                some = at + np.flatnonzero(keep[at:at + SLICE])
                if len(some):
                    keep[some] = probabilities(net, [texts[k].encode().lower() for k in some]).max(axis=1) >= least
        return pd.Series(keep)

    return docs.where(known(docs["text"].cast("string")))


def label_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, by a network learned from the labelled rows that aren't held out.

    Null, empty and letterless texts are `und` with score 0, as are all where nothing can be learned. Texts of any length are read
    whole. Equal texts get equal labels, repeated rows and rows without an id one each. An empty table gives no rows.
    """
    return predict(docs, fit(docs))
