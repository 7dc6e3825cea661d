"""Document fingerprints by winnowing, and the likeness of neighbouring documents."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Characters of a gram, and grams of a window: any match of K + WINDOW - 1 characters leaves a common fingerprint.
K, WINDOW = 20, 29
#: Base of the rolling hash (odd, so it has an inverse modulo 2^64) and the multiplier that mixes it.
BASE, MIX = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD
#: Buckets for each shuffle partition, so that buckets dealt by hash even out.
BUCKETS = 8

_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS.clear()
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _POWERS.append(np.cumprod(factors, dtype=np.uint64))
    return _POWERS[0][:n], _POWERS[1][:n]


def gram_hashes(text: str, k: int = K) -> np.ndarray:
    """32-bit hashes of all k-grams by a rolling sum; a shorter text is one gram, an empty one none."""
    if not text:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    k = min(k, len(codes))
    up, down = _powers(len(codes))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up, dtype=np.uint64)])
    h = (total[k:] - total[:-k]) * down[: len(codes) - k + 1]
    h ^= h >> np.uint64(33)
    h *= np.uint64(MIX)
    return h >> np.uint64(32)


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions that some window selects: its smallest hash, the rightmost of equal ones."""
    h = gram_hashes(text, k)
    if not len(h):
        return h.astype(np.uint32), np.zeros(0, np.int64)
    # Smallest hash first, then largest position, in one number; texts have less than 2^32 characters.
    low = np.uint64(0xFFFFFFFF)
    best = (h << np.uint64(32)) | (low - np.arange(len(h), dtype=np.uint64))
    span, window = 1, min(window, len(h))
    while 2 * span <= window:
        best = np.minimum(best[: len(best) - span], best[span:])
        span *= 2
    if span < window:
        best = np.minimum(best[: len(best) - (window - span)], best[window - span:])
    best = best[np.concatenate([[True], best[1:] != best[:-1]])]
    return (best >> np.uint64(32)).astype(np.uint32), (low - (best & low)).astype(np.int64)


def as_text(hashes: np.ndarray) -> str:
    """The set of hashes, ascending, eight hex digits each."""
    return np.unique(hashes).astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets of hashes; two empty ones are alike."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def edited(text: str, following: str) -> str:
    """The last quarter of the characters replaced by as many from the start of another text, or all of it."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _compared(k: int, window: int):
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("positions", pa.list_(pa.int64())),
    ])

    def row(doc_id, text, mark, following, next_mark):
        other = edited(text, following)
        own = mark if other == text else winnow(other, k, window)
        return (
            doc_id, len(text), hashlib.sha256(other.encode()).hexdigest(), as_text(mark[0]), as_text(own[0]),
            likeness(mark[0], own[0]), likeness(mark[0], next_mark[0]), mark[1],
        )

    def run(batches):
        before = None  # the document that still waits for its next one
        for b in slices(batches):
            rows = []
            for bucket, guest, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text"))):
                if before is not None and before[0] == bucket:
                    mark = winnow(text, k, window)
                    rows.append(row(*before[1:], text, mark))
                    before = None if guest else (bucket, doc_id, text, mark)
                elif not guest:
                    before = (bucket, doc_id, text, winnow(text, k, window))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)

    return run


def compare_next(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and its edited text, and likenesses; `positions` of the selected grams come with them.

    The next document is that of the next row in ascending (doc_id, text), null ids first; after the last comes the first.
    A single document is its own next. Null text is empty: no fingerprint, and alike to another empty one. Texts shorter
    than a gram are one gram. Repeated rows stay.

    One shuffle of the texts: ids alone give the borders of buckets, and the first row of each bucket goes as a guest to
    the end of the one before. A bucket is streamed, never held.
    """
    low = -(1 << 63)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(low)))
    spark = docs.sparkSession
    n = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    quantiles = [i / n for i in range(1, n)]
    borders = docs.agg(F.percentile_approx("key", quantiles, 10 * n)).first()[0] or []
    borders = np.unique(np.array(borders, np.int64))

    @F.pandas_udf("int")
    def bucket_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(borders, key.to_numpy(), side="left").astype("int32"))

    heads = docs.select("key").withColumn("bucket", bucket_of("key")).groupBy("bucket").agg(F.min("key").alias("head"))
    heads = sorted((r["bucket"], r["head"]) for r in heads.collect())  # one row a bucket
    to = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}  # the first bucket's head goes to the last bucket
    first = np.array(sorted(to), np.int64)
    goal = np.array([to[h] for h in first.tolist()], np.int32)

    @F.pandas_udf("array<int>")
    def places(key: pd.Series) -> pd.Series:
        """The bucket of a row, and that before if it is the first of its bucket."""
        own = np.searchsorted(borders, key.to_numpy(), side="left")
        at = np.minimum(np.searchsorted(first, key.to_numpy()), len(first) - 1)
        head = first[at] == key.to_numpy()
        return pd.Series([[int(o), int(goal[a])] if h else [int(o)] for o, h, a in zip(own, head, at)])

    if not heads:
        return docs.select("doc_id", "text").limit(0).mapInArrow(lambda b: iter(()), _OUT)
    dealt = docs.withColumn("places", places("key")).select("doc_id", "text", "key", F.posexplode("places").alias("guest", "bucket"))
    # One row of the head's key is guest enough, but which one is only known in order: all come, and the first is used.
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "guest", "key", "text")
    return dealt.select("bucket", (F.col("guest") > 0).alias("guest"), "doc_id", "text").mapInArrow(_compared(k, window), _OUT)


_OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, positions array<long>"
)
