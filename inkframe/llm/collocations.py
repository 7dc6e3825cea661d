"""Phrase collocations by top-order marginalisation: the longest windows are counted, and Spark's ROLLUP sums their prefixes."""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored

#: Least count of a phrase, share (per cent) of a phrase's count at which a longer one takes its place, phrases of a language.
LEAST, COVERED, TOP = 30, 80, 2000
#: Words of the longest window.
ORDER = 4
#: Words that a task counts at a time, and bits (as a power of two) of the filters of frequent pairs and triples.
CHUNK, BITS = 1_200_000, 27
#: Parts that a language's phrases are first ranked in.
SALTS = 64

#: A-Z become small letters; what ends a piece becomes one mark, which no word can hold.
_MARKS = b".,;:!?\n\v\f\r"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else (ord(".") if c in _MARKS else c) for c in range(256))
COLUMNS = [f"w{k + 1}" for k in range(ORDER)]


def words(text: str) -> list[bytes]:
    """The words of a text in order, with b"." wherever a piece ends."""
    return text.encode("utf-8", "replace").translate(_TABLE).replace(b".", b" . ").split()


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Chunk:
    """Words of many texts as numbers: 0 ends a piece, others count from 1; `lang` starts anew at each text."""

    def __init__(self):
        self.known = Numbers({b".": 0})
        self.parts: list[np.ndarray] = []
        self.langs: list[str] = []
        self.size = 0

    def add(self, lang: str, text: str) -> None:
        found = words(text)
        if found:
            found.append(b".")
            self.parts.append(np.fromiter(map(self.known.__getitem__, found), np.int32, len(found)))
            self.langs.append(lang)
            self.size += len(found)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Words, the language of each (a number), and the languages' names."""
        names = sorted(set(self.langs))
        place = {n: k for k, n in enumerate(names)}
        lang = np.repeat([place[x] for x in self.langs], [len(p) for p in self.parts]).astype(np.int32)
        return np.concatenate(self.parts), lang, names

    def hashes(self, size: int) -> np.ndarray:
        """For each place the number of the `size` words from there on in their language, the same in every task; 0 where a piece
        ends among them."""
        ids, lang, names = self.arrays()
        of_word = np.array([xxhash.xxh3_64_intdigest(w) for w in self.known], np.uint64)
        of_lang = np.array([xxhash.xxh3_64_intdigest(n.encode(), 1) for n in names], np.uint64)
        gram, whole = of_word[ids] ^ of_lang[lang], ids > 0
        for k in range(1, min(size, len(ids))):
            gram = gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + of_word[ids[k:]]
            gram ^= gram >> np.uint64(29)
            gram *= np.uint64(0xBF58476D1CE4E5B9)
            whole = whole[:-1] & (ids[k:] > 0)
        out = np.zeros(len(ids), np.uint64)
        if size <= len(ids):
            out[:len(gram)] = np.where(whole, gram | np.uint64(1), np.uint64(0))
        return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    chunk = Chunk()
    for b in slices(batches):
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            chunk.add(lang, text)
            if chunk.size >= CHUNK:
                yield chunk
                chunk = Chunk()
    if chunk.parts:
        yield chunk


def _grams(size: int, shorter: Broadcast | None):
    """Hashes of `size` words side by side with their counts; of three, those only whose pairs the filter of pairs passes."""
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for chunk in _chunks(batches):
            grams = chunk.hashes(size)
            if shorter is not None:
                known = known or Filter.opened(shorter.value)
                pairs = known.passes(chunk.hashes(size - 1))
                grams = grams[:-1][pairs[:-1] & pairs[1:]]
            grams, n = np.unique(grams, return_counts=True)
            keep = grams != 0
            grams, n = grams[keep].view(np.int64), n[keep].astype(np.int32)
            for a in range(0, len(grams), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(grams[a:a + (1 << 16)]), pa.array(n[a:a + (1 << 16)])], schema=schema)

    return run


class Filter:
    """A Bloom filter of hashes: two bits each, of a size that doesn't grow. It may pass some that aren't in it, never miss one."""

    def __init__(self, bits: int, raw: bytes | None = None):
        self.bits = bits
        self.bytes = np.zeros(1 << (bits - 3), np.uint8) if raw is None else np.frombuffer(raw, np.uint8)

    @classmethod
    def opened(cls, packed: bytes) -> Filter:
        raw = zlib.decompress(packed)
        return cls(len(raw).bit_length() + 2, raw)

    def places(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = grams.view(np.uint64)
        shift = np.uint64(64 - self.bits)
        return (u * np.uint64(0xD6E8FEB86659FD93)) >> shift, (u * np.uint64(0xA0761D6478BD642F)) >> shift

    def add(self, grams: np.ndarray) -> None:
        for at in self.places(grams):
            np.bitwise_or.at(self.bytes, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def passes(self, grams: np.ndarray) -> np.ndarray:
        a, b = ((self.bytes[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 for at in self.places(grams))
        return (a & b).astype(bool) & (grams != 0)


def frequent_grams(docs: DataFrame, size: int, least: int, shorter: Broadcast | None = None) -> bytes:
    """The filter of all runs of `size` words that occur `least` times or more, packed; its size is 2**BITS bits, whatever the input.

    Tasks make filters of their share of the runs, cut into slabs; each slab is or-ed by itself.
    """
    counts = docs.mapInArrow(_grams(size, shorter), "gram long, n int").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = stored(counts.where(F.col("n") >= least).select("gram"), "grams")
    slab, bits = 1 << 16, BITS

    def filled(batches):
        held = Filter(bits)
        for b in batches:
            held.add(b.column("gram").to_numpy())
        for at in range(0, len(held.bytes), slab):
            part = held.bytes[at:at + slab]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at // slab]), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["slab", "raw"])

    def joined(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(zlib.decompress(r), np.uint8) for r in t.column("raw").to_pylist()]
        return pa.table({"slab": t.column("slab")[:1], "raw": pa.array([zlib.compress(reduce(np.bitwise_or, parts).tobytes(), 1)], pa.binary())})

    # Each task makes one filter of fixed size, however many runs there are, and a slab gets at most 64 parts.
    slabs = counts.coalesce(64).mapInArrow(filled, "slab long, raw binary").groupBy("slab").applyInArrow(joined, "slab long, raw binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in slabs.toLocalIterator():
        part = np.frombuffer(zlib.decompress(row["raw"]), np.uint8)
        out[row["slab"] * slab:row["slab"] * slab + len(part)] = part
    return zlib.compress(out.tobytes(), 1)


def lead_windows(ids: np.ndarray, pairs: np.ndarray, triples: np.ndarray) -> np.ndarray:
    """For each word the window of ORDER words that it leads, padded with 0 from where a pair or triple in it is not frequent."""
    windows = np.zeros((ORDER, len(ids)), np.int32)
    windows[0] = ids
    go = pairs.copy()
    for k in range(1, ORDER):
        if k > 1:  # the triple that ends with the new word
            ahead = np.zeros(len(ids), bool)
            ahead[:len(ids) - k + 2] = triples[k - 2:]
            go &= ahead
        windows[k, :len(ids) - k] = ids[k:]
        windows[k][~go] = 0
    return windows


def _unique(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs of numbers below 2**31, and the number of the pair at each place."""
    u, inverse = np.unique((a.astype(np.int64) << np.int64(31)) | b.astype(np.int64), return_inverse=True)
    return u >> np.int64(31), u & np.int64((1 << 31) - 1), inverse


def _counted(lang: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different windows of a language, as numbers of language and words, and how often each occurs."""
    if not w[1:].any():
        u, n = np.unique((lang.astype(np.int64) << np.int64(31)) | w[0].astype(np.int64), return_counts=True)
        return u >> np.int64(31), np.stack([u & np.int64((1 << 31) - 1), *[np.zeros_like(u)] * (ORDER - 1)]), n
    at, columns = lang.astype(np.int64), []
    for x in w:
        before, own, at = _unique(at, x)
        columns = [c[before] for c in columns] if columns else [before]
        columns.append(own)
    return columns[0], np.stack(columns[1:]), np.bincount(at)


def count_windows(docs: DataFrame, pairs: Broadcast, triples: Broadcast) -> DataFrame:
    """lang, w1 to w4, n: how often each padded longest window occurs in a chunk of words; '' stands for padding."""
    schema = pa.schema([("lang", pa.string()), *((c, pa.string()) for c in COLUMNS), ("n", pa.int64())])

    def run(batches):
        known = None
        for chunk in _chunks(batches):
            known = known or [Filter.opened(pairs.value), Filter.opened(triples.value)]
            ids, lang, names = chunk.arrays()
            windows = lead_windows(ids, *(f.passes(chunk.hashes(k)) for k, f in zip((2, 3), known)))
            letters = pa.array([x.decode("utf-8", "replace") if k else "" for k, x in enumerate(chunk.known)], pa.string())
            langs = pa.array(names, pa.string())
            for some in ((ids > 0) & (windows[1] == 0), windows[1] > 0):  # most windows end after their first word
                own, w, n = _counted(lang[some], windows[:, some])
                for at in range(0, len(n), 1 << 16):
                    s = slice(at, at + (1 << 16))
                    rows = [langs.take(pa.array(own[s])), *(letters.take(pa.array(x[s])) for x in w), pa.array(n[s])]
                    yield pa.RecordBatch.from_arrays(rows, schema=schema)

    return docs.mapInArrow(run, "lang string, " + ", ".join(f"{c} string" for c in COLUMNS) + ", n long")


def phrase_counts(docs: DataFrame, least: int) -> DataFrame:
    """lang, size, phrase, f: every phrase of 1 to ORDER words that occurs `least` times; size 0 has all word occurrences of a
    language.

    A window ends early where two or three words side by side are not frequent: no phrase that reaches beyond can be. So it is
    the frequent part of the longest window that is counted, and each prefix of it is summed by ROLLUP.
    """
    send = docs.sparkSession.sparkContext.broadcast
    pairs = send(frequent_grams(docs, 2, least))
    triples = send(frequent_grams(docs, 3, least, pairs))
    rolled = count_windows(docs, pairs, triples).rollup("lang", *COLUMNS).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    size = F.lit(ORDER) - F.bit_count("level")
    padded = reduce(operator.or_, (F.col(c) == "" for c in COLUMNS))
    rolled = rolled.where(F.col("lang").isNotNull() & ~F.coalesce(padded, F.lit(False)) & ((F.col("f") >= least) | (size == 0)))
    return stored(rolled.select("lang", size.cast("int").alias("size"), F.concat_ws(" ", *COLUMNS).alias("phrase"), "f"), "phrases")


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: for each language its `top` phrases of 2 to 4 words by score.

    Pieces end at `.,;:!?` and line breaks; words are what blanks and tabs part; A-Z count as small letters. The score of a
    phrase of count a is that of its weakest cut, floor(2000000 a / (l + r)) of the counts of both parts, in exact arithmetic.
    A phrase goes if a longer one that contains it has `covered` per cent of its count.

    A null text is empty, a null lang is `und`; languages without words have no rows; repeated rows all count; a text of any
    length is counted whole. Ties: score, then count, then the phrase's bytes. An empty table gives no rows. Other columns
    aren't looked at.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = phrase_counts(rows, least)
    totals = known.where("size = 0").select(F.col("lang").alias("of"), F.col("f").alias("n"))
    known = known.where("size > 0")
    part = F.split("phrase", " ")
    some = known.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"))
    cuts = some.select("lang", "phrase", "a", part.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("first"), F.expr("array_join(slice(w, cut + 1, size(w)), ' ')").alias("rest"))
    side = lambda name, count: known.select(F.col("lang").alias(f"{name}_lang"), F.col("phrase").alias(f"{name}_phrase"), F.col("f").alias(count))
    for name, count in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(side(name, count), (F.col("lang") == F.col(f"{name}_lang")) & (F.col(name) == F.col(f"{name}_phrase")))
    score = F.expr("cast(cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0)) as decimal(38, 0)) div cast(cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)) as decimal(38, 0))")
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))
    longer = some.where("size > 2").select("lang", F.col("a").alias("more"), "size", part.alias("w"))
    longer = longer.select("lang", "more", "size", "w", F.explode(F.expr("sequence(2, size - 1)")).alias("k"))
    longer = longer.select("lang", "more", F.explode(F.expr("transform(sequence(1, size - k + 1), i -> array_join(slice(w, i, k), ' '))")).alias("inner"))
    longer = longer.groupBy(F.col("lang").alias("in"), "inner").agg(F.max("more").alias("more"))
    kept = weakest.join(longer, (F.col("lang") == F.col("in")) & (F.col("phrase") == F.col("inner")), "left")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    kept = kept.where(F.col("more").isNull() | (big("more") * 100 < big("a") * covered)).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # First within parts, so that no task ranks more than SALTS times the report.
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return kept.join(totals, F.col("lang") == F.col("of")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
