"""Divergence of sources: in-mapper stripes of counts by source for each term, merged by key, emit every divergence."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored

#: Documents of a language that a term must occur in, ranks of a term report, and the whole that probabilities are shares of.
LEAST, RANKS, WHOLE = 3, 200, 1_000_000_000
#: Counts that a task holds before it spills its stripes.
HELD = 1_000_000
#: Stripes of a language that one task takes (expected), sources of a block of a language's matrix, and cells up to which the
#: pairs of a block are all computed for every stripe; beyond, only those of sources that have the term.
PART, BLOCK, DENSE = 40_000, 1024, 4096

#: A-Z become small letters, any other character below U+0080 parts terms.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else (c if 97 <= c <= 122 or c >= 128 else 32) for c in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a text in order: runs of letters a-z and of anything from U+0080 on."""
    return text.encode("utf-8", "replace").translate(_TABLE).split()


STRIPE = "lang string, term string, df long, sources array<string>, counts array<long>"
_SCHEMA = pa.schema([("lang", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds whole documents into stripes: for each term its documents and its count by source. Written out when HELD are held."""
    docs: dict[str, Counter] = {}
    counts: dict[str, dict[str, Counter]] = {}

    def spilled():
        for lang, df in docs.items():
            place = {w: k for k, w in enumerate(df)}
            by = [(s, c) for s, c in sorted(counts[lang].items()) if c]
            if not by:
                continue
            term = np.concatenate([np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for _, c in by])
            n = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for _, c in by])
            source = np.repeat(np.arange(len(by)), [len(c) for _, c in by])
            order = np.argsort(term, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(place)))])
            names, words, every = pa.array([s for s, _ in by], pa.string()), [w.decode() for w in df], np.fromiter(df.values(), np.int64, len(df))
            for a in range(0, len(words), 1 << 14):
                z = min(a + (1 << 14), len(words))
                at, cut = order[ends[a]:ends[z]], pa.array(ends[a:z + 1] - ends[a], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * (z - a), pa.string()), pa.array(words[a:z], pa.string()), pa.array(every[a:z]),
                    pa.ListArray.from_arrays(cut, names.take(pa.array(source[at]))), pa.ListArray.from_arrays(cut, pa.array(n[at])),
                ], schema=_SCHEMA)
        docs.clear()
        counts.clear()

    held = 0
    for b in slices(batches):
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
            found = terms(text)
            by = counts.setdefault(lang, {}).setdefault(source, Counter())
            held -= len(by)
            docs.setdefault(lang, Counter()).update(set(found))
            by.update(found)
            held += len(by)
        if held > HELD:
            yield from spilled()
            held = 0
    yield from spilled()


def _merge(stripes: pa.Table, least: int) -> pa.RecordBatch:
    """Sums whole runs of stripes of one key, which lie side by side, and leaves out terms of too few documents."""
    stripes = stripes.combine_chunks()
    lang, term, sources, counts = (stripes.column(c).combine_chunks() for c in ("lang", "term", "sources", "counts"))
    codes = np.stack([c.dictionary_encode().indices.to_numpy() for c in (lang, term)], 1)
    start = np.concatenate([[True], (codes[1:] != codes[:-1]).any(axis=1)])
    group, first = np.cumsum(start) - 1, np.flatnonzero(start)
    df = np.add.reduceat(stripes.column("df").to_numpy(), first)
    names = sources.flatten().dictionary_encode()
    known = names.dictionary.to_pylist()
    rank = np.empty(len(known), np.int64)
    rank[sorted(range(len(known)), key=lambda k: known[k].encode())] = np.arange(len(known))
    of = np.repeat(group, sources.value_lengths().to_numpy())
    key, inverse = np.unique(of * len(known) + rank[names.indices.to_numpy()], return_inverse=True)
    n = np.zeros(len(key), np.int64)
    np.add.at(n, inverse, counts.flatten().to_numpy())
    keep = df >= least
    group, source = key // max(1, len(known)), key % max(1, len(known))
    at = keep[group]
    ends = np.concatenate([[0], np.cumsum(np.bincount(group[at], minlength=len(df))[keep])])
    ordered = pa.array([known[k] for k in np.argsort(rank)], pa.string())
    cut = pa.array(ends, pa.int32())
    return pa.RecordBatch.from_arrays([
        lang.take(pa.array(first[keep])), term.take(pa.array(first[keep])), pa.array(df[keep]),
        pa.ListArray.from_arrays(cut, ordered.take(pa.array(source[at]))), pa.ListArray.from_arrays(cut, pa.array(n[at])),
    ], schema=_SCHEMA)


def _merged(least: int):
    """Stripes come sorted by (lang, term); the run of the last key waits for the next batch."""

    def run(batches):
        held: list[pa.Table] = []
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]).cast(_SCHEMA)
            lang, term = t.column("lang"), t.column("term")
            last = pc.and_(pc.equal(lang, lang[-1]), pc.equal(term, term[-1])).to_numpy()
            cut = int(np.argmax(last))
            same = held and held[0].column("term")[0] == term[-1] and held[0].column("lang")[0] == lang[-1]
            if cut or not same:
                whole = [*held, t.slice(0, cut)] if held or cut else []
                if whole:
                    yield _merge(pa.concat_tables(whole), least)
                held = []
            held.append(t.slice(cut))
            if len(held) > 64:  # a term with very many stripes is summed as it comes
                held = [pa.Table.from_batches([_merge(pa.concat_tables(held), 0)])]
        if held:
            yield _merge(pa.concat_tables(held), least)

    return run


def merged_stripes(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term, df, sources, counts: the stripes of all terms that `least` documents of their language hold, sources in order.

    Tasks spill one stripe for each term, however often it occurs; these meet by key and are summed as they stream by.
    """
    parts = docs.mapInArrow(_stripes, STRIPE).repartition("lang", "term").sortWithinPartitions("lang", "term")
    return stored(parts.mapInArrow(_merged(least), STRIPE), "stripes")


def share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 (count + 1) / whole), exactly: in 64 bits where they hold it, otherwise in Python's integers."""
    count, whole = np.broadcast_arrays(count, whole)
    if not count.size or int(count.max()) < (1 << 63) // WHOLE - 1:
        return 1 + WHOLE * (count + 1) // whole
    return np.array([1 + WHOLE * (int(c) + 1) // int(w) for c, w in zip(count.ravel(), whole.ravel())], np.int64).reshape(count.shape)


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / q) of shares, which are at most 10**9 + 1: squares fit 64 bits."""
    d = p - q
    return d * d // q


class Language:
    """The groups of one language with their sums; takes stripes and emits divergences.

    Most counts of a source are 0, and all those of a source have one share. So the matrix of pairs starts from V times what two
    absent terms give, and each stripe corrects it for the sources that have its term, against all others.
    """

    def __init__(self, groups: list[dict], rows: int, columns: int, ranks: int):
        self.sources = [g["source"] for g in groups]
        self.place = {s: k for k, s in enumerate(self.sources)}
        sums, self.terms = np.array([g["n"] for g in groups], np.int64), groups[0]["terms"]
        self.whole = sums + self.terms
        self.every = int(sums.sum()) + self.terms
        self.rows = range(rows * BLOCK, min((rows + 1) * BLOCK, len(groups)))
        self.columns = range(columns * BLOCK, min((columns + 1) * BLOCK, len(groups)))
        self.absent = share(np.zeros(1, np.int64), np.maximum(self.whole, 1))
        self.sums = np.zeros((len(self.rows), len(self.columns)), np.int64)
        self.base = apart(self.absent[self.rows.start:self.rows.stop, None], self.absent[None, self.columns.start:self.columns.stop])
        self.best: list[tuple[list, np.ndarray, list]] = []
        self.ranks, self.waiting = ranks, 0
        self.first = rows == columns == 0

    def add(self, names: list[str], sources: list[list[str]], counts: list[list[int]]) -> None:
        n = np.zeros((len(names), len(self.sources)), np.int64)
        for k, (s, c) in enumerate(zip(sources, counts)):
            n[k, [self.place[x] for x in s]] = c
        p = share(n, self.whole[None, :])
        a, b = p[:, self.rows.start:self.rows.stop], p[:, self.columns.start:self.columns.stop]
        has_a, has_b = n[:, self.rows.start:self.rows.stop] > 0, n[:, self.columns.start:self.columns.stop] > 0
        if self.base.size <= DENSE:
            self.sums += apart(a[:, :, None], b[:, None, :]).sum(axis=0) - len(names) * self.base
        for k in range(len(names)) if self.base.size > DENSE else ():
            i, j = np.flatnonzero(has_a[k]), np.flatnonzero(has_b[k])
            if len(i):
                self.sums[i] += apart(a[k, i][:, None], b[k][None, :]) - self.base[i]
            if len(j):
                rest = np.flatnonzero(~has_a[k])
                at = np.ix_(rest, j)
                self.sums[at] += apart(a[k, rest][:, None], b[k, j][None, :]) - self.base[at]
        if self.first:
            q = share(n.sum(axis=1), np.array([self.every], np.int64))[:, None]
            k, s = np.nonzero((n > 0) & (p > q))
            self.best.append(([names[x] for x in k], np.stack([s, apart(p, q)[k, s]]), []))
            self.waiting += len(k)
            if self.waiting > max(200_000, 4 * self.ranks * len(self.sources)):
                self.settle()

    def settle(self) -> None:
        """Keep, of each source, the terms that can be among its first."""
        if not self.best:
            return
        names = np.array([x.encode() for ns, _, _ in self.best for x in ns], object)
        source, value = np.concatenate([v for _, v, _ in self.best], axis=1)
        by = np.lexsort((_byte_order(names), -value, source))
        names, source, value = names[by], source[by], value[by]
        keep = np.arange(len(source)) - np.searchsorted(source, source) < self.ranks
        self.best = [([x.decode() for x in names[keep]], np.stack([source[keep], value[keep]]), [])]
        self.waiting = int(keep.sum())


def _byte_order(names: np.ndarray) -> np.ndarray:
    rank = np.empty(len(names), np.int64)
    rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    return rank


FOUND = "lang string, source string, part string, item string, value long"


def _divergences(ranks: int):
    """Rows come sorted by (lang, piece, rows, columns, kind): the groups of a language, then its stripes."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def told(key, l: Language):
        l.settle()
        if l.best:
            names, (source, value), _ = l.best[0]
            at = pa.array(l.sources, pa.string()).take(pa.array(source))
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(names), pa.string()), at, pa.array(["term"] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(value)], schema=schema)
        sums = l.sums
        if key[1] == 0:  # one piece of the language has what absent terms give
            sums = sums + l.base * l.terms
        for i, a in enumerate(l.rows):
            others = [k for k, b in enumerate(l.columns) if b != a]
            items = [l.sources[l.columns[k]] for k in others]
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(others), pa.string()), pa.array([l.sources[a]] * len(others), pa.string()), pa.array(["pair"] * len(others), pa.string()), pa.array(items, pa.string()), pa.array(sums[i, others])], schema=schema)

    def run(batches):
        key, groups, language = None, [], None
        for b in slices(batches, 256):
            rows = b.to_pylist()
            at = 0
            while at < len(rows):
                own = tuple(rows[at][c] for c in ("lang", "piece", "rows", "columns"))
                end = at
                while end < len(rows) and rows[end]["kind"] == rows[at]["kind"] and tuple(rows[end][c] for c in ("lang", "piece", "rows", "columns")) == own:
                    end += 1
                if own != key:
                    if key is not None:
                        yield from told(key, language or Language(groups, key[2], key[3], ranks))
                    key, groups, language = own, [], None
                if rows[at]["kind"] == 0:
                    groups += [r["group"] for r in rows[at:end]]
                else:
                    language = language or Language(groups, own[2], own[3], ranks)
                    some = [r["stripe"] for r in rows[at:end]]
                    language.add([r["term"] for r in some], [r["sources"] for r in some], [r["counts"] for r in some])
                at = end
        if key is not None:
            yield from told(key, language or Language(groups, key[2], key[3], ranks))

    return run


def source_divergence(docs: DataFrame, least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: how far the sources of a language are from each other, and by which terms each
    stands out.

    A group's share of a kept term is p = 1 + floor(10**9 (count + 1) / (N + V)), N its count of all V kept terms; the
    divergence of p from q is floor((p - q)**2 / q). Part `pair`: every other source of the language, summed over its kept
    terms. Part `term`: terms of the group with a larger share than in the whole language, the first `ranks`. All in exact
    integers. Ties go by the bytes of the item.

    Null text, lang and source are empty strings; a group without terms, or a language without kept ones, has its pairs all
    the same (0 where no term is kept); a language of one source has no pairs. Repeated rows count each. Texts of any length
    are folded whole. An empty table gives no rows. Other columns aren't looked at.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), text("text"))
    stripes = merged_stripes(rows, least)
    sums = stripes.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    groups = rows.select("lang", "source").distinct().withColumn("n", F.lit(0).cast("long")).unionByName(sums)
    groups = groups.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sizes = stored(stripes.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("terms")), "sizes")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    groups = stored(groups.join(sizes, F.col("lang") == F.col("of"), "left").select("lang", "source", "n", number("terms")), "groups")
    cuts = groups.groupBy(F.col("lang").alias("of")).agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.greatest(F.ceil(F.max("terms") / PART), F.lit(1)).cast("int").alias("pieces"),
    )
    cuts = stored(cuts, "cuts")
    blocks = [F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("rows"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("columns")]

    def dealt(df: DataFrame, piece: Column, kind: int, name: str, columns: list[str]) -> DataFrame:
        df = df.join(cuts, F.col("lang") == F.col("of")).select("lang", piece.alias("piece"), "blocks", F.struct(*columns).alias(name))
        df = df.select("lang", "piece", "blocks", blocks[0], name).select("lang", "piece", "rows", blocks[1], name)
        return df.select("lang", "piece", "rows", "columns", F.lit(kind).alias("kind"), name)

    a = dealt(groups, F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)), 0, "group", ["source", "n", "terms"])
    b = dealt(stripes, F.pmod(F.xxhash64("term"), F.col("pieces")).cast("int"), 1, "stripe", ["term", "sources", "counts"])
    both = a.unionByName(b, allowMissingColumns=True).repartition("lang", "piece", "rows", "columns")
    both = both.sortWithinPartitions("lang", "piece", "rows", "columns", "kind", "group.source")
    found = both.mapInArrow(_divergences(ranks), FOUND)
    found = stored(found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "divergences")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item"))
    first = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    pairs = found.where("part = 'pair'").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(first).select("lang", "source", "part", "item", "value", "rank")
