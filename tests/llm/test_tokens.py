import random
import zlib

import fixtures
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from inkframe.llm import arrow_output, bpe, queries, token_counts
from inkframe.llm.common import new_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_every_vocabulary_string_is_proven():
    assert bpe.not_whole(PATH) == [] and bpe.is_byte_bpe(PATH) and bpe.in_rank_order(PATH)


def test_ids_and_counts_are_the_librarys(library):
    ids, counts = bpe.Encoder(PATH), bpe.Encoder(PATH, bpe.not_whole(PATH))
    rng = random.Random(5)
    letters = [*"ab' \n\t\r  !é×ªß²_9½.,’", "　", "中", "\x1c", "\x85", "<|endoftext|>", " the", "'ll", "<|"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    for text in texts + [t or "" for t in fixtures.TEXTS]:
        assert ids.ids(text) == np.array(library(text), "<u4").tobytes(), repr(text)
        assert counts.count(text) == len(library(text)), repr(text)


def test_cache_forgets_without_error():
    m = bpe.Memo(len, {"a": 1})
    m.room = 5
    assert [m[str(k)] for k in range(20)] == [len(str(k)) for k in range(20)] and m["a"] == 1 and len(m) <= 6


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_of_other_files(spark, name):
    path = public_tokenizers.path(name)
    got = {r["doc_id"]: r for r in token_counts.count_tokens(fixtures.documents(spark), path, limit=20).collect()}
    if name.endswith(".model"):
        import sentencepiece

        count = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t))
    else:
        count = lambda t: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids)
    for k, t in enumerate(fixtures.TEXTS):
        n = count(t or "")
        assert (got[k]["n_bytes"], got[k]["n_tokens"], got[k]["over_limit"]) == (len((t or "").encode()), n, n > 20)


def test_counts_keep_rows(spark):
    assert token_counts.count_tokens(fixtures.awkward(spark), PATH).count() == len(fixtures.TEXTS) + 2
    assert token_counts.count_tokens(fixtures.empty(spark), PATH).count() == 0


def test_arrow_round_trip(spark, library):
    rows = fixtures.awkward(spark).select("doc_id", "text").collect()
    order = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    want, start = [], 0
    for r in order:
        ids = np.array([*library(r["text"]), 0], "<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    for length in (7, 2048):
        got = [tuple(r) for r in arrow_output.arrow_round_trip(fixtures.awkward(spark), PATH, length=length).collect()]
        assert sorted(got, key=lambda r: r[1]) == want
    assert arrow_output.arrow_round_trip(fixtures.empty(spark), PATH).count() == 0


def test_sequences_are_equal_and_views(spark, tmp_path, library):
    folder = new_folder(spark, "sequences")
    manifest = arrow_output.write_sequences(fixtures.documents(spark), PATH, folder, length=16).collect()
    for row in manifest:
        table = pa.ipc.open_file(pa.memory_map(row["file"].removeprefix("file://"))).read_all()
        assert table.num_rows == row["n_sequences"] and table.schema.field("ids").type.list_size == 16
        mask = np.array(table.column("mask").combine_chunks().flatten())
        assert mask.sum() == row["n_tokens"] and mask[: row["n_tokens"]].all()
        assert np.shares_memory(*(table.column("ids").chunk(0).flatten().to_numpy(zero_copy_only=True) for _ in range(2)))


def test_a_damaged_manifest_is_refused(spark):
    manifest = arrow_output.write_sequences(fixtures.documents(spark), PATH, new_folder(spark, "sequences"))
    wrong = manifest.selectExpr("part", "file", "n_docs", "n_tokens + 1 as n_tokens", "n_sequences")
    with pytest.raises(Exception, match="the manifest says"):
        arrow_output.read_documents(wrong).collect()


def test_queries(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    n = {k: len(library(t)) for k, t in docs.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in queries.BUILDS["op3_token_counts"](spark, SF_DIR).collect()} == n
    assert {r["doc_id"]: r["n_tokens"] - 1 for r in queries.BUILDS["op10_arrow_output"](spark, SF_DIR).collect()} == n


@pytest.mark.parametrize("kind", [" ", "\n", " \n", "a", "!", "7", "ab ", " ", "é"])
def test_runs_of_two_million_characters(kind):
    text = "start " + kind * (2_000_000 // len(kind)) + "end"
    whole = np.array(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert bpe.Encoder(PATH).ids(text) == whole


@pytest.mark.parametrize("size", [4_000, 4_999, 5_031, 5_032, 5_040, 9_000, 60_000])
def test_blank_runs_around_the_stride(size):
    text = "x" * 7 + " " * size + "y" * 5_100
    whole = np.array(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert bpe.Encoder(PATH).ids(text) == whole and (size < 5_032 or bpe.long_blank(text))


def test_long_runs_through_the_operators(spark):
    from inkframe.llm import packing

    texts = [k * 2_000_000 for k in (" ", "\n", "a", "!")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = [Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids + [0] for t in texts]
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in arrow_output.arrow_round_trip(docs, PATH).collect()}
    assert got == {k: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in enumerate(ids)}
    packed = {}
    for r in packing.pack_documents(docs, PATH).collect():
        packed.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for k, x in enumerate(ids):
        pieces = sorted(packed[k])
        assert [p[1] for p in pieces] == list(np.cumsum([0] + [p[2] for p in pieces[:-1]])) and sum(p[2] for p in pieces) == len(x)
        assert all(c == zlib.crc32(np.array(x[s:s + n], "<u4").tobytes()) for _, s, n, c in pieces)
