import hashlib
import io
import struct

import oracle
import pytest
import zstandard

from inkframe.llm import queries, warc
from inkframe.llm.common import new_folder

SF_DIR = "/root/testdata/sf0.001"
LONG = "<p>" + "payload " * 40

ROWS = [
    (3, "http://a/", LONG, "x"), (1, "http://b/", LONG, "x"), (1, "http://b/", LONG, "x"), (7, None, LONG, None), (4, "http://c/\r\nX: y", "short", "x"),
    (5, "http://d/", "short", "x"), (6, "http://e/", None, "x"), (8, "http://f/", "", "x"), (9, "http://g/é", "ü" * 50, "x"), (10, "", "ü" * 50, "x"),
    (None, "http://h/", LONG, "x"), (None, "http://i/", LONG * 2, "x"), (None, "http://i/", LONG * 2, "x"), (11, "http://j/", "z" * 3_000_000, "x"),
]


def expected(rows):
    first, out = {}, []
    for page_id, _, page, _ in rows:
        p = (page or "").encode()
        if len(p) >= 100 and page_id is not None:
            first[p] = min(first.get(p, page_id), page_id)
    for page_id, _, page, _ in rows:
        p = (page or "").encode()
        to = first.get(p)
        revisit = to is not None and page_id != to
        out.append((page_id, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, digest string")
    assert sorted(map(tuple, warc.warc_round_trip(pages).collect()), key=repr) == expected(ROWS)
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_archives_hold_a_dictionary_and_one_frame_a_record(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    manifest = warc.write_archives(rows, new_folder(spark, "warc")).collect()
    pages, trained = {f"<urn:page:{r['page_id']}>": r for r in rows.collect()}, 0
    for archive in manifest:
        data = open(archive["file"].removeprefix("file://"), "rb").read()
        leads = struct.unpack("<I", data[:4])[0] == warc.DICTIONARY_FRAME
        found = [warc.parse(f) for f in warc.frames(io.BytesIO(data))]
        assert len(found) == archive["records"] == data.count(warc.ZSTD_MAGIC) - leads
        trained += leads
        for r in found:
            page = pages.pop(r["headers"]["warc-record-id"])
            assert r["block"].decode() == page["html"] and r["headers"]["warc-target-uri"] == page["url"]
    assert not pages and trained


def test_plain_dictionary_frame_and_damage():
    raw = b"some raw content that records share " * 20
    one = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw)).compress(warc.record(1, "u", b"abc", "d", None, False))
    data = struct.pack("<II", warc.DICTIONARY_FRAME, len(raw)) + raw + one
    assert [warc.parse(f)["block"] for f in warc.frames(io.BytesIO(data))] == [b"abc"]
    assert list(warc.frames(io.BytesIO(b""))) == []
    for bad in (data[:20], data[:-2], data + b"rest that is no frame"):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.frames(io.BytesIO(bad)))
    good = warc.record(1, None, b"abc", "d", None, False)
    for bad in (good[:-1], good.replace(b"Content-Length: 3", b"Content-Length: 2"), b"WARC/9\r\n\r\n", good.replace(b"WARC-Type: response\r\n", b"")):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_query_equals_sql(spark):
    con = oracle.duck(SF_DIR)
    assert oracle.compare(spark, con, "op9_warc", queries.BUILDS["op9_warc"], queries.ORACLES["op9_warc"], SF_DIR) is None
