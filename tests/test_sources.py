"""Page images and JSON files in, tables out, and back."""

import base64
import json
import struct
import zlib

import numpy as np
import pytest

from inkframe.sources import pages, tables


def png(rgb):
    h, w, _ = rgb.shape

    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + line.tobytes() for line in rgb.astype(np.uint8))
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def scan(folder, names, rng):
    folder.mkdir(parents=True)
    out = {}
    for n in names:
        out[n] = rng.integers(0, 256, (7, 11, 3))
        (folder / n).write_bytes(png(out[n]))
    (folder / "notes.txt").write_text("no page")
    return out


def test_pages_to_lines(spark, tmp_path):
    rng = np.random.default_rng(0)
    drawn = scan(tmp_path / "ev1", ["page-10.png", "page-2.png", "cover.PNG"], rng)
    scan(tmp_path / "ev2", ["p1.png"], rng)
    numbers = {(r.event, r.file): r.page_no for r in pages.page_numbers(spark, str(tmp_path), ("png",)).collect()}
    assert numbers == {("ev1", "cover.PNG"): 1, ("ev1", "page-2.png"): 2, ("ev1", "page-10.png"): 3, ("ev2", "p1.png"): 1}
    lines = pages.to_scanlines(pages.read_pages(spark, str(tmp_path), ("png",)))
    got = {}
    for r in lines.filter("event = 'ev1'").orderBy("y").collect():
        got.setdefault(r.file, []).append(r.px)
    for name, rgb in drawn.items():
        want = (rgb[:, :, 0] * 299 + rgb[:, :, 1] * 587 + rgb[:, :, 2] * 114) // 1000
        assert (np.array(got[name]) == want).all()


def test_long_numbers_and_damaged_files(spark, tmp_path):
    scan(tmp_path / "ev", ["p2.png", "12345678901234567890.png", "p010.png", "9999999999999999999.png"], np.random.default_rng(2))
    (tmp_path / "ev" / "p3.png").write_bytes(b"no image at all")
    numbers = {r.file: r.page_no for r in pages.page_numbers(spark, str(tmp_path), ("png",)).collect()}
    assert sorted(numbers, key=numbers.get) == ["p2.png", "p3.png", "p010.png", "9999999999999999999.png", "12345678901234567890.png"]
    images = pages.read_pages(spark, str(tmp_path), ("png",))
    assert [tuple(r) for r in pages.rejected_images(images).collect()] == [("ev", "p3.png", "not decodable")]
    assert {r.file for r in pages.to_scanlines(images).collect()} == set(numbers) - {"p3.png"}


def test_streamed_pages_equal_batch(spark, tmp_path):
    scan(tmp_path / "in" / "ev", [f"p{i}.png" for i in range(5)], np.random.default_rng(1))
    src = pages.stream_pages(spark, str(tmp_path / "in"), ("png",), files_per_trigger=2)
    q = (
        pages.to_scanlines(src).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    key = lambda r: (r.event, r.file, r.y, tuple(r.px))
    batch = pages.to_scanlines(pages.read_pages(spark, str(tmp_path / "in"), ("png",)))
    assert {key(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {key(r) for r in batch.collect()}


def box(x, y, w, h):
    return {"x": x, "y": y, "width": w, "height": h}


def test_cell_map_and_labels(spark, tmp_path):
    doc = {"side": "front", "referenceSize": {"width": 100, "height": 200}, "referenceDpi": 200, "exclusions": [box(1, 2, 3, 4)],
           "cells": [{"row": 18, "column": "left", "total": box(5, 6, 7, 8), "tally": box(1, 6, 3, 8)}]}
    path = str(tmp_path / "map.json")
    (tmp_path / "map.json").write_text(json.dumps(doc, indent=1))
    r = tables.read_cell_map(spark, path, "front").first()
    assert (r.side, r.item_row, r.total_x, r.tally_h, r.page_h) == ("front", 18, 5, 8, 200)
    assert tables.read_exclusions(spark, path).first().w == 3
    try:
        tables.read_cell_map(spark, path, "back").collect()
    except Exception as e:
        assert "declares side front" in str(e)
    else:
        raise AssertionError("a map of the wrong side must fail")
    (tmp_path / "o.json").write_text(json.dumps({"front": [], "back": [{"row": 77, "reason": "r", "total": {"y": 5, "height": 6}}]}))
    o = tables.read_overrides(spark, str(tmp_path / "o.json")).first()
    assert (o.side, o.item_row, o.total_y, o.total_h, o.total_x, o.tally_y) == ("back", 77, 5, 6, None, None)
    (tmp_path / "l.json").write_text(json.dumps({"event": "ev", "labels": {"3:18": 4, "7.19 7:42:2:20": "T"}}))
    got = {(r.event, r.card, r.item_row, r.value, r.n) for r in tables.read_labels(spark, str(tmp_path / "l.json")).collect()}
    assert got == {("ev", 3, 18, "4", 4), ("7.19 7:42", 2, 20, "T", None)}


def test_samples_and_exemplars(spark, tmp_path):
    s = {"label": 3, "bitmap": [0, 255, 7], "card": 1, "row": 18, "value": 3}
    (tmp_path / "alpha.json").write_text(json.dumps({"samples": [s, {**s, "source": "own"}]}))
    (tmp_path / "beta.json").write_text(json.dumps({"source": "file", "samples": [s]}))
    got = sorted(r.source for r in tables.read_samples(spark, str(tmp_path / "*.json")).collect())
    assert got == ["alpha", "file", "own"]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "model.json").write_text(json.dumps({"k": 5, "samples": [{"label": 9, "b": base64.b64encode(bytes([0, 255, 128])).decode()}]}))
    r = tables.read_exemplars(spark, str(tmp_path / "m" / "model.json")).first()
    assert (r.k, r.label, r.v) == (5, 9, [0.0, 255.0, 128.0])
    df = tables.read_samples(spark, str(tmp_path / "beta.json"))
    tables.write_exemplars(df, str(tmp_path / "out"))
    back = tables.read_exemplars(spark, str(tmp_path / "out")).collect()
    assert [(r.k, r.ex, r.label, r.v) for r in back] == [(5, 0, 3, [0.0, 255.0, 7.0])]
    tables.write_exemplars(df, str(tmp_path / "out"), k=9, accuracy=0.7)
    model = spark.read.json(str(tmp_path / "out")).first()
    assert (model.k, model.digitAccuracy, model.trainedOn) == (9, 0.7, ["file"])
    for bad in ([256.0], [-1.0], [0.5], [None]):
        with pytest.raises(Exception, match="no whole number"):
            tables.write_exemplars(spark.createDataFrame([("s", 1, bad)], "source string, label int, v array<double>"), str(tmp_path / "bad"))


def test_frozen_cells(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.7)], "event string, card int, ink double")
    tables.write_cells(df, str(tmp_path / "cells"))
    assert tables.rescore(spark, str(tmp_path / "cells"), ["b"]).first().ink == 0.7
    more = spark.createDataFrame([("b", 2, 0.9), ("c", 1, 0.1)], "event string, card int, ink double")
    tables.write_cells(more, str(tmp_path / "cells"))
    # a's folder stays, b's is replaced, c's is new
    assert {(r.event, r.card) for r in tables.rescore(spark, str(tmp_path / "cells")).collect()} == {("a", 1), ("b", 2), ("c", 1)}
    tables.write_datasheet(df, str(tmp_path / "sheet"))
    assert spark.read.parquet(str(tmp_path / "sheet")).count() == 2
    tables.write_prefills(df, str(tmp_path / "fills"))
    assert spark.read.json(str(tmp_path / "fills")).count() == 2
    tables.write_samples(df.withColumnRenamed("event", "source"), str(tmp_path / "samples"))
    assert {r.source for r in spark.read.json(str(tmp_path / "samples")).collect()} == {"a", "b"}
