"""Streams give what the batch gives."""

import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkframe.operators import pairing
from inkframe.sources import pages as pages_source
from inkframe.streaming import drafts, metrics, progress
from inkframe.streaming import pairing as stream_pairing


def finish(df, out, check, mode="append"):
    q = (
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", check)
        .outputMode(mode).trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    assert q.exception() is None


def write_batches(folder, batches):
    os.makedirs(folder)
    for i, rows in enumerate(batches):
        path = os.path.join(folder, f"{i:03d}.json")
        with open(path, "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Small streams: their state is held in two stores instead of eight."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


PAGES = "event string, page_no bigint, side string, total bigint, ts timestamp"


def at(seconds):
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(1_700_000_000 + seconds))


def page(event, page_no, side, seconds, total=None):
    return {"event": event, "page_no": page_no, "side": side, "total": total, "ts": at(seconds)}


def read(spark, folder, schema=PAGES, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(str(folder))


def cards_of(spark, out):
    return sorted(tuple(r) for r in spark.read.parquet(str(out)).select("event", "card_no", "front_page", "back_page", "late_page").fillna(-1).collect())


def test_pairing_stream_equals_batch_with_pages_out_of_order_and_a_restart(spark, tmp_path):
    rng = np.random.default_rng(1)
    feeds = {"a": "fbbffbf", "b": "ffbb", "c": "bfbfbfbf", "d": "".join(rng.choice(["f", "b"], 60))}
    pages = [page(e, i + 1, {"f": "front", "b": "back"}[c], 0, len(s)) for e, s in feeds.items() for i, c in enumerate(s)]
    shuffled = [{**pages[i], "ts": at(k)} for k, i in enumerate(rng.permutation(len(pages)))]
    cuts = [0, 20, 31, 55, len(pages)]
    batches = [shuffled[a:b] for a, b in zip(cuts, cuts[1:])]
    write_batches(tmp_path / "in", batches[:2])
    finish(stream_pairing.pair_stream(read(spark, tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    for k, rows in enumerate(batches[2:]):
        write_batches(tmp_path / f"more{k}", [rows])
        os.rename(tmp_path / f"more{k}" / "000.json", tmp_path / "in" / f"9{k}.json")
    finish(stream_pairing.pair_stream(read(spark, tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    batch = spark.createDataFrame(pages).withColumn("overlap", F.lit(1.0)).withColumn("late_page", F.lit(None).cast("bigint"))
    want = pairing.pair_pages(batch).select("event", "card_no", "front_page", "back_page", F.lit(-1).cast("bigint").alias("late_page")).fillna(-1)
    assert cards_of(spark, tmp_path / "out") == sorted(tuple(r) for r in want.collect())


def test_state_ends_and_late_pages_are_told_and_counted(spark, tmp_path):
    counts = progress.LateCounts()
    spark.streams.addListener(counts)
    try:
        write_batches(tmp_path / "in", [
            [page("e", 1, "front", 0), page("e", 2, "back", 1), page("e", 4, "back", 2)],  # page 3 is missing, 4 waits
            [page("x", 1, "front", 200)],  # time goes on
            [page("w", 1, "back", 201, 1)],  # and e is found to be quiet
            [page("e", 3, "front", 205), page("e", 5, "front", 206), page("e", 6, "back", 207)],
            [page("e", 6, "back", 207)],
            [page("y", 1, "front", 2000, 1)],  # e and x are forgotten
            [page("e", 7, "front", 10), page("y", 1, "front", 2001, 1)],  # behind the watermark; sent again
        ])
        paired = progress.watch_pairing(stream_pairing.pair_stream(read(spark, tmp_path / "in"), late="10 seconds", quiet_ms=60_000, keep_ms=600_000))
        q = paired.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
        got = cards_of(spark, tmp_path / "out")
        assert got == sorted([
            ("e", 1, 1, 2, -1), ("e", 2, -1, 4, -1), ("e", -1, -1, -1, 3), ("e", 3, 5, 6, -1), ("e", -1, -1, -1, 6), ("w", 1, -1, 1, -1), ("x", 1, 1, -1, -1), ("y", 1, 1, -1, -1), ("y", -1, -1, -1, 1),
        ])
        end = time.time() + 30
        while counts.of(q.id).get("rows", 0) < 12 and time.time() < end:
            time.sleep(0.2)
        told = counts.of(q.id)
        assert (told["dropped_by_watermark"], told["pairing.late_pages"], told["pairing.cards"]) == (1, 3, 6)
        # Of e and x, whose cards are all made, nothing is left.
        rows = spark.read.format("statestore").option("stateVarName", "point").load(str(tmp_path / "ck"))
        assert [r.key.event for r in rows.select("key").collect()] == ["y"]
    finally:
        spark.streams.removeListener(counts)


def test_any_number_of_pages_may_wait(spark, tmp_path):
    many = 6000
    write_batches(tmp_path / "in", [
        [page("e", p, "front" if p % 2 else "back", p % 50, many) for p in range(many, 1, -1)], [page("e", 1, "front", 50, many)],
    ])
    finish(stream_pairing.pair_stream(read(spark, tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert cards_of(spark, tmp_path / "out") == [("e", k + 1, 2 * k + 1, 2 * k + 2, -1) for k in range(many // 2)]


def test_files_are_numbered_once_their_event_is_complete(spark, tmp_path):
    schema = "event string, file string, side string, total bigint, ts timestamp"

    def file(event, name, seconds, total=None):
        return {"event": event, "file": name, "side": "front", "total": total, "ts": at(seconds)}

    counts = progress.LateCounts()
    spark.streams.addListener(counts)
    try:
        write_batches(tmp_path / "in", [
            [file("a", "p10.jpg", 0, 3), file("b", "scan2.jpg", 0), file("b", "scan2.jpg", 1)], [file("a", "p9.jpg", 5, 3), file("a", "q009.jpg", 5, 3), file("b", "x.jpg", 5), file("b", "scan00100000000000000000000000.jpg", 6)],
            [file("a", "p1.jpg", 6, 3)], [file("c", "1.jpg", 900)],
        ])
        numbered = progress.watch_numbering(stream_pairing.number_stream(read(spark, tmp_path / "in", schema), late="10 seconds", quiet_ms=60_000))
        q = numbered.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
        got = {(r.event, r.file): (r.page_no, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        assert got == {
            ("a", "p9.jpg"): (1, 3), ("a", "q009.jpg"): (2, 3), ("a", "p10.jpg"): (3, 3), ("a", "p1.jpg"): (None, 3),
            ("b", "x.jpg"): (1, 3), ("b", "scan2.jpg"): (2, 3), ("b", "scan00100000000000000000000000.jpg"): (3, 3),
        }
        assert counts.of(q.id)["numbering.late_files"] == 1
    finally:
        spark.streams.removeListener(counts)


def test_image_files_stream_into_cards_as_the_batch_makes_them(spark, tmp_path):
    """Files of scans come in any order, two at a time; numbers and cards are those of the listing and the batch."""
    from test_sources import png

    def draw(path, shade, seconds):
        with open(path, "wb") as f:
            f.write(png(np.full((6, 8, 3), shade, np.uint8)))
        os.utime(path, (1_700_000_000 + seconds,) * 2)

    for event, sides in {"beach": "fbfbbf", "pier": "bf"}.items():
        os.makedirs(tmp_path / "scans" / event)
        for n, s in enumerate(sides):
            draw(str(tmp_path / "scans" / event / f"page-{n * 7 + 2}.png"), 250 if s == "f" else 20, (n * 5) % 7)
    light = F.aggregate("px", F.lit(0), lambda a, v: a + v) / F.size("px")
    side = F.when(light > 128, "front").otherwise("back")
    images = pages_source.stream_pages(spark, str(tmp_path / "scans"), ("png",), files_per_trigger=2)
    sided = pages_source.to_scanlines(images, keep=["ts"]).filter("y = 0").select("event", "file", side.alias("side"), F.lit(None).cast("bigint").alias("total"), "ts")
    numbered = stream_pairing.number_stream(sided, late="1 minute", quiet_ms=1000)
    cards = stream_pairing.pair_stream(numbered, late=None, quiet_ms=1000)
    os.makedirs(tmp_path / "scans" / "zz")  # time goes on with another event
    draw(str(tmp_path / "scans" / "zz" / "1.png"), 250, 9000)
    finish(cards, str(tmp_path / "out"), str(tmp_path / "ck"))
    numbers = pages_source.page_numbers(spark, str(tmp_path / "scans"), ("png",))
    batch = pages_source.to_scanlines(pages_source.read_pages(spark, str(tmp_path / "scans"), ("png",))).filter("y = 0").select("event", "file", side.alias("side")).join(numbers, ["event", "file"])
    want = pairing.pair_pages(batch.filter("event <> 'zz'").withColumn("overlap", F.lit(1.0))).select("event", "card_no", "front_page", "back_page").fillna(-1)
    assert [r[:4] for r in cards_of(spark, tmp_path / "out") if r[0] != "zz"] == sorted(tuple(r) for r in want.collect())


def test_late_pages_are_counted(spark):
    rows = [("a", None, None, None, 3), ("a", None, None, None, 4), ("b", 1, 1, 2, None)]
    got = stream_pairing.late_counts(spark.createDataFrame(rows, stream_pairing.CARDS)).collect()
    assert [tuple(r) for r in got] == [("a", 2)]


def test_debounce_keeps_last_of_each_burst(spark, tmp_path):
    def save(key, ms, value):
        return {"key": key, "ts": f"2024-01-01T00:00:{ms / 1000:06.3f}Z", "value": value}

    write_batches(tmp_path / "in", [
        [save("x", 0, 1), save("x", 100, 2), save("x", 350, 3), save("y", 0, 9)],
        [save("x", 2000, 4), save("x", 2300, 5)],
        [save("z", 50000, 0)],
        [save("z", 59000, 0)],
    ])
    src = spark.readStream.schema("key string, ts timestamp, value bigint").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    finish(drafts.debounced(src, ["key"], late="1 second"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = sorted((r.key, r.value, r.saves) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [g for g in got if g[0] != "z"] == [("x", 3, 3), ("x", 5, 2), ("y", 9, 1)]


def test_upsert_keeps_latest_and_survives_replay(spark, tmp_path):
    write = drafts.upsert_into(str(tmp_path / "t"), ["file_name"], ["saved_at"])
    one = spark.createDataFrame([("f", 1, "old"), ("f", 2, "new"), ("g", 1, "g1")], "file_name string, saved_at bigint, v string")
    two = spark.createDataFrame([("f", 1, "late"), ("g", 5, "g5")], "file_name string, saved_at bigint, v string")
    write(one, 0)
    write(two, 1)
    write(two, 1)
    got = {(r.file_name, r.v) for r in drafts.read_latest(spark, str(tmp_path / "t"), ["file_name"], ["saved_at"]).collect()}
    assert got == {("f", "new"), ("g", "g5")}


def test_compaction_bounds_what_is_read_and_replays_change_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError, match="nothing was written"):
        drafts.read_latest(spark, path, ["file_name"], ["saved_at"])
    assert drafts.compact(spark, path, ["file_name"], ["saved_at"]) == -1
    write = drafts.upsert_into(path, ["file_name"], ["saved_at"], merge_every=4)
    batch = lambda k: spark.createDataFrame([(f"f{i}", 10 * k + i, f"{k}/{i}") for i in range(k % 3, 5)], "file_name string, saved_at bigint, v string")
    for k in range(11):
        write(batch(k), k)
    read = lambda: sorted(map(tuple, drafts.read_latest(spark, path, ["file_name"], ["saved_at"]).collect()))
    want = sorted((f"f{i}", 10 * k + i, f"{k}/{i}") for i, k in ((0, 9), (1, 10), (2, 10), (3, 10), (4, 10)))
    assert read() == want and drafts._head(spark, path) == 7
    scanned = drafts._log(spark, path, 7)
    assert scanned.select(F.input_file_name().alias("f")).distinct().count() <= 3 * 8 and scanned.count() == sum(5 - k % 3 for k in (8, 9, 10))
    # Replays, of a batch in the base with other rows, and of one beside it.
    write(spark.createDataFrame([("f0", 999, "wrong")], "file_name string, saved_at bigint, v string"), 3)
    write(batch(9), 9)
    assert read() == want
    assert drafts.compact(spark, path, ["file_name"], ["saved_at"]) == 10 and read() == want
    assert spark.read.parquet(f"{path}/base/upto=10").count() == 5
    assert drafts.compact(spark, path, ["file_name"], ["saved_at"]) == 10
    # A base without its pointer is not taken.
    spark.createDataFrame([("f0", 5000, "torn")], "file_name string, saved_at bigint, v string").write.parquet(f"{path}/base/upto=11")
    assert read() == want


def test_resends_are_dropped(spark, tmp_path):
    row = {"save_id": "s1", "ts": "2024-01-01T00:00:00Z", "value": 1}
    write_batches(tmp_path / "in", [[row], [row, {**row, "save_id": "s2"}]])
    src = spark.readStream.schema("save_id string, ts timestamp, value bigint").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    finish(drafts.without_resends(src), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r.save_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["s1", "s2"]


def test_window_metrics_stream_equals_batch(spark, tmp_path):
    rows = [{"ts": f"2024-01-0{1 + i % 3}T0{i % 9}:00:00Z", "event_type": "ab"[i % 2], "value": float(i)} for i in range(60)]
    rows.append({"ts": "2024-02-01T00:00:00Z", "event_type": "a", "value": 0.0})
    end = {"ts": "2024-02-09T00:00:00Z", "event_type": "a", "value": 0.0}
    write_batches(tmp_path / "in", [rows, [end], [end]])
    schema = "ts timestamp, event_type string, value double"
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    finish(metrics.window_metrics(src, "1 day", late="1 day"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in metrics.window_metrics(spark.read.schema(schema).json(str(tmp_path / "in")), "1 day").collect()}
    assert got and got == {w for w in want if w[0].month == 1 or w[0].day == 1}


@pytest.mark.parametrize("name", ["progress"])
def test_progress_counts(spark, tmp_path, name):
    write_batches(tmp_path / "in", [[{"event": "e", "total": 3}], [{"event": "e", "total": 3}, {"event": "d", "total": 1}]])
    src = spark.readStream.schema("event string, total bigint").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = metrics.progress(src).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table(name).collect()} == {("e", 2, 3), ("d", 1, 1)}
