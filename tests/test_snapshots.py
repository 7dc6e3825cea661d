"""A version counts once its manifest is there; rules are counted by the pass that writes."""

import os

import pytest
from pyspark.sql import functions as F

from inkframe.operators import export, knn
from inkframe.sources import snapshots, tables

CELLS = "event string, card int, ink double"


def test_a_failing_freeze_leaves_the_last_version(spark, tmp_path):
    path = str(tmp_path / "cells")
    with pytest.raises(ValueError, match="nothing is published"):
        tables.rescore(spark, path)
    assert tables.write_cells(spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.7), (None, 1, 0.2)], CELLS), path) == 1
    bad = spark.range(40).select(F.lit("a").alias("event"), F.col("id").cast("int").alias("card"), F.when(F.col("id") > 35, F.raise_error(F.lit("torn"))).otherwise(0.1).cast("double").alias("ink"))
    with pytest.raises(Exception, match="torn"):
        tables.write_cells(bad.repartition(4), path)
    read = lambda **more: sorted((str(r.event), r.card, r.ink) for r in tables.rescore(spark, path, **more).collect())
    assert read() == [("None", 1, 0.2), ("a", 1, 0.5), ("b", 1, 0.7)]
    # The next version takes the number of the torn one, and what that left behind is gone.
    assert tables.write_cells(spark.createDataFrame([("b", 2, 0.9), ("7", 1, 0.1)], CELLS), path) == 2
    assert read() == [("7", 1, 0.1), ("None", 1, 0.2), ("a", 1, 0.5), ("b", 2, 0.9)]
    assert read(version=1) == [("None", 1, 0.2), ("a", 1, 0.5), ("b", 1, 0.7)] and read(events=["b", "7"]) == [("7", 1, 0.1), ("b", 2, 0.9)]
    assert sorted(map(tuple, snapshots.versions(spark, path).collect())) == [(1, 3, 3), (2, 4, 4)]
    with pytest.raises(ValueError, match="no version 9"):
        tables.rescore(spark, path, version=9)
    assert tables.rescore(spark, path).schema.simpleString() == "struct<event:string,card:int,ink:double>"


def test_nothing_and_all_may_be_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    assert snapshots.write(spark.createDataFrame([], CELLS), path, "event") == 1
    assert snapshots.read(spark, path).count() == 0
    snapshots.write(spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.5)], CELLS), path, "event")
    snapshots.write(spark.createDataFrame([("c", 1, 0.5)], CELLS), path, "event", whole=True)
    assert [r.event for r in snapshots.read(spark, path).collect()] == ["c"]


EVENTS = "event string, data_entry_volunteer string, club string, date string, shoreline string, volunteers int, pounds double, duration_hours double"


def test_edits_are_published_only_if_no_rule_is_broken(spark, tmp_path):
    events = spark.createDataFrame([("e", "Ann", "", "2024-07-19", "Pier", 3, 4.5, 2.0)], EVENTS)
    values = lambda rows: spark.createDataFrame(rows, "event string, card bigint, item_row bigint, value double")
    path, good = str(tmp_path / "sheet"), [("e", 1, 18, 4.0), ("e", 2, 18, 0.0), ("e", 76, 110, 1.0), ("e", 1, 20, None)]
    spark.createDataFrame(good, "event string, card bigint, item_row bigint, value double").write.parquet(str(tmp_path / "values"))
    assert export.publish_edits(events, spark.read.parquet(str(tmp_path / "values")), path) == 1
    want = {("e", r, k, v) for r, k, v in [("C18", "number", "4.0"), ("BZ110", "number", "1.0")]}
    got = {(r.event, r.ref, r.kind, r.value) for r in snapshots.read(spark, path).collect()}
    assert want < got and len(got) == 2 + 6
    broken = [*good, ("e", 0, 18, 1.0), ("e", 77, 18, 2.0), ("e", 1, 18, 2.0), ("e", 1, 19, 1.5), ("e", 1, 1, 1.0), ("e", 3, 18, -1.0)]
    with pytest.raises(snapshots.BrokenRule) as told:
        export.publish_edits(events, values(broken), path)
    assert told.value.counts == {"card number": 2, "formula column": 1, "row twice": 2, "fraction": 1, "not an item row": 1, "negative value": 1}
    assert {(r.event, r.ref, r.kind, r.value) for r in snapshots.read(spark, path).collect()} == got
    assert [r.version for r in snapshots.versions(spark, path).collect()] == [1]


def test_only_changed_events_are_compared_again(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(i, i % 4, i % 10, rng.random(64).tolist()) for i in range(80)]
    frame = lambda rows: spark.createDataFrame(rows, "sample_id bigint, source bigint, label int, v array<double>")
    model, path = frame(rows[:40]).cache(), str(tmp_path / "near")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(knn.cached_neighbours(frame(rows), path, model)) == key(knn.neighbours(frame(rows), model))
    assert key(knn.cached_neighbours(frame(rows[::-1]), path, model)) == key(knn.neighbours(frame(rows), model))
    assert snapshots.latest_version(spark, path) == 1  # nothing had changed
    changed = [(*r[:3], rng.random(64).tolist()) if r[0] == 42 else r for r in rows]
    assert key(knn.cached_neighbours(frame(changed), path, model)) == key(knn.neighbours(frame(changed), model))
    held = snapshots.manifest(spark, path).filter("version = 2 and folder is not null").collect()
    assert {r.key: r.folder for r in held} == {"0": 1, "1": 1, "2": 2, "3": 1}
    # An event that is gone is not read; another model or another option makes all anew.
    assert key(knn.cached_neighbours(frame(rows[1::2]), path, model)) == key(knn.neighbours(frame(rows[1::2]), model))
    assert key(knn.cached_neighbours(frame(rows), path, model, pool=7)) == key(knn.neighbours(frame(rows), model, pool=7))
    assert {r.folder for r in snapshots.manifest(spark, path).filter("folder is not null").collect()} >= {1, 2, 3}
    assert key(knn.cached_neighbours(frame(rows), str(tmp_path / "own"))) == key(knn.neighbours(frame(rows)))
    assert knn.cached_neighbours(frame(rows).limit(0), str(tmp_path / "none")).count() == 0
    assert os.path.isdir(path)
