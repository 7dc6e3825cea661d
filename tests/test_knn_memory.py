"""What comparing holds in Python doesn't follow the samples: one worker a task, a block at a time."""

import tracemalloc

import numpy as np
import pyarrow as pa

from inkframe.functions import vectors
from inkframe.operators import knn
from inkframe.sources import snapshots


def test_one_worker_a_task_prepares_and_compares(spark, tmp_path):
    rows = [(i, i % 3, i % 5, np.random.default_rng(i).random(64).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "sample_id bigint, source bigint, label int, v array<double>")
    plan = knn.neighbours(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan and "MapInPandas" not in plan
    nothing = snapshots.manifest(spark, f"{tmp_path}/none")
    plan = nothing._jdf.queryExecution().executedPlan().toString()
    assert "RDD" not in plan and nothing.count() == 0
    assert ", ".join(f"{c} {t}" for c, t in nothing.dtypes) == snapshots.MANIFEST


def peak(n, side):
    rng = np.random.default_rng(n)
    matrix, at = vectors.ready(rng.random((50, side * side)), side), np.arange(50)
    v = pa.FixedSizeListArray.from_arrays(pa.array(rng.random(n * side * side)), side * side).cast(pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.full(n, 99)), v], names=["sample_id", "source", "v"])
    tracemalloc.start()
    rows = sum(len(out) for out in knn._compared(iter([batch]), matrix, at, at % 10, at, 25, side))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n * 25
    return most


def test_memory_does_not_follow_a_batch():
    for side in (8, 28):
        assert peak(4000, side) < 1.2 * peak(400, side)


def test_odd_samples_and_exemplars(spark):
    """A null source is no one's own, an exemplar's null label stays null, and samples of the only source have no neighbours."""
    rng = np.random.default_rng(2)
    rows = [(i, i % 2 if i else None, None if i == 3 else i % 5, rng.random(64).tolist()) for i in range(8)]
    df = spark.createDataFrame(rows, "sample_id bigint, source bigint, label int, v array<double>")
    got = knn.neighbours(df).collect()
    assert sorted(r.ex for r in got if r.query == 1) == [0, 2, 4, 6] and {r.label for r in got if r.ex == 3} == {None}
    assert sum(r.query == 0 for r in got) == 8 and all(r.rank >= 1 for r in got)
    assert knn.neighbours(df.filter("source = 1")).count() == 0 and knn.neighbours(df.limit(0)).count() == 0
