"""Crops that are looked at side by side come to what each comes to alone, and take as few steps as there are frames."""

import re

import numpy as np
import pyarrow as pa
from test_read_cards import marks

from inkframe.functions import frames
from inkframe.operators import cards, components, ordered, raster
from inkframe.plans import BUILDS

SF = "/root/testdata/sf0.01"


def drawn(n, seed=6):
    """Crops of many sizes: paper, strokes, a rule, a wall, and every seventh blank."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        h, w = rng.integers(3, 40), rng.integers(3, 50)
        m = rng.integers(235, 251, (h, w))
        if k % 7:
            for _ in range(rng.integers(1, 6)):
                y, x = rng.integers(0, h), rng.integers(0, w)
                m[y:y + rng.integers(1, 14), x:x + rng.integers(1, 4)] = rng.integers(20, 215)
            m[h // 2] = 60 if k % 3 == 0 else m[h // 2]
            m[:, 0] = 70 if k % 4 == 0 else m[:, 0]
        out.append(m.astype(np.int16))
    return out


def packed(crops):
    order = [np.random.default_rng(k).permutation(len(m)) for k, m in enumerate(crops)]
    return pa.array([list(map(int, o)) for o in order], pa.list_(pa.int64())), pa.array(
        [[m[y].tolist() for y in o] for m, o in zip(crops, order)], pa.list_(pa.list_(pa.int16())))


def test_many_crops_share_a_frame_and_none_changes(monkeypatch):
    crops = [*drawn(60), np.zeros((0, 0), np.int16)]
    y, px = packed(crops)
    assert len(list(frames.frames(y, px, True))) == 1
    for room in (1, 4000, frames.FRAME):
        monkeypatch.setattr(frames, "FRAME", room)
        seen = 0
        for part, pixels, lines, heights, widths in frames.frames(y, px, True):
            assert part.start == seen and (pixels.size <= room or len(pixels) == 1)
            found = components._marks_of(frames.struck_ink(pixels, heights, widths), heights, widths, np.zeros(len(heights), int), 2, 4)
            for k, m in enumerate(crops[part]):
                assert (pixels[k, :len(m), :m.shape[1]] == m).all() and (heights[k], widths[k]) == m.shape
                mine = {tuple(map(int, r)) for r in zip(*[found[i][found[0] == k] for i in (2, 3, 4, 5, 7)])}
                assert mine == (set(marks(m)) if m.size else set())
            seen = part.stop
        assert seen == len(crops)


def test_crop_marks_equal_those_of_the_masks(spark):
    """Also of crops some of whose lines are absent; a crop without lines has a row."""
    crops = {k: m for k, m in enumerate(drawn(40, seed=8))}
    there = {k: [y for y in range(len(m)) if k % 5 or y % 4 != 1] for k, m in crops.items()}
    lines = [(k, y, [int(v) for v in crops[k][y]]) for k in crops for y in there[k]]
    df = spark.createDataFrame(lines, "page bigint, y bigint, px array<smallint>")
    names = ["page", "label", "min_x", "max_x", "min_y", "max_y", "count", "ink"]
    want = sorted(map(str, components.find_marks(raster.ink_mask(df)).select(*names).collect()))
    rows = [(k, 0.5, 0.25, [(y, [int(v) for v in crops[k][y]]) for y in there[k]]) for k in crops] + [(99, 0.5, 0.25, [])]
    found = components.crop_marks(spark.createDataFrame(rows, "page bigint, box_ink double, tally_ink double, r array<struct<y: bigint, px: array<smallint>>>"))
    got = found.collect()
    assert sorted(str(r) for r in found.filter("page < 99").select(*names).collect()) == want
    assert [(r.label, r.w, r.h) for r in got if r.page == 99] == [(None, 0, 0)]
    assert {(r.page, r.w, r.h) for r in got if r.page < 99} == {(k, m.shape[1], len(there[k])) for k, m in crops.items()}


def test_a_cell_without_a_box_holds_nothing_in_it(spark):
    ink = [(1, 0, 18, cards.STRIP, y, [20] * 4 + [250] * 36) for y in range(20)]
    df = spark.createDataFrame([(cards.KINDS * 18 + k, p, i, k, y, px) for _, p, i, k, y, px in ink],
                               "crop bigint, page bigint, item_row int, kind int, y bigint, px array<smallint>")
    for tasks in (None, 3):
        got = cards.judge_cells(df, tasks).collect()
        assert [(r.page, r.item_row, r.ink, r.tally_ink, r.has_value, r.tally_marked) for r in got] == [(0, 18, 0.0, 0.1, False, False)]


def test_cells_are_cut_and_judged_in_one_pass(spark, monkeypatch):
    """Lines, cells and marks are dealt to 60 tasks of 1,000 of the 60,000 rows, and no crop's lines stand in windows."""
    monkeypatch.setattr(ordered, "TASK_ROWS", 1000)
    plan = BUILDS["q_cells"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(.*, 60\), REPARTITION_BY_NUM", plan)) >= 6
    assert "MapInArrow" in plan and "Window" not in plan and "RDD" not in plan
