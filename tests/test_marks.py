"""Components, fragments and tallies against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkframe.operators import components, tally


def label(mask):
    """8-connected pieces by flood fill: sorted (min_x, max_x, min_y, max_y, count)."""
    h, w = mask.shape
    seen, out = set(), []
    for y in range(h):
        for x in range(w):
            if not mask[y, x] or (x, y) in seen:
                continue
            stack, piece = [(x, y)], []
            seen.add((x, y))
            while stack:
                cx, cy = stack.pop()
                piece.append((cx, cy))
                for nx in range(cx - 1, cx + 2):
                    for ny in range(cy - 1, cy + 2):
                        if 0 <= nx < w and 0 <= ny < h and mask[ny, nx] and (nx, ny) not in seen:
                            seen.add((nx, ny))
                            stack.append((nx, ny))
            xs, ys = zip(*piece, strict=True)
            out.append((min(xs), max(xs), min(ys), max(ys), len(piece)))
    return sorted(out)


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(0)
    out = [(rng.random((18, 40)) < d).astype(int) for d in (0.05, 0.3, 0.45, 0.8)]
    snake = np.zeros((21, 40), int)  # one long winding piece
    snake[::2] = 1
    for i, y in enumerate(range(1, 21, 2)):
        snake[y, 39 if i % 2 == 0 else 0] = 1
    return [*out, snake, np.zeros((5, 9), int), np.ones((5, 9), int)]


def as_lines(spark, masks):
    rows = [(p, y, [int(v) for v in line]) for p, m in enumerate(masks) for y, line in enumerate(m)]
    return spark.createDataFrame(rows, "page bigint, y bigint, px array<smallint>")


def test_components_equal_flood_fill(spark, masks):
    got = {}
    for r in components.components(as_lines(spark, masks)).collect():
        got.setdefault(r.page, []).append((r.min_x, r.max_x, r.min_y, r.max_y, r["count"]))
    for p, m in enumerate(masks):
        assert sorted(got.get(p, [])) == label(m)


def test_distributed_labels_equal_local(spark, masks):
    lines = as_lines(spark, masks)
    runs = components.line_runs(lines)
    far = components.label_components(runs, components.run_edges(runs))
    got = far.groupBy("page", "label").count().count()
    assert got == sum(len(label(m)) for m in masks)


def merge(boxes):
    out = []
    for b in sorted(boxes):
        if out:
            p = out[-1]
            low, high, left, right = min(p[3], b[3]), max(p[4], b[4]), min(p[0], b[0]), max(p[2], b[2])
            h = high - low + 1
            overlap = min(p[2], b[2]) - max(p[0], b[0])
            narrow = min(p[2] - p[0], b[2] - b[0]) + 1
            if overlap > narrow * 0.5 or (b[0] - p[2] - 1 <= h * 0.18 and right - left + 1 <= h * 1.05):
                out[-1] = (left, p[1], right, low, high, p[5] + b[5])
                continue
        out.append(b)
    return out


def test_fragment_merge(spark):
    rng = random.Random(1)
    crops = {}
    for c in range(400):
        crops[c] = []
        for k in range(rng.randint(1, 6)):
            x, y = rng.randint(0, 60), rng.randint(0, 30)
            crops[c].append((x, k, x + rng.randint(0, 20), y, y + rng.randint(5, 28), rng.randint(1, 99)))
    rows = [(c, *b) for c, bs in crops.items() for b in bs]
    df = spark.createDataFrame(rows, "crop bigint, min_x bigint, k bigint, max_x bigint, min_y bigint, max_y bigint, count bigint")
    got = {}
    for r in components.merge_fragments(df).orderBy("crop", "j").collect():
        got.setdefault(r.crop, []).append((r.min_x, r.max_x, r.min_y, r.max_y, r["count"]))
    for c, bs in crops.items():
        assert got[c] == [(b[0], b[2], b[3], b[4], b[5]) for b in merge(bs)]


def strokes(strip, xs, **over):
    base = {"kind": "stroke", "angle": 90, "length": 40, "ink": 40, "max_y": 50}
    return [(strip, k, *{**base, **over}.values(), x - 1, x + 1, 10, x) for k, x in enumerate(xs)]


def bar(strip, k, x0, x1):
    return (strip, k, "bar", 10, x1 - x0, x1 - x0, 40, x0, x1, 10, (x0 + x1) // 2)


def test_tally_shapes(spark):
    rows = (
        strokes(1, [10, 24, 38])
        + strokes(2, [10, 24, 38, 52]) + [bar(2, 9, 5, 57)]
        + strokes(3, [10, 24, 38, 52]) + [bar(3, 9, 5, 57)] + strokes(3, [100, 114])[0:2]
        + strokes(4, [10, 24]) + strokes(4, [38], angle=30)
        + strokes(5, [10, 24, 38, 90, 104, 118, 132, 146])
        + strokes(6, [10, 24]) + strokes(6, [38], max_y=120)
        + strokes(7, [10, 24])
    )
    seg = spark.createDataFrame(
        rows, "strip bigint, k bigint, kind string, angle bigint, length bigint, ink bigint, max_y bigint, "
        "min_x bigint, max_x bigint, min_y bigint, mid_x bigint"
    )
    strips = seg.groupBy("strip").agg({"ink": "sum"}).withColumnRenamed("sum(ink)", "ink").selectExpr(
        "strip", "IF(strip = 7, ink * 2, ink) AS ink", "ink * 3 AS raw_ink", "false AS clipped"
    )
    got = {r.strip: (r["count"], r.reason) for r in tally.count_tallies(seg, strips).collect()}
    assert got[1] == (3, "")
    assert got[2] == (5, "")
    assert got[3] == (7, "")
    assert got[4] == (None, "strokes not parallel")
    assert got[5] == (None, "ragged groups")
    assert got[6] == (None, "no common baseline")
    assert got[7] == (None, "unexplained ink")


def test_verdicts_on_drawn_strips(spark):
    def strip(*xs, height=40):
        m = np.zeros((58, 120), int)
        for x in xs:
            m[9:9 + height, x:x + 2] = 1
        return m

    scribble = np.zeros((58, 120), int)
    scribble[10:45, 20:45] = 1
    drawn = {0: strip(20, 34, 48), 1: strip(20), 2: strip(20, 34), 3: scribble, 4: strip(20, 60, 90, height=4)}
    lines = as_lines(spark, list(drawn.values()))
    strips = components.strip_verdict(components.find_marks(components.inset_rows(lines, 58)), 46)
    # Spread of strokes; one stroke; two too near; one heavy mark; specks.
    assert {r.page: r.marked or False for r in strips.collect()} == {0: True, 1: False, 2: False, 3: True, 4: False}
    boxes = components.box_verdict(components.find_marks(lines), 120, 58)
    assert {r.page: r.marked for r in boxes.collect()} == {0: True, 1: True, 2: True, 3: True, 4: False}


def test_dense_pages_are_declined(spark):
    ink = spark.createDataFrame([(p, x, 5) for p, n in ((1, 30), (2, 31)) for x in range(n)], "page bigint, x bigint, y bigint")
    got = {r.page: (r.angle, r.length, r.reason) for r in tally.strongest_line(ink, max_ink=30).collect()}
    assert got == {1: (0, 29.0, ""), 2: (None, None, "too dense")}


def drawn(*strokes, height=116, width=460):
    """A context with strokes (x0, y0, x1, y1), three pixels wide, as the pen draws them."""
    m = np.zeros((height, width), int)
    for x0, y0, x1, y1 in strokes:
        for y in range(y0, y1 + 1):
            x = round(x0 + (x1 - x0) * (y - y0) / max(1, y1 - y0))
            m[y, max(0, x - 1):x + 2] = 1
    return m


def seen(x0, y0, x1, y1, top=35, bottom=81):
    """What the counted band, trimmed from a strip of lines 29 to 86, shows of a stroke: angle, extent and middle."""
    a, b = max(y0, top), min(y1, bottom)
    at = lambda y: x0 + (x1 - x0) * (y - y0) / (y1 - y0)
    return np.degrees(np.arctan2(b - a, at(b) - at(a))), a, b, (at(a) + at(b)) / 2


UPRIGHT = (40, 41, 40, 75)


@pytest.mark.parametrize(("strokes", "overruns", "reason"), [
    # It comes down into the row from above; it hangs below its own row; another mark stands over it.
    ([UPRIGHT, (66, 3, 76, 72)], [0, 26], "ink continues past the row"),
    ([UPRIGHT, (66, 41, 76, 112)], [0, 0], ""),
    ([UPRIGHT, (66, 41, 70, 72), (62, 3, 64, 22)], [0, 0], ""),
    # One line without ink is bridged, two are not; a stroke that just leaves the row belongs to it.
    ([UPRIGHT, (66, 20, 66, 72)], [0, 9], ""),
])
def test_ink_is_followed_above_the_row(spark, strokes, overruns, reason):
    m = drawn(*strokes)
    lines = spark.createDataFrame([(1, y, row.tolist()) for y, row in enumerate(m)], "strip bigint, y bigint, px array<int>")
    rows = [(1, k, "stroke", *(float(v) for v in seen(*s)[:1]), *(v for v in seen(*s)[1:3]), int(seen(*s)[3] + 0.5), 40, 40) for k, s in enumerate(strokes[:2])]
    found = spark.createDataFrame(rows, "strip bigint, k bigint, kind string, angle double, min_y bigint, max_y bigint, mid_x bigint, length bigint, ink bigint")
    traced = tally.row_overrun(found.withColumn("min_x", F.col("mid_x") - 3).withColumn("max_x", F.col("mid_x") + 3), lines, 29)
    assert [r.overrun for r in traced.orderBy("k").collect()] == overruns
    strips = spark.createDataFrame([(1, 80, 400, False)], "strip bigint, ink bigint, raw_ink bigint, clipped boolean")
    got = tally.count_tallies(traced.withColumn("angle", F.lit(90)).withColumn("max_y", F.lit(75)), strips, 58).first()
    assert (got.reason, got["count"]) == (reason, None if reason else 2)


def test_trace_bridges_one_line_and_turns_with_the_ink(spark):
    m = drawn((10, 0, 30, 40), height=60, width=50)
    m[20] = 0
    cases = {1: m, 2: np.where(np.arange(60)[:, None] == 19, 0, m), 3: np.zeros((60, 50), int)}
    lines = spark.createDataFrame([(s, y, row.tolist()) for s, c in cases.items() for y, row in enumerate(c)], "strip bigint, y bigint, px array<int>")
    # A flat stroke has no upward end; the last has no lines at all.
    rows = [(1, 0, 63.4, 35, 40, 29), (2, 0, 63.4, 35, 40, 29), (3, 0, 90.0, 35, 40, 29), (1, 1, 0.0, 35, 40, 29), (9, 0, 90.0, 35, 40, 29)]
    got = tally.row_overrun(spark.createDataFrame(rows, "strip bigint, k bigint, angle double, min_y bigint, max_y bigint, mid_x bigint"), lines, 30).collect()
    assert {(r.strip, r.k): r.overrun for r in got} == {(1, 0): 29, (2, 0): 9, (3, 0): 0, (1, 1): 0, (9, 0): 0}


def test_sweep_of_any_grid_equals_every_setting_by_itself(spark):
    rng = np.random.default_rng(5)
    rows = [(crop, k, int(x), int(x + w), int(y), int(y + h), int(1 + rng.integers(1, 1 + (w + 1) * (h + 1))))
            for crop in range(60) for k in range(int(rng.integers(1, 7)))
            for x, w, y, h in [rng.integers(0, 45, 4)]]
    boxes = spark.createDataFrame(rows, "crop bigint, k bigint, min_x bigint, max_x bigint, min_y bigint, max_y bigint, count bigint").cache()
    truth = spark.createDataFrame([(c, c % 4) for c in range(59)], "crop bigint, digits int")
    grid = {"hollow": [0.3, 0.0, 0.06, 0.06, 1.0], "short": np.linspace(0, 1, 200).tolist(), "bar": [0.2, 1.0, 3.5, 50.0]}
    got = {(r.param, r.setting): tuple(r)[2:] for r in components.sweep_shape(boxes, truth, values=grid).collect()}
    assert len(got) == 4 + 200 + 4
    digits = {c: c % 4 for c in range(59)}
    for param, setting in [*((p, v) for p in ("hollow", "bar") for v in grid[p]), *(("short", v) for v in grid["short"][::23])]:
        one = {**components.SHIPPING, param: setting}
        right = none = over = 0
        kept = [b for b in rows if not (b[5] - b[4] + 1 < one["short"] * 58 or (b[3] - b[2] + 1) / (b[5] - b[4] + 1) > one["bar"]
                                        or b[6] < (b[3] - b[2] + 1) * (b[5] - b[4] + 1) * one["hollow"])]
        for crop, want in digits.items():
            if not any(b[0] == crop for b in rows):
                continue
            own = sorted((b for b in kept if b[0] == crop), key=lambda b: (b[2], b[1]))
            tall = max((b[5] - b[4] + 1 for b in own), default=0)
            n = len(joined_boxes([b[2:6] for b in own if b[5] - b[4] + 1 >= tall * components.SPECK]))
            right, none, over = right + (n == want), none + (n == 0 and want != 0), over + (n > want)
        assert got[param, setting] == (right, none, over), (param, setting)
    assert components.sweep_shape(boxes.limit(0), truth).count() == 0


def joined_boxes(boxes):
    """Left to right: a box joins the last one where they overlap by half or make one digit."""
    out = []
    for x0, x1, y0, y1 in boxes:
        if out:
            a0, a1, b0, b1 = out[-1]
            h = max(b1, y1) - min(b0, y0) + 1
            if min(a1, x1) - max(a0, x0) > (min(a1 - a0, x1 - x0) + 1) * 0.5 or (x0 - a1 - 1 <= h * 0.18 and max(a1, x1) - min(a0, x0) + 1 <= h * 1.05):
                out[-1] = (min(a0, x0), max(a1, x1), min(b0, y0), max(b1, y1))
                continue
        out.append((x0, x1, y0, y1))
    return out
