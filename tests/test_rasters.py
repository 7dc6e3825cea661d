"""Raster operators on pages drawn in code."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkframe.operators import islands, raster


def lines_of(spark, pages):
    rows = [(p, y, [int(v) for v in line]) for p, m in pages.items() for y, line in enumerate(m)]
    return spark.createDataFrame(rows, "page bigint, y bigint, px array<smallint>")


def back(df):
    out = {}
    for r in df.orderBy("page", "y").collect():
        out.setdefault(r.page, []).append(r.px)
    return {p: np.array(v) for p, v in out.items()}


@pytest.fixture(scope="module")
def pages():
    rng = np.random.default_rng(4)
    return {1: rng.integers(0, 256, (23, 31)), 2: rng.integers(0, 256, (12, 40)), 3: np.full((9, 9), 255)}


def test_quarter_turns(spark, pages):
    lines = lines_of(spark, pages)
    for t in (1, 2, 3, 4):
        got = back(raster.quarter_turn(lines, t))
        for p, m in pages.items():
            assert (got[p] == np.rot90(m, -t)).all()


def test_local_max_and_stencil(spark, pages):
    lines = lines_of(spark, pages)
    got, soft = back(raster.local_max(lines, 3)), back(raster.stencil3(lines))
    for p, m in pages.items():
        pad = np.pad(m, 3)
        h, w = m.shape
        want = np.max([pad[dy:dy + h, dx:dx + w] for dy in range(7) for dx in range(7)], axis=0)
        assert (got[p] == want).all()
        pad = np.pad(m, 1)
        k = [[1, 2, 1], [2, 4, 2], [1, 2, 1]]
        blur = sum(k[dy][dx] * pad[dy:dy + h, dx:dx + w] for dy in range(3) for dx in range(3)) // 16
        assert (soft[p] == blur).all()


def test_identity_geometry(spark, pages):
    lines = lines_of(spark, {1: pages[1]})
    fits = spark.createDataFrame([(1, 1.0, 0.0, 1.0, 0.0)], "page bigint, sx double, ox double, sy double, oy double")
    got = back(raster.resample(lines, fits, 31, 23))[1]
    assert (got[:-1, :-1] == pages[1][:-1, :-1]).all()
    assert (got[-1] == 255).all() and (got[:, -1] == 255).all()
    still = back(raster.rotate(lines, spark.createDataFrame([(1, 0.0)], "page bigint, deg double")))[1]
    assert (still[:-1, :-1] == pages[1][:-1, :-1]).all()


def ruled(h=80, w=120, slope=0.0):
    m = np.full((h, w), 250)
    for y in range(10, h, 12):
        for x in range(w):
            yy = y + int(np.floor((x - w / 2) * slope + 0.5))
            if 0 <= yy < h:
                m[yy, x] = 20
    return m


@pytest.mark.parametrize("deg", [-3.0, 0.0, 2.0])
def test_skew_is_found(spark, deg):
    lines = lines_of(spark, {1: ruled(slope=np.tan(np.deg2rad(deg)))})
    got = raster.skew_angle(lines, 120, 80, max_deg=4, step=0.5, sub=1).first()
    assert abs(got.deg + deg) <= 0.5


def test_axis_fit_recovers_scale_and_offset(spark):
    rng = np.random.default_rng(2)
    ref = np.convolve(rng.random(400), np.ones(9) / 9, "same")
    scale, offset = 1.02, -12.0
    at = (np.arange(460) - offset) / scale
    page = np.interp(at, np.arange(400), ref, left=0, right=0)
    df = spark.createDataFrame([(1, ref.tolist(), page.tolist())], "page bigint, ref array<double>, v array<double>")
    got = raster.fit_axis(df, 40, 360, max_offset=40).first()
    assert abs(got.scale - scale) < 0.002 and abs(got.offset - offset) < 1.5 and got.score > 0.99


def test_best_shift_sign(spark):
    a = np.zeros(60)
    a[20:25] = 1
    df = spark.createDataFrame([(1, a.tolist(), np.roll(a, 7).tolist())], "page bigint, ref array<double>, v array<double>")
    assert raster.best_shift(df, 40).first().shift == 7


def test_rules_and_walls_are_struck_but_strokes_stay(spark):
    m = np.full((58, 100), 248)
    m[28:30, :] = 60  # a printed rule
    m[:, 2:4] = 60  # a wall at the side
    m[10:48, 50:53] = 90  # a written one, in the middle
    got = back(raster.ink_mask(lines_of(spark, {1: m})))[1]
    assert got[:, 2:4].sum() == 0 and got[28:30].sum() == 0 and got[12:26, 50:53].all()


def test_overlap_touching_edges_is_none(spark):
    rects = spark.createDataFrame([(1, 1, 0, 0, 10, 10), (1, 2, 20, 20, 10, 10), (2, 3, 0, 0, 90, 90)],
                                  "page bigint, cell bigint, x bigint, y bigint, w bigint, h bigint")
    ex = spark.createDataFrame([(1, 10, 0, 5, 5), (1, 29, 29, 40, 40), (2, 89, 89, 3, 3)], "page bigint, x bigint, y bigint, w bigint, h bigint")
    assert [r.cell for r in raster.without_excluded(rects, ex).collect()] == [1]


def test_best_side_short_circuit(spark):
    rows = [
        (1, 0, "front", 0, 0.8), (1, 1, "back", 0, 0.95), (1, 2, "front", 1, 0.99),
        (2, 0, "front", 0, 0.4), (2, 1, "back", 0, 0.76), (2, 2, "front", 1, 0.99),
        (3, 0, "front", 0, 0.4), (3, 1, "back", 0, 0.4), (3, 2, "front", 1, 0.6), (3, 3, "back", 1, 0.6),
    ]
    df = spark.createDataFrame(rows, "page bigint, attempt bigint, side string, turns bigint, overlap double")
    got = {r.page: (r.side, r.turns, r.trusted) for r in raster.best_side(df).collect()}
    assert got == {1: ("front", 0, True), 2: ("back", 0, True), 3: ("front", 1, False)}


def test_peaks_keep_their_distance(spark):
    v = [0, 5, 0, 0, 9, 9, 0, 1, 0, 0, 0, 7, 0, 6, 0]
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "page bigint, i bigint, v double")
    assert sorted(r.i for r in islands.peaks(df, min_sep=4, factor=1.8).collect()) == [4, 11]


def test_bridged_runs(spark):
    df = spark.createDataFrame([(1, i) for i in (1, 2, 5, 6, 10)], "page bigint, i bigint")
    got = sorted((r.start, r.end, r.n) for r in islands.run_bounds(df, ["page"], max_gap=2).collect())
    assert got == [(1, 6, 4), (10, 10, 1)]


def test_banner_overlap_without_banner_is_zero(spark):
    b = spark.createDataFrame([(1, "left", 0, False)], "page bigint, block string, y bigint, banner boolean")
    ref = spark.createDataFrame([("left", 0, False)], "block string, y bigint, banner boolean")
    assert raster.banner_overlap(b, ref).select(F.col("overlap")).first()[0] == 0.0
