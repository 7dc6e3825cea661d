"""Drawn cards, scaled, shifted, tilted and turned, come back onto their form."""

import numpy as np
import pytest

from inkframe.operators import raster, register

W, H = 300, 400
BLOCKS = [(20, 145), (155, 280)]
BANNERS = {"front": (60, 150, 260), "back": (60, 110, 215, 330)}


def card(side):
    m = np.full((H, W), 250)
    m[10:30, 20:280] = 40  # a masthead at no fixed distance from the grid
    for x0, x1 in BLOCKS:
        for y in BANNERS[side]:
            m[y:y + 16, x0:x1] = 30  # 16 lines, as on scans: a fit is good to a line or two
        for y in range(70, 390, 10):  # faint rules, and captions that tell left from right
            m[y, x0:x1] = np.minimum(m[y, x0:x1], 210)
            m[y + 3:y + 6, x0 + 3:x0 + 30] = np.minimum(m[y + 3:y + 6, x0 + 3:x0 + 30], 90)
    return m


def scan(m, scale=1.0, dx=0.0, dy=0.0, deg=0.0):
    y, x = np.mgrid[0:H, 0:W].astype(float)
    a = np.deg2rad(deg)
    cx, cy = W / 2, H / 2
    u = (cx + (x - cx) * np.cos(a) + (y - cy) * np.sin(a) - dx) / scale
    v = (cy - (x - cx) * np.sin(a) + (y - cy) * np.cos(a) - dy) / scale
    x0, y0 = np.floor(u).astype(int), np.floor(v).astype(int)
    ok = (x0 >= 0) & (y0 >= 0) & (x0 + 1 < W) & (y0 + 1 < H)
    x0, y0 = np.clip(x0, 0, W - 2), np.clip(y0, 0, H - 2)
    fx, fy = u - x0, v - y0
    out = (m[y0, x0] * (1 - fx) + m[y0, x0 + 1] * fx) * (1 - fy) + (m[y0 + 1, x0] * (1 - fx) + m[y0 + 1, x0 + 1] * fx) * fy
    return np.where(ok, np.floor(out), 255).astype(int)


def lines(spark, pages):
    rows = [(p, y, [int(v) for v in line]) for p, m in pages.items() for y, line in enumerate(m)]
    return spark.createDataFrame(rows, "page bigint, y bigint, px array<smallint>")


@pytest.fixture(scope="module")
def targets(spark):
    cells = [
        (name, x1 - 30, 170 + 10 * k, 27, 8, x0 + 2, 170 + 10 * k, x1 - x0 - 35, 8)
        for (x0, x1), name in zip(BLOCKS, ("left", "right")) for k in range(8)
    ]
    cells = spark.createDataFrame(cells, "printed_column string, total_x bigint, total_y bigint, total_w bigint, total_h bigint, "
                                         "tally_x bigint, tally_y bigint, tally_w bigint, tally_h bigint")
    return {s: register.target(s, lines(spark, {0: card(s)}).drop("page"), cells, pad=115) for s in BANNERS}


def test_scale_shift_and_tilt_are_taken_back(spark, targets):
    pages = {
        1: scan(card("front")), 2: scan(card("front"), 1.02, -5, 12), 3: scan(card("back"), 0.98, 4, -7),
        4: scan(card("front"), 1.01, 3, 5, 1.0), 5: np.full((H, W), 255),
    }
    fits, placed = register.register_pages(lines(spark, pages), targets["front"], targets["back"], W, H, sub=1)
    got = {r.page: r for r in fits.collect()}
    assert {p: (r.side, r.turns, r.trusted) for p, r in got.items() if p != 5} == {
        1: ("front", 0, True), 2: ("front", 0, True), 3: ("back", 0, True), 4: ("front", 0, True)}
    assert not got[5].trusted
    assert abs(got[2].sy - 1.02) < 0.004 and abs(got[2].oy - 12) < 1.5 and abs(got[2].sx - 1.02) < 0.004 and abs(got[2].ox + 5) < 1.5
    assert abs(abs(got[4].deg) - 1.0) < 0.15
    image = {}
    for r in placed.collect():
        image.setdefault(r.page, np.full((H, W), 255))[r.y] = r.px
    assert set(image) == set(pages)
    window = np.s_[60:250, 20:280]
    error = lambda m, side: np.abs(m[window] - card(side)[window]).mean()
    assert all(error(image[p], side) < 20 for p, side in ((1, "front"), (2, "front"), (3, "back"), (4, "front")))
    assert all(error(image[p], side) < 0.6 * error(pages[p], side) for p, side in ((2, "front"), (3, "back"), (4, "front")))


def test_a_page_fed_sideways_is_turned(spark, targets):
    turned = np.rot90(scan(card("front"), 1.0, 2, 3), 1)  # once anticlockwise: one clockwise turn takes it back
    got = register.register_pages(lines(spark, {7: turned}), targets["front"], targets["back"], H, W, sub=1)[0].first()
    assert (got.side, got.turns, got.trusted) == ("front", 1, True)
    assert raster.quarter_turn(lines(spark, {7: turned}), 1).count() == H
