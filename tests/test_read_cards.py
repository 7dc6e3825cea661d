"""Cells against a plain walk over each crop, numbers against the glyphs drawn, and image files all the way to cards."""

import struct
import zlib

import numpy as np
import pytest
from test_register import BANNERS, card, lines

from inkframe.operators import cards, register

MAP = (
    "side string, item_row int, printed_column string, total_x int, total_y int, total_w int, total_h int, "
    "tally_x int, tally_y int, tally_w int, tally_h int, page_w int, page_h int"
)
GLYPHS = {
    0: "01110 10001 10001 10001 10001 10001 01110", 1: "00100 01100 00100 00100 00100 00100 01110", 2: "01110 10001 00001 00110 01000 10000 11111",
    4: "00010 00110 01010 10010 11111 00010 00010", 7: "11111 00001 00010 00100 01000 01000 01000",
}


def glyph(d, scale=4):
    return np.kron(np.array([[int(c) for c in row] for row in GLYPHS[d].split()]), np.ones((scale, scale), int))


# ---------------------------------------------------------------- the plain walk
def pieces(m):
    """Boxes of 8-connected ink by flood fill: (x0, x1, y0, y1, pixels)."""
    left, out = set(zip(*np.nonzero(m))), []
    while left:
        stack, seen = [left.pop()], []
        while stack:
            y, x = stack.pop()
            seen.append((y, x))
            for q in [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]:
                if q in left:
                    left.remove(q)
                    stack.append(q)
        ys, xs = zip(*seen)
        out.append((min(xs), max(xs), min(ys), max(ys), len(seen)))
    return out


def around(m, r):
    h, w = m.shape
    return np.array([[m[max(0, y - r):y + r + 1, max(0, x - r):x + r + 1].max() for x in range(w)] for y in range(h)])


def struck(dark, most, near=lambda a, b: True):
    out, i = [], 0
    while i < len(dark):
        j = i
        while j < len(dark) and dark[j]:
            j += 1
        out += range(i, j) if 0 < j - i <= most and near(i, j - 1) else []
        i = max(j, i + 1)
    return out


def marks(crop):
    ink = (around(crop, 9) - crop >= 22).astype(int)
    h, w = ink.shape
    edge = max(2, int(w * 0.25 + 0.5))
    rows = struck(ink.sum(1) >= w * 0.5, 6)
    cols = struck(ink.sum(0) >= h * 0.5, 6, lambda a, b: a < edge or b >= w - edge)
    ink[rows] = 0
    ink[:, cols] = 0
    return [(x0, x1, y0, y1, ink[y0:y1 + 1, x0:x1 + 1].sum()) for x0, x1, y0, y1, n in pieces(around(ink, 2)) if n >= 4]


def bar(h):
    return min(20, max(6, int(h * 0.25 + 0.5)))


def verdict(page, box, strip):
    def cut(r):
        return page[r[1]:r[1] + r[3], r[0]:r[0] + r[2]]

    if all((cut(r) < 170).mean() < 0.008 for r in (box, strip)):
        return None
    b, s = cut(box), cut(strip)
    dy = int(s.shape[0] * 0.1 + 0.5)
    s = s[dy:s.shape[0] - dy] if s.shape[0] - 2 * dy >= 8 else s
    found = marks(b)
    value = any(m[3] - m[2] + 1 >= bar(len(b)) for m in found) or sum(m[4] for m in found) >= min(90, b.size * 0.01)
    found = marks(s)
    tall = [m for m in found if m[3] - m[2] + 1 >= bar(len(s))]
    spread = len(tall) >= 2 and max(m[1] for m in tall) - min(m[0] for m in tall) >= 25
    written = spread or any(m[4] >= 250 for m in found)
    return (value, written and not value) if value or written else None


def test_cells_equal_a_plain_walk(spark):
    rng = np.random.default_rng(5)
    boxes = {(side, 18 + r): ((120, 10 + 36 * r, 50 + r, 24 + r), (4, 10 + 36 * r, 110, 22 + 2 * r)) for side in ("front", "back") for r in range(5)}
    # The back's third row lies on an exclusion.
    maps = spark.createDataFrame([(s, r, "left", *b, *t, 180, 200) for (s, r), (b, t) in boxes.items()], MAP)
    excluded = spark.createDataFrame([("back", 125, 85, 10, 10)], "side string, x int, y int, w int, h int")
    drawn, want = {}, {}
    for page in range(12):
        side = ("front", "back")[page % 2]
        m = rng.integers(235, 251, (200, 180))
        for y in range(8, 200, 36):
            m[y:y + 2] = 60
        m[:, 118:121] = 70
        if page < 11:
            for _ in range(30):
                y, x, h = rng.integers(0, 180), rng.integers(0, 176), rng.integers(1, 20)
                m[y:y + h, x:x + rng.integers(1, 4)] = rng.integers(20, 215)
        drawn[page] = m
        for (s, r), (box, strip) in boxes.items():
            if s == side and (s, r) != ("back", 20):
                found = verdict(m, box, strip)
                if found:
                    want[page, r] = found
    pages = spark.createDataFrame([(p, ("front", "back")[p % 2]) for p in drawn], "page bigint, side string")
    got = cards.read_cells(lines(spark, drawn), pages, maps, exclusions=excluded).collect()
    assert {(r.page, r.item_row): (r.has_value, r.tally_only) for r in got} == want
    assert len(got) == len(want) and len({v for v in want.values()}) == 2 and len(want) < 54
    assert all(r.value is None and r.digits is None and r.tally is None for r in got)


@pytest.fixture(scope="module")
def model(spark):
    """Exemplars cut from drawn boxes by the operator itself."""
    rows = []
    for d in GLYPHS:
        m = np.full((44, 100), 245)
        m[8:36, 30:50][glyph(d) == 1] = 40
        rows += [(d, y, [int(v) for v in line]) for y, line in enumerate(m)]
    found = cards.digit_bitmaps(spark.createDataFrame(rows, "crop bigint, y bigint, px array<smallint>"))
    assert {(r.crop, r.j, r.digits) for r in found.select("crop", "j", "digits").collect()} == {(d, 0, 1) for d in GLYPHS}
    return found.selectExpr("crop AS ex", "CAST(crop AS INT) AS label", "v")


def test_written_numbers_are_read_and_strips_counted(spark, model):
    """One page: numbers of one to three digits, four digits that no one reads, an empty box beside a tally, and an empty row."""
    written = {18: [4], 19: [2, 7], 20: [1, 0, 4], 21: [1, 2, 4, 7]}
    page = np.full((300, 300), 245)
    for row, digits in written.items():
        for j, d in enumerate(digits):
            page[12 + 48 * (row - 18):40 + 48 * (row - 18), 160 + 30 * j:180 + 30 * j][glyph(d) == 1] = 40
    for x in (60, 72, 84):  # strokes near a side of the strip pass for its printed wall
        page[205:230, x:x + 3] = 40
    maps = spark.createDataFrame(
        [("front", r, "left", 150, 4 + 48 * (r - 18), 140, 44, 4, 4 + 48 * (r - 18), 140, 44, 300, 300) for r in range(18, 24)], MAP)
    pages = spark.createDataFrame([(7, "front")], "page bigint, side string")

    def tallies(strips):
        return strips.groupBy("strip").count().selectExpr("strip", "3 AS count", "0.8D AS confidence")

    read = cards.read_cells(lines(spark, {7: page}), pages, maps, exemplars=model, tallies=tallies, k=1).collect()
    got = {r.item_row: (r.value, r.source, r.has_value, r.tally_only) for r in read}
    assert got == {
        18: (4, "digits", True, False), 19: (27, "digits", True, False), 20: (104, "digits", True, False),
        21: (None, None, True, False), 22: (3, "tally", False, True),
    }
    low = cards.read_cells(lines(spark, {7: page}), pages, maps, exemplars=model, gate=0.9, k=1).collect()
    assert all(r.value is None for r in low) and len(low) == 5


def test_no_pages_and_no_cells(spark):
    maps = spark.createDataFrame([("front", 18, "left", 2, 2, 8, 8, 12, 2, 8, 8, 30, 30)], MAP)
    none = spark.createDataFrame([], "page bigint, side string")
    blank = lines(spark, {1: np.full((30, 30), 250)})
    assert cards.read_cells(blank, none, maps).count() == 0
    front = spark.createDataFrame([(1, "front")], "page bigint, side string")
    assert cards.read_cells(blank, front, maps).count() == 0
    assert cards.read_cells(blank, front, maps.limit(0)).count() == 0


# ---------------------------------------------------------------- files to cards
def png(m):
    head = struct.pack(">IIBBBBB", m.shape[1], m.shape[0], 8, 0, 0, 0, 0)
    raw = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in m)

    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_files_become_cards(spark, tmp_path):
    forms = {s: np.kron(card(s), np.ones((2, 2), int)) for s in BANNERS}
    rows = {"front": range(18, 22), "back": range(60, 64)}
    cells = [(s, r, "left", 232, 342 + 20 * i, 54, 17, 110, 342 + 20 * i, 116, 17, 600, 800) for s in rows for i, r in enumerate(rows[s])]
    maps = spark.createDataFrame(cells, MAP)
    other = [("front", r, "right", 500, 342 + 20 * i, 54, 17, 380, 342 + 20 * i, 116, 17, 600, 800) for i, r in enumerate(range(22, 26))]
    grid = maps.unionByName(spark.createDataFrame(other, MAP))
    targets = {s: register.target(s, lines(spark, {0: forms[s]}).drop("page"), grid.filter(grid.side.isin(s, "front")), pad=230) for s in forms}

    def page(side, row=None, dx=0, dy=0, wide=0):
        m = forms[side].copy()
        if row is not None:
            y = 342 + 20 * (row - rows[side][0])
            m[y + 3:y + 14, 257:261] = 30
        m = np.roll(m, (dy, dx), (0, 1))
        return np.pad(m, ((0, 0), (0, wide)), constant_values=250)

    a, b = tmp_path / "beach", tmp_path / "park"
    a.mkdir(), b.mkdir()
    feed = [page("front", 19, 4, 6), page("back", 61, -3, 2), page("front", 20), np.full((800, 600), 255), page("back", 63, 0, -5)]
    for i, m in enumerate(feed):
        (a / f"s{i + 1}.png").write_bytes(png(m))
    (a / "s6.png").write_bytes(b"no image")
    (b / "p1.png").write_bytes(png(page("back", 60, 2, 2, wide=10)))  # another size of scan
    one = np.zeros(784)
    one[[y * 28 + x for y in range(4, 24) for x in range(10, 18)]] = 255.0
    model = spark.createDataFrame([(0, 1, one.tolist())], "ex bigint, label int, v array<double>")
    got = cards.read_scans(spark, str(tmp_path), targets["front"], targets["back"], maps, suffixes=("png",), sub=1, exemplars=model)
    pages = {(r.event, r.page_no): (r.side, r.trusted) for r in got.pages.collect()}
    assert {k: v for k, v in pages.items() if k != ("beach", 4)} == {
        ("beach", 1): ("front", True), ("beach", 2): ("back", True), ("beach", 3): ("front", True), ("beach", 5): ("back", True), ("park", 1): ("back", True)}
    assert not pages["beach", 4][1]
    found = [(r.event, r.page_no, r.item_row, r.has_value, r.value, r.source) for r in got.cells.collect()]
    assert sorted(found) == [
        ("beach", 1, 19, True, 1, "digits"), ("beach", 2, 61, True, 1, "digits"), ("beach", 3, 20, True, 1, "digits"),
        ("beach", 5, 63, True, 1, "digits"), ("park", 1, 60, True, 1, "digits")]
    problems = {(r.event, r.kind, r.page) for r in got.problems.collect()}
    assert {("beach", "misaligned-page", 4), ("beach", "unreadable-image", 6), ("park", "odd-page-count", None)} <= problems
    cells = {(r.event, r.page_no): r for r in got.cells.collect()}
    assert cells["beach", 1].item_name and cells["beach", 1].picture.w > 54 and cells["beach", 1].card_no == cells["beach", 2].card_no == 1
    cards_of = {(r.event, r.card_no): r.missing_sides for r in got.cards.collect()}
    assert cards_of["beach", 1] == "" and cards_of["park", 1] == "front"
