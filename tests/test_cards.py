"""Pairing against the plain loop, chunk borders and hot feeds included."""

import random
import re

import pytest

from inkframe.operators import pairing


def greedy(pages):
    """Cards of one feed by walking it once: [(front, back)], in order."""
    cards, i = [], 0
    while i < len(pages):
        (p, side), nxt = pages[i], pages[i + 1] if i + 1 < len(pages) else None
        if nxt and nxt[1] != side:
            pair = {side: p, nxt[1]: nxt[0]}
            i += 2
        else:
            pair = {side: p}
            i += 1
        cards.append((pair.get("front"), pair.get("back")))
    return cards


def feeds(rng, n):
    for event in range(n):
        size = rng.choice([1, 2, 3, 5, 8, 13, 40])
        bias = rng.choice([0.1, 0.5, 0.9])
        pages, page = [], 0
        side = "front"
        for _ in range(size):
            page += rng.choice([1, 1, 1, 4])
            side = ("back" if side == "front" else "front") if rng.random() < bias else side
            pages.append((page, side))
        yield event, pages


@pytest.mark.parametrize("width", [2, 7, 4096])
def test_equal_to_loop_at_every_chunk_width(spark, width):
    data = list(feeds(random.Random(width), 150))
    rows = [(e, p, s, 1.0) for e, pages in data for p, s in pages]
    df = spark.createDataFrame(rows, "event bigint, page_no bigint, side string, overlap double")
    got = {}
    for r in pairing.pair_pages(df, chunk_width=width).collect():
        got.setdefault(r.event, {})[r.card_no] = (r.front_page, r.back_page)
    for event, pages in data:
        want = greedy(pages)
        assert [got[event].get(i + 1) for i in range(len(want))] == want
        assert len(got[event]) == len(want)


def test_worked_cases(spark):
    def pair(text):
        pages = [(1, i + 1, {"f": "front", "b": "back"}[c], 1.0) for i, c in enumerate(text)]
        df = spark.createDataFrame(pages, "event bigint, page_no bigint, side string, overlap double")
        cards = [(r.front_page, r.back_page) for r in pairing.pair_pages(df).orderBy("card_no").collect()]
        problems = [(r.kind, r.page, r.other_page) for r in pairing.pairing_problems(df).collect()]
        return cards, problems

    assert pair("fbbffb") == ([(1, 2), (4, 3), (5, 6)], [])
    cards, problems = pair("fbffbfb")
    assert cards[1] == (3, None) and len(cards) == 4
    assert ("sequence-break", 3, 4) in problems and ("odd-page-count", None, None) in problems
    assert len(pair("b")[1]) == 2


def test_one_feed_is_spread_over_tasks(spark):
    """One event with all pages: the plan must window by chunk, not by event."""
    df = spark.range(20000).selectExpr(
        "id div 1000000 AS event", "id + 1 AS page_no", "IF(id % 7 < 3, 'front', 'back') AS side", "1D AS overlap"
    )
    placed = pairing.placed_pages(df, chunk_width=256)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    windows = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert any("event" in w and "_chunk" in w for w in windows)
    sides = [(i + 1, "front" if i % 7 < 3 else "back") for i in range(20000)]
    want = greedy(sides)
    got = pairing.pair_pages(df, chunk_width=256).orderBy("card_no").collect()
    assert [(r.front_page, r.back_page) for r in got] == want
