"""Page numbers and cards from a stream of pages, with state that ends with the event."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

CARDS = "event string, card_no bigint, front_page bigint, back_page bigint, late_page bigint"
NUMBERED = "event string, file string, page_no bigint, side string, total bigint, ts timestamp"
#: Milliseconds of event time after an event's last page until what is missing is taken to be lost, and until its state goes.
QUIET_MS, KEEP_MS = 600_000, 86_400_000


def _number(v: Any) -> int | None:
    return None if v is None or pd.isna(v) else int(v)


class _Timers:
    """When an event is taken to be complete, and when it is forgotten; both move with its last page."""

    def __init__(self, handle: StatefulProcessorHandle, quiet: int, keep: int):
        self.handle, self.quiet, self.keep = handle, quiet, max(quiet, keep)

    def move(self, before: int | None, seen: int) -> None:
        if before == seen:
            return
        for ms in {self.quiet, self.keep}:
            if before is not None:
                self.handle.deleteTimer(before + ms)
            self.handle.registerTimer(seen + ms)


class Feed:
    """Takes an event's pages in page order and pairs neighbours of different sides; a page that stands alone is a card too."""

    def __init__(self, event: str, next_page: int = 1, cards: int = 0, held: tuple[int, str] | None = None, total: int | None = None):
        self.event, self.next_page, self.cards, self.held, self.total = event, next_page, cards, held, total
        self.out: list[tuple] = []

    def _card(self, *pages: tuple[int, str]) -> None:
        self.cards += 1
        at = {side: page for page, side in pages}
        self.out.append((self.event, self.cards, at.get("front"), at.get("back"), None))

    def take(self, page: int, side: str) -> None:
        if self.held and self.held[1] != side:
            self._card(self.held, (page, side))
            self.held = None
        else:
            if self.held:
                self._card(self.held)
            self.held = (page, side)
        self.next_page = page + 1

    def end(self) -> None:
        """No page follows for now: what is held stands alone."""
        if self.held:
            self._card(self.held)
            self.held = None

    def late(self, page: int) -> None:
        self.out.append((self.event, None, None, None, page))

    def rows(self) -> pd.DataFrame:
        names = [c.split()[0] for c in CARDS.split(", ")]
        return pd.DataFrame(self.out, columns=names).astype({c: "Int64" for c in names[1:]})


class Pairing(StatefulProcessor):
    """For each event the point reached, the page held for its other side, and pages that came early, one row of state each."""

    def __init__(self, quiet: int, keep: int):
        self.quiet, self.keep = quiet, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.point = handle.getValueState("point", "next_page bigint, cards bigint, held_page bigint, held_side string, total bigint, early bigint, seen bigint")
        self.waiting = handle.getMapState("waiting", "page bigint", "side string")
        self.timers = _Timers(handle, self.quiet, self.keep)

    def _load(self, event: str) -> tuple[Feed, int, int | None]:
        if not self.point.exists():
            return Feed(event), 0, None
        nxt, cards, page, side, total, early, seen = self.point.get()
        return Feed(event, nxt, cards, None if page is None else (page, side), total), early, seen

    def _store(self, feed: Feed, early: int, seen: int) -> None:
        self.point.update((feed.next_page, feed.cards, *(feed.held or (None, None)), feed.total, early, seen))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        feed, early, before = self._load(key[0])
        seen, fresh = before, {}
        for pdf in rows:
            for page, side, total, ms in zip(pdf["page_no"], pdf["side"], pdf["total"], pdf["ms"], strict=True):
                page, seen = int(page), max(seen or 0, int(ms))
                if _number(total) is not None:
                    feed.total = max(feed.total or 0, int(total))
                if page < feed.next_page:
                    feed.late(page)
                else:
                    fresh[page] = side
        while True:
            page = feed.next_page
            if page in fresh:
                side = fresh.pop(page)
                if early and self.waiting.containsKey((page,)):  # sent again
                    self.waiting.removeKey((page,))
                    early -= 1
            elif early and self.waiting.containsKey((page,)):
                side = self.waiting.getValue((page,))[0]
                self.waiting.removeKey((page,))
                early -= 1
            else:
                break
            feed.take(page, side)
        for page, side in fresh.items():
            early += not (early and self.waiting.containsKey((page,)))
            self.waiting.updateValue((page,), (side,))
        if feed.total is not None and feed.next_page > feed.total:
            feed.end()
        self.timers.move(before, seen)
        self._store(feed, early, seen)
        yield feed.rows()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        feed, early, seen = self._load(key[0])
        if seen is not None and expiredTimerInfo.getExpiryTimeInMs() >= seen + self.timers.quiet and (early or feed.held):
            for page, side in sorted((k[0], v[0]) for k, v in self.waiting.iterator()):
                feed.take(page, side)
            feed.end()
            self.waiting.clear()
            self._store(feed, 0, seen)
        if seen is not None and expiredTimerInfo.getExpiryTimeInMs() >= seen + self.timers.keep:
            self.point.clear()
            self.waiting.clear()
        yield feed.rows()

    def close(self) -> None:
        pass


class Numbering(StatefulProcessor):
    """For each event the files that came so far, by their place in natural order, until it is complete."""

    def __init__(self, quiet: int, keep: int):
        self.quiet, self.keep = quiet, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.point = handle.getValueState("point", "files bigint, total bigint, done boolean, seen bigint")
        self.files = handle.getMapState("files", "digits int, number string, file string", "side string")
        self.timers = _Timers(handle, self.quiet, self.keep)

    def _told(self, event: str, rows: list[tuple], total: int | None, ms: int) -> pd.DataFrame:
        out = pd.DataFrame([(event, *r, total) for r in rows], columns=["event", "file", "page_no", "side", "total"])
        out = out.astype({"page_no": "Int64", "total": "Int64"})
        out["ts"] = pd.to_datetime(pd.Series([ms] * len(rows), dtype="int64"), unit="ms")
        return out

    def _complete(self, event: str, ms: int) -> pd.DataFrame:
        files = sorted((k[0], k[1], k[2].encode(), v[0]) for k, v in self.files.iterator())
        self.files.clear()
        return self._told(event, [(f.decode(), n + 1, side) for n, (_, _, f, side) in enumerate(files)], len(files), ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        files, total, done, before = self.point.get() if self.point.exists() else (0, None, False, None)
        seen, late = before, []
        for pdf in rows:
            for file, side, digits, number, announced, ms in zip(*(pdf[c] for c in ("file", "side", "digits", "number", "total", "ms")), strict=True):
                seen = max(seen or 0, int(ms))
                total = total if _number(announced) is None else max(total or 0, int(announced))
                if done:
                    late.append((file, None, side))
                    continue
                files += not self.files.containsKey((int(digits), number, file))
                self.files.updateValue((int(digits), number, file), (side,))
        now = max(seen, timerValues.getCurrentWatermarkInMs())
        if late:
            yield self._told(key[0], late, total, now)
        if not done and total is not None and files >= total:
            done = True
            yield self._complete(key[0], now)
        self.timers.move(before, seen)
        self.point.update((files, total, done, seen))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self.point.exists():
            return
        files, total, done, seen = self.point.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if not done and at >= seen + self.timers.quiet:
            self.point.update((files, total, True, seen))
            yield self._complete(key[0], max(at, timerValues.getCurrentWatermarkInMs()))
        if at >= seen + self.timers.keep:
            self.point.clear()

    def close(self) -> None:
        pass


def _with_state(df: DataFrame) -> DataFrame:
    """State with timers needs the store that holds it on disk; another choice of the session's stays."""
    if "RocksDB" not in (df.sparkSession.conf.get(STORE, None) or ""):
        df.sparkSession.conf.set(STORE, ROCKS)
    return df


def number_stream(files: DataFrame, *, late: str = "10 minutes", quiet_ms: int = QUIET_MS, keep_ms: int = KEEP_MS) -> DataFrame:
    """`(event, file, page_no, side, total, ts)`: a file's place in its event's natural order, once the event is complete.

    `files` is a stream of `(event, file, side, total, ts)`. An event is complete when as many files as its `total` have come, or
    when the watermark is `quiet_ms` past its last. A file that comes later has no page number; its state goes `keep_ms`
    after the last file. Files behind the watermark are dropped and counted by Spark.
    """
    digits = F.regexp_replace(F.regexp_replace("file", r"\D", ""), "^0+", "")
    rows = files.filter(F.col("file").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late)
    rows = rows.select("event", "file", "side", F.length(digits).alias("digits"), digits.alias("number"), F.col("total").cast("bigint").alias("total"), "ts", F.unix_millis("ts").alias("ms"))
    return _with_state(rows).groupBy("event").transformWithStateInPandas(Numbering(quiet_ms, keep_ms), NUMBERED, "Append", "EventTime", eventTimeColumnName="ts")


def pair_stream(pages: DataFrame, *, late: str | None = "10 minutes", quiet_ms: int = QUIET_MS, keep_ms: int = KEEP_MS) -> DataFrame:
    """Cards, and pages that came too late for one, from a stream of `(event, page_no, side, total, ts)`; pages count from 1.

    Pages come in any order and are taken in page order. An event that announces its total is finished with its last page. Where
    pages are missing, those that follow wait, however many, until the watermark is `quiet_ms` past the event's last page; then
    what is missing is taken to be lost. Event time alone decides, so a replay gives the same cards. `keep_ms` after its last
    page an event's state is gone. A row with `late_page` is a page below the point reached: a resend, or one that had been
    taken to be lost. Pages behind the watermark are dropped and counted by Spark (see `progress.LateCounts`); those without a
    number or a time have no place in the order and are left out. `late` is None where `pages` has a watermark already.
    """
    rows = pages.filter(F.col("page_no").isNotNull() & F.col("ts").isNotNull())
    rows = rows.withWatermark("ts", late) if late else rows
    rows = rows.select("event", F.col("page_no").cast("bigint").alias("page_no"), "side", F.col("total").cast("bigint").alias("total"), "ts", F.unix_millis("ts").alias("ms"))
    return _with_state(rows).groupBy("event").transformWithStateInPandas(Pairing(quiet_ms, keep_ms), CARDS, "Append", "EventTime")


def late_counts(paired: DataFrame) -> DataFrame:
    """Late pages of each event: `(event, late)`."""
    return paired.filter(F.col("late_page").isNotNull()).groupBy("event").agg(F.count(F.lit(1)).alias("late"))
