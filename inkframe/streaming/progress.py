"""What a running stream has read, dropped behind its watermark and told late, for each query."""

from __future__ import annotations

import threading
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def watch_pairing(paired: DataFrame, name: str = "pairing") -> DataFrame:
    """Cards as they are, with their number and that of late pages as metrics of every batch."""
    late = F.count(F.when(F.col("late_page").isNotNull(), 1))
    return paired.observe(name, F.count("card_no").alias("cards"), late.alias("late_pages"))


def watch_numbering(numbered: DataFrame, name: str = "numbering") -> DataFrame:
    """Numbered files as they are, with their number and that of files that came after their event was complete."""
    late = F.count(F.when(F.col("page_no").isNull(), 1))
    return numbered.observe(name, F.count("page_no").alias("pages"), late.alias("late_files"))


class LateCounts(StreamingQueryListener):
    """Sums over all batches of each query, by its id: rows read, rows dropped behind the watermark, state rows, and every observed metric.

    A query that is restarted from its checkpoint keeps its id, so its sums go on.
    """

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._sums: dict[str, Counter] = defaultdict(Counter)
        self._state: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self._lock:
            own = self._sums[str(p.id)]
            own["rows"] += p.numInputRows
            own["dropped_by_watermark"] += sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
            for name, row in p.observedMetrics.items():
                own.update({f"{name}.{k}": v for k, v in row.asDict().items()})
            self._state[str(p.id)] = sum(o.numRowsTotal for o in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def of(self, query_id: str) -> dict[str, int]:
        """The sums of one query so far, and the state rows that it holds now."""
        with self._lock:
            return {**self._sums[str(query_id)], "state_rows": self._state.get(str(query_id), 0)}
