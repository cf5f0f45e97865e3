"""What streams report: rows, rates, observed counts and the last error of each query, and health by them."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


@dataclass
class Progress:
    """One query so far."""

    name: str | None
    begun: float
    batches: int = 0
    rows: int = 0
    rows_a_second: float = 0.0
    observed: Counter = field(default_factory=Counter)
    told_at: float = 0.0
    ended: bool = False
    error: str | None = None


class Watch(StreamingQueryListener):
    """Keeps the progress of all queries of a session. What Spark tells of a query that is idle counts as a sign of life."""

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.clock = clock
        self.queries: dict[str, Progress] = {}

    def of(self, query: StreamingQuery | str) -> Progress | None:
        return self.queries.get(str(query if isinstance(query, str) else query.runId))

    def onQueryStarted(self, event) -> None:
        self.queries[str(event.runId)] = Progress(event.name, self.clock(), told_at=self.clock())

    def onQueryProgress(self, event) -> None:
        told, now = event.progress, self.clock()
        one = self.queries.setdefault(str(told.runId), Progress(told.name, now))
        one.told_at = now
        if told.numInputRows:
            one.batches += 1
            one.rows += told.numInputRows
            one.rows_a_second = told.processedRowsPerSecond or 0.0
        for name, row in (told.observedMetrics or {}).items():
            one.observed.update({f"{name}.{k}": v for k, v in row.asDict().items() if isinstance(v, int)})

    def onQueryIdle(self, event) -> None:
        if one := self.queries.get(str(event.runId)):
            one.told_at = self.clock()

    def onQueryTerminated(self, event) -> None:
        if one := self.queries.get(str(event.runId)):
            one.ended, one.error = True, event.exception

    def health(self, query: StreamingQuery | str, silent_s: float = 300) -> str:
        """unknown, failed, ended, stalled (no sign of life for silent_s) or running."""
        one = self.of(query)
        if one is None:
            return "unknown"
        if one.ended:
            return "failed" if one.error else "ended"
        return "stalled" if self.clock() - one.told_at > silent_s else "running"

    def rate(self, query: StreamingQuery | str) -> float:
        """Rows a second since the query began."""
        one = self.of(query)
        return one.rows / max(1e-9, one.told_at - one.begun) if one and one.rows else 0.0


def watch(spark: SparkSession, clock: Callable[[], float] = time.monotonic) -> Watch:
    """A Watch that is added to the session; spark.streams.removeListener() takes it off again."""
    out = Watch(clock)
    spark.streams.addListener(out)
    return out
