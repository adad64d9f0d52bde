"""Counters of a running pipeline, and its lag."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

from pyspark.sql.streaming import StreamingQueryListener

#: The counters, in the order of the one-line snapshot.
COUNTERS = ("txns", "changes", "acked", "deduped", "sink_errors", "late", "drift")


@dataclass
class Metrics:
    values: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTERS, 0))
    lock: threading.Lock = field(default_factory=threading.Lock)

    def add(self, name: str, n: int = 1) -> None:
        with self.lock:
            self.values[name] += n

    def __getitem__(self, name: str) -> int:
        return self.values[name]

    def snapshot(self) -> str:
        return " ".join(f"{k}={v}" for k, v in self.values.items())


class LateRows(StreamingQueryListener):
    """Adds rows that stateful operators dropped behind the watermark to `late`."""

    def __init__(self, metrics: Metrics):
        self.metrics = metrics

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.metrics.add("late", sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators))

    def onQueryTerminated(self, event) -> None:
        pass


@dataclass(frozen=True)
class Lag:
    confirmed_lsn: int
    current_lsn: int

    @property
    def bytes(self) -> int:
        return self.current_lsn - self.confirmed_lsn
