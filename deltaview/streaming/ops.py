"""Heartbeats and lag reports on a connection of their own, beside a running pipeline."""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import Any

from deltaview.functions.lsn import lsn_of
from deltaview.streaming.metrics import Lag, Metrics

#: Seconds between heartbeats, and before a lost connection is opened again.
INTERVAL, RETRY = 10.0, 5.0


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def emit_heartbeat(connection: Any) -> None:
    """Write a transactional message to the log, so that an idle source's position moves."""
    cursor = connection.cursor()
    cursor.execute("SELECT pg_logical_emit_message(true, 'deltaview', 'heartbeat')")
    cursor.fetchall()
    connection.commit()


def slot_lag(connection: Any, slot: str) -> Lag | None:
    """How far an active slot is behind; None if it isn't there or isn't active."""
    cursor = connection.cursor()
    cursor.execute(f"SELECT CAST(confirmed_flush_lsn AS text), CAST(pg_current_wal_lsn() AS text) FROM pg_replication_slots WHERE slot_name = {_quoted(slot)} AND active")
    row = cursor.fetchone()
    connection.commit()
    return None if row is None else Lag(lsn_of(row[0]), lsn_of(row[1]))


class OpsLoop(threading.Thread):
    """Every `interval` seconds a heartbeat and a lag report; `connect` gives a DB-API connection and
    is called again `retry` seconds after a failure. Ends soon after stop()."""

    def __init__(self, connect: Callable[[], Any], slot: str, metrics: Metrics, report: Callable[[str], Any] = print, interval: float = INTERVAL, retry: float = RETRY):
        super().__init__(daemon=True)
        self.connect, self.slot, self.metrics, self.report, self.interval, self.retry = connect, slot, metrics, report, interval, retry
        self.ended = threading.Event()
        self.lag: Lag | None = None

    def run(self) -> None:
        while not self.ended.is_set():
            try:
                connection = self.connect()
                while not self.ended.is_set():
                    emit_heartbeat(connection)
                    self.lag = slot_lag(connection, self.slot)
                    self.report("slot not active" if self.lag is None else f"lag_bytes={self.lag.bytes} confirmed={self.lag.confirmed_lsn} {self.metrics.snapshot()}")
                    self.ended.wait(self.interval)
                connection.close()
            except Exception as e:  # whatever the driver raises: the pipeline goes on without reports
                self.report(f"ops connection failed: {e}")
                self.ended.wait(self.retry)

    def stop(self) -> None:
        self.ended.set()
        self.join()
