"""The pipeline over a stream of changes: drop replays, apply the plan, deliver, then record
the position. Delivery is at least once; a batch never splits a transaction (its source ends
batches on commits)."""

from __future__ import annotations

import json
import os
import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from deltaview.operators import log, refjoin, views, windows, zset
from deltaview.plans import compiler
from deltaview.plans.document import Plan
from deltaview.sinks import sinks
from deltaview.sinks.sinks import Sink
from deltaview.sources import readers
from deltaview.sources.pgoutput import Column, Relation
from deltaview.streaming import files
from deltaview.streaming.drift import Drift, DriftDetector
from deltaview.streaming.metrics import Metrics

VERSION = 1


class Checkpoint:
    """The last delivered commit position and some JSON state, replaced in one step. With a session
    the file is on any file system that Spark knows, else it is a local one."""

    def __init__(self, path: str, spark: SparkSession | None = None):
        self.path, self.spark = path, spark
        self.lsn, self.state = 0, {}
        if spark is not None:
            held = files.load(spark, path)
        else:
            try:
                with open(path, encoding="utf-8") as f:
                    held = json.load(f)
            except FileNotFoundError:
                held = None
        if held is None:
            return
        if held.get("version") != VERSION:
            raise ValueError(f"checkpoint of version {held.get('version')}, not {VERSION}")
        self.lsn, self.state = held["lsn"], held["state"]

    def advance(self, lsn: int, state: dict | None = None) -> None:
        self.lsn, self.state = lsn, self.state if state is None else state
        value = {"version": VERSION, "lsn": self.lsn, "state": self.state}
        if self.spark is not None:
            files.save(self.spark, self.path, value)
            return
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        with open(f"{self.path}.tmp", "w", encoding="utf-8") as f:
            json.dump(value, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{self.path}.tmp", self.path)


@dataclass
class Engine:
    """One table's pipeline. `process` handles a batch of whole transactions: replays go, the plan
    is applied, the sink and then the view behind the plan take the result, and the position is
    recorded. A view that has taken a batch in skips it when it comes again."""

    table: str
    plan: Plan
    sink: Sink
    checkpoint: Checkpoint
    view: Sink | None = None
    metrics: Metrics = field(default_factory=Metrics)

    def process(self, changes: DataFrame, batch_id: int) -> None:
        self.deliver(changes, batch_id, self.checkpoint.advance)

    def deliver(self, changes: DataFrame, batch_id: int, advance: Callable[[int], None]) -> None:
        changes = changes.persist()
        try:
            fresh = log.without_replays(changes, self.checkpoint.lsn)
            txn = lambda df: df.agg(F.count_distinct("commit_lsn").alias("txns"), F.count("*").alias("changes"), F.max("commit_lsn").alias("last")).head()
            seen, kept = txn(changes), txn(fresh)
            self.metrics.add("deduped", seen["txns"] - kept["txns"])
            if not kept["changes"]:
                return
            self.metrics.add("txns", kept["txns"])
            self.metrics.add("changes", kept["changes"])
            shaped = compiler.apply(log.resolved(fresh), self.plan.tables.get(self.table, []))
            try:
                self.sink.write(shaped, batch_id)
                if self.view is not None:
                    self.view.write(shaped, batch_id)
            except Exception:
                self.metrics.add("sink_errors")
                raise
            advance(max(self.checkpoint.lsn, kept["last"]))
            self.metrics.add("acked", kept["txns"])
        finally:
            changes.unpersist()

    def start(self, stream: DataFrame, location: str, **trigger) -> StreamingQuery:
        """Runs until stopped, or until the input ends with trigger availableNow=True."""
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", location)
        return (writer.trigger(**trigger) if trigger else writer).start()


class JoinedView:
    """A view of facts joined to a reference table that changes, too, both kept in `path`.

    Of a batch, the reference's changes are taken in before the facts; a fact is joined once, as it
    comes, to the reference of that time, and retracted in the same way."""

    def __init__(self, path: str, join: views.JoinSpec):
        self.join, self.reference = join, sinks.ViewTableSink(f"{path}/reference")
        self.rows = sinks.ViewTableSink(f"{path}/rows", shape=self._joined)

    def _joined(self, delta: DataFrame) -> DataFrame:
        reference = self.reference.read(delta.sparkSession)
        return delta if reference is None else refjoin.join_current(delta, reference, self.join.fact_key, self.join.reference_key)

    def apply_reference(self, changes: DataFrame, batch_id: int) -> None:
        self.reference.write(changes, batch_id)

    def write(self, changes: DataFrame, batch_id: int) -> None:
        self.rows.write(changes, batch_id)

    def read(self, spark: SparkSession) -> DataFrame | None:
        return self.rows.read(spark)

    def reference_len(self, spark: SparkSession) -> int:
        held = self.reference.read(spark)
        return 0 if held is None else refjoin.reference_len(held)


def view_aggregates(rows: DataFrame, config: views.ViewConfig) -> DataFrame:
    """SUM and COUNT of a kept view's rows, by window too if the view has one."""
    if config.window is None:
        return views.aggregates(rows, config)
    framed = windows.assign(rows, config.window.column, config.window.size_ms)
    return views.aggregates(framed, views.ViewConfig(("window_start", "window_end", *config.key_columns), config.sum_column, config.count))


class Runner:
    """All tables of one replication log, behind one position.

    A batch's relation definitions go to the drift detector, whose state is kept with the position;
    reference tables are taken in first, then each engine delivers its table, then the
    position moves to the batch's end. Heartbeats move it, too. `stop` ends the query
    between two batches, which is between two transactions.
    """

    def __init__(self, engines: dict[str, tuple[Relation, Engine]], checkpoint: Checkpoint, references: dict[str, tuple[Relation, JoinedView]] | None = None, metrics: Metrics | None = None):
        self.engines, self.references, self.checkpoint, self.metrics = engines, references or {}, checkpoint, metrics or Metrics()
        self.detector = DriftDetector(checkpoint.state.get("drift", "{}"))
        self.drifts: list[Drift] = []
        self.busy, self.stopping = threading.Lock(), threading.Event()

    def process(self, raw: DataFrame, batch_id: int) -> None:
        with self.busy:
            if self.stopping.is_set():
                raise Stopped
            raw = raw.persist()
            try:
                fresh = (F.col("commit_lsn") > self.checkpoint.lsn) & (F.col("op") == "R")
                # One row for each definition that the batch holds.
                for r in raw.where(fresh).select("relation_id", "namespace", "table", "unchanged").orderBy("commit_lsn", "lsn").collect():
                    columns = (c.rsplit(":", 1) for c in r["unchanged"])
                    drift = self.detector.observe(Relation(r["relation_id"], r["namespace"], r["table"], tuple(Column(n, int(o)) for n, o in columns)))
                    if drift is not None:
                        self.drifts.append(drift)
                        self.metrics.add("drift")
                for relation, view in self.references.values():
                    view.apply_reference(log.resolved(readers.typed(raw, relation)), batch_id)
                for relation, engine in self.engines.values():
                    engine.deliver(readers.typed(raw, relation), batch_id, lambda lsn: None)
                last = raw.agg(F.max("commit_lsn")).head()[0]
                if last is not None:
                    self.checkpoint.advance(max(self.checkpoint.lsn, last), self.checkpoint.state | {"drift": self.detector.state()})
            finally:
                raw.unpersist()

    def start(self, raw: DataFrame, location: str, **trigger) -> StreamingQuery:
        writer = raw.writeStream.foreachBatch(self.process).option("checkpointLocation", location)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def stop(self, query: StreamingQuery) -> None:
        """End the query once the batch that runs is delivered; a later one does nothing."""
        self.stopping.set()
        with self.busy:
            query.stop()


class Stopped(RuntimeError):
    """A batch that came after the stop; it is delivered when the stream runs again."""


def stream_view(changes: DataFrame, config: views.ViewConfig) -> DataFrame:
    """The view's aggregates over a stream of changes, for update or complete mode. Groups
    whose count is 0 come out, too, so that a sink can delete them. A streaming aggregation can't
    take back groups at a truncate: for tables that are truncated, keep a ViewTableSink."""
    return views.aggregates(zset.delta(changes), config, keep_empty=True)


def stream_windows(changes: DataFrame, config: views.ViewConfig, delay: str) -> DataFrame:
    """The view's aggregates by window over a stream, behind a watermark; in append mode a
    window comes out once it is closed. Its event-time column has to be a timestamp."""
    rows = zset.delta(changes).withColumn("_ts", F.col(config.window.column).cast("timestamp"))
    rows = rows.withWatermark("_ts", delay)
    frame = F.window("_ts", f"{config.window.size_ms} milliseconds").alias("window")
    sums = [F.sum("w").alias("count")]
    if config.sum_column:
        kind = rows.schema[config.sum_column].dataType
        sums.append(F.sum(views.weighted(config.sum_column, kind, False)).alias("sum"))
    return rows.groupBy(frame, *config.key_columns).agg(*sums)


def batch_windows(changes: DataFrame, config: views.ViewConfig) -> DataFrame:
    """The same by batch, per window: window_start, window_end, keys, sum, count."""
    rows = windows.assign(zset.delta(changes), config.window.column, config.window.size_ms)
    keyed = views.ViewConfig(("window_start", "window_end", *config.key_columns), config.sum_column, True)
    return views.aggregates(rows, keyed)
