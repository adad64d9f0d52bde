"""A windowed view kept by batches, with an exact watermark.

Spark's own watermark filters late rows by the mark of the batch before the last; here a
batch is filtered by the mark that all earlier batches set, retractions go to the window of
the row they take back, and windows come out once, when the mark passes their end.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaview.operators import views, windows, zset
from deltaview.streaming import files
from deltaview.streaming.metrics import Metrics


class WindowedView:
    """State lies in `path`: open windows, closed windows by batch, and `mark.json`, which is
    replaced last, so that a batch that fails is done again from the state before it. A truncate
    empties the open windows; closed ones have been delivered and stay. `metrics` counts late rows."""

    def __init__(self, path: str, config: views.ViewConfig, delay_ms: int, spark: SparkSession | None = None, metrics: Metrics | None = None):
        self.path, self.config, self.delay, self.metrics = path.rstrip("/"), config, delay_ms, metrics
        spark = spark or SparkSession.getActiveSession()
        self.state: dict[str, Any] = files.load(spark, f"{self.path}/mark.json") or {"watermark": None, "dropped_late": 0, "open": None, "batch": -1}

    def _sums(self, rows: DataFrame) -> DataFrame:
        columns = [F.sum("count").alias("count")] + ([F.sum("sum").alias("sum")] if self.config.sum_column else [])
        return rows.groupBy("window_start", "window_end", *self.config.key_columns).agg(*columns)

    def write(self, changes: DataFrame, batch_id: int) -> None:
        if batch_id <= self.state["batch"]:
            return
        spec, mark = self.config.window, self.state["watermark"]
        emptied = not changes.where("op = 'T'").isEmpty()
        rows = windows.assign(zset.delta(zset.since_truncate(changes)), spec.column, spec.size_ms).withColumn("watermark", F.lit(mark).cast("bigint")).persist()
        kept, late = windows.split_late(rows)
        dropped = windows.late_count(late).head()["dropped_late"]
        latest = rows.agg(F.max(windows.event_millis(spec.column, rows.schema[spec.column].dataType)).alias("m")).head()["m"]
        columns = [F.col("w").alias("count")]
        if self.config.sum_column:
            columns.append(views.weighted(self.config.sum_column, rows.schema[self.config.sum_column].dataType, False).alias("sum"))
        added = kept.select("window_start", "window_end", *self.config.key_columns, *columns)
        if self.state["open"] and not emptied:
            added = added.unionByName(changes.sparkSession.read.parquet(self.state["open"]))
        new = max([x for x in (mark, None if latest is None else latest - self.delay) if x is not None], default=None)
        sums = self._sums(added).persist()
        now = f"{self.path}/open/batch={batch_id}"
        windows.open_(sums, new if new is not None else -(2**62)).write.mode("overwrite").parquet(now)
        if new is not None:
            windows.closed(sums, new).where("count <> 0").write.mode("overwrite").parquet(f"{self.path}/closed/batch={batch_id}")
        sums.unpersist()
        rows.unpersist()
        before = self.state["open"] if self.state["open"] != now else None
        self.state = {"watermark": new, "dropped_late": self.state["dropped_late"] + dropped, "open": now, "batch": batch_id}
        files.save(changes.sparkSession, f"{self.path}/mark.json", self.state)
        if before:
            files.remove(changes.sparkSession, before)
        if self.metrics is not None:
            self.metrics.add("late", dropped)

    def open_windows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.state["open"]).where("count <> 0")

    def closed_windows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/closed").drop("batch")
