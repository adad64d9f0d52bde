"""Tumbling event-time windows [start, start + size), aligned to 1970-01-01 UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaview.functions.values import iso_to_millis
from deltaview.model import WEIGHT


def event_millis(column: str, kind: T.DataType) -> Column:
    """Event time in milliseconds: integers as they are, timestamps, ISO text; else null."""
    value = F.col(column)
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return value.cast("bigint")
    if isinstance(kind, T.TimestampType):
        return F.unix_millis(value)
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{column}`)")
    return iso_to_millis(value) if isinstance(kind, T.StringType) else F.lit(None).cast("bigint")


def window_start(millis: Column, size_ms: int) -> Column:
    """Floors, for times before 1970 too."""
    return millis - F.pmod(millis, F.lit(size_ms).cast("bigint"))


def assign(rows: DataFrame, column: str, size_ms: int) -> DataFrame:
    """Rows with their window_start and window_end; rows without an event time are left out."""
    millis = event_millis(column, rows.schema[column].dataType)
    start = rows.withColumn("window_start", window_start(millis, size_ms)).where(F.col("window_start").isNotNull())
    return start.withColumn("window_end", F.col("window_start") + size_ms)


def arrival_watermarks(rows: DataFrame, column: str, batch: str, delay_ms: int) -> DataFrame:
    """Rows with `watermark`: the latest event time of earlier batches less the delay, or null.

    One small row per batch is ordered, not the rows themselves.
    """
    millis = event_millis(column, rows.schema[column].dataType)
    latest = rows.groupBy(batch).agg(F.max(millis).alias("_latest"))
    before = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    marks = latest.select(batch, (F.max("_latest").over(before) - delay_ms).alias("watermark"))
    return rows.join(marks, batch, "left")


def split_late(assigned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, late): a row is late if its window had ended at the watermark."""
    late = F.coalesce(F.col("window_end") <= F.col("watermark"), F.lit(False))
    return assigned.where(~late), assigned.where(late)


def late_count(late: DataFrame) -> DataFrame:
    """dropped_late: rows by the size of their weight."""
    weight = F.abs(F.col(WEIGHT)) if WEIGHT in late.columns else F.lit(1)
    return late.agg(F.coalesce(F.sum(weight), F.lit(0)).cast("bigint").alias("dropped_late"))


def closed(per_window: DataFrame, watermark_ms: int | Column) -> DataFrame:
    """Windows that a watermark ends."""
    return per_window.where(F.col("window_end") <= watermark_ms)


def open_(per_window: DataFrame, watermark_ms: int | Column) -> DataFrame:
    return per_window.where(F.col("window_end") > watermark_ms)
