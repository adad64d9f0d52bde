"""Maintained SUM and COUNT group-bys.

Both are linear, so the sum over deltas is the aggregate of the view: one partial and one
final hash aggregation over what changed, in batch and in streaming alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaview.functions.values import truncated
from deltaview.model import WEIGHT


@dataclass(frozen=True)
class WindowSpec:
    column: str
    size_ms: int


@dataclass(frozen=True)
class JoinSpec:
    fact_key: str
    reference_key: str


@dataclass(frozen=True)
class ViewConfig:
    key_columns: tuple[str, ...] = ()
    sum_column: str | None = None
    count: bool = False
    window: WindowSpec | None = None
    join: JoinSpec | None = None


def parse_view(spec: str) -> ViewConfig:
    """`k1,k2:count` or `k1,k2:sum:v`."""
    parts = spec.split(":")
    keys = tuple(k for k in parts[0].split(",") if k)
    if len(parts) == 2 and parts[1] == "count":
        return ViewConfig(keys, count=True)
    if len(parts) == 3 and parts[1] == "sum" and parts[2]:
        return ViewConfig(keys, sum_column=parts[2])
    raise ValueError(f"a view is 'keys:count' or 'keys:sum:column', not {spec!r}")


def weighted(column: str, kind: T.DataType, truncate: bool) -> Column:
    """What a row adds to a sum: nulls and text add nothing; decimals stay exact."""
    value = F.col(column)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return (truncated(value) if truncate else F.coalesce(value, F.lit(0.0))) * F.col(WEIGHT)
    if isinstance(kind, T.NumericType):
        return F.coalesce(value, F.lit(0).cast(kind)) * F.col(WEIGHT)
    return F.lit(0).cast("bigint") * F.col(WEIGHT)


def aggregates(delta: DataFrame, config: ViewConfig, truncate_floats: bool = False, keep_empty: bool = False) -> DataFrame:
    """Key columns, then `sum` and `count` as configured.

    Null keys are one group. Groups without rows are left out, the global group of an empty
    view too; `keep_empty` leaves them in with count 0, as a sink needs it to delete them.
    """
    columns = [F.sum(WEIGHT).alias("_rows")]
    if config.sum_column is not None:
        columns.append(F.sum(weighted(config.sum_column, delta.schema[config.sum_column].dataType, truncate_floats)).alias("sum"))
    grouped = delta.groupBy(*config.key_columns).agg(*columns)
    if not keep_empty:
        grouped = grouped.where(F.col("_rows") != 0)
    out = list(config.key_columns)
    out += ["sum"] if config.sum_column is not None else []
    return grouped.select(*out, *([F.col("_rows").alias("count")] if config.count else []))
