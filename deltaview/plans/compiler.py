"""Plans compiled to DataFrame -> DataFrame functions over one table's change log.

Every operator works on both images, so that what a change takes back is what an earlier
one put in. All of it is Column expressions: projections collapse into one, and the filter
reaches the scan. Works on batches and on streams.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaview.functions.values import CAST_TYPES, cast
from deltaview.model import DELETE, INSERT, TRUNCATE, UPDATE
from deltaview.plans import mapexpr, predicates
from deltaview.plans.document import Cast, Filter, Map, Operator, Plan, PlanError, Redact, Rename, Select

REDACTED = "***"
_INTEGERS = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)


def _image(df: DataFrame) -> T.StructType:
    return df.schema["after"].dataType


def _rebuilt(df: DataFrame, fields: Callable[[str, T.StructType], list[Column]]) -> DataFrame:
    """Both images made anew from their fields; an image that is null stays null."""
    schema = _image(df)
    return df.withColumns({i: F.when(F.col(i).isNotNull(), F.struct(*fields(i, schema))) for i in ("before", "after")})


def _select(df: DataFrame, op: Select) -> DataFrame:
    """The named columns in the order of the source; unknown names are left out."""
    return _rebuilt(df, lambda i, s: [F.col(i)[n].alias(n) for n in s.names if n in op.columns])


def _rename(df: DataFrame, op: Rename) -> DataFrame:
    names = [op.names.get(n, n) for n in _image(df).names]
    if len(set(names)) < len(names):
        raise PlanError(f"rename makes a name twice: {', '.join(names)}")
    return _rebuilt(df, lambda i, s: [F.col(i)[n].alias(op.names.get(n, n)) for n in s.names])


def _cast(df: DataFrame, op: Cast) -> DataFrame:
    return _rebuilt(df, lambda i, s: [(cast(F.col(i)[f.name], f.dataType, op.to).cast(CAST_TYPES[op.to]) if f.name == op.column else F.col(i)[f.name]).alias(f.name) for f in s.fields])


def _map(df: DataFrame, op: Map) -> DataFrame:
    """The column's new value; where the expression has none, the old one if it is an integer."""

    def fields(i: str, s: T.StructType) -> list[Column]:
        integer = lambda n: F.col(i)[n] if n in s.names and isinstance(s[n].dataType, _INTEGERS) else None
        made, old = mapexpr.compile_expr(op.expr, integer), integer(op.column)
        made = (made if old is None else F.coalesce(made, old.cast("bigint"))).alias(op.column)
        kept = [made if n == op.column else F.col(i)[n].alias(n) for n in s.names]
        return kept if op.column in s.names else [*kept, made]

    return _rebuilt(df, fields)


def _redact(df: DataFrame, op: Redact) -> DataFrame:
    return _rebuilt(df, lambda i, s: [(F.lit(REDACTED) if n in op.columns else F.col(i)[n]).alias(n) for n in s.names])


def _filter(df: DataFrame, op: Filter, mixed_is_true: bool) -> DataFrame:
    """Rows that enter become inserts, rows that leave become deletes, rows that were never in
    go. Truncates pass."""
    schema = _image(df)

    def match(i: str) -> Column:
        column = lambda n: (F.col(i)[n], schema[n].dataType) if n in schema.names else None
        return F.col(i).isNotNull() & predicates.compile_predicate(op.predicate, column, mixed_is_true)

    before, after, truncate = match("before"), match("after"), F.col("op") == TRUNCATE
    # An insert's before image and a delete's after image, if a source sends them, mean nothing.
    before, after = before & (F.col("op") != INSERT), after & (F.col("op") != DELETE)
    out = df.where(truncate | before | after)
    kind = F.when(truncate, TRUNCATE).when(before & after, UPDATE).when(after, INSERT).otherwise(DELETE)
    null = F.lit(None).cast(schema)
    return out.select(*(kind.alias("op") if c == "op" else F.when(before, F.col("before")).otherwise(null).alias("before") if c == "before" else F.when(after, F.col("after")).otherwise(null).alias("after") if c == "after" else F.col(c) for c in df.columns))


def step(op: Operator, mixed_is_true: bool = False) -> Callable[[DataFrame], DataFrame]:
    """One operator as a function of a change log."""
    if isinstance(op, Filter):
        return lambda df: _filter(df, op, mixed_is_true)
    return lambda df: {Select: _select, Rename: _rename, Cast: _cast, Map: _map, Redact: _redact}[type(op)](df, op)


def apply(changes: DataFrame, ops: list[Operator], mixed_is_true: bool = False) -> DataFrame:
    """Operators from left to right."""
    return reduce(lambda df, op: df.transform(step(op, mixed_is_true)), ops, changes)


def compile_plan(plan: Plan, mixed_is_true: bool = False) -> Callable[[str, DataFrame], DataFrame]:
    """(`namespace.table`, its changes) -> changes; tables without operators pass through."""
    return lambda table, changes: apply(changes, plan.tables.get(table, []), mixed_is_true)


def on_rows(rows: DataFrame, ops: list[Operator], mixed_is_true: bool = False) -> DataFrame:
    """Operators over plain rows, each taken as an insert."""
    image = F.struct(*(F.col(c) for c in rows.columns))
    log = rows.select(F.lit(INSERT).alias("op"), F.lit(None).cast(rows.schema).alias("before"), image.alias("after"))
    return apply(log, ops, mixed_is_true).select("after.*")


def describe(plan: Plan) -> str:
    """What `plan check` prints."""
    if not plan.tables:
        return "plan OK (no tables; everything passes through)"
    lines = []
    for table, ops in plan.tables.items():
        lines += [f"{table}:", *(f"  - {op}" for op in ops)]
    lines += [f"key {table}: [{', '.join(keys)}]" for table, keys in plan.keys.items()]
    return "\n".join([*lines, f"plan OK ({len(plan.tables)} table(s))"])
