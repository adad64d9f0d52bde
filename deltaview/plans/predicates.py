"""Filter predicates: a column against a literal, and, or, not; always true or false.

A comparison is less, equal, greater or mixed (null on either side, or types that have no
order). Mixed is false for every operator, or, with mixed_is_true, true for ne, le and ge.
A column that does not exist makes every comparison false.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaview.functions.values import to_double

OPERATORS = ("eq", "ne", "lt", "gt", "le", "ge")
_INTEGERS = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)


@dataclass(frozen=True)
class Compare:
    op: str
    column: str
    value: Any

    def __str__(self) -> str:
        return f"{self.column} {self.op} {self.value!r}"


@dataclass(frozen=True)
class All:
    exprs: tuple[Predicate, ...]

    def __str__(self) -> str:
        return "(" + " and ".join(map(str, self.exprs)) + ")"


@dataclass(frozen=True)
class Any_:
    exprs: tuple[Predicate, ...]

    def __str__(self) -> str:
        return "(" + " or ".join(map(str, self.exprs)) + ")"


@dataclass(frozen=True)
class Not:
    expr: Predicate

    def __str__(self) -> str:
        return f"not {self.expr}"


Predicate = Compare | All | Any_ | Not


def parse(spec: dict[str, Any]) -> Predicate:
    op = spec["op"]
    if op in OPERATORS:
        return Compare(op, spec["column"], spec["value"])
    if op in ("and", "or"):
        return (All if op == "and" else Any_)(tuple(parse(e) for e in spec["exprs"]))
    if op == "not":
        return Not(parse(spec["expr"]))
    raise ValueError(f"unknown filter operator {op!r}")


def _three_way(left: Column, right: Column) -> Column:
    return F.when(left < right, -1).when(left > right, 1).when(left == right, 0)


def _order(value: Column, kind: T.DataType, literal: Any) -> Column:
    """-1, 0, 1, or null for mixed."""
    mixed = F.lit(None).cast("int")
    number = isinstance(literal, (int, float)) and not isinstance(literal, bool)
    if isinstance(kind, _INTEGERS):
        whole = isinstance(literal, int) and -(2**63) <= literal < 2**63
        return _three_way(value, F.lit(int(literal))) if whole else mixed
    if isinstance(kind, (T.DoubleType, T.FloatType)) and number:
        known = F.when(F.isnan(value), 0).otherwise(_three_way(value, F.lit(float(literal))))
        return F.when(value.isNotNull(), known)
    if isinstance(kind, T.DecimalType):
        if number:
            return _three_way(value, F.lit(literal))
        return _three_way(value.cast("decimal(38,9)"), F.lit(literal).try_cast("decimal(38,9)")) if isinstance(literal, str) else mixed
    if isinstance(kind, T.BooleanType) and isinstance(literal, bool):
        return F.when(value == F.lit(literal), 0)
    if isinstance(kind, T.StringType):
        if isinstance(literal, str):
            return _three_way(value, F.lit(literal))
        if number:
            parsed = to_double(value)
            return F.when(F.isnan(parsed), 0).otherwise(_three_way(parsed, F.lit(float(literal))))
    return mixed


def compile_predicate(p: Predicate, column: Callable[[str], tuple[Column, T.DataType] | None], mixed_is_true: bool = False) -> Column:
    """The predicate as a Column that is never null. `column` gives a column and its type."""
    inner = lambda e: compile_predicate(e, column, mixed_is_true)
    if isinstance(p, All):
        return reduce(lambda a, b: a & b, map(inner, p.exprs), F.lit(True))
    if isinstance(p, Any_):
        return reduce(lambda a, b: a | b, map(inner, p.exprs), F.lit(False))
    if isinstance(p, Not):
        return ~inner(p.expr)
    found = column(p.column)
    if found is None:
        return F.lit(False)
    value, kind = found
    c = _order(value, kind, p.value)
    if p.op in ("eq", "lt", "gt"):
        return F.coalesce({"eq": c == 0, "lt": c < 0, "gt": c > 0}[p.op], F.lit(False))
    if p.op == "ne" and isinstance(kind, T.BooleanType) and isinstance(p.value, bool):
        return F.coalesce(value != F.lit(p.value), F.lit(mixed_is_true))
    return F.coalesce({"ne": c != 0, "le": c <= 0, "ge": c >= 0}[p.op], F.lit(mixed_is_true))
