"""Typed values from and to text, as Column expressions that never fail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaview.model import type_of_oid

_INTEGER = r"^[+-]?[0-9]+$"
_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
#: How casts from text read booleans.
TRUE_WORDS, FALSE_WORDS = ("t", "true", "T", "TRUE"), ("f", "false", "F", "FALSE")


def to_long(text: Column) -> Column:
    """A 64-bit integer, or null; white space is no part of a number."""
    return F.when(text.rlike(_INTEGER), text.try_cast("bigint"))


def to_double(text: Column) -> Column:
    return F.when(text.rlike(_FLOAT), text.try_cast("double"))


def to_boolean(text: Column) -> Column:
    return F.when(text.isin(*TRUE_WORDS), F.lit(True)).when(text.isin(*FALSE_WORDS), F.lit(False))


def to_timestamp(text: Column) -> Column:
    """A timestamp from ISO text of a date and a time to the second at least; any offset counts."""
    return F.when(F.trim(text).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}"), F.trim(text).try_cast("timestamp"))


def iso_to_millis(text: Column) -> Column:
    """Milliseconds since 1970-01-01 UTC of ISO text, or null; text without an offset is UTC."""
    bare = F.trim(text)
    zoned = F.when(bare.rlike(r"(Z|[+-][0-9]{2}(:?[0-9]{2})?)$") & bare.rlike(r":[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9:]+)$"), bare).otherwise(F.concat(bare, F.lit("Z")))
    return F.unix_millis(to_timestamp(zoned))


def decode(text: Column, oid: int) -> Column:
    """A source's text value by the type id of its column; null where it does not parse."""
    kind = type_of_oid(oid)
    if isinstance(kind, T.LongType):
        return to_long(text)
    if isinstance(kind, T.DoubleType):
        return to_double(text)
    if isinstance(kind, T.BooleanType):
        return F.when(text == "t", F.lit(True)).when(text == "f", F.lit(False))
    if isinstance(kind, T.TimestampType):
        return to_timestamp(text)
    return text


def render(value: Column, kind: T.DataType) -> Column:
    """Text of a value; whole floats have no fraction, so that 1.0 and 1 meet in a join key."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))
    return value.cast("string")


def cast(value: Column, kind: T.DataType, to: str) -> Column:
    """Cast to int, float, bool or text; null where the value has no such form."""
    text, number = isinstance(kind, T.StringType), isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    real, exact = isinstance(kind, (T.DoubleType, T.FloatType)), isinstance(kind, T.DecimalType)
    if to == "text":
        return render(value, kind)
    if to == "int":
        if exact:
            return F.when(value == F.floor(value), value.try_cast("bigint"))
        return value.cast("bigint") if number else to_long(value) if text else F.lit(None).cast("bigint")
    if to == "float":
        return value.cast("double") if number or real or exact else to_double(value) if text else F.lit(None).cast("double")
    if to == "bool":
        return value if isinstance(kind, T.BooleanType) else to_boolean(value) if text else F.lit(None).cast("boolean")
    raise ValueError(f"unknown cast target {to!r}: int, float, bool or text")


CAST_TYPES = {"int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "text": T.StringType()}


def truncated(value: Column) -> Column:
    """A float cut to a 64-bit integer: saturating, and 0 for NaN and null."""
    top = F.lit(9223372036854775807)
    return (
        F.when(value.isNull() | F.isnan(value), F.lit(0).cast("bigint"))
        .when(value >= F.lit(9.223372036854775807e18), top)
        .when(value <= F.lit(-9.223372036854775808e18), F.lit(-9223372036854775807) - 1)
        .otherwise(value.try_cast("bigint"))
    )
