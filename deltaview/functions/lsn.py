"""Log positions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_FORM = r"^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$"


def parse_lsn(text: Column) -> Column:
    """`high/low` in hexadecimal as one bigint; 0 if malformed."""
    half = lambda i: F.conv(F.split_part(text, F.lit("/"), F.lit(i)), 16, 10).cast("bigint")
    return F.when(text.rlike(_FORM), half(1) * 4294967296 + half(2)).otherwise(F.lit(0).cast("bigint"))


def lsn_of(text: str) -> int:
    if not re.match(_FORM, text):
        return 0
    high, low = text.split("/")
    return int(high, 16) << 32 | int(low, 16)


def format_lsn(lsn: int) -> str:
    return f"{lsn >> 32:X}/{lsn & 0xFFFFFFFF:X}"
