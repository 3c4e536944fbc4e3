"""String functions of the engine as native Columns. Only ASCII white space and case count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = r"[ \n\r\t\f]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalize_space(c: Column) -> Column:
    """Runs of white space become one space; none is left at the ends. Not Java's \\s: that has more."""
    return F.trim(F.regexp_replace(c, _WS, " "))


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \n\r\t\f]+|[ \n\r\t\f]+\z", "")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)
