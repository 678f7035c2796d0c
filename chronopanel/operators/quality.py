"""Checks of bars and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bad_ohlc() -> Column:
    """True where a bar contradicts itself; a null price flags nothing by itself."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return F.coalesce((h < lo) | (h < o) | (h < c) | (lo > o) | (lo > c) | (o <= 0) | (c <= 0), F.lit(False))


def is_digits(name: Column) -> Column:
    """True for a name of nothing but digits; False for null."""
    return F.coalesce(F.regexp_like(F.trim(name), F.lit("^[0-9]+$")), F.lit(False))
