"""Column expressions that bring noisy keys to one notation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ISO text and day number of the date that stands for "open".
OPEN_TEXT = "9999-12-31"
OPEN_DAY = 2932896


def ticker_key(c: Column | str) -> Column:
    """Upper case without anything but A-Z and 0-9; null when nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""), F.lit(""))


def source_key(c: Column | str) -> Column:
    """A source's name without case and spacing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(c), r"\s+", "")


def open_end(c: Column | str) -> Column:
    """Null for an end that is open (null or the open date), else the end."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c < F.lit(OPEN_TEXT).cast("date"), c)


def is_real(c: Column | str) -> Column:
    """True for a double that is neither null nor NaN; never null."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c)
