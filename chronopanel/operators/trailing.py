"""Bounded trailing windows over a series; too few rows or a null within give null."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series() -> WindowSpec:
    """A security's rows in date order; a function, as a window needs a session."""
    return Window.partitionBy("security_id").orderBy("date")


#: Rows after which running sums start anew; no window may be longer.
CHUNK = 256


def cumulated(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """df with, for each name, running counts, sums and sums of squares of a value's finite rows.

    Every trailing mean, deviation or count is then a difference of two rows.
    A frame of its own per window would be summed anew at every row, n rows
    each; this is one pass whatever the windows' lengths. NaN and infinite
    values count as null. Sums start anew every CHUNK rows, so that an extreme
    value costs later windows no digits once its chunk is over.
    """
    chunk = Window.partitionBy("security_id", "_chunk")
    upto = chunk.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    whole = chunk.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    finite = lambda v: F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    out = df.select("*", *[finite(v.cast("double")).alias(f"_v_{k}") for k, v in values.items()], F.floor((F.row_number().over(series()) - 1) / CHUNK).alias("_chunk"))
    cols = []
    for k in values:
        v = F.col(f"_v_{k}")
        for kind, x in (("n", F.when(v.isNotNull(), 1).otherwise(0)), ("s", F.coalesce(v, F.lit(0.0))), ("q", F.coalesce(v * v, F.lit(0.0)))):
            cols += [F.sum(x).over(upto).alias(f"_{kind}_{k}"), F.sum(x).over(whole).alias(f"_{kind}t_{k}")]
    return out.select("*", *cols)


def _last(kind: str, name: str, n: int) -> Column:
    """The sum over the last n rows: within a chunk a difference, else what this chunk and the end of the one before hold."""
    if n > CHUNK:
        raise ValueError(f"a window of {n} rows is longer than {CHUNK}")
    c, w = f"_{kind}_{name}", series()
    before = F.coalesce(F.lag(f"_{kind}t_{name}", n).over(w), F.lit(0))
    crossed = F.lag("_chunk", n).over(w) < F.col("_chunk")
    # rows of the first chunk less than n rows in have nothing to take off; later ones the rest of the chunk before
    return F.col(c) - F.coalesce(F.lag(c, n).over(w), F.lit(0)) + F.when(crossed, before).otherwise(F.lit(0))


def count(name: str, n: int) -> Column:
    """Non-null values among the last n rows of a cumulated name."""
    return _last("n", name, n)


def mean(name: str, n: int) -> Column:
    """Mean of the last n rows, if all n have the value."""
    return F.when(count(name, n) == n, _last("s", name, n) / n)


def deviation(name: str, n: int) -> Column:
    """Sample deviation of the non-null values among the last n rows; null for fewer than two."""
    k, s, q = count(name, n), _last("s", name, n), _last("q", name, n)
    return F.when(k >= 2, F.sqrt(F.greatest(F.lit(0.0), (q - s * s / k) / (k - 1))))


def return_between(close: str, end: int, window: int) -> Column:
    """close `end` rows ago over close `end + window` rows ago, less 1; null on a zero or missing one."""
    start = F.lag(close, end + window).over(series())
    last = F.lag(close, end).over(series()) if end else F.col(close)
    return F.when(start != 0, last / start - 1)


def daily_return(close: str) -> Column:
    before = F.lag(close, 1).over(series())
    return F.when(before != 0, F.col(close) / before - 1)


def drawdown(closes: Column) -> Column:
    """Least (c - running peak) / peak over an array of values in time order."""
    start = F.struct(F.lit(None).cast("double").alias("peak"), F.lit(0.0).alias("dd"))

    def step(acc: Column, c: Column) -> Column:
        peak = F.greatest(F.coalesce(acc["peak"], c), c)
        return F.struct(peak.alias("peak"), F.least(acc["dd"], F.when(peak > 0, (c - peak) / peak).otherwise(F.lit(0.0))).alias("dd"))

    return F.aggregate(closes, start, step, lambda a: a["dd"])
