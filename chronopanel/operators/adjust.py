"""Reverse-cumulative adjustment factors of splits and dividends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.operators.asof import asof_backward

#: Share counts of ordinary splits; a ratio within the tolerance of one, or of its reciprocal, is genuine. Fixed values.
SPLIT_RATIOS = (1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 10.0, 15.0, 20.0, 25.0, 50.0, 100.0)
SPLIT_TOLERANCE = 0.03


def split_kind(ratio: Column) -> Column:
    """'genuine' or 'likely_spinoff_artifact' by nearness to an ordinary ratio; null for null."""
    near = None
    for r in SPLIT_RATIOS:
        for c in (r, 1 / r):
            hit = F.abs(ratio - F.lit(c)) / F.lit(c) <= SPLIT_TOLERANCE
            near = hit if near is None else near | hit
    return F.when(ratio.isNull(), None).when(near, "genuine").otherwise("likely_spinoff_artifact")


def later_product(bars: DataFrame, events: DataFrame, key: str, date: str, event_date: str, factor: str, name: str) -> DataFrame:
    """bars with `name`: the product of the factors of all events after the bar's date, 1 without any.

    Events are multiplied per key and date before the shuffle, then united with
    the bars and accumulated from the last date back: one sort per key, no range
    join, whether or not an event falls on a session.
    """
    per_day = events.where(F.col(factor).isNotNull() & F.col(event_date).isNotNull()).groupBy(key, F.col(event_date).alias("_d")).agg(F.product(factor).alias("_f"))
    row = F.struct(*bars.columns)
    both = bars.select(key, F.col(date).alias("_d"), F.lit(None).cast("double").alias("_f"), row.alias("_r")).unionByName(per_day.select(key, "_d", "_f", F.lit(None).cast(bars.schema.simpleString()).alias("_r")))
    # an event on the bar's own date comes after the bar in this order, so it has no part in it
    w = Window.partitionBy(key).orderBy(F.col("_d").desc(), F.col("_r").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    out = both.withColumn("_p", F.coalesce(F.product("_f").over(w), F.lit(1.0))).where("_r is not null")
    return out.select("_r.*", F.col("_p").alias(name))


def split_adjusted(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """bars with prices divided and volume multiplied by the ratios of later genuine splits."""
    ok = splits.where((F.col("ratio") != 0) & (split_kind(F.col("ratio")) == "genuine"))
    out = later_product(bars, ok, "security_id", "date", "ex_date", "ratio", "_ratio")
    for c in ("open", "high", "low", "close"):
        out = out.withColumn(c, F.col(c) / F.col("_ratio"))
    return out.withColumn("volume", F.col("volume") * F.col("_ratio")).drop("_ratio")


def total_return(bars: DataFrame, dividends: DataFrame, floor: float = 0.01) -> DataFrame:
    """bars scaled back for later dividends, each by 1 - amount / close of the bar before its ex-date.

    A dividend that is null or not positive, or has no positive close before it,
    is skipped; a factor is `floor` at least. Prices are multiplied, volume is
    divided.
    """
    paid = dividends.where(F.col("amount") > 0)
    anchored = asof_backward(paid, bars, ["security_id"], "ex_date", "date", ["close"], strict=True)
    factors = anchored.where(F.col("close") > 0).withColumn("factor", F.greatest(1 - F.col("amount") / F.col("close"), F.lit(floor)))
    out = later_product(bars, factors, "security_id", "date", "ex_date", "factor", "_factor")
    for c in ("open", "high", "low", "close"):
        out = out.withColumn(c, F.col(c) * F.col("_factor"))
    return out.withColumn("volume", F.col("volume") / F.col("_factor")).drop("_factor")
