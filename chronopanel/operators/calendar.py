"""Calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def business_days(start: Column, end: Column) -> Column:
    """Mondays to Fridays from start to end, both counted, in closed form; 0 if end is before start."""
    # days since a Monday; full weeks count five, the rest up to five
    upto = lambda c: F.floor((F.unix_date(c) + 3) / 7) * 5 + F.least(F.pmod(F.unix_date(c) + 3, F.lit(7)), F.lit(5))
    return F.when(end < start, F.lit(0).cast("long")).otherwise(upto(F.date_add(end, 1)) - upto(start)).cast("long")


def month_starts(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Dates a month apart from start to end; the day of the month must be 28 or less."""
    if int(start[8:10]) > 28:
        raise ValueError("a monthly schedule must start on day 28 or earlier")
    return spark.range(1).select(F.explode(F.expr(f"sequence(date '{start}', date '{end}', interval 1 month)")).alias("rebalance_date"))


def schedule(spark: SparkSession, start: str, end: str, frequency: str) -> DataFrame:
    """Dates from start to end: 'daily', 'weekly' or 'monthly'."""
    step = {"daily": "1 day", "weekly": "7 days", "monthly": "1 month"}.get(frequency)
    if step is None:
        raise ValueError(f"no such frequency: {frequency}")
    if frequency == "monthly":
        return month_starts(spark, start, end)
    return spark.range(1).select(F.explode(F.expr(f"sequence(date '{start}', date '{end}', interval {step})")).alias("rebalance_date"))
