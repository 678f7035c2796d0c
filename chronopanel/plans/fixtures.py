"""Panels that the queries share, as DataFrames and as the same rules in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.functions.keys import is_real
from chronopanel.session import table

#: One bar per security and date: lowest feed, last ingested; bars without a close are none.
PANEL = """panel as (
  select security_id, date, open, high, low, close, volume, price_data_quality from (
    select *, row_number() over (partition by security_id, date order by source_id, ingested_at desc, price_id desc) as _rn
    from prices where close is not null and not isnan(close) and security_id is not null and date is not null)
  where _rn = 1)"""

#: Month starts at which point-in-time queries look: those after the first session, up to the last.
MONTHS = "months as (select unnest(generate_series(date_trunc('month', a) + interval 1 month, z, interval 1 month))::date as as_of from (select min(session_date) as a, max(session_date) as z from trading_sessions))"

#: Month starts from a security's first month on.
PROBES = "probes as (select security_id, as_of from (select security_id, min(date) as f, max(date) as l from panel group by 1), months where as_of >= f and as_of <= l + 40)"


def panel(spark: SparkSession, d: str) -> DataFrame:
    """One bar per security and date; combined before the shuffle, so no sort."""
    bars = table(spark, d, "prices").where(is_real("close") & F.col("security_id").isNotNull() & F.col("date").isNotNull())
    keep = ["open", "high", "low", "close", "volume", "price_data_quality"]
    # the greatest of (-source, ingested, id) is the last ingested bar of the lowest feed
    best = F.max(F.struct((-F.col("source_id")).alias("s"), "ingested_at", "price_id", *keep)).alias("b")
    return bars.groupBy("security_id", "date").agg(best).select("security_id", "date", *[f"b.{c}" for c in keep])


def month_bounds(spark: SparkSession, d: str) -> tuple[str, str]:
    """First and last month start of the calendar: one row, read where a plan needs it as a constant."""
    a = F.add_months(F.trunc(F.min("session_date"), "month"), 1)
    r = table(spark, d, "trading_sessions").agg(a.cast("string").alias("a"), F.trunc(F.max("session_date"), "month").cast("string").alias("z")).first()
    return (r["a"], r["z"]) if r["a"] else ("9999-12-31", "0001-01-01")


def months(spark: SparkSession, d: str) -> DataFrame:
    a, z = month_bounds(spark, d)
    one = spark.range(1).where(F.lit(a) <= F.lit(z))
    return one.select(F.explode(F.expr(f"sequence(date '{a}', greatest(date '{a}', date '{z}'), interval 1 month)")).alias("as_of"))


def probes(spark: SparkSession, d: str, p: DataFrame | None = None) -> DataFrame:
    """Security and month start, from the first bar to 40 days past the last.

    The months are generated from each security's span, so there is no join.
    """
    a, z = month_bounds(spark, d)
    span = (panel(spark, d) if p is None else p).groupBy("security_id").agg(F.min("date").alias("f"), F.max("date").alias("l"))
    first = F.greatest(F.when(F.dayofmonth("f") == 1, F.col("f")).otherwise(F.add_months(F.trunc("f", "month"), 1)), F.lit(a).cast("date"))
    last = F.least(F.trunc(F.date_add("l", 40), "month"), F.lit(z).cast("date"))
    return span.where(first <= last).select("security_id", F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("as_of"))
