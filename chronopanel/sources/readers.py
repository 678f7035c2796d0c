"""Readers and writers: delimited files, synthetic bars, run results, checkpoints of progress."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an attempt to fetch a series came to. Fixed values.
STATUSES = ("SUCCESS_WITH_DATA", "SUCCESS_EMPTY_PROVIDER", "TRANSIENT_FAILURE", "PERMANENT_FAILURE")


class PriceSource(Protocol):
    """Anything that gives daily bars of tickers as a DataFrame."""

    def fetch(self, spark: SparkSession, tickers: Sequence[str], start: str, end: str) -> DataFrame: ...


class MembershipSource(Protocol):
    """Anything that gives membership claims as a DataFrame."""

    def parse(self, spark: SparkSession, path: str) -> DataFrame: ...


class DelimitedMembership:
    """Claims from lines of ticker, start and end; an empty end is open.

    Header, blank and short lines are left out; `only` keeps listed tickers by a
    semi join; claims that start before `weak_before` carry a note.
    """

    SCHEMA = "ticker string, start_date string, end_date string"

    def __init__(self, index_name: str, only: DataFrame | None = None, weak_before: str = "2001-01-01") -> None:
        self.index_name, self.only, self.weak_before = index_name, only, weak_before

    def parse(self, spark: SparkSession, path: str) -> DataFrame:
        raw = spark.read.csv(path, schema=self.SCHEMA, header=True, mode="PERMISSIVE")
        start = F.try_to_date("start_date", "yyyy-MM-dd")
        rows = raw.where(F.trim("ticker") != "").select(F.trim("ticker").alias("raw_ticker"), F.lit(self.index_name).alias("index_name"), start.alias("effective_date"), F.try_to_date(F.nullif(F.trim("end_date"), F.lit("")), "yyyy-MM-dd").alias("removal_date"))
        rows = rows.where("effective_date is not null").withColumn("note", F.when(F.col("effective_date") < F.lit(self.weak_before).cast("date"), "start lies in a weakly documented period"))
        return rows if self.only is None else rows.join(self.only, "raw_ticker", "left_semi")


def claims_from_records(spark: SparkSession, records: Iterable[dict], confidence: str = "verified") -> DataFrame:
    """Claims from dicts of raw_ticker, index_name, effective_date and removal_date; no records give an empty table."""
    schema = "raw_ticker string, index_name string, effective_date date, removal_date date"
    rows = [(r.get("raw_ticker"), r.get("index_name"), r.get("effective_date"), r.get("removal_date")) for r in records]
    return spark.createDataFrame(rows, schema).withColumn("confidence", F.lit(confidence))


def read_table(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A CSV with header: '' is null, wrong values are null, columns cast as named."""
    raw = spark.read.csv(path, header=True, mode="PERMISSIVE")
    cast = {"date": lambda c: F.try_to_date(c, "yyyy-MM-dd")}
    value = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return raw.select(*[(cast[t](value(c)) if t in cast else value(c).try_cast(t)).alias(c) for c, t in columns.items()])


class SyntheticPrices:
    """Deterministic bars on weekdays from a linear congruential generator per ticker.

    The seed is the ticker's SHA-256 modulo 2^32; a first price is `start_price`
    and seed modulo 200. Each bar takes five draws: drift, open, high, low,
    volume. Tickers in `empty` have no bars; days within a ticker's pair of
    dates in `gaps` are passed over without a draw. A generator is sequential,
    so a ticker is a task's group; tickers are parallel.
    """

    def __init__(self, empty: Sequence[str] = (), gaps: dict[str, tuple[str, str]] | None = None, start_price: float = 100.0) -> None:
        self.empty, self.gaps, self.start_price = frozenset(empty), dict(gaps or {}), start_price

    def fetch(self, spark: SparkSession, tickers: Sequence[str], start: str, end: str) -> DataFrame:
        empty, gaps, start_price = self.empty, self.gaps, self.start_price
        names = ["ticker", "date", "open", "high", "low", "close", "volume"]

        def draws(state: int) -> Iterator[float]:
            while True:
                state = (1103515245 * state + 12345) % 2**31
                yield state / 2**31

        def bars(pdf: pd.DataFrame) -> pd.DataFrame:
            ticker = pdf["ticker"].iloc[0]
            lo, hi = gaps.get(ticker, ("9999", "0000"))
            days = [x for x in pdf["date"].sort_values() if not lo <= x.isoformat() <= hi] if ticker not in empty else []
            seed = int(hashlib.sha256(ticker.encode()).hexdigest(), 16) % 2**32
            rng, close, out = draws(seed), start_price + seed % 200, []
            for day in days:
                drift, at, up, down, traded = (next(rng) for _ in range(5))
                close = max(0.5, close * (1 + (drift - 0.5) * 0.02))
                first = close * (1 + (at - 0.5) * 0.005)
                top, low = max(first, close) * (1 + up * 0.005), min(first, close) * (1 - down * 0.005)
                out.append((ticker, day, round(first, 4), round(top, 4), round(low, 4), round(close, 4), float(1_000_000 + int(traded * 5_000_000))))
            return pd.DataFrame(out, columns=names)

        days = spark.createDataFrame([(t,) for t in tickers], "ticker string").select("ticker", F.explode(F.expr(f"sequence(date '{start}', date '{end}', interval 1 day)")).alias("date")).where(F.weekday("date") < 5)
        return days.groupBy("ticker").applyInPandas(bars, "ticker string, date date, open double, high double, low double, close double, volume double")


def guarded(df: DataFrame, date: Column, bound: Column) -> DataFrame:
    """df, failing the job at the first row whose date lies after its bound: no look into the future."""
    ok = F.assert_true(date.isNull() | bound.isNull() | (date <= bound), F.lit("a row is dated after what it may see"))
    return df.where(ok.isNull())


def timing(attempts: DataFrame) -> DataFrame:
    """Attempts (skipped, bars, seconds, error) as counts and mean times of each kind, and what more securities would take.

    The estimate rests on fresh attempts that brought data, or on all fresh ones if none did.
    """
    fresh, data = ~F.col("skipped"), ~F.col("skipped") & (F.col("bars") > 0)
    mean = lambda c: F.avg(F.when(c, F.col("seconds")))
    each = F.coalesce(mean(data), mean(fresh))
    return attempts.agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(fresh).alias("fresh"), F.count_if(data).alias("fresh_with_data"), F.count_if(fresh & (F.col("bars") == 0)).alias("fresh_without_data"), F.count_if("skipped").alias("skipped"), F.count("error").alias("errors"),
        F.round(F.avg("seconds"), 4).alias("mean_all"), F.round(mean(fresh), 4).alias("mean_fresh"), F.round(mean(data), 4).alias("mean_with_data"), F.round(each * 200 / 60, 1).alias("minutes_for_200"), F.round(each * 1200 / 60, 1).alias("minutes_for_1200"),
    )


def clean_actions(raw: DataFrame, start: str, end: str) -> DataFrame:
    """Dividends above 0 and split ratios above 0 other than 1, in range; unreadable numbers are left out."""
    v = F.col("value").try_cast("double")
    ok = F.when(F.col("action_type") == "dividend", v > 0).otherwise((v > 0) & (v != 1))
    return raw.where(ok & F.col("ex_date").between(start, end)).withColumn("value", v)


def attempt_status(rows: Column, error: Column) -> Column:
    """Outcome of an attempt from its row count and error text."""
    gone = F.lower(error).rlike("delisted|not found|no data found|404")
    return F.when(error.isNull() & (rows > 0), STATUSES[0]).when(error.isNull(), STATUSES[1]).when(gone, STATUSES[3]).otherwise(STATUSES[2])


def pending(keys: DataFrame, done: DataFrame, on: Sequence[str], forced: DataFrame | None = None) -> DataFrame:
    """Keys still to do: not in `done`, or forced."""
    left = keys.join(done.select(*on).distinct(), list(on), "left_anti")
    return left if forced is None else left.unionByName(keys.join(forced, list(on), "left_semi")).distinct()


def evolve(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with the columns it lacks, as nulls of their type; running it twice changes nothing."""
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in columns.items() if c not in df.columns])


def long_metrics(wide: DataFrame, run: str) -> DataFrame:
    """Metrics of runs as (run, metric_name, value)."""
    names = [c for c, t in wide.dtypes if c != run and t in ("double", "float", "int", "bigint")]
    return wide.select(run, *[F.col(c).cast("double").alias(c) for c in names]).unpivot([run], names, "metric_name", "value")


def wide_metrics(long: DataFrame, run: str, names: Sequence[str]) -> DataFrame:
    return long.groupBy(run).pivot("metric_name", list(names)).agg(F.first("value"))


def reset_table(df: DataFrame, path: str, synthetic: Column, force: bool = False) -> bool:
    """Replace the table at path by df unless it holds a row that is not synthetic; whether it was replaced."""
    spark = df.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not force and there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there) and spark.read.parquet(path).where(~F.coalesce(synthetic, F.lit(False))).limit(1).count():
        return False
    df.write.mode("overwrite").parquet(path)
    return True
