"""Numbering and ranking in order without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.session import checkpoint


def number_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str, weight: Column | None = None) -> DataFrame:
    """df with dense numbers from 1 per `by` in a total `order`.

    Rows are range-partitioned by (by, order) and sorted within partitions; a
    partition's rows are numbered where they lie and start after the rows of
    the partitions before, whose counts are few. So a group of any share of the
    rows spreads over tasks. The partitioned rows are cut with a checkpoint, as
    two passes must see the same partitions. With `weight` the number is the
    running sum of the weights up to and with the row.
    """
    keys = [F.col(c) for c in by]
    w = (weight if weight is not None else F.lit(1)).cast("long")
    cols = [c if isinstance(c, Column) else F.col(c) for c in order]
    spread = df.withColumn("_w", w).repartitionByRange(*keys, *cols).sortWithinPartitions(*keys, *cols)
    spread = checkpoint(spread.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    total = spread.groupBy(*by, "_p").agg(F.sum("_w").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = total.select(*by, "_p", before.alias("_s"))
    here = F.sum("_w").over(Window.partitionBy(*by, "_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    out = spread.withColumn("_h", here)
    on = [out[c].eqNullSafe(start[c]) for c in by] + [out["_p"] == start["_p"]]
    return out.join(start, on).select(*[out[c] for c in df.columns], (F.col("_h") + F.col("_s")).alias(name))


def value_ranks(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """df with _below, _equal and _n: how many values of its group are smaller, equal, and in all; null for a null value.

    Values are counted first, combined before the shuffle, the distinct values
    numbered by `number_rows` with their counts as weights, and joined back, so
    a cross-section of any size spreads over tasks.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_equal"))
    upto = number_rows(counts, by, [value], "_upto", F.col("_equal"))
    n = counts.groupBy(*by).agg(F.sum("_equal").alias("_n"))
    ranks = upto.join(n, list(by)).select(*by, value, (F.col("_upto") - F.col("_equal")).alias("_below"), "_equal", "_n")
    return df.join(ranks, [*by, value], "left").select(*df.columns, "_below", "_equal", "_n")


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(by, share, quantile): exact quantiles of the non-null values with linear interpolation.

    For few groups of any size: the groups and shares are broadcast to the
    numbered distinct values, and two of them decide each quantile.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_equal"))
    upto = number_rows(counts, by, [value], "_upto", F.col("_equal"))
    n = counts.groupBy(*by).agg(F.sum("_equal").alias("_n"))
    want = n.withColumn("share", F.explode(F.array(*[F.lit(float(x)) for x in shares]))).withColumn("_h", (F.col("_n") - 1) * F.col("share"))
    j = upto.join(F.broadcast(want), list(by))
    holds = lambda at: (F.col("_upto") - F.col("_equal") <= at) & (at < F.col("_upto"))
    low, high = F.floor("_h"), F.ceil("_h")
    ends = j.where(holds(low) | holds(high)).groupBy(*by, "share", "_h").agg(F.max(F.when(holds(low), F.col(value))).alias("_a"), F.max(F.when(holds(high), F.col(value))).alias("_z"))
    return ends.select(*by, "share", (F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("_h") - F.floor("_h"))).alias("quantile"))
