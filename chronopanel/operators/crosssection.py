"""Ranks, means and correlations over cross-sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mid_rank(value: str, by: Sequence[str]) -> Column:
    """(below + half of equal) / n among the non-null values of a cross-section; null for n < 2."""
    here, mine = Window.partitionBy(*by), Window.partitionBy(*by, value)
    n = F.count(value).over(here)
    below = F.rank().over(here.orderBy(F.col(value).asc_nulls_last())) - 1
    return F.when(F.col(value).isNotNull() & (n >= 2), (below + 0.5 * F.count(value).over(mine)) / n)


def average_rank(value: str, by: Sequence[str]) -> Column:
    """0-based rank, ties sharing their mean rank."""
    here, mine = Window.partitionBy(*by), Window.partitionBy(*by, value)
    return F.rank().over(here.orderBy(F.col(value).asc_nulls_last())) - 1 + (F.count(value).over(mine) - 1) / 2


def safe_corr(x: str, y: str, otherwise: float | None = None) -> Column:
    """Pearson correlation; `otherwise` where a side has no variance or there are under two pairs."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    # corr itself divides by zero on a flat side
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.coalesce(F.when(F.count(a) >= 2, r), F.lit(otherwise).cast("double"))


def rank_correlation(df: DataFrame, by: Sequence[str], x: str, y: str, least: int = 1) -> DataFrame:
    """Spearman correlation, share of equal signs and count per cross-section of `least` rows or more."""
    ranked = df.withColumn("_rx", average_rank(x, by)).withColumn("_ry", average_rank(y, by))
    return (
        ranked.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n"), safe_corr("_rx", "_ry").alias("ic"), F.avg(((F.col(x) > 0) == (F.col(y) > 0)).cast("double")).alias("hit_rate"))
        .where(F.col("n") >= least)
    )
