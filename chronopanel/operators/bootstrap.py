"""Autocorrelation, circular block bootstrap and the significance test built on it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def autocorrelation(series: DataFrame, order: str, value: str, max_lag: int = 20) -> DataFrame:
    """lag, rho for lags 1..max_lag of one series in order, by the biased estimator.

    Nulls are left out before numbering. One series of calendar length is
    numbered in one task; each point then meets only its max_lag successors.
    """
    s = series.where(F.col(value).isNotNull()).select(F.row_number().over(Window.orderBy(order)).alias("i"), F.col(value).cast("double").alias("x"))
    every = Window.partitionBy()
    c = s.select("i", (F.col("x") - F.avg("x").over(every)).alias("x")).withColumn("v", F.sum(F.col("x") * F.col("x")).over(every))
    lead = c.select(F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("lag"), "i", F.col("x").alias("y")).select("lag", (F.col("i") - F.col("lag")).alias("i"), "y")
    return c.join(lead, "i").groupBy("lag").agg(F.try_divide(F.sum(F.col("x") * F.col("y")), F.max("v")).alias("rho"))


def choose_block_length(acf: dict[int, float], n: int, low: int = 5, high: int = 20) -> int:
    """2k + 3 within [low, high], k being the last lag before the first |rho| < 2 / sqrt(n)."""
    if n < 8:
        return low
    k = 0
    for lag in sorted(acf):
        if acf[lag] is None or abs(acf[lag]) < 2 / math.sqrt(n):
            break
        k = lag
    return max(low, min(high, 2 * k + 3))


def block_means(spark: SparkSession, values: list[float], block: int, draws: int, seed: int, tasks: int = 8) -> DataFrame:
    """Means of `draws` circular block resamples of a series; replicates run in parallel.

    Each replicate has a generator of its own, seeded by (seed, replicate), so
    the result does not depend on the tasks. The series is of calendar length
    and is sent to the tasks.
    """
    x = np.asarray(values, float)
    blocks = -(-len(x) // block)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for rep in pdf["id"]:
                rng = np.random.default_rng((seed, int(rep)))
                start = rng.integers(0, len(x), blocks)
                idx = ((start[:, None] + np.arange(block)[None, :]) % len(x)).ravel()[: len(x)]
                out.append(float(x[idx].mean()))
            yield pd.DataFrame({"replicate": pdf["id"], "mean": out})

    return spark.range(0, draws, 1, tasks).mapInPandas(run, "replicate long, mean double")


def mean_interval(spark: SparkSession, values: list[float], block: int, draws: int = 5000, level: float = 0.95, seed: int = 42) -> dict | None:
    """Percentile interval of a series' mean, None for fewer than four blocks."""
    if len(values) < 4 * block:
        return None
    means = sorted(r["mean"] for r in block_means(spark, values, block, draws, seed).select("mean").collect())  # `draws` numbers, a parameter
    low = means[round((1 - level) / 2 * (draws - 1))]
    high = means[round((1 + level) / 2 * (draws - 1))]
    return {"mean": float(np.mean(values)), "low": low, "high": high, "excludes_zero": not low <= 0 <= high, "block": block, "n": len(values)}


def verdict(night: dict | None, difference: dict | None, annual: int = 252, least_pct: float = 1.0) -> str:
    """What two intervals say of an effect.

    'inconclusive' where there is no interval; 'failure' where either holds
    zero; 'inconclusive' where both do not, but the mean, annualised in percent,
    is below `least_pct` in size; else 'genuine_effect_candidate'.
    """
    if night is None or difference is None:
        return "inconclusive"
    if not (night["excludes_zero"] and difference["excludes_zero"]):
        return "failure"
    return "inconclusive" if abs(night["mean"] * annual * 100) < least_pct else "genuine_effect_candidate"
