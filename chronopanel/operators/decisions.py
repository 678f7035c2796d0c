"""Mechanical verdicts on models that challenge a champion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of outcomes. Fixed values.
OUTCOMES = ("NO_IMPROVEMENT_OR_FAILS_ROBUSTNESS", "GENUINELY_PROMISING", "MULTIPLE_PROMISING")
#: Gain in mean rank correlation that counts, and the share of it that one regime or one family may carry. Fixed values.
LEAST_GAIN, MOST_FROM_REGIME, MOST_FROM_FAMILY = 0.02, 0.8, 0.8


def decide(challengers: DataFrame, champions: DataFrame, least_gain: float = LEAST_GAIN) -> DataFrame:
    """challengers with gain, gates and whether they survive.

    challengers: (step, model, mean_ic, mean_ic_excluding, history_ok and
    mean_ic_without_family, null where there was no such run); champions: (step,
    model, mean_ic, mean_ic_excluding). The best champion of a step is its
    greatest mean_ic, and its greatest mean_ic_excluding for the regime gate. A
    challenger clears the threshold by `least_gain`; then no gate may fail: its
    history diagnostic, less than MOST_FROM_REGIME of the gain from the regime
    left out, less than MOST_FROM_FAMILY of it from the family left out. A gate
    that cannot be computed does not fail.
    """
    best = champions.groupBy("step").agg(F.max("mean_ic").alias("_best"), F.max("mean_ic_excluding").alias("_best_x"))
    c = challengers.join(best, "step", "left").withColumn("gain", F.col("mean_ic") - F.col("_best"))
    share = lambda other: F.when(F.col("gain") != 0, 1 - other / F.col("gain"))
    c = c.withColumn("from_regime", share(F.col("mean_ic_excluding") - F.col("_best_x"))).withColumn("from_family", share(F.col("mean_ic_without_family") - F.col("_best")))
    clears = F.coalesce(F.col("gain") >= least_gain, F.lit(False))
    holds = F.coalesce(F.col("history_ok"), F.lit(True)) & F.coalesce(F.col("from_regime") < MOST_FROM_REGIME, F.lit(True)) & F.coalesce(F.col("from_family") < MOST_FROM_FAMILY, F.lit(True))
    return c.select("step", "model", "mean_ic", "gain", clears.alias("clears_threshold"), "from_regime", "from_family", (clears & holds).alias("survives"))


def outcome(decisions: DataFrame) -> DataFrame:
    """What the decisions come to, in one row."""
    n = F.count_if("survives")
    return decisions.agg(F.count(F.lit(1)).alias("challengers"), n.alias("survivors"), F.when(n == 0, OUTCOMES[0]).when(n == 1, OUTCOMES[1]).otherwise(OUTCOMES[2]).alias("outcome"))
