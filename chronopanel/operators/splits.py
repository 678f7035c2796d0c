"""Chronological splits with embargo."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def primary_split(dates: DataFrame, date: str, train: float, validation: float, test: float, embargo: int) -> DataFrame:
    """dates with `part`: train, validation, test, or purged (the last `embargo` of the first two).

    Cut points are round(n * share), halves to even. A calendar's dates are
    numbered in one task.
    """
    if abs(train + validation + test - 1) > 1e-9:
        raise ValueError("the shares must add up to 1")
    if embargo < 0:
        raise ValueError("the embargo must not be negative")
    w = Window.orderBy(date)
    i = F.row_number().over(w) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy())
    out = dates.select(date).distinct().withColumn("_i", i).withColumn("_n", n)
    a, b = F.bround(F.col("_n") * train).cast("long"), F.bround(F.col("_n") * (train + validation)).cast("long")
    part = F.when(F.col("_i") < a - embargo, "train").when(F.col("_i") < a, "purged").when(F.col("_i") < b - embargo, "validation").when(F.col("_i") < b, "purged").otherwise("test")
    return out.select(date, part.alias("part"))


def expanding_checkpoints(n: int, first: int, every: int, embargo: int) -> list[tuple[int, int]]:
    """(position of a retraining, last position it may train on) along n dates."""
    return [(i, max(0, i - 1 - embargo)) for i in range(first, n, every)]


def inner_folds(n: int, folds: int, embargo: int, least: int = 1) -> list[tuple[range, range]]:
    """Expanding folds within n training dates: train up to the embargo, evaluate on the next stretch."""
    step = n // (folds + 1)
    out = []
    for k in range(1, folds + 1):
        end = k * step
        stop = n if k == folds else end + step
        if end - embargo >= least and stop > end:
            out.append((range(0, end - embargo), range(end, stop)))
    return out
