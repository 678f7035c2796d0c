"""Irregular readings onto a regular grid: harmonic regression with bridged residuals."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.keys import is_real

#: Periods of the harmonics in grid steps: a trading year and a quarter of one.
PERIODS = (252.0, 63.0)


def _basis(i: F.Column, origin: float, scale: float, periods: Sequence[float]) -> list[F.Column]:
    """1, trend and a sine and cosine for each period, at grid index i."""
    out = [F.lit(1.0), (i - F.lit(origin)) / F.lit(scale)]
    for p in periods:
        a = i * F.lit(2 * math.pi / p)
        out += [F.sin(a), F.cos(a)]
    return out


def _solve(m: int, targets: int, ridge: float):  # noqa: ANN202
    pairs = [(a, b) for a in range(m) for b in range(a, m)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            get = lambda c: b.column(c).to_numpy(zero_copy_only=False).astype(float)
            cols = []
            for t in range(targets):
                x = np.zeros((b.num_rows, m, m))
                for k, (i, j) in enumerate(pairs):
                    x[:, i, j] = x[:, j, i] = get(f"t{t}_x{k}")
                y = np.stack([get(f"t{t}_y{i}") for i in range(m)], axis=1)
                n = np.maximum(x[:, 0, 0], 1.0)
                x += (ridge * n)[:, None, None] * np.diag([0.0] + [1.0] * (m - 1))
                x[x[:, 0, 0] == 0, 0, 0] = 1.0  # a series without a reading
                cols.append(np.linalg.solve(x, y[:, :, None])[:, :, 0])
            yield pa.RecordBatch.from_arrays(
                [b.column("_key"), *[pa.FixedSizeListArray.from_arrays(pa.array(c.ravel()), m).cast(pa.list_(pa.float64())) for c in cols]], names=["_key", *[f"c{t}" for t in range(targets)]]
            )

    return run


def regular_grid(
    df: DataFrame,
    sessions: DataFrame,
    *,
    keys: Sequence[str],
    date: str,
    value: str,
    also: Sequence[str] = (),
    order: Sequence[str] = (),
    session: str = "session_date",
    periods: Sequence[float] = PERIODS,
    ridge: float = 1e-6,
) -> DataFrame:
    """One row per series and session from its first to its last reading of `value`.

    A series is one combination of the `keys`. Readings on dates that are no
    session, and readings whose value is null or NaN, are left out; of several
    readings of a session the greatest by `order` counts. Returns the keys,
    `date`, `value`, the columns in `also`, and `status`: 'observed', or
    'filled' for a session without a reading of the value. Filled values are
    prediction plus bridged residual: a harmonic regression with trend of the
    series, whose residual runs linearly between those of the readings before
    and after the gap. A null in an `also` column is filled the
    same way from its own regression, without a bridge, and floored at 0.

    The normal equations are sums of products, combined before the shuffle; the
    solver sees one row per series. Missing sessions come from each reading's
    successor, so a gap needs no join. What one task sorts for a series is
    bounded by the number of sessions.

    `sessions` is a calendar; its distinct dates are numbered in one task.
    Null keys or dates take no part, repeated rows count once, a series without
    a reading gives no row, empty tables give an empty result, other columns
    are ignored. A series of one reading gives that one row.
    """
    targets = [value, *also]
    cal = sessions.select(F.col(f"`{session}`").cast("date").alias("_date")).dropna().distinct()
    cal = cal.select("_date", F.row_number().over(Window.orderBy("_date")).alias("_i"))
    ks = [f"_k{i}" for i in range(len(keys))]
    bars = (
        df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keys, ks, strict=True)], F.col(f"`{date}`").cast("date").alias("_date"), *[F.col(f"`{c}`").cast("double").alias(f"_v{t}") for t, c in enumerate(targets)], F.struct(*[F.col(f"`{c}`") for c in order], F.col(f"`{value}`")).alias("_o"))
        .where(is_real("_v0"))
        .dropna(subset=[*ks, "_date"])
        .join(F.broadcast(cal), "_date")
    )
    key = F.struct(*ks).alias("_key")

    m = 2 + 2 * len(periods)
    x = _basis(F.col("_i").cast("double"), 1250.0, 1250.0, periods)
    design = bars.select(key, *[e.alias(f"_x{i}") for i, e in enumerate(x)], *[f"_v{t}" for t in range(len(targets))])
    sums = []
    for t in range(len(targets)):
        w = F.when(is_real(f"_v{t}"), F.lit(1.0)).otherwise(F.lit(0.0))
        y = F.when(is_real(f"_v{t}"), F.col(f"_v{t}")).otherwise(F.lit(0.0))
        sums += [F.sum(w * F.col(f"_x{a}") * F.col(f"_x{b}")).alias(f"t{t}_x{k}") for k, (a, b) in enumerate((a, b) for a in range(m) for b in range(a, m))]
        sums += [F.sum(y * F.col(f"_x{a}")).alias(f"t{t}_y{a}") for a in range(m)]
    key_type = design.schema["_key"].dataType.simpleString()
    coef = design.groupBy("_key").agg(*sums).mapInArrow(_solve(m, len(targets), ridge), f"_key {key_type}, " + ", ".join(f"c{t} array<double>" for t in range(len(targets))))

    series = Window.partitionBy("_key").orderBy("_i")
    day = Window.partitionBy("_key", "_i").orderBy(F.col("_o").desc())
    read = bars.select(key, "_i", "_o", *[f"_v{t}" for t in range(len(targets))])
    # one sort by (key, i, order) serves both windows; the calendar join leaves no other shuffle
    read = read.repartition("_key").withColumn("_rn", F.row_number().over(day)).where("_rn = 1")
    read = read.withColumn("_n", F.lead(F.struct("_i", "_v0")).over(series))

    def predict(i: F.Column, t: int) -> F.Column:
        return sum((F.col(f"c{t}")[j] * e for j, e in enumerate(_basis(i.cast("double"), 1250.0, 1250.0, periods))), F.lit(0.0))

    grid = read.withColumn("_j", F.explode(F.sequence(F.col("_i"), F.coalesce(F.col("_n._i") - 1, F.col("_i"))))).join(coef, "_key")
    filled = F.col("_j") != F.col("_i")
    share = (F.col("_j") - F.col("_i")) / (F.col("_n._i") - F.col("_i"))
    residual = (F.col("_v0") - predict(F.col("_i"), 0)) * (1 - share) + (F.col("_n._v0") - predict(F.col("_n._i"), 0)) * share
    out = [F.when(filled, predict(F.col("_j"), 0) + residual).otherwise(F.col("_v0")).alias(value)]
    for t, c in enumerate(also, 1):
        out.append(F.when(~filled & is_real(f"_v{t}"), F.col(f"_v{t}")).otherwise(F.greatest(F.lit(0.0), predict(F.col("_j"), t))).alias(c))
    back = cal.select(F.col("_i").alias("_j"), "_date")
    return grid.join(F.broadcast(back), "_j").select(*[F.col(f"_key.{k}").alias(c) for k, c in zip(ks, keys, strict=True)], F.col("_date").alias(date), *out, F.when(filled, F.lit("filled")).otherwise(F.lit("observed")).alias("status"))
