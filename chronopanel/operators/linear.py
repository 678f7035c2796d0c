"""Grids of linear and logistic models from sums: all fits of a grid in a few passes over the rows."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Moments:
    """Sums over rows of (1, features, label) and of their products."""

    products: np.ndarray

    def of(self, cols: Sequence[int]) -> tuple[float, np.ndarray, np.ndarray, float, np.ndarray, np.ndarray]:
        """Rows, means and population deviations (1 where 0) of some features, the label's mean, and their centred, scaled products with themselves and the label."""
        at = [1 + c for c in cols]
        p, n = self.products, self.products[0, 0]
        mean, y = p[0, at] / n, p[0, -1] / n
        cov = p[np.ix_(at, at)] - n * np.outer(mean, mean)
        var = np.diag(cov) / n
        # what rounding leaves of a constant is no variance
        sd = np.where(var > 1e-12 * np.maximum(1.0, mean * mean), np.sqrt(np.maximum(var, 0)), 1.0)
        return n, mean, sd, y, cov / np.outer(sd, sd), (p[at, -1] - n * mean * y) / sd


def moments_by(df: DataFrame, by: str, features: Sequence[str], label: str) -> dict[object, Moments]:
    """Moments of each group: partial sums where the rows lie, added up per group; as many rows as there are groups reach the driver."""
    k = len(features) + 2

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            keys = b.column("_by").to_pandas()
            x = np.column_stack([np.ones(b.num_rows), *[b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (*features, label)]])
            code, names = pd.factorize(keys)
            sums = [(x[code == g].T @ x[code == g]).ravel() for g in range(len(names))]
            yield pa.RecordBatch.from_arrays([pa.array(list(names), b.schema.field("_by").type), pa.array([s.tolist() for s in sums], pa.list_(pa.float64()))], names=["_by", "m"])

    kind = dict(df.dtypes)[by]
    parts = df.select(F.col(by).alias("_by"), *features, label).dropna().mapInArrow(run, f"_by {kind}, m array<double>")

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_by": [pdf["_by"].iloc[0]], "m": [np.sum(np.stack(pdf["m"].to_list()), axis=0).tolist()]})

    rows = parts.groupBy("_by").applyInPandas(add, f"_by {kind}, m array<double>").collect()  # a row per date
    return {r["_by"]: Moments(np.array(r["m"]).reshape(k, k)) for r in rows}


def total(moments: Mapping[object, Moments], keys: Sequence[object], width: int) -> Moments:
    """The sum over some groups; those without rows add nothing."""
    have = [moments[k].products for k in keys if k in moments]
    return Moments(np.sum(have, axis=0) if have else np.zeros((width, width)))


def ridge(m: Moments, cols: Sequence[int], alpha: float) -> np.ndarray:
    """Intercept and coefficients on raw features, of the fit with penalty alpha on the sum of squares of standardized ones."""
    _, mean, sd, y, g, b = m.of(cols)
    w = np.linalg.solve(g + alpha * np.eye(len(cols)), b)
    return _raw(w, mean, sd, y)


def elastic_net(m: Moments, cols: Sequence[int], alpha: float, l1: float = 0.5, tolerance: float = 1e-10) -> np.ndarray:
    """The same with penalty alpha (l1 |w| + (1 - l1) w^2 / 2) on the mean square.

    Alternating directions on the products until neither residual is above
    `tolerance` (the problem is convex), then the exact solution for the
    coefficients that are not 0.
    """
    n, mean, sd, y, g, b = m.of(cols)
    g, b, k = g / n, b / n, len(cols)
    rho, flat, square = 0.1, alpha * l1, alpha * (1 - l1)
    inverse = np.linalg.inv(g + rho * np.eye(k))
    z = u = np.zeros(k)
    while True:
        w = inverse @ (b + rho * (z - u))
        v = w + u
        new = np.sign(v) * np.maximum(np.abs(v) - flat / rho, 0.0) / (1 + square / rho)
        u = v - new
        moved, z = max(np.abs(w - new).max(), np.abs(new - z).max()), new
        if moved <= tolerance:
            break
    on = z != 0
    if on.any():
        exact = np.linalg.solve(g[np.ix_(on, on)] + square * np.eye(on.sum()), b[on] - flat * np.sign(z[on]))
        z = z.copy()
        z[on] = np.where(np.sign(exact) == np.sign(z[on]), exact, z[on])
    return _raw(z, mean, sd, y)


def _raw(w: np.ndarray, mean: np.ndarray, sd: np.ndarray, y: float) -> np.ndarray:
    c = w / sd
    return np.r_[y - c @ mean, c]


@dataclass(frozen=True)
class Logit:
    """One logistic model to fit: its features, its dates and C, the weight of the likelihood against half the sum of squares."""

    cols: tuple[int, ...]
    dates: frozenset
    c: float


def logistic_all(df: DataFrame, by: str, features: Sequence[str], label: str, models: Sequence[Logit], moments: Mapping[object, Moments], most: int = 50, tolerance: float = 1e-8) -> list[np.ndarray]:
    """Intercepts and coefficients of all models by Newton's method; each step is one pass over the rows for all of them.

    The intercept bears no penalty; features are standardized on a model's own
    dates. Every task adds up its rows' gradients and Hessians, a row per model;
    steps end when no coefficient of any model moves by more than `tolerance`.
    The problem is convex; a model that is still moving after `most` steps is an error.
    """
    width = len(features) + 2
    scale = [total(moments, list(m.dates), width) for m in models]
    scale = [s.of(m.cols)[1:3] if s.products[0, 0] else (np.zeros(len(m.cols)), np.ones(len(m.cols))) for s, m in zip(scale, models, strict=True)]
    w = [np.zeros(len(m.cols) + 1) for m in models]
    rows = df.select(F.col(by).alias("_by"), *features, F.col(label).cast("double").alias("_z")).dropna()

    def one_pass(now: list[np.ndarray]):  # noqa: ANN202
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in it:
                if not b.num_rows:
                    continue
                keys = b.column("_by").to_pandas()
                x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features])
                z = b.column("_z").to_numpy(zero_copy_only=False).astype(float)
                for i, m in enumerate(models):
                    here = keys.isin(m.dates).to_numpy()
                    if not here.any():
                        continue
                    a = np.column_stack([np.ones(here.sum()), (x[here][:, m.cols] - scale[i][0]) / scale[i][1]])
                    p = 1 / (1 + np.exp(-np.clip(a @ now[i], -500, 500)))
                    s = np.r_[a.T @ (p - z[here]), ((a * (p * (1 - p))[:, None]).T @ a).ravel()]
                    sums[i] = sums[i] + s if i in sums else s
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["i", "s"])

        return run

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [pdf["i"].iloc[0]], "s": [np.sum(np.stack(pdf["s"].to_list()), axis=0).tolist()]})

    for _ in range(most):
        got = rows.mapInArrow(one_pass(w), "i int, s array<double>").groupBy("i").applyInPandas(add, "i int, s array<double>").collect()  # a row per model
        moved = 0.0
        for r in got:
            i, k = r["i"], len(w[r["i"]])
            s, ridge_ = np.array(r["s"]), np.r_[0.0, np.ones(k - 1)] / models[r["i"]].c
            step = np.linalg.solve(s[k:].reshape(k, k) + np.diag(ridge_) + 1e-12 * np.eye(k), s[:k] + ridge_ * w[i])
            w[i] = w[i] - step
            moved = max(moved, np.abs(step).max())
        if moved <= tolerance:
            break
    else:
        raise RuntimeError(f"logistic fits still move by {moved} after {most} steps")
    return [np.r_[v[0] - (v[1:] / sd) @ mean, v[1:] / sd] for v, (mean, sd) in zip(w, scale, strict=True)]


def scored(df: DataFrame, by: str, features: Sequence[str], label: str, models: Sequence[tuple[str, Sequence[object], np.ndarray]]) -> DataFrame:
    """(model, by, score, label) of the rows on each model's dates; models: (name, dates, intercept and coefficients over all features).

    The models' coefficients, a row per model and date, are few and broadcast.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[by]
    table = spark.createDataFrame([(name, d, [float(x) for x in c]) for name, dates, c in models for d in dates], f"_model string, _by {kind}, _c array<double>")
    x = df.select(F.col(by).alias("_by"), F.array(F.lit(1.0), *[F.col(f).cast("double") for f in features]).alias("_x"), F.col(label).alias(label))
    j = x.join(F.broadcast(table), "_by")
    score = F.aggregate(F.zip_with("_x", "_c", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return j.select(F.col("_model").alias("model"), F.col("_by").alias(by), score.alias("score"), label)
