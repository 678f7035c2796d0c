"""Regression forests and boosted trees grown on binned features; a fit is one task's work on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bins a feature is cut into, by its quantiles on the training rows.
BINS = 128


@dataclass(frozen=True)
class Trees:
    """Trees as arrays per node: feature (-1 for a leaf), bin up to which rows go left, left child, value."""

    cuts: list[np.ndarray]
    start: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.cuts)
        rows, out = np.arange(len(x)), np.full(len(x), self.start)
        for feature, cut, left, value in self.trees:
            at = np.zeros(len(x), int)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = b[rows, np.maximum(f, 0)] > cut[at]
                at = np.where(inner, left[at] + right, at)
            out += value[at]
        return out


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])


def grow(b: np.ndarray, y: np.ndarray, depth: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree of least squared error: each node takes the best cut over all features that leaves `least` rows on both sides."""
    p = b.shape[1]
    off = np.arange(p) * BINS
    feature, cut, left, value = [-1], [0], [0], [0.0]
    todo = [(0, np.arange(len(y)), 0)]
    while todo:
        node, rows, level = todo.pop()
        n, s = len(rows), y[rows].sum()
        value[node] = s / n
        if level == depth or n < 2 * least:
            continue
        flat = (b[rows] + off).ravel()
        count = np.bincount(flat, minlength=p * BINS).reshape(p, BINS).cumsum(axis=1)
        total = np.bincount(flat, np.repeat(y[rows], p), minlength=p * BINS).reshape(p, BINS).cumsum(axis=1)
        ok = (count >= least) & (n - count >= least)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, total**2 / count + (s - total) ** 2 / (n - count), -np.inf)
        best = int(gain.argmax())
        f, c = divmod(best, BINS)
        if not gain[f, c] > s * s / n + 1e-12:
            continue
        feature[node], cut[node], left[node] = f, c, len(feature)
        goes = b[rows, f] > c
        for side in (rows[~goes], rows[goes]):
            todo.append((len(feature), side, level + 1))
            feature.append(-1)
            cut.append(0)
            left.append(0)
            value.append(0.0)
    return np.array(feature), np.array(cut), np.array(left), np.array(value)


def fit(x: np.ndarray, y: np.ndarray, boosted: bool, *, trees: int, depth: int, least: int, step: float = 0.05, seed: int = 20240613) -> Trees:
    """A forest over bootstrap samples with all features at each cut, or trees boosted on residuals; no rows give no trees."""
    if not len(y):
        return Trees([np.array([])] * x.shape[1], 0.0, [])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    b, rng, out = binned(x, cuts), np.random.default_rng(seed), []
    if not boosted:
        for _ in range(trees):
            i = rng.integers(0, len(y), len(y))
            f, c, left, v = grow(b[i], y[i], depth, least)
            out.append((f, c, left, v / trees))
        return Trees(cuts, 0.0, out)
    start = float(y.mean())
    now = np.full(len(y), start)
    for _ in range(trees):
        f, c, left, v = grow(b, y - now, depth, least)
        one = Trees(cuts, 0.0, [(f, c, left, v * step)])
        out.append(one.trees[0])
        now = now + one.predict(x)
    return Trees(cuts, start, out)


def rank_correlations(day: np.ndarray, score: np.ndarray, y: np.ndarray, least: int = 5) -> list[float]:
    """Spearman correlation of each day with `least` rows or more, where neither side is flat."""
    import pandas as pd

    out = []
    for _, g in pd.DataFrame({"d": day, "a": score, "b": y}).groupby("d"):
        if len(g) >= least:
            a, b = g["a"].rank(), g["b"].rank()
            if a.std() > 0 and b.std() > 0:
                out.append(float(np.corrcoef(a, b)[0, 1]))
    return out
