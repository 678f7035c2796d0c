"""Implausible readings: an isolation forest per series and explicit limit rules."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a forest sees of a bar; the first five are the largest over its prices.
FEATURES = ("level", "width", "difference before", "difference after", "weekday-adjusted difference", "run length")


def _mix(*parts: np.ndarray | int) -> np.ndarray:
    """Hash integers to well spread 64-bit numbers (splitmix64), broadcasting."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (np.asarray(p).astype(np.uint64) ^ h) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return h


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _number(x: object) -> int:
    """A key as a number, the same in every process."""
    return int(x) if isinstance(x, int | np.integer) else int.from_bytes(hashlib.blake2b(str(x).encode(), digest_size=8).digest(), "big", signed=True)


def path_length(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def isolation_scores(x: np.ndarray, series: np.ndarray, ids: np.ndarray, trees: int, sample: int, seed: int) -> np.ndarray:
    """Isolation-forest scores of every row, each series having a forest of its own.

    x: rows by features. series: 0..S-1, ascending. ids: a number for each
    series that its random choices come from, so that the scores do not depend
    on what else is in the batch. All trees of all series grow level by level.
    """
    n, f = x.shape
    s = int(series[-1]) + 1
    size = np.bincount(series, minlength=s)
    begin = np.cumsum(size) - size
    depth = max(1, int(np.ceil(np.log2(sample))))
    tree_ids = _mix(np.repeat(ids, trees), np.tile(np.arange(trees), s), seed)
    nt = s * trees
    own = np.repeat(np.arange(s), trees)
    drawn = np.minimum(size, sample)[own]
    pick = (_unit(_mix(tree_ids[:, None], np.arange(sample)[None, :], 1)) * size[own][:, None]).astype(np.int64) + begin[own][:, None]
    in_use = np.arange(sample)[None, :] < drawn[:, None]
    rows = pick[in_use]
    tree = np.repeat(np.arange(nt), drawn)
    pts = x[rows]
    node = np.zeros(len(rows), np.int64)
    nodes = 2 ** (depth + 1) - 1
    feat = np.full((nt, nodes), -1, np.int8)
    cut = np.zeros((nt, nodes))
    tail = np.zeros((nt, nodes), np.float32)
    for d in range(depth + 1):
        key = tree * nodes + node
        order = np.argsort(key, kind="stable")
        key, tree, node, pts = key[order], tree[order], node[order], pts[order]
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[at, len(key)])
        tn, nn = tree[at], node[at]
        low, high = np.minimum.reduceat(pts, at, axis=0), np.maximum.reduceat(pts, at, axis=0)
        wide = high > low
        split = wide.any(axis=1) & (count > 1) & (d < depth)
        rank = np.where(wide, _unit(_mix(tree_ids[tn][:, None], nn[:, None], np.arange(f)[None, :], 2)), -1.0)
        chosen = rank.argmax(axis=1)
        i = np.arange(len(at))
        u = _unit(_mix(tree_ids[tn], nn, 3))
        c = low[i, chosen] + (0.02 + 0.96 * u) * (high[i, chosen] - low[i, chosen])
        feat[tn[split], nn[split]] = chosen[split]
        cut[tn[split], nn[split]] = c[split]
        tail[tn[~split], nn[~split]] = path_length(count[~split])
        grow = np.repeat(split, count)
        if not grow.any():
            break
        cc, cf = np.repeat(c, count)[grow], np.repeat(chosen, count)[grow]
        tree, node, pts = tree[grow], node[grow], pts[grow]
        node = 2 * node + 1 + (pts[np.arange(len(pts)), cf] >= cc)
    # Score tree by tree; a row stops where its tree has no further cut.
    total = np.zeros(n)
    fl, cu, ta = feat.ravel(), cut.ravel(), tail.ravel()
    xr = np.ascontiguousarray(x).ravel()
    at_row = np.arange(n) * f
    for t in range(trees):
        base = (series * trees + t) * nodes
        live = np.arange(n)
        where = base.copy()
        length = np.zeros(n)
        pos = np.zeros(n, np.int64)
        for _ in range(depth):
            k = fl[where[live]]
            go = k >= 0
            live = live[go]
            if not len(live):
                break
            k = k[go].astype(np.int64)
            pos[live] = 2 * pos[live] + 1 + (xr[at_row[live] + k] >= cu[where[live]])
            where[live] = base[live] + pos[live]
            length[live] += 1
        total += length + ta[where]
    return 2.0 ** (-(total / trees) / np.maximum(path_length(np.minimum(size, sample)), 1e-9)[series])


def _median_by(group: np.ndarray, v: np.ndarray, groups: int) -> np.ndarray:
    """Median of each group's values that are not NaN; NaN where there is none."""
    ok = ~np.isnan(v)
    g, v = group[ok], v[ok]
    order = np.lexsort((v, g))
    n = np.bincount(g, minlength=groups)
    begin = np.cumsum(n) - n
    out = np.full(groups, np.nan)
    has = n > 0
    s = v[order]
    out[has] = (s[begin[has] + (n[has] - 1) // 2] + s[begin[has] + n[has] // 2]) / 2
    return out


def _shift(v: np.ndarray, series: np.ndarray, k: int) -> np.ndarray:
    """The value k rows on in the same series, else NaN."""
    out = np.full(len(v), np.nan)
    if k > 0:
        out[:-k] = np.where(series[k:] == series[:-k], v[k:], np.nan)
    elif k < 0:
        out[-k:] = np.where(series[-k:] == series[:k], v[:k], np.nan)
    return out


def _run_length(v: np.ndarray, series: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of each row's run of equal values in a row, and its place in the run from 0."""
    n = len(v)
    new = np.ones(n, bool)
    new[1:] = (series[1:] != series[:-1]) | ~(v[1:] == v[:-1])
    at = np.flatnonzero(new)
    length = np.diff(np.r_[at, n])
    return np.repeat(length, length), np.arange(n) - np.repeat(at, length)


def judge(series: np.ndarray, ids: np.ndarray, day: np.ndarray, prices: np.ndarray, cfg: dict) -> dict[str, np.ndarray]:
    """Scores and flags of bars that are sorted by series and day, one row a day.

    prices: rows by (open, high, low, close), NaN for none.
    """
    o, h, lo, c = prices.T
    n, groups = len(series), len(ids)
    with np.errstate(invalid="ignore", divide="ignore"):
        bad = (prices <= 0).any(axis=1) | (h < lo) | (o > h) | (o < lo) | (c > h) | (c < lo)
    score, spike, stuck = np.full(n, np.nan), np.zeros(n, bool), np.zeros(n, bool)

    def fill(dst: np.ndarray, idx: np.ndarray, v: np.ndarray) -> None:
        dst[idx] = v

    closed = np.flatnonzero(~np.isnan(c))
    if len(closed):
        cs = series[closed]
        runs = []
        for v in (o[closed], c[closed]):
            length, place = _run_length(v, cs)
            stuck[closed] |= (length > cfg["stuck_over"]) & (place > 0)
            runs.append(np.where(np.isnan(v), 1, length))
        run = np.maximum(*runs)
        # Levels are read off bars with a positive close; the rest is bad by rule.
        keep = c[closed] > 0
        idx, s, run = closed[keep], cs[keep], run[keep]
    if len(closed) and len(idx):
        uniq, s0 = np.unique(s, return_inverse=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            lp = np.log(np.where(prices[idx] > 0, prices[idx], np.nan))
        lc = lp[:, 3]
        ret = lc - _shift(lc, s, -1)
        mid = _median_by(s0, ret, len(uniq))
        sigma = np.maximum(1.4826 * _median_by(s0, np.abs(ret - mid[s0]), len(uniq)), cfg["least_sigma"])
        sigma = np.where(np.isnan(sigma), cfg["least_sigma"], sigma)[s0]
        near = np.sort(np.stack([_shift(lc, s, k) for k in (-3, -2, -1, 1, 2, 3)]), axis=0)
        have = (~np.isnan(near)).sum(axis=0)
        j = np.arange(len(s))
        level = np.where(have > 0, (near[np.maximum(have - 1, 0) // 2, j] + near[np.minimum(have // 2, 5), j]) / 2, lc)
        before, after = _shift(lc, s, -1)[:, None], _shift(lc, s, 1)[:, None]
        weekday = s0 * 7 + day[idx] % 7
        usual = _median_by(weekday, ret, len(uniq) * 7)[weekday][:, None]
        far = lambda v: np.log1p(np.nanmax(np.where(np.isnan(v), 0.0, np.abs(v)), axis=1) / sigma)
        width = np.maximum(lp[:, 1], lp[:, 3]) - np.minimum(lp[:, 2], lp[:, 3])
        x = np.stack([far(lp - level[:, None]), far(width[:, None]), far(lp - before), far(after - lp), far(lp - before - usual), np.log(np.maximum(run, 1.0))], axis=1)
        sc = isolation_scores(x, s0, ids[uniq], cfg["trees"], cfg["sample"], cfg["seed"])
        fill(score, idx, sc)
        # Exact check of what the forest isolates: a price leaves the level of the
        # bars before and after a run of at most two bars, which agree with each other.
        hit = np.zeros(len(s), bool)
        for back, on in ((-1, 1), (-2, 1), (-1, 2)):
            b, a = _shift(lc, s, back), _shift(lc, s, on)
            db, da = lp - b[:, None], lp - a[:, None]
            with np.errstate(invalid="ignore"):
                least = np.minimum(np.abs(db), np.abs(da))
                hit |= ((least > cfg["far"] * sigma[:, None]) & (db * da > 0) & (np.abs(a - b)[:, None] < 0.5 * least)).any(axis=1)
        spike[idx] = hit & (sc >= cfg["least_score"])
    return {"score": score, "bad": bad, "spike": spike, "stuck": stuck}


def _detector(keys: int, cfg: dict):  # noqa: ANN202
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, count = [], 0
        for b in it:
            if not b.num_rows:
                continue
            held.append(b)
            count += b.num_rows
            if count < 60_000:
                continue
            t = pa.Table.from_batches(held)
            differs = np.zeros(t.num_rows, bool)
            for k in range(keys):
                v = t.column(k).to_numpy(zero_copy_only=False)
                differs |= v != v[-1]
            at = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
            if at:
                yield t.slice(0, at)
                held, count = t.slice(at).to_batches(), t.num_rows - at
        if count:
            yield pa.Table.from_batches(held)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches(it):
            cols = [t.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
            day = t.column("_day").to_numpy().astype(np.int64)
            new = np.zeros(t.num_rows, bool)
            for v in cols:
                new[1:] |= v[1:] != v[:-1]
            series = np.cumsum(new)
            last = np.r_[(series[1:] != series[:-1]) | (day[1:] != day[:-1]), True]
            pick = np.flatnonzero(last)
            series, day = series[pick], day[pick]
            first = np.flatnonzero(np.r_[True, series[1:] != series[:-1]])
            ids = _mix(*[np.array([_number(x) for x in v[pick][first]], np.int64) for v in cols])
            prices = np.stack([t.column(c).to_numpy(zero_copy_only=False)[pick].astype(float) for c in ("_o", "_h", "_l", "_c")], axis=1)
            r = judge(series, ids, day, prices, cfg)
            at = pa.array(pick)
            yield pa.RecordBatch.from_arrays(
                [*[t.column(k).take(at).combine_chunks() for k in range(keys)], t.column("_day").take(at).combine_chunks(), pa.array(r["score"], from_pandas=True), *[pa.array(r[k]) for k in ("bad", "spike", "stuck")]],
                names=[*[f"_k{i}" for i in range(keys)], "_day", "score", "impossible", "spike", "stuck"],
            )

    return run


def implausible_bars(
    df: DataFrame,
    *,
    keys: Sequence[str],
    date: str,
    prices: Sequence[str] = ("open", "high", "low", "close"),
    order: Sequence[str] = (),
    trees: int = 24,
    sample: int = 128,
    least_score: float = 0.52,
    far: float = 16.0,
    stuck_over: int = 6,
    least_sigma: float = 1e-6,
    seed: int = 7,
) -> DataFrame:
    """Every bar of every series with an anomaly score and flags.

    A series is one combination of the integer or text `keys`. Of several bars
    of one date the greatest by (has a close, `order`) counts. Returns the keys,
    `date`, `score` (null without a positive close) and the flags

    * impossible: a price not positive, high below low, or open or close outside
      them; a null or NaN price takes no part,
    * stuck: open or close unchanged over more than `stuck_over` bars in a row
      (bars without a close do not count); not the first bar of the run,
    * spike: nominated by the forest (score >= `least_score`) and, by the exact
      check that follows, a price further than `far` usual moves (1.4826 MAD of the series'
      log returns) from the close before and the close after a run of at most
      two bars, which agree with each other, so lasting changes are none.

    The isolation forest is the series' own: `trees` trees of `sample` draws
    each (the method's own bound; every bar is scored) on the FEATURES, on log
    scales of the series' usual moves.

    One shuffle, by series; a series' bars are bounded by the calendar. Null
    keys or dates take no part, repeated rows count once, an empty table gives
    an empty result, other columns are ignored.
    """
    cfg = {"trees": trees, "sample": sample, "least_score": least_score, "far": far, "stuck_over": stuck_over, "least_sigma": least_sigma, "seed": seed}
    ks = [f"_k{i}" for i in range(len(keys))]
    types = dict(df.dtypes)
    real = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
    rows = (
        df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keys, ks, strict=True)], F.unix_date(F.col(f"`{date}`").cast("date")).alias("_day"), *[real(c).alias(a) for c, a in zip(prices, ("_o", "_h", "_l", "_c"), strict=True)], *[F.col(f"`{c}`").alias(f"_by{i}") for i, c in enumerate(order)])
        .dropna(subset=[*ks, "_day"])
        .repartition(*ks)
        .sortWithinPartitions(*ks, "_day", F.col("_c").isNotNull(), *[f"_by{i}" for i in range(len(order))], "_c", "_o", "_h", "_l")
        .drop(*[f"_by{i}" for i in range(len(order))])
    )
    out = rows.mapInArrow(_detector(len(keys), cfg), ", ".join(f"{k} {types[c]}" for k, c in zip(ks, keys, strict=True)) + ", _day int, score double, impossible boolean, spike boolean, stuck boolean")
    return out.select(*[F.col(k).alias(c) for k, c in zip(ks, keys, strict=True)], F.date_from_unix_date("_day").alias(date), "score", "impossible", "spike", "stuck")
