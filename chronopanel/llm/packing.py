"""Filling containers of fixed capacity: local search by swaps between underfull bins."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Mapping
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.session import checkpoint


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Start: items by falling size, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        at = bisect_left(room, (s, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(bins)
            bins.append([])
        bins[b].append(int(i))
        if left > s:
            insort(room, (left - s, b))
        elif left == 0 and s == 0:
            insort(room, (0, b))
    return bins


def empty_bins(bins: list[list[int]], sizes: np.ndarray, capacity: int, table: int = 64) -> list[list[int]]:
    """Empty bins by moves and swaps between underfull bins that raise the squared fill.

    Bins are filled up in order of falling fill. A bin takes from the bins below
    it by the step that fills it most: it takes an item or two of one bin, or
    exchanges one of its own for one, one for two of one bin, or two for one.
    The bin gains what the lower one loses, so the sum of squared fills rises
    with every step and the search ends: when no bin can be saved (the count is
    the total over the capacity), or when no step is left. What lower bins offer
    is kept in order, single items and pairs, so a step is a few binary
    searches; pairs of bins of more than `table` items are searched from both
    ends instead of being listed.
    """
    size = [int(x) for x in sizes]
    by = lambda i: (size[i], i)
    fill = [sum(size[i] for i in b) for b in bins]
    bins = [sorted(b, key=by) for b in bins]
    where = {i: k for k, b in enumerate(bins) for i in b}
    least = -(-sum(fill) // capacity)
    live = sum(bool(b) for b in bins)
    moved = True
    while moved and live > least:
        moved = False
        order = sorted((k for k, b in enumerate(bins) if b and fill[k] < capacity), key=lambda k: (-fill[k], k))
        done = [False] * len(bins)
        single = sorted((size[i], i) for k in order for i in bins[k] if size[i])
        pairs = sorted((size[b[x]] + size[b[y]], b[y], b[x], k) for k in order for b in [bins[k]] if len(b) <= table for x in range(len(b)) for y in range(x))
        sums = [x[0] for x in pairs]
        long = [k for k in order if len(bins[k]) > table]

        def lower(k: int, r: int, gain: int) -> bool:
            return k != r and not done[k] and fill[k] < fill[r] + gain

        def one(r: int, give: int, gap: int, beat: int) -> tuple[int, tuple[int, ...]]:
            """The greatest gain of more than `beat` from one item for `give`, within the gap."""
            at = bisect_right(single, (give + gap, 1 << 62)) - 1
            while at >= 0 and single[at][0] - give > beat:
                s, i = single[at]
                if lower(where[i], r, s - give):
                    return s - give, (i,)
                at -= 1
            return 0, ()

        def two(r: int, give: int, gap: int, beat: int) -> tuple[int, tuple[int, ...]]:
            """The same from two items of one bin."""
            got: tuple[int, tuple[int, ...]] = (0, ())
            at = bisect_right(sums, give + gap) - 1
            while at >= 0 and sums[at] - give > beat:
                s, i, j, k = pairs[at]
                if where[i] == k and where[j] == k and lower(k, r, s - give):
                    beat, got = s - give, (s - give, (i, j))
                    break
                at -= 1
            for k in long:
                b, lo, hi = bins[k], 0, len(bins[k]) - 1
                while lo < hi and beat < gap:
                    s = size[b[lo]] + size[b[hi]]
                    if s > give + gap:
                        hi -= 1
                        continue
                    if s - give > beat and lower(k, r, s - give):
                        beat, got = s - give, (s - give, (b[lo], b[hi]))
                    lo += 1
            return got

        for r in order:
            while bins[r] and fill[r] < capacity:
                gap, mine = capacity - fill[r], bins[r]
                gives: Iterator[tuple[int, ...]] = chain([()], ((i,) for i in mine))
                best: tuple[int, tuple[int, ...], tuple[int, ...]] = (0, (), ())
                seen = set()
                for g in chain(gives, ((mine[x], mine[y]) for x in range(len(mine)) for y in range(x))):
                    give = sum(size[i] for i in g)
                    if (len(g), give) in seen:
                        continue
                    seen.add((len(g), give))
                    for search in (one,) if len(g) == 2 else (one, two):
                        gain, take = search(r, give, gap, best[0])
                        if gain > best[0]:
                            best = (gain, g, take)
                    if best[0] == gap:
                        break
                gain, give_up, take = best
                if not gain:
                    break
                d = where[take[0]]
                for items, a, b in ((take, d, r), (give_up, r, d)):
                    for i in items:
                        bins[a].remove(i)
                        insort(bins[b], i, key=by)
                        where[i] = b
                fill[r] += gain
                fill[d] -= gain
                live -= not bins[d]
                moved = True
            # a bin that is done offers nothing to those below it
            done[r] = True
            for i in bins[r]:
                if size[i]:
                    del single[bisect_left(single, (size[i], i))]
    return [b for b in bins if b]


def pack_containers(
    items: DataFrame, capacities: Mapping[str, int], *, item: str, size: str, items_per_shard: int = 10_000, reopened: float = 0.02, merge: int = 32, seed: int = 11, with_start: bool = False
) -> DataFrame:
    """An assignment of items to containers of each capacity with little unused space.

    Returns (container_name, container_id, item, piece, size). No item is split
    unless it exceeds the capacity: then it fills whole containers and its rest
    is an item like others; pieces count from 0. Every item has a row for each
    capacity; one of size 0 or null lies in some container and takes no space.
    `with_start` adds shard and best_fit, the number of containers in which best
    fit alone puts that shard.

    Pieces are spread at random over shards of about `items_per_shard`, each
    packed by best fit and the swap search of `empty_bins`. The least filled
    share `reopened` of each shard's containers is then packed anew together
    with that of `merge` - 1 other shards. What a task holds is bounded by the
    shard. Container ids are unique per capacity and the same in every run.

    capacities: container sizes, a fixed small table of the caller's. An empty
    table gives an empty result; repeated ids are items of their own; null ids
    are kept.
    """
    small = checkpoint(items.select(F.col(item).alias("item"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size")))
    caps = sorted((k, int(v)) for k, v in capacities.items())
    parts = lambda cap: F.greatest(F.lit(1).cast("long"), F.ceil(F.col("size") / F.lit(cap)))
    pieces = small.agg(*[F.coalesce(F.sum(parts(v)), F.lit(0).cast("long")).alias(f"n{i}") for i, (_, v) in enumerate(caps)]).first()
    shards = [max(1, -(-n // items_per_shard)) for n in pieces]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).cast("long").alias("cap"), F.lit(n).cast("long").alias("shards")) for (k, v), n in zip(caps, shards, strict=True)])).alias("c")
    rows = (
        small.select("item", "size", each)
        .select(F.col("c.name").alias("name"), F.col("c.cap").alias("cap"), F.col("c.shards").alias("shards"), "item", "size")
        .withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("cap"))).cast("int"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("shard", F.pmod(F.xxhash64("item", "size", "piece", F.lit(seed)), "shards").cast("int"))
        .withColumn("size", F.when(F.col("piece") < F.col("parts") - 1, F.col("cap")).otherwise(F.col("size") - F.col("cap") * (F.col("parts") - 1)))
        .select("name", "cap", "shard", F.col("shard").alias("home"), F.lit(0).cast("long").alias("fit"), "item", "size", "piece")
    )
    types = dict(small.dtypes)
    out = f"name string, cap long, shard int, home int, fit long, item {types['item']}, size long, piece int, bin string, open boolean"

    def packer(level: str, share: float):  # noqa: ANN202
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["item", "piece", "size"], kind="stable", ignore_index=True)
            cap, sizes = int(pdf["cap"].iloc[0]), pdf["size"].to_numpy()
            start = best_fit(sizes, cap)
            if level == "a":
                pdf["fit"] = len(start)
            bins = empty_bins(start, sizes, cap)
            fills = np.array([sizes[b].sum() for b in bins])
            loose = np.zeros(len(bins), bool)
            if share:
                loose[np.argsort(fills, kind="stable")[: max(1, int(len(bins) * share))]] = True
                loose &= fills < cap
            where = np.empty(len(pdf), object)
            opened = np.zeros(len(pdf), bool)
            shard = int(pdf["shard"].iloc[0])
            for k, b in enumerate(bins):
                where[b] = f"{level}{shard}-{k}"
                opened[b] = loose[k]
            return pdf.assign(bin=where, open=opened)[["name", "cap", "shard", "home", "fit", "item", "size", "piece", "bin", "open"]]

        return run

    first = rows.groupBy("name", "cap", "shard").applyInPandas(packer("a", reopened if max(shards, default=1) > 1 else 0.0), out)
    if max(shards, default=1) > 1:
        first = checkpoint(first)
        again = first.where("open").withColumn("shard", F.floor(F.col("shard") / merge).cast("int")).drop("bin", "open").groupBy("name", "cap", "shard").applyInPandas(packer("b", 0.0), out)
        first = first.where("not open").unionByName(again)
    extra = [F.col("home").alias("shard"), F.col("fit").alias("best_fit")] if with_start else []
    return first.select(F.col("name").alias("container_name"), F.col("bin").alias("container_id"), F.col("item").alias(item), "piece", F.col("size").alias(size), *extra)
