"""Version history of a changing attribute by tree reduction of unit intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.functions.keys import OPEN_DAY

#: A summary of a block of runs: its first run (with the start of the second,
#: where there is one), its last run, and whether they are one and the same.
_FIELDS = ("f_start", "f_end", "f_pay", "l_start", "l_pay", "single")
_SCHEMA = "entity {0}, salt int, done boolean, chunk int, f_start int, f_end int, f_pay string, l_start int, l_pay string, single boolean"


def merge_pairs(group: np.ndarray, s: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray], list[tuple[np.ndarray, ...]]]:
    """Reduce blocks to one per group, merging neighbours pairwise in log2 rounds.

    group: ids of the blocks' groups, equal ids adjacent, blocks in order.
    Returns the groups, their one block each, and the finished runs as tuples
    (group index array, start, payload, end).
    """
    done: list[tuple[np.ndarray, ...]] = []
    while len(group):
        n = len(group)
        first = np.r_[True, group[1:] != group[:-1]]
        pos = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
        left = np.flatnonzero((pos % 2 == 0) & np.r_[group[1:] == group[:-1], False])
        if not len(left):
            break
        right = left + 1
        a, b = ({k: v[i] for k, v in s.items()} for i in (left, right))
        same = a["l_pay"] == b["f_pay"]
        # The run across the border is finished when it reaches neither outer edge.
        emit = same & ~a["single"] & ~b["single"]
        done.append((group[left[emit]], a["l_start"][emit], a["l_pay"][emit], b["f_end"][emit]))
        emit = ~same & ~a["single"]
        done.append((group[left[emit]], a["l_start"][emit], a["l_pay"][emit], b["f_start"][emit]))
        emit = ~same & ~b["single"]
        done.append((group[left[emit]], b["f_start"][emit], b["f_pay"][emit], b["f_end"][emit]))
        m = {
            "f_start": a["f_start"],
            "f_pay": a["f_pay"],
            "f_end": np.where(~a["single"], a["f_end"], np.where(same, b["f_end"], b["f_start"])),
            "l_start": np.where(b["single"] & same, a["l_start"], b["l_start"]),
            "l_pay": b["l_pay"],
            "single": same & a["single"] & b["single"],
        }
        keep = np.ones(n, bool)
        keep[right] = False
        for k in s:
            s[k][left] = m[k]
            s[k] = s[k][keep]
        group = group[keep]
    return group, s, done


def _batches(it: Iterator[pa.RecordBatch], key: list[str], rows: int = 200_000) -> Iterator[pa.Table]:
    """Tables of at least `rows` rows that never split a run of equal keys."""
    held: list[pa.RecordBatch] = []
    count = 0
    for b in it:
        if not b.num_rows:
            continue
        held.append(b)
        count += b.num_rows
        if count < rows:
            continue
        t = pa.Table.from_batches(held)
        last = t.slice(t.num_rows - 1)
        at = t.num_rows - 1
        vals = [t.column(k).to_numpy(zero_copy_only=False) for k in key]
        differs = np.zeros(t.num_rows, bool)
        for k, v in zip(key, vals, strict=True):
            differs |= v != last.column(k).to_numpy(zero_copy_only=False)[0]
        at = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if at:
            yield t.slice(0, at)
            held, count = t.slice(at).to_batches(), t.num_rows - at
    if count:
        yield pa.Table.from_batches(held)


def _codes(*cols: np.ndarray) -> np.ndarray:
    """Group numbers of rows whose equal keys are adjacent."""
    new = np.zeros(len(cols[0]), bool)
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _reducer(entity: str, final: bool):  # noqa: ANN202
    key = ["entity"] if final else ["entity", "chunk"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _batches(it, ["entity", "salt"] if final else key):
            if final:
                ready = t.filter(t.column("done"))
                yield from ready.to_batches()
                t = t.filter(pa.compute.invert(t.column("done")))
                if not t.num_rows:
                    continue
            col = {c: t.column(c).to_numpy(zero_copy_only=False) for c in ("chunk", *_FIELDS)}
            col["single"] = col["single"].astype(bool)
            ent = t.column("entity")
            group = _codes(*[t.column(k).to_numpy(zero_copy_only=False) for k in key])
            rep = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            s = {f: col[f].copy() for f in _FIELDS}
            g, s, done = merge_pairs(group, s)
            if final:  # each entity's last runs have no successor
                done.append((g[~s["single"]], s["f_start"][~s["single"]], s["f_pay"][~s["single"]], s["f_end"][~s["single"]]))
                done.append((g, s["l_start"], s["l_pay"], np.full(len(g), OPEN_DAY)))
            dg, ds, dp, de = (np.concatenate([x[i] for x in done]) if done else np.empty(0) for i in range(4))
            rows = np.r_[rep[dg.astype(int)], rep[g] if not final else np.empty(0, int)].astype(int)
            nd, ns = len(dg), 0 if final else len(g)
            z = lambda a, f: np.r_[a, s[f]] if ns else a
            yield pa.RecordBatch.from_arrays(
                [
                    ent.take(pa.array(rows)).combine_chunks(),
                    pa.array(np.r_[(ds.astype(np.int64) // 512 % 61) + 1, np.zeros(ns, int)].astype(np.int32)),
                    pa.array(np.r_[np.ones(nd, bool), np.zeros(ns, bool)]),
                    pa.array(col["chunk"][rows].astype(np.int32)),
                    pa.array(z(ds, "f_start").astype(np.int32)),
                    pa.array(z(de, "f_end").astype(np.int32)),
                    pa.array(list(z(dp, "f_pay")), pa.string()),
                    pa.array(z(ds, "l_start").astype(np.int32)),
                    pa.array(list(z(dp, "l_pay")), pa.string()),
                    pa.array(np.r_[np.ones(nd, bool), s["single"]] if ns else np.ones(nd, bool)),
                ],
                names=["entity", "salt", "done", "chunk", *_FIELDS],
            )

    return run


def version_history(obs: DataFrame, entity: str, day: str, payload: str, order: str | None = None, chunk_days: int = 512) -> DataFrame:
    """Full history of an attribute from dated observations of it.

    obs: one row per observation; `payload` null says "no value from here on".
    Of several observations of an entity and day the one with the greatest
    `order` counts (ties: the greatest payload). Returns (entity, value,
    valid_from, valid_to) with dates, valid_to 9999-12-31 for the last version;
    stretches without a value give no row.

    Each observation is a unit interval. Neighbouring blocks of runs merge
    pairwise, runs of equal payload across their border becoming one, in
    logarithmic rounds: first within (entity, chunk of `chunk_days` days), then
    over the chunks of an entity. A block passes on only its first and its last
    run; runs in between are finished and leave the tree. So an entity that
    holds any share of the rows is spread over its chunks, and the second level
    gets two runs a chunk.

    Rows without entity or day are left out, repeated rows count once, an empty
    table gives an empty result, other columns are ignored.
    """
    ent = dict(obs.dtypes)[entity]
    rank = F.struct(*([F.col(f"`{order}`").alias("o")] if order else []), F.col(f"`{payload}`").cast("string").alias("p"))
    units = (
        obs.where(F.col(f"`{entity}`").isNotNull() & F.col(f"`{day}`").isNotNull())
        .select(F.col(f"`{entity}`").alias("entity"), F.unix_date(F.col(f"`{day}`").cast("date")).alias("t"), rank.alias("r"))
        .groupBy("entity", "t")
        .agg(F.max("r").alias("r"))
        .select("entity", "t", F.coalesce(F.concat(F.lit("="), F.col("r.p")), F.lit("")).alias("p"))
    )
    blocks = units.select(
        "entity",
        F.lit(0).alias("salt"),
        F.lit(False).alias("done"),
        F.floor(F.col("t") / chunk_days).cast("int").alias("chunk"),
        F.col("t").alias("f_start"),
        F.lit(OPEN_DAY).alias("f_end"),
        F.col("p").alias("f_pay"),
        F.col("t").alias("l_start"),
        F.col("p").alias("l_pay"),
        F.lit(True).alias("single"),
    )
    schema = _SCHEMA.format(ent)
    lower = blocks.repartition("entity", "chunk").sortWithinPartitions("entity", "chunk", "f_start").mapInArrow(_reducer(ent, False), schema)
    upper = lower.repartition("entity", "salt").sortWithinPartitions("entity", "salt", "chunk").mapInArrow(_reducer(ent, True), schema)
    return upper.where(F.col("f_pay") != "").select(
        F.col("entity").alias(entity),
        F.substring("f_pay", 2, 1 << 30).alias("value"),
        F.date_from_unix_date("f_start").alias("valid_from"),
        F.date_from_unix_date("f_end").alias("valid_to"),
    )
