"""Attributes as known at event time: bitemporal lookup in persistent search trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.functions.keys import OPEN_DAY

#: Days of a shard, and of one of the 64-bit words that hold a shard's event days.
SHARD, WORD = 1024, 64


class PersistentTree:
    """Path-copied search trees over valid time, one version per known time.

    Claims are inserted in the order in which they became known; an insertion
    copies the path from the root to its valid-time leaf, so every earlier root
    stays a complete tree of what was known then. A node holds the last inserted
    claim below it. Many trees live in one set of arrays and are built and
    searched together, level by level.

    tree: ids of the claims' trees, equal ids adjacent, each tree's claims in
    known order. valid: the claims' valid-time keys.
    """

    def __init__(self, tree: np.ndarray, valid: np.ndarray) -> None:
        n = len(tree)
        self.n = n
        order = np.lexsort((valid, tree))
        new = np.r_[True, (tree[order][1:] != tree[order][:-1]) | (valid[order][1:] != valid[order][:-1])] if n else np.empty(0, bool)
        self.u_tree, self.u_valid = tree[order][new], valid[order][new]
        start = np.searchsorted(self.u_tree, tree, "left")
        leaf = np.empty(n, np.int64)
        leaf[order] = np.cumsum(new) - 1
        leaf -= start  # rank of the claim's key among its tree's keys
        most = int(leaf.max()) + 1 if n else 1
        self.depth = max(0, int(np.ceil(np.log2(most))))
        # Node k*(depth+1)+d is the copy that claim k made at depth d. Its children
        # are the copy of claim k and, for the other side, the last copy made before.
        width = self.depth + 1
        self.left = np.full((n, width), -1, np.int64)
        self.right = np.full((n, width), -1, np.int64)
        at = np.arange(n)
        for d in range(self.depth):
            side = leaf >> (self.depth - d - 1)
            span = np.int64(1) << (d + 1)
            other = tree.astype(np.int64) * span + (side ^ 1)
            own = tree.astype(np.int64) * span + side
            seq = np.lexsort((at, own))
            i = np.searchsorted(own[seq] * (n + 1) + at[seq], other * (n + 1) + at) - 1
            last = np.where(i >= 0, seq[np.maximum(i, 0)], -1)
            last = np.where((last >= 0) & (own[last] == other), last, -1)
            goes_right = (side & 1) == 1
            self.left[:, d] = np.where(goes_right, last, at)
            self.right[:, d] = np.where(goes_right, at, last)

    def latest(self, tree: np.ndarray, root: np.ndarray, until: np.ndarray) -> np.ndarray:
        """For each query the last known claim with valid key <= until, or -1.

        root: the last claim of that tree known at the query's time, or -1.
        """
        if not self.n:
            return np.full(len(root), -1, np.int64)
        big = np.int64(1) << 40
        keys = self.u_tree.astype(np.int64) * big + (self.u_valid + (1 << 30))
        rank = np.searchsorted(keys, tree.astype(np.int64) * big + (until.astype(np.int64) + (1 << 30)), "right") - 1
        rank = rank - np.searchsorted(self.u_tree, tree, "left")
        node = np.where(rank >= 0, root, -1)
        best = np.full(len(root), -1, np.int64)
        for d in range(self.depth):
            live = node >= 0
            safe = np.maximum(node, 0)
            l, r = self.left[safe, d], self.right[safe, d]
            to_right = ((rank >> (self.depth - d - 1)) & 1) == 1
            best = np.where(live & to_right & (l > best), l, best)  # the whole left side is valid
            node = np.where(live, np.where(to_right, r, l), -1)
        return np.maximum(best, node)


def _flat(t: pa.Table, name: str) -> tuple[np.ndarray, pa.Array]:
    col = t.column(name).combine_chunks()
    return np.diff(col.offsets.to_numpy()), col.flatten()


def _search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = [f"w{i}" for i in range(SHARD // WORD)]
    for b in it:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        n_claims, c = _flat(t, "claims")
        field = {f.name: c.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(c.type)}
        row = np.repeat(np.arange(t.num_rows), n_claims)
        lane = np.unique(field["lane"].astype(str), return_inverse=True)
        names = pa.array(lane[0])
        tree = row * len(lane[0]) + lane[1]
        order = np.lexsort((field["id"], field["known"], tree))
        tree, valid, known, ident, gone = (x[order] for x in (tree, field["valid"].astype(np.int64), field["known"].astype(np.int64), field["id"], field["gone"]))
        trees = PersistentTree(tree, valid)

        bits = np.stack([t.column(w).to_numpy(zero_copy_only=False).astype("<i8") for w in words], axis=1)
        r, offset = np.nonzero(np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little"))
        day = t.column("shard").to_numpy().astype(np.int64)[r] * SHARD + offset
        has = np.unique(tree)
        # Every event asks each tree of its shard.
        lanes = np.arange(len(lane[0]))
        qr, qday = np.repeat(r, len(lanes)), np.repeat(day, len(lanes))
        qtree = qr * len(lanes) + np.tile(lanes, len(r))
        ok = has[np.minimum(np.searchsorted(has, qtree), len(has) - 1)] == qtree if len(has) else np.zeros(len(qtree), bool)
        qr, qday, qtree = qr[ok], qday[ok], qtree[ok]
        big = np.int64(1) << 33
        roots = np.searchsorted(tree * big + known + (1 << 31), qtree * big + qday + (1 << 31), "right") - 1
        roots = np.where((roots >= 0) & (tree[np.maximum(roots, 0)] == qtree), roots, -1)
        hit = trees.latest(qtree, roots, qday)
        keep = hit >= 0
        keep &= np.where(keep, gone[hit] > qday, False)
        hit, qr, qday, qtree = hit[keep], qr[keep], qday[keep], qtree[keep]
        yield pa.RecordBatch.from_arrays(
            [t.column("entity").combine_chunks().take(pa.array(qr)), pa.array(qday.astype(np.int32)), names.take(pa.array(qtree % len(lanes))), pa.array(ident[hit].astype(np.int64))],
            names=["entity", "day", "lane", "id"],
        )


def known_asof(
    events: DataFrame,
    claims: DataFrame,
    *,
    entity: str,
    event_date: str,
    lane: str,
    claim_id: str,
    valid_from: str,
    valid_to: str,
    known_from: str,
    horizon: str = "2030-01-01",
) -> DataFrame:
    """The claim that was valid and known on each date on which an entity has events.

    For each distinct (entity, date) of `events` and each `lane` of `claims`:
    of the entity's claims whose valid_from and known date (known_from, or
    valid_from where that is null) are both on or before the date, the one with
    the latest known date decides (ties: the greatest claim_id). If it still
    holds, valid_to being null or after the date, there is a row (entity,
    event_date, lane, claim_id); nothing that became known later has any say.
    Join the events with it on entity and date to get one row per event.

    Events are counted by day: an entity's days of one shard of 1,024 days are a
    bitmap, combined before the shuffle, so an entity with any share of the
    events takes 16 words a shard. Of the claims that took effect before a
    shard only the deciding one per lane goes into it; from `horizon` on all is
    one shard for the claims, and events there keep their own. Each shard's
    claims form path-copied persistent search trees: an event selects the root
    of what was known, then searches the valid-time key.

    Null entities, dates, lanes or ids take no part; claims with an end not
    after their start are the caller's to remove; repeated rows count once;
    empty tables give an empty result; other columns are ignored.
    """
    ent = dict(events.dtypes)[entity]
    day = F.unix_date(F.col(f"`{event_date}`").cast("date"))
    tail = F.floor(F.unix_date(F.lit(horizon).cast("date")) / SHARD).cast("int")
    off = F.pmod(F.col("day"), F.lit(SHARD))
    days = events.where(F.col(f"`{entity}`").isNotNull()).select(F.col(f"`{entity}`").alias("entity"), day.alias("day")).where(F.col("day").isNotNull())
    marks = (
        days.select("entity", F.least(F.floor(F.col("day") / SHARD).cast("int"), tail).alias("part"), F.floor(F.col("day") / SHARD).cast("int").alias("shard"), (off / WORD).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(day, {WORD}) as int))").alias("bit"))
        .groupBy("entity", "part", "shard")
        .agg(*[F.coalesce(F.bit_or(F.when(F.col("word") == i, F.col("bit"))), F.lit(0).cast("long")).alias(f"w{i}") for i in range(SHARD // WORD)])
    )
    valid, known = F.col("valid"), F.col("known")
    facts = (
        claims.select(
            F.col(f"`{entity}`").alias("entity"),
            F.col(f"`{lane}`").cast("string").alias("lane"),
            F.col(f"`{claim_id}`").cast("long").alias("id"),
            F.unix_date(F.col(f"`{valid_from}`").cast("date")).alias("valid"),
            F.coalesce(F.unix_date(F.col(f"`{valid_to}`").cast("date")), F.lit(OPEN_DAY)).alias("gone"),
            F.unix_date(F.coalesce(F.col(f"`{known_from}`"), F.col(f"`{valid_from}`")).cast("date")).alias("known"),
        )
        .dropna()
        .withColumn("own", F.least(F.floor(F.greatest(valid, known) / SHARD).cast("int"), tail))
        .withColumn("part", F.explode(F.sequence("own", tail)))
        # of what took effect before the shard only the last known can decide in it
        .withColumn("slot", F.when((F.col("part") == F.col("own")), F.struct("valid", "known")))
        .groupBy("entity", "part", "lane", "slot")
        .agg(F.max(F.struct("known", "id", "valid", "gone")).alias("c"))
        .groupBy("entity", "part")
        .agg(F.collect_list(F.struct("lane", "c.id", "c.valid", "c.known", "c.gone")).alias("claims"))
    )
    found = marks.join(facts, ["entity", "part"]).select("entity", "shard", "claims", *[f"w{i}" for i in range(SHARD // WORD)]).mapInArrow(_search, f"entity {ent}, day int, lane string, id long")
    return found.select(F.col("entity").alias(entity), F.date_from_unix_date("day").alias(event_date), F.col("lane").alias(lane), F.col("id").alias(claim_id))
