"""Continuous periods and gaps from overlapping intervals, in two levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.keys import OPEN_DAY


def merge_intervals(
    df: DataFrame, keys: Sequence[str], start: str, end: str, shard_days: int = 1024, last_shard_from: str = "2030-01-01"
) -> DataFrame:
    """Covered periods and the gaps between them, per key.

    Intervals are half open, [start, end); a null end means open. Touching
    periods join. Returns the keys and span_kind ('covered' or 'gap'),
    start_date and end_date as dates, 9999-12-31 for open.

    Two levels, so that one entity may hold any share of the rows:

    1. Intervals with one start collapse to the longest (combined before the
       shuffle). Each is clipped into shards of `shard_days` days; everything
       from `last_shard_from` on is one last shard, so that an open interval
       makes few pieces. Pieces merge within (keys, shard).
    2. Pieces that touch a shard's edge, at most two a shard, are stitched.

    A shard of N days yields at most N/2 pieces, hence what any task of the
    second level holds is bounded by the calendar, not by the rows.

    Rows without a start, and rows whose end is not after their start, cover
    nothing and are left out; repeated rows count once; an empty table gives an
    empty result; null keys are keys like others; other columns are ignored.
    """
    k = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keys)]
    ks = [f"_k{i}" for i in range(len(keys))]
    first, last = F.unix_date(F.col(f"`{start}`").cast("date")), F.unix_date(F.col(f"`{end}`").cast("date"))
    tail = F.floor(F.unix_date(F.lit(last_shard_from).cast("date")) / F.lit(shard_days)).cast("int")
    shard = lambda c: F.least(F.floor(c / F.lit(shard_days)).cast("int"), tail)

    longest = (
        df.select(*k, first.alias("_s"), F.coalesce(last, F.lit(OPEN_DAY)).alias("_e"))
        .where(F.col("_s").isNotNull() & (F.col("_e") > F.col("_s")))
        .groupBy(*ks, "_s")
        .agg(F.max("_e").alias("_e"))
    )
    low = F.col("_sh") * shard_days
    high = F.when(F.col("_sh") < tail, low + shard_days).otherwise(F.lit(OPEN_DAY))
    pieces = longest.withColumn("_sh", F.explode(F.sequence(shard(F.col("_s")), shard(F.col("_e") - 1)))).select(
        *ks, "_sh", F.greatest("_s", low).alias("_s"), F.least("_e", high).alias("_e")
    )
    local = _coalesce(pieces, [*ks, "_sh"])
    edge = ((F.col("_s") == low) | (F.col("_e") == high)).alias("_edge")
    covered = _coalesce(local.select(*ks, edge, "_s", "_e"), [*ks, "_edge"])

    follows = F.lead("_s").over(Window.partitionBy(*ks).orderBy("_s"))
    spans = covered.select(*ks, "_s", "_e", follows.alias("_n")).select(
        *ks,
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.lit("covered").alias("span_kind"), F.col("_s").alias("a"), F.col("_e").alias("b")),
                    F.when(F.col("_n").isNotNull(), F.struct(F.lit("gap").alias("span_kind"), F.col("_e").alias("a"), F.col("_n").alias("b"))),
                )
            )
        ).alias("_x"),
    )
    return spans.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keys)],
        F.col("_x.span_kind").alias("span_kind"),
        F.date_from_unix_date("_x.a").alias("start_date"),
        F.date_from_unix_date("_x.b").alias("end_date"),
    )


def _coalesce(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Merge the overlapping or touching [_s, _e) of each `by`."""
    w = Window.partitionBy(*by).orderBy("_s", "_e")
    before = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        df.withColumn("_new", F.when(F.col("_s") <= before, 0).otherwise(1))
        .withColumn("_i", island)
        .groupBy(*by, "_i")
        .agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
        .drop("_i")
    )
