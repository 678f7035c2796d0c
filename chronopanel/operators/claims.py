"""Claim logs: conflicts between sources, universes as of a date, reuse gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN = "9999-12-31"


def conflicting(claims: DataFrame, keys: list[str], source: str, start: str, end: str, row_id: str) -> DataFrame:
    """Ids of claims that overlap a claim of another source on the same keys with other bounds.

    Closed intervals, a null end being open. Claims first collapse to distinct
    (keys, source, start, end). A claim conflicts exactly if, of the other
    sources' intervals with other bounds, one starts by its end and ends from
    its start on. Those with bounds of their own are compared by an equi-join
    on the keys within shards of 1,024 days, so that only claims that share
    time meet, never all pairs of a key.
    """
    e = F.coalesce(F.col(end), F.lit(OPEN).cast("date"))
    base = claims.where(F.col(start).isNotNull()).select(*keys, F.col(source).alias("_src"), F.col(start).alias("_s"), e.alias("_e"), F.col(row_id).alias("_id"))
    spans = base.select(*keys, "_src", "_s", "_e").distinct()
    tail = 24
    shard = lambda c: F.least(F.floor(F.unix_date(c) / 1024).cast("int"), F.lit(tail))
    cut = spans.withColumn("_sh", F.explode(F.sequence(shard(F.col("_s")), F.greatest(shard(F.col("_e")), shard(F.col("_s"))))))
    a, b = cut.alias("a"), cut.alias("b")
    on = (F.col("a._sh") == F.col("b._sh")) & (F.col("a._src") != F.col("b._src")) & (F.col("a._s") <= F.col("b._e")) & (F.col("b._s") <= F.col("a._e")) & ((F.col("a._s") != F.col("b._s")) | (F.col("a._e") != F.col("b._e")))
    for k in keys:
        on = (F.col(f"a.{k}") == F.col(f"b.{k}")) & on
    bad = a.join(b, on, "left_semi").select(*keys, "_src", "_s", "_e").distinct()
    return base.join(bad, [*keys, "_src", "_s", "_e"], "left_semi").select(F.col("_id").alias(row_id))


def reuse_gaps(claims: DataFrame, key: str, start: str, end: str, least_days: int = 730) -> DataFrame:
    """First gap of at least so many days between consecutive distinct periods of a key."""
    spans = claims.where(F.col(key).isNotNull() & F.col(start).isNotNull()).select(key, F.col(start).alias("_s"), F.col(end).alias("_e")).distinct()
    w = Window.partitionBy(key).orderBy("_s", F.col("_e").asc_nulls_first())
    gaps = spans.withColumn("_n", F.lead("_s").over(w)).withColumn("gap_days", F.datediff("_n", "_e")).where(F.col("gap_days") >= least_days)
    best = F.min_by(F.struct(F.col("_s").alias("period_1_start"), F.col("_e").alias("period_1_end"), F.col("_n").alias("period_2_start"), "gap_days"), F.struct("_s", "_e")).alias("b")
    return gaps.groupBy(key).agg(best).select(key, "b.*")
