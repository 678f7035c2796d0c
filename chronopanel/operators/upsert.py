"""Idempotent loads: first wins, latest wins, anti joins and surrogate keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.operators.ranking import number_rows


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key by a total order: an aggregate, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), F.struct(*order)).alias("_b")
    return df.groupBy(*keys).agg(pick).select(*keys, "_b.*").select(*df.columns)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by(F.struct(*rest), F.struct(*order)).alias("_b")
    return df.groupBy(*keys).agg(pick).select(*keys, "_b.*").select(*df.columns)


def insert_new(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Rows to append to target: the first of each key that target does not have (nulls equal)."""
    fresh = first_per_key(rows, keys, order)
    have = target.select(*keys).distinct().alias("t")
    cond = None
    for k in keys:
        c = F.col(f"f.{k}").eqNullSafe(F.col(f"t.{k}"))
        cond = c if cond is None else cond & c
    return fresh.alias("f").join(have, cond, "left_anti")


def overwrite_latest(target: DataFrame, rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """target with rows put in by key, the greatest version winning."""
    return latest_per_key(target.unionByName(rows, allowMissingColumns=True), keys, [version])


def with_surrogate(df: DataFrame, name: str, order: Sequence[Column | str], start: int = 1) -> DataFrame:
    """df with dense numbers in order of `order`, which must be total.

    The rows are range-partitioned and numbered where they lie, so none of the
    tasks sorts all of them.
    """
    out = number_rows(df, [], order, name)
    return out.withColumn(name, F.col(name) + (start - 1))


def update_metadata(target: DataFrame, updates: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """target with the updates' values put where its own are null; keys without an update stay."""
    u = updates.select(key, *[F.col(c).alias(f"_u_{c}") for c in columns])
    rest = [F.coalesce(c, f"_u_{c}").alias(c) if c in columns else F.col(c) for c in target.columns]
    return target.join(u, key, "left").select(*rest)
