"""One surviving record per group of duplicates by iterative truth discovery."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.session import checkpoint


def chain_groups(df: DataFrame, keys: Sequence[str], date: str, row_id: str, gap_days: int) -> DataFrame:
    """df with group_id and group_size: rows whose dates follow each other closely.

    A group is a longest run of rows of equal keys whose sorted dates are at
    most `gap_days` apart; its id is its smallest `row_id`. Only an entity's
    distinct dates are sorted in one task; rows of one date are combined before
    the shuffle. Rows with a null key or date get no group and are left out.
    """
    by = Window.partitionBy(*keys).orderBy(date)
    days = df.dropna(subset=[*keys, date]).groupBy(*keys, date).agg(F.min(row_id).alias("_id"), F.count(F.lit(1)).alias("_n"))
    new = F.when(F.datediff(F.col(date), F.lag(date).over(by)) <= gap_days, 0).otherwise(1)
    days = days.withColumn("_new", new).withColumn("_c", F.sum("_new").over(by))
    chain = Window.partitionBy(*keys, "_c")
    days = days.select(*keys, date, F.min("_id").over(chain).alias("group_id"), F.sum("_n").over(chain).alias("group_size"))
    return df.join(days, [*keys, date])


def best_claims(claims: DataFrame, *, group: str, claim_id: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """For each group and field the greatest claim by `order` that has a value in the field.

    Returns the group, field_name, `claim_id` and value. One aggregate, combined
    before the shuffle, so a group of any size is no more than a row a field and
    task. Nulls come last in each ground; of claims equal in all of `order` the
    greatest value wins, so end `order` in a unique column. A null is no value;
    a group or field without one has no row, an empty table gives none.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v")) for f in fields])).alias("cell")
    long = claims.select(F.col(group).alias("g"), F.col(claim_id).alias("id"), F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]).alias("o"), cells).where("cell.v is not null")
    best = long.groupBy("g", F.col("cell.f").alias("f")).agg(F.max(F.struct("o", F.col("cell.v").alias("v"), "id")).alias("b"))
    return best.select(F.col("g").alias(group), F.col("f").alias("field_name"), F.col("b.id").alias(claim_id), F.col("b.v").alias("value"))


def discover_truth(
    claims: DataFrame,
    *,
    group: str,
    claim_id: str,
    source: str,
    weight: Column,
    fields: Sequence[str],
    tolerance: float = 1e-4,
    prior: tuple[float, float] = (4.0, 1.0),
) -> tuple[DataFrame, DataFrame]:
    """The best supported value of every field of every group, and each source's reliability.

    claims: one row per claim and group; a null in a field is no claim about it.
    Alternates until no reliability moves by more than `tolerance`:

    * votes: a value's support is the sum over the claims of it of the claim's
      `weight` times its source's reliability; the best supported value is the
      group's truth for the field;
    * reliability: the weighted share of a source's values that are the truth,
      smoothed by `prior` (agreeing and disagreeing pseudo-votes).

    From the tenth round on a reliability moves only by 1 / (round - 8) of the
    way, so the alternation ends also where two states take turns. Ties end with
    the greatest value.

    Returns (values, sources): values has the group, field_name, value,
    `claim_id` of the best claim of that value (by weight, then id), support as
    a share of the field's votes, and votes; sources has the source,
    reliability and its number of votes.

    Claims are first counted per (group, field, value, source), combined before
    the shuffle, so a group of any size takes as many rows as it has distinct
    values and sources. A null source is a source of its own, repeated claims
    vote twice, an empty table gives empty results, a group of one claim gives
    its values.
    """
    rank = F.struct(weight.alias("w"), F.col(claim_id).alias("id"))
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"v_{f}").alias("v")) for f in fields])).alias("cell")
    long = claims.select(F.col(group).alias("g"), F.coalesce(F.col(source), F.lit("")).alias("s"), weight.cast("double").alias("wt"), rank.alias("r"), *[F.col(f).cast("string").alias(f"v_{f}") for f in fields])
    long = long.select("g", "s", "wt", "r", cells)
    votes = (
        long.where("cell.v is not null")
        .groupBy("g", F.col("cell.f").alias("f"), F.col("cell.v").alias("v"), "s")
        .agg(F.sum("wt").alias("wt"), F.max("r").alias("r"))
    )
    votes = checkpoint(votes)
    reliability = votes.select("s").distinct().withColumn("rel", F.lit(prior[0] / sum(prior)))

    def choose(rel: DataFrame) -> DataFrame:
        support = votes.join(rel, "s").groupBy("g", "f", "v").agg(F.sum(F.col("wt") * F.col("rel")).alias("sup"), F.max("r").alias("r"))
        first = F.struct(F.round("sup", 9).alias("sup"), F.col("v"))
        return support.groupBy("g", "f").agg(F.max_by(F.struct("v", "r.id", "sup"), first).alias("best"), F.sum("sup").alias("total"))

    for i in count(1):
        truth = choose(reliability).select("g", "f", F.col("best.v").alias("t"))
        agree = F.when(F.col("v") == F.col("t"), F.col("wt")).otherwise(0.0)
        share = (F.sum(agree) + prior[0]) / (F.sum("wt") + sum(prior))
        step = 1.0 if i < 10 else 1.0 / (i - 8)
        fresh = votes.join(truth, ["g", "f"]).groupBy("s").agg(share.alias("new")).join(reliability, "s")
        fresh = checkpoint(fresh.select("s", (F.col("rel") + step * (F.col("new") - F.col("rel"))).alias("rel"), F.abs(step * (F.col("new") - F.col("rel"))).alias("moved")))
        moved = fresh.agg(F.max("moved")).first()[0]
        reliability = fresh.select("s", "rel")
        if moved is None or moved <= tolerance:
            break
    values = choose(reliability).select(
        F.col("g").alias(group), F.col("f").alias("field_name"), F.col("best.v").alias("value"), F.col("best.id").alias(claim_id), F.try_divide(F.col("best.sup"), F.col("total")).alias("support"), F.col("total").alias("votes")
    )
    sources = votes.groupBy("s").agg(F.sum("wt").alias("votes")).join(reliability, "s").select(F.col("s").alias(source), F.col("rel").alias("reliability"), "votes")
    return values, sources
