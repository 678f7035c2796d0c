"""Universes as of a date: members, availability, and one reason for each candidate left out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.operators import asof, trailing
from chronopanel.operators.calendar import business_days


@dataclass(frozen=True)
class Policy:
    """What a universe demands of a candidate; `bad_share` None demands nothing of its bars."""

    name: str
    completeness: float
    full_history: bool = False
    resolved_only: bool = False
    unflagged_only: bool = False
    bad_share: float | None = None


STRICT = Policy("STRICT", 0.95, full_history=True, resolved_only=True, unflagged_only=True)
PERMISSIVE = Policy("PERMISSIVE", 0.80)


def member_months(claims: DataFrame, first: str, last: str) -> DataFrame:
    """One claim per index, month start and entity: the smallest membership_id that holds there.

    claims: membership_id, security_id, ticker, index_name, effective_date and
    removal_date (null is open). A claim's months are generated from its bounds,
    so there is no range join; the entity is the security, or the ticker where
    it is unresolved. Months run from `first` to `last`.
    """
    lo, hi = F.lit(first).cast("date"), F.lit(last).cast("date")
    entity = F.coalesce(F.col("security_id").cast("string"), F.concat(F.lit("unresolved:"), "ticker"))
    a = F.greatest(F.when(F.dayofmonth("effective_date") == 1, F.col("effective_date")).otherwise(F.add_months(F.trunc("effective_date", "month"), 1)), lo)
    z = F.least(F.coalesce(F.trunc(F.date_sub("removal_date", 1), "month"), hi), hi)
    on = claims.where("effective_date is not null").withColumn("_a", a).withColumn("_z", z).where("_a <= _z")
    on = on.select("index_name", entity.alias("entity"), "membership_id", "security_id", "ticker", F.explode(F.expr("sequence(_a, _z, interval 1 month)")).alias("as_of"))
    one = on.groupBy("index_name", "as_of", "entity").agg(F.min(F.struct("membership_id", "security_id", "ticker")).alias("m"))
    return one.select("index_name", "as_of", "entity", "m.membership_id", "m.security_id", "m.ticker")


def availability(points: DataFrame, bars: DataFrame, lookback: int = 252, near_days: int = 5) -> DataFrame:
    """points (security_id, as_of) with what their last `lookback` bars up to as_of are like.

    any_data, near_date (a bar less than near_days back), lookback, completeness
    (bars found per weekday from the earliest of them, unrounded), liquidity (a
    positive volume among them). Bars after as_of are never seen: they enter
    only by an as-of join.
    """
    w = trailing.series()
    p = trailing.cumulated(bars, {"traded": F.when(F.col("volume") > 0, 1)})
    earliest = F.coalesce(F.lag("date", lookback - 1).over(w), F.first("date").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.select("security_id", "date", F.least(F.row_number().over(w), F.lit(lookback)).alias("found"), earliest.alias("earliest"), (trailing.count("traded", lookback) > 0).alias("traded"))
    a = asof.asof_backward(points, p, ["security_id"], "as_of", "date", ["found", "earliest", "traded"])
    share = F.try_divide(F.col("found"), business_days(F.col("earliest"), F.col("as_of")))
    no = F.lit(False)
    return a.select(
        *points.columns,
        F.col("fact_time").isNotNull().alias("any_data"),
        F.coalesce(F.datediff("as_of", "fact_time") < near_days, no).alias("near_date"),
        F.coalesce(F.col("found") >= lookback, no).alias("lookback"),
        F.coalesce(share, F.lit(0.0)).alias("completeness"),
        F.coalesce("traded", no).alias("liquidity"),
    )


def exclusion_reason(policy: Policy) -> Column:
    """The first gate a candidate fails, null if it passes all; an ordered chain over joined columns."""
    c = F.col
    whole = c("near_date") & c("lookback") & c("liquidity") & (c("completeness") >= policy.completeness)
    gates: list[tuple[Column, str]] = [(c("security_id").isNull(), "identity_unresolved"), (~c("known_security"), "security_row_not_found")]
    if policy.resolved_only:
        gates.append((F.coalesce(c("identifier_quality") == "unresolved", F.lit(False)), "identity_unresolved_by_policy"))
    if policy.unflagged_only:
        gates.append((c("flagged"), "review_flagged_by_policy"))
    gates.append((~c("any_data"), "no_data"))
    if policy.full_history:
        gates.append((~whole, "short_history_by_policy"))
    gates += [(c("completeness") < policy.completeness, "incomplete"), (~c("lookback"), "short_lookback"), (~c("liquidity"), "no_volume")]
    if policy.bad_share is not None:
        gates.append((c("bad_share") > policy.bad_share, "bad_bars_by_policy"))
    gates.append((~c("passed_filters"), "failed_filters"))
    out = F.when(*_gate(gates[0]))
    for g in gates[1:]:
        out = out.when(*_gate(g))
    return out


def _gate(g: tuple[Column, str]) -> tuple[Column, Column]:
    return F.coalesce(g[0], F.lit(False)), F.lit(g[1])


def judged(candidates: DataFrame, policies: tuple[Policy, ...]) -> DataFrame:
    """candidates once per policy with `reason`; their columns are computed once for all policies."""
    each = F.explode(F.array(*[F.struct(F.lit(p.name).alias("policy"), exclusion_reason(p).alias("reason")) for p in policies])).alias("_j")
    return candidates.select("*", each).select("_j.policy", *candidates.columns, "_j.reason")
