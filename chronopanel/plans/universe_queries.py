"""Universes at every month start: members, availability, reasons of exclusion, eligible sets and their coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.operators import asof
from chronopanel.operators.claims import reuse_gaps
from chronopanel.operators.universe import PERMISSIVE, STRICT, availability, judged, member_months
from chronopanel.plans.claims_queries import E3, SQL as CLAIMS_SQL, _BAD, _BD, _CL, _claims
from chronopanel.plans.fixtures import MONTHS, PANEL, PROBES, month_bounds, panel, probes
from chronopanel.session import checkpoint, table

POLICIES = (STRICT, PERMISSIVE)


def members(spark: SparkSession, d: str) -> DataFrame:
    c = _claims(spark, d).where("confidence in ('verified', 'unverified')")
    return member_months(c, *month_bounds(spark, d))


def E1(spark: SparkSession, d: str) -> DataFrame:
    """Status of each member at each month start, from prices up to it."""
    have = panel(spark, d).groupBy("security_id").agg(F.min("date").alias("first_price"))
    sec = table(spark, d, "securities").select("security_id", "active_flag", "delisted_date")
    j = members(spark, d).join(have, "security_id", "left").join(sec, "security_id", "left")
    status = F.when(F.col("security_id").isNull(), "unresolved_identifier").when(F.col("first_price") <= F.col("as_of"), "usable_price_data").when(~F.col("active_flag") | F.col("delisted_date").isNotNull(), "known_delisted_unavailable_price").otherwise("known_constituent_no_price_data")
    return j.select("index_name", "as_of", "ticker", "security_id", status.alias("status"))


def E2(spark: SparkSession, d: str) -> DataFrame:
    """Availability at each probe: nearness, lookback, completeness and volume over the last 252 rows."""
    a = availability(probes(spark, d), panel(spark, d))
    return a.select("security_id", "as_of", "near_date", "lookback", F.round("completeness", 4).alias("completeness"), "liquidity")


def universe(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate of every month start under both policies, with the reason it is left out or null."""
    m = members(spark, d)
    bars = panel(spark, d)
    sec = table(spark, d, "securities").where("security_id is not null").select("security_id", "identifier_quality", F.lit(True).alias("known_security"))
    flagged = reuse_gaps(_claims(spark, d).where("removal_date is null or removal_date > effective_date"), "ticker", "effective_date", "removal_date", 730).select("ticker", F.lit(True).alias("flagged"))
    bad = bars.groupBy("security_id").agg(F.avg((F.col("price_data_quality") == "suspicious").cast("double")).alias("bad_share"))
    passed = E3(spark, d).select("security_id", F.col("passed").alias("passed_filters"))
    at = availability(m.where("security_id is not null").select("security_id", "as_of").distinct(), bars)
    c = m.join(sec, "security_id", "left").join(flagged, "ticker", "left").join(bad, "security_id", "left").join(passed, "security_id", "left").join(at, ["security_id", "as_of"], "left")
    no = F.lit(False)
    c = c.withColumns({k: F.coalesce(k, no) for k in ("known_security", "flagged", "passed_filters", "any_data", "near_date", "lookback", "liquidity")}).withColumn("completeness", F.coalesce("completeness", F.lit(0.0)))
    return judged(c, POLICIES).select("policy", "index_name", "as_of", "ticker", "security_id", "reason")


def E4(spark: SparkSession, d: str) -> DataFrame:
    return universe(spark, d)


def eligible(spark: SparkSession, d: str) -> DataFrame:
    """(policy, as_of, security_id) that pass; a security in two indexes counts once. Cut, as every strategy reads it."""
    return checkpoint(universe(spark, d).where("reason is null").select("policy", "as_of", "security_id").distinct())


def E6(spark: SparkSession, d: str) -> DataFrame:
    return universe(spark, d).where("reason is null").select("policy", "as_of", "security_id").distinct()


def A20(spark: SparkSession, d: str) -> DataFrame:
    """Coverage per policy and month start: candidates, usable, and counts of reasons."""
    r = F.col("reason")
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    return (
        universe(spark, d)
        .groupBy("policy", "as_of")
        .agg(F.count(F.lit(1)).alias("candidates"), n(r.isNull(), "usable"), n(r.contains("policy"), "excluded_by_quality"), n(r == "no_data", "without_data"), n(r.contains("identity_unresolved"), "identity_unresolved"), n(r == "short_history_by_policy", "partial_history"))
    )


def J16(spark: SparkSession, d: str) -> DataFrame:
    """The eligible set in force on every session: the latest monthly set at or before it."""
    sets = E6(spark, d).where("policy = 'PERMISSIVE'").select("as_of", "security_id")
    at = sets.select("as_of").distinct().withColumn("g", F.lit(1))
    days = table(spark, d, "trading_sessions").select(F.col("session_date").alias("day")).dropna().distinct().withColumn("g", F.lit(1))
    force = asof.asof_backward(days, at, ["g"], "day", "as_of", []).where("fact_time is not null").select("day", F.col("fact_time").alias("as_of"))
    return sets.groupBy("as_of").agg(F.count(F.lit(1)).alias("n"), F.min("security_id").alias("first_id"), F.max("security_id").alias("last_id")).join(F.broadcast(force), "as_of").select("day", "as_of", "n", "first_id", "last_id")


QUERIES = {"E1_universe_status": E1, "E2_availability": E2, "E4_universe": E4, "E6_eligible_sets": E6, "A20_coverage": A20, "J16_eligible_on_day": J16}

_ENT = "coalesce(security_id::varchar, 'unresolved:' || ticker)"
_MM = f"mm as (select index_name, as_of, membership_id, security_id, ticker from months join cl on effective_date <= as_of and (removal_date is null or removal_date > as_of) and confidence in ('verified', 'unverified') qualify row_number() over (partition by index_name, as_of, {_ENT} order by membership_id) = 1)"
_BARS = "w as (select *, count(*) over f as found, first_value(date) over f as earliest, bool_or(volume > 0) over f as traded from panel window f as (partition by security_id order by date rows 251 preceding))"
_AV = f"""pts as (select distinct security_id, as_of from mm where security_id is not null), av0 as (select p.security_id, p.as_of, b.date, b.found, b.earliest, b.traded from pts p asof left join w b on p.security_id = b.security_id and p.as_of >= b.date),
 av as (select security_id, as_of, date is not null as any_data, coalesce(as_of - date < 5, false) as near, coalesce(found >= 252, false) as lookback, coalesce(found / nullif({_BD.format('earliest', 'as_of')}, 0), 0) as completeness, coalesce(traded, false) as liquid from av0)"""
_GAPS = "fl as (select distinct ticker from (select ticker, removal_date as e, lead(effective_date) over (partition by ticker order by effective_date, removal_date nulls first) as n from (select distinct ticker, effective_date, removal_date from cl where effective_date is not null and (removal_date is null or removal_date > effective_date))) where n - e >= 730)"
_F3 = f"f3 as (select security_id, passed from ({CLAIMS_SQL['E3_universe_filters']}))"


def _case(full: bool, least: float) -> str:
    strict = "when s.identifier_quality = 'unresolved' then 'identity_unresolved_by_policy' when fl.ticker is not null then 'review_flagged_by_policy'" if full else ""
    whole = f"when not (near and lookback and liquid and completeness >= {least}) then 'short_history_by_policy'" if full else ""
    return f"case when mm.security_id is null then 'identity_unresolved' when s.security_id is null then 'security_row_not_found' {strict} when not coalesce(any_data, false) then 'no_data' {whole} when completeness < {least} then 'incomplete' when not lookback then 'short_lookback' when not liquid then 'no_volume' when not coalesce(passed, false) then 'failed_filters' end"


_J = "from mm left join securities s on s.security_id = mm.security_id left join fl on fl.ticker = mm.ticker left join av on av.security_id = mm.security_id and av.as_of = mm.as_of left join f3 on f3.security_id = mm.security_id"
_UNI = f"{PANEL}, {MONTHS}, {_CL}, {_MM}, {_BARS}, {_AV}, {_GAPS}, {_F3}, un as (select 'STRICT' as policy, index_name, mm.as_of, mm.ticker, mm.security_id, {_case(True, 0.95)} as reason {_J} union all select 'PERMISSIVE', index_name, mm.as_of, mm.ticker, mm.security_id, {_case(False, 0.8)} {_J})"
_EL = f"{_UNI}, el as (select distinct policy, as_of, security_id from un where reason is null)"
SQL = {
    "E1_universe_status": f"with {PANEL}, {MONTHS}, {_CL}, {_MM}, f as (select security_id, min(date) as first_price from panel group by 1) select o.index_name, o.as_of, o.ticker, o.security_id, case when o.security_id is null then 'unresolved_identifier' when f.first_price <= o.as_of then 'usable_price_data' when not s.active_flag or s.delisted_date is not null then 'known_delisted_unavailable_price' else 'known_constituent_no_price_data' end as status from mm o left join f on f.security_id = o.security_id left join securities s on s.security_id = o.security_id",
    "E2_availability": f"with {PANEL}, {MONTHS}, {PROBES}, {_BARS}, a as (select p.security_id, p.as_of, b.date, b.found, b.earliest, b.traded from probes p asof left join w b on p.security_id = b.security_id and p.as_of >= b.date), c as (select *, {_BD.format('earliest', 'as_of')} as bd from a) select security_id, as_of, coalesce(as_of - date < 5, false) as near_date, coalesce(found >= 252, false) as lookback, round(coalesce(case when bd > 0 then found / bd end, 0.0), 4) as completeness, coalesce(traded, false) as liquidity from c",
    "E4_universe": f"with {_UNI} select policy, index_name, as_of, ticker, security_id, reason from un",
    "E6_eligible_sets": f"with {_EL} select * from el",
    "A20_coverage": f"with {_UNI} select policy, as_of, count(*) as candidates, count(*) - count(reason) as usable, count(case when contains(reason, 'policy') then 1 end) as excluded_by_quality, count(case when reason = 'no_data' then 1 end) as without_data, count(case when contains(reason, 'identity_unresolved') then 1 end) as identity_unresolved, count(case when reason = 'short_history_by_policy' then 1 end) as partial_history from un group by 1, 2",
    "J16_eligible_on_day": f"with {_EL}, s as (select as_of, count(*) as n, min(security_id) as first_id, max(security_id) as last_id from el where policy = 'PERMISSIVE' group by 1), x as (select d.day, (select max(as_of) from s where s.as_of <= d.day) as as_of from (select distinct session_date as day from trading_sessions where session_date is not null) d) select day, s.as_of, n, first_id, last_id from x join s using (as_of)",
}
