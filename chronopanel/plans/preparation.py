"""Queries of the data-preparation operators (general ones)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.functions.keys import open_end, source_key, ticker_key
from chronopanel.operators.grid import regular_grid
from chronopanel.operators.history import version_history
from chronopanel.operators.intervals import merge_intervals
from chronopanel.operators.known_asof import known_asof
from chronopanel.operators.spikes import implausible_bars
from chronopanel.session import table


def usable_claims(spark: SparkSession, d: str) -> DataFrame:
    """Membership claims with a start and an end that is open or later."""
    end = open_end("removal_date")
    return table(spark, d, "membership_records").withColumn("removal_date", end).where(F.col("effective_date").isNotNull() & (end.isNull() | (end > F.col("effective_date"))))


def _iso(*names: str) -> list:
    return [F.date_format(n, "yyyy-MM-dd").alias(n) for n in names]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    key = ticker_key("ticker")
    gone = F.coalesce(F.lower(F.trim("listing_status")) == "delisted", F.lit(False))
    hist = table(spark, d, "ticker_history").select("security_id", F.col("valid_from").alias("day"), key.alias("k"), F.struct(F.lit(0).alias("late"), F.lit(None).cast("timestamp").alias("at")).alias("o")).where("k is not null")
    snap = (
        table(spark, d, "ticker_snapshots")
        .select("security_id", F.col("snapshot_date").alias("day"), F.when(~gone, key).alias("k"), F.struct(F.lit(1).alias("late"), F.col("loaded_at").alias("at")).alias("o"), gone.alias("gone"))
        .where("k is not null or gone")
        .drop("gone")
    )
    v = version_history(hist.unionByName(snap), "security_id", "day", "k", "o")
    return v.select("security_id", F.col("value").alias("ticker_key"), *_iso("valid_from", "valid_to"))


def p3_scored(spark: SparkSession, d: str) -> DataFrame:
    return implausible_bars(table(spark, d, "prices"), keys=["security_id", "source_id"], date="date", order=["ingested_at", "price_id"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_scored(spark, d).where("impossible or spike or stuck").select("security_id", "source_id", F.date_format("date", "yyyy-MM-dd").alias("bar_date"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    hit = known_asof(
        table(spark, d, "prices"), usable_claims(spark, d), entity="security_id", event_date="date", lane="index_name", claim_id="membership_id", valid_from="effective_date", valid_to="removal_date", known_from="announcement_date"
    )
    return hit.select("security_id", F.date_format("date", "yyyy-MM-dd").alias("bar_date"), "index_name", "membership_id")


def p6_grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(table(spark, d, "prices"), table(spark, d, "trading_sessions"), keys=["security_id", "source_id"], date="date", value="close", also=["volume"], order=["ingested_at", "price_id"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_grid(spark, d).where("status = 'filled'").select("security_id", "source_id", F.date_format("date", "yyyy-MM-dd").alias("missing_date"))


def p6_statuses(spark: SparkSession, d: str) -> DataFrame:
    """Per series: sessions of its span, those observed and those filled, and the observed values' sum unchanged."""
    g = p6_grid(spark, d)
    seen = F.col("status") == "observed"
    return g.groupBy("security_id", "source_id").agg(F.count(F.lit(1)).alias("sessions"), F.count_if(seen).alias("observed"), F.count_if(F.col("status") == "filled").alias("filled"), F.count_if(F.col("close").isNull()).alias("without_close"), F.round(F.sum(F.when(seen, F.col("close"))), 4).alias("observed_sum"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    claims = usable_claims(spark, d).select(ticker_key("raw_ticker").alias("ticker_key"), "index_name", source_key("source_name").alias("src"), "effective_date", F.struct("ingested_at", "membership_id", "removal_date").alias("c"))
    last = claims.where("ticker_key is not null and index_name is not null").groupBy("ticker_key", "index_name", "src", "effective_date").agg(F.max("c").alias("c"))
    spans = merge_intervals(last.select("ticker_key", "index_name", "effective_date", F.col("c.removal_date").alias("removal_date")), ["ticker_key", "index_name"], "effective_date", "removal_date")
    return spans.select("ticker_key", "index_name", "span_kind", *_iso("start_date", "end_date"))


_KEY = "nullif(regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g'), '')"
_USABLE = "(select * replace (case when removal_date < date '9999-12-31' then removal_date end as removal_date) from membership_records where effective_date is not null and (removal_date is null or removal_date > effective_date))"

QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_scored": p3_scored, "p4_found": p4_found, "p6_found": p6_found, "p6_grid": p6_grid, "p6_statuses": p6_statuses, "p7_found": p7_found}

SQL = {
    "p2_found": f"""
with obs as (
  select security_id, valid_from as day, {_KEY.format("ticker")} as k, 0 as late, null::timestamp as at_ from ticker_history
  where {_KEY.format("ticker")} is not null
  union all
  select security_id, snapshot_date, case when coalesce(lower(trim(listing_status)) = 'delisted', false) then null else {_KEY.format("ticker")} end, 1, loaded_at
  from ticker_snapshots
  where coalesce(lower(trim(listing_status)) = 'delisted', false) or {_KEY.format("ticker")} is not null
), one as (
  select * from obs where security_id is not null and day is not null
  qualify row_number() over (partition by security_id, day order by late desc, at_ desc nulls last, k desc nulls last) = 1
), turns as (
  select *, lag(k) over w as before, row_number() over w as rn from one window w as (partition by security_id order by day)
), runs as (
  select security_id, k, day, lead(day) over (partition by security_id order by day) as next_day from turns where rn = 1 or k is distinct from before
)
select security_id, k as ticker_key, strftime(day, '%Y-%m-%d') as valid_from, coalesce(strftime(next_day, '%Y-%m-%d'), '9999-12-31') as valid_to
from runs where k is not null""",
    "p4_found": f"""
with b as (select distinct security_id, date from prices where security_id is not null and date is not null),
c as (select *, coalesce(announcement_date, effective_date) as known from {_USABLE} where security_id is not null and index_name is not null),
best as (
  select b.security_id, b.date, c.index_name, arg_max({{'m': membership_id, 'r': removal_date}}, {{'k': known, 'm': membership_id}}) as x
  from b join c on b.security_id = c.security_id and c.effective_date <= b.date and c.known <= b.date
  group by all
)
select security_id, strftime(date, '%Y-%m-%d') as bar_date, index_name, x.m as membership_id from best where x.r is null or x.r > date""",
    "p6_found": """
with s as (select session_date, row_number() over (order by session_date) as i from (select distinct session_date from trading_sessions where session_date is not null)),
b as (select distinct security_id, source_id, i from prices join s on date = session_date where close is not null and not isnan(close) and security_id is not null and source_id is not null),
r as (select security_id, source_id, min(i) as a, max(i) as z from b group by all)
select r.security_id, r.source_id, strftime(s.session_date, '%Y-%m-%d') as missing_date
from r join s on s.i between r.a and r.z anti join b on b.security_id = r.security_id and b.source_id = r.source_id and b.i = s.i""".replace(
        "anti join b on b.security_id = r.security_id and b.source_id = r.source_id and b.i = s.i",
        "where not exists (select 1 from b where b.security_id = r.security_id and b.source_id = r.source_id and b.i = s.i)",
    ),
    "p6_statuses": """
with s as (select session_date, row_number() over (order by session_date) as i from (select distinct session_date from trading_sessions where session_date is not null)),
b as (select security_id, source_id, i, close from prices join s on date = session_date where close is not null and not isnan(close) and security_id is not null and source_id is not null
  qualify row_number() over (partition by security_id, source_id, date order by ingested_at desc nulls last, price_id desc) = 1),
r as (select security_id, source_id, min(i) as a, max(i) as z, count(*) as n, sum(close) as t from b group by all)
select security_id, source_id, z - a + 1 as sessions, n as observed, z - a + 1 - n as filled, 0::bigint as without_close, round(t, 4) as observed_sum from r""",
    "p7_found": f"""
with c as (
  select {_KEY.format("raw_ticker")} as ticker_key, index_name, effective_date as s, coalesce(removal_date, date '9999-12-31') as e
  from {_USABLE} where {_KEY.format("raw_ticker")} is not null and index_name is not null
  qualify row_number() over (partition by {_KEY.format("raw_ticker")}, index_name, regexp_replace(lower(source_name), '\\s+', '', 'g'), effective_date order by ingested_at desc nulls last, membership_id desc) = 1
), m as (select *, max(e) over (partition by ticker_key, index_name order by s, e rows between unbounded preceding and 1 preceding) as pe from c),
g as (select *, sum(case when s <= pe then 0 else 1 end) over (partition by ticker_key, index_name order by s, e rows unbounded preceding) as i from m),
p as (select ticker_key, index_name, min(s) as s, max(e) as e from g group by ticker_key, index_name, i),
n as (select *, lead(s) over (partition by ticker_key, index_name order by s) as ns from p)
select ticker_key, index_name, 'covered' as span_kind, strftime(s, '%Y-%m-%d') as start_date, strftime(e, '%Y-%m-%d') as end_date from n
union all
select ticker_key, index_name, 'gap', strftime(e, '%Y-%m-%d'), strftime(ns, '%Y-%m-%d') from n where ns is not null""",
}
