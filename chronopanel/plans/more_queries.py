"""Guards, cross references, routings and composites of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronopanel.functions.keys import source_key, ticker_key
from chronopanel.operators import asof, trailing, upsert
from chronopanel.operators.adjust import split_kind
from chronopanel.operators.quality import bad_ohlc
from chronopanel.operators.ranking import number_rows
from chronopanel.plans.claims_queries import SQL as CLAIMS_SQL, _claims
from chronopanel.plans.feature_queries import _F1, FAMILIES, family_features
from chronopanel.plans.fixtures import MONTHS, PANEL, PROBES, months, panel, probes
from chronopanel.session import table
from chronopanel.sources import readers


def P14(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d)
    out = (F.col("open") > F.col("high")) | (F.col("open") < F.col("low"))
    return p.agg(F.count_if(out).alias("violations"), F.count_if(out & bad_ohlc()).alias("known"), (F.count_if(out) == F.count_if(out & bad_ohlc())).alias("all_known"))


def A33(spark: SparkSession, d: str) -> DataFrame:
    """Share of probes whose next session lacks an open."""
    p = panel(spark, d)
    cal = p.select("date").distinct().withColumn("g", F.lit(1))
    at = asof.asof_forward(months(spark, d).withColumn("g", F.lit(1)), cal, ["g"], "as_of", "date", []).select("as_of", F.col("fact_time").alias("date")).where("date is not null")
    j = probes(spark, d).join(F.broadcast(at), "as_of").join(p.select("security_id", "date", "open"), ["security_id", "date"], "left")
    return j.groupBy("as_of").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("open").isNull()).alias("without_open"), F.round(F.avg(F.col("open").isNull().cast("double")), 6).alias("share"))


def W16(spark: SparkSession, d: str) -> DataFrame:
    """Overnight log returns per year; the session's own close is not needed."""
    p = panel(spark, d)
    cal = F.broadcast(asof.sessions(p, "date").select("date", "prev_session"))
    w = trailing.series()
    j = p.join(cal, "date").withColumn("pd", F.lag("date").over(w)).withColumn("pc", F.lag("close").over(w))
    r = F.when((F.col("pd") == F.col("prev_session")) & (F.col("open") > 0) & (F.col("pc") > 0), F.ln(F.col("open") / F.col("pc")))
    return j.withColumn("r", r).groupBy(F.year("date").alias("year")).agg(F.count("r").alias("pairs"), F.round(F.avg("r"), 8).alias("mean"))


def W18(spark: SparkSession, d: str) -> DataFrame:
    """Deepest fall below the running peak of each security."""
    w = trailing.series().rowsBetween(Window.unboundedPreceding, 0)
    p = panel(spark, d).withColumn("peak", F.max("close").over(w)).where("peak > 0")
    return p.groupBy("security_id").agg(F.round(F.min((F.col("close") - F.col("peak")) / F.col("peak")), 6).alias("max_drawdown"))


def O5(spark: SparkSession, d: str) -> DataFrame:
    """The first thirty flagged bars by date: a report, so the limit is the feature."""
    return panel(spark, d).where("price_data_quality <> 'ok'").select("security_id", "date", "price_data_quality").orderBy("date", "security_id").limit(30)


def O7(spark: SparkSession, d: str) -> DataFrame:
    """Tickers in order of first appearance."""
    t = _claims(spark, d).groupBy("ticker").agg(F.min("membership_id").alias("first_id"))
    return number_rows(t, [], ["first_id"], "place")


def I1(spark: SparkSession, d: str) -> DataFrame:
    """Tickers without a security, with surrogate ids after the greatest there is."""
    s = table(spark, d, "securities")
    have = s.select(ticker_key("primary_ticker").alias("ticker"))
    new = _claims(spark, d).select("ticker").distinct().join(have, "ticker", "left_anti")
    return upsert.with_surrogate(new, "n", ["ticker"])


def I7(spark: SparkSession, d: str) -> DataFrame:
    """How each claim's ticker finds a security: by its own ticker, by a former one, or not."""
    now = table(spark, d, "securities").select(ticker_key("primary_ticker").alias("ticker"), F.lit("present").alias("a")).where("ticker is not null").distinct()
    old = table(spark, d, "ticker_history").select(ticker_key("ticker").alias("ticker"), F.lit("former").alias("b")).where("ticker is not null").distinct()
    c = _claims(spark, d).join(now, "ticker", "left").join(old, "ticker", "left")
    return c.groupBy(F.coalesce("a", "b", F.lit("none")).alias("found_by")).agg(F.count(F.lit(1)).alias("claims"), F.countDistinct("ticker").alias("tickers"))


def I11(spark: SparkSession, d: str) -> DataFrame:
    """Splits routed by ratio: genuine ones by direction, others noted as artifacts."""
    a = table(spark, d, "corporate_actions").where("action_type in ('split', 'reverse_split')")
    kind = split_kind(F.col("ratio_or_value"))
    route = F.when(kind == "genuine", F.when(F.col("ratio_or_value") > 1, "split").otherwise("reverse_split")).otherwise("artifact")
    note = F.concat_ws(" | ", "detail", F.when(kind != "genuine", F.lit("likely spin-off")))
    return a.select("security_id", "ex_date", "ratio_or_value", route.alias("route"), note.alias("note")).distinct()


def S3(spark: SparkSession, d: str) -> DataFrame:
    wide = readers.evolve(table(spark, d, "data_sources"), {"tier": "string", "retired": "boolean", "rows_seen": "long"})
    return wide.select("source_id", "source_name", F.coalesce("retired", F.lit(False)).alias("retired"), F.coalesce("rows_seen", F.lit(0).cast("long")).alias("rows_seen"))


def S24(spark: SparkSession, d: str) -> DataFrame:
    """Get-or-create of a source dimension: names of the claims and feeds, numbered."""
    a = table(spark, d, "membership_records").select(source_key("source_name").alias("name"))
    b = table(spark, d, "data_sources").select(source_key("source_name").alias("name"))
    return upsert.with_surrogate(a.union(b).where("name is not null").distinct(), "id", ["name"])


#: Traded values, given to the unit; all other features to six places.
_WHOLE = ("dollar_volume", "rolling_avg_dollar_volume_20d")


def M1(spark: SparkSession, d: str) -> DataFrame:
    """The feature matrix: every probe with the 18 features of the five families."""
    return family_features(spark, d).select("security_id", "as_of", *[F.round(c, 0 if c in _WHOLE else 6).alias(c) for x in FAMILIES.values() for c in x])


QUERIES = {
    "P14_violations_known": P14, "A33_open_coverage": A33, "W16_overnight_panel": W16, "W18_running_peak": W18, "O5_flagged_sample": O5, "O7_ordered_tickers": O7, "I1_new_securities": I1,
    "I7_rename_fallback": I7, "I11_split_routing": I11, "S3_schema_evolution": S3, "S24_source_dimension": S24, "M1_feature_matrix": M1,
}

_K = "nullif(regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g'), '')"
_CL = CLAIMS_SQL["I3_claims_ingest"].split("with ", 1)[1].split(", n as (", 1)[0]
_P = f"with {PANEL}, {MONTHS}, {PROBES}"
_OUT = "open > high or open < low"
_BAD = "high < low or high < open or high < close or low > open or low > close or open <= 0 or close <= 0"
_DD = """n0 as (select *, row_number() over (partition by security_id order by date) as n from panel), s0 as (select p.security_id, p.as_of, b.n from probes p asof left join n0 b on p.security_id = b.security_id and p.as_of >= b.date),
 x0 as (select s0.security_id, s0.as_of, n0.close, max(n0.close) over (partition by s0.security_id, s0.as_of order by n0.n) as peak from s0 join n0 on n0.security_id = s0.security_id and n0.n between s0.n - 251 and s0.n where s0.n >= 252),
 mdd as (select security_id, as_of, min(least(0, case when peak > 0 then (close - peak) / peak else 0 end)) as max_drawdown_252d from x0 group by 1, 2)"""
_PV = """se as (select date, lag(date) over (order by date) as prev_session, row_number() over (order by date) as i from (select distinct date from panel)), mi as (select as_of, max(i) as i from months join se on date <= as_of group by 1),
 wn as (select mi.as_of, se.date, se.prev_session from mi join se on se.i between mi.i - 62 and mi.i), lb as (select security_id, max(date) as last from panel group by 1),
 rr as (select a.security_id, a.date, a.close / b.close - 1 as r, last from panel a join se on se.date = a.date join panel b on b.security_id = a.security_id and b.date = se.prev_session join lb on lb.security_id = a.security_id where b.close <> 0),
 pv as (select as_of, stddev_samp(m) as proxy_index_volatility from (select as_of, wn.date, avg(r) as m from wn join rr on rr.date = wn.date where as_of <= last + 40 group by 1, 2) group by 1)"""
_MR = "case when {0} is not null and count({0}) over (partition by fat.as_of) >= 2 then (rank() over (partition by fat.as_of order by {0} nulls last) - 1 + 0.5 * count(*) over (partition by fat.as_of, {0})) / count({0}) over (partition by fat.as_of) end"
_KIND = "list_bool_or([abs(ratio_or_value - c) / c <= 0.03 for c in [1.5,2,2.5,3,4,5,6,7,8,10,15,20,25,50,100]] || [abs(ratio_or_value - 1/c) / (1/c) <= 0.03 for c in [1.5,2,2.5,3,4,5,6,7,8,10,15,20,25,50,100]])"


SQL = {
    "P14_violations_known": f"with {PANEL}, v as (select count(case when {_OUT} then 1 end) as violations, count(case when ({_OUT}) and ({_BAD}) then 1 end) as known from panel) select violations, known, violations = known as all_known from v",
    "A33_open_coverage": f"{_P}, s as (select as_of, (select min(date) from panel where date >= as_of) as date from months) select p.as_of, count(*) as pairs, count(*) - count(b.open) as without_open, round(1 - count(b.open) / count(*), 6) as share from probes p join s using (as_of) left join panel b on b.security_id = p.security_id and b.date = s.date where s.date is not null group by 1",
    "W16_overnight_panel": f"with {PANEL}, cal as (select date, lag(date) over (order by date) as prev_session from (select distinct date from panel)), j as (select p.*, prev_session, lag(p.date) over w as pd, lag(close) over w as pc from panel p join cal using (date) window w as (partition by security_id order by p.date)), r as (select year(date)::bigint as year, case when pd = prev_session and open > 0 and pc > 0 then ln(open / pc) end as r from j) select year, count(r) as pairs, round(avg(r), 8) as mean from r group by 1",
    "W18_running_peak": f"with {PANEL}, p as (select *, max(close) over (partition by security_id order by date) as peak from panel) select security_id, round(min((close - peak) / peak), 6) as max_drawdown from p where peak > 0 group by 1",
    "O5_flagged_sample": f"with {PANEL} select security_id, date, price_data_quality from panel where price_data_quality <> 'ok' order by date, security_id limit 30",
    "O7_ordered_tickers": f"with {_CL}, t as (select ticker, min(membership_id) as first_id from cl group by 1) select ticker, first_id, row_number() over (order by first_id) as place from t",
    "I1_new_securities": f"with {_CL}, t as (select distinct ticker from cl where ticker not in (select {_K.format('primary_ticker')} from securities where {_K.format('primary_ticker')} is not null)) select ticker, row_number() over (order by ticker) as n from t",
    "I7_rename_fallback": f"with {_CL}, x as (select ticker, case when ticker in (select {_K.format('primary_ticker')} from securities where {_K.format('primary_ticker')} is not null) then 'present' when ticker in (select {_K.format('ticker')} from ticker_history where {_K.format('ticker')} is not null) then 'former' else 'none' end as found_by from cl) select found_by, count(*) as claims, count(distinct ticker) as tickers from x group by 1",
    "I11_split_routing": f"select distinct security_id, ex_date, ratio_or_value, case when {_KIND} then case when ratio_or_value > 1 then 'split' else 'reverse_split' end else 'artifact' end as route, concat_ws(' | ', detail, case when not {_KIND} then 'likely spin-off' end) as note from corporate_actions where action_type in ('split', 'reverse_split')",
    "S3_schema_evolution": "select source_id, source_name, false as retired, 0::bigint as rows_seen from data_sources",
    "S24_source_dimension": "with t as (select regexp_replace(lower(source_name), '\\s+', '', 'g') as name from membership_records union select regexp_replace(lower(source_name), '\\s+', '', 'g') from data_sources) select name, row_number() over (order by name) as id from t where name is not null",
    "M1_feature_matrix": f"""{_P}, {_F1}, {_DD}, {_PV}, z as (select sid as security_id, fat.as_of, fat.* exclude (sid, as_of), max_drawdown_252d, return_3m - avg(return_3m) over (partition by fat.as_of) as return_relative_to_eligible_mean_63d,
      {_MR.format('return_12m')} as momentum_percentile_rank, {_MR.format('realised_volatility_63d')} as volatility_percentile_rank, avg(return_3m) over (partition by fat.as_of) as proxy_index_trend, proxy_index_volatility,
      avg(case when distance_from_200d_ma > 0 then 1.0 when distance_from_200d_ma <= 0 then 0.0 end) over (partition by fat.as_of) as breadth_proxy
      from (select * from fat) fat left join mdd on mdd.security_id = fat.sid and mdd.as_of = fat.as_of left join pv on pv.as_of = fat.as_of)
      select security_id, as_of, {', '.join(f"round({c}, {0 if c in _WHOLE else 6}) as {c}" for x in FAMILIES.values() for c in x)} from z""",
}
