"""Stores of runs, reference loads, cross references, profiles and decisions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.functions.keys import ticker_key
from chronopanel.operators import asof, decisions, models, quality, upsert
from chronopanel.operators.claims import reuse_gaps
from chronopanel.operators.crosssection import rank_correlation
from chronopanel.plans.asof_queries import J13
from chronopanel.plans.claims_queries import SQL as CLAIMS_SQL, A15, _BAD, _CL, _K, _claims
from chronopanel.plans.feature_queries import _F1, LADDER, features_at, features_of
from chronopanel.plans.fixtures import MONTHS, PANEL, PROBES, month_bounds, panel, probes
from chronopanel.plans.model_queries import training_panel
from chronopanel.plans.source_queries import S18
from chronopanel.session import checkpoint, shared_folder, table
from chronopanel.sources import readers, runs


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/chronopanel-{uuid.uuid4().hex}"


def S20(spark: SparkSession, d: str) -> DataFrame:
    """Figures of every security saved as those of a run, in two writes of which the later counts, and loaded in order."""
    store = runs.RunStore(spark, _folder(spark))
    m = checkpoint(S18(spark, d).select(F.col("security_id").cast("string").alias("run_id"), "metric_name", "value"))
    run = m.select("run_id").distinct()
    store.save_run(run, m.withColumn("value", F.lit(0.0)), write=0)
    store.save_run(run, m, write=1)
    return store.load_results().select("run_id", "metric_name", "value")


def S21(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of every probe, those from 2020 on saved again by another feature: a key saved again is replaced."""
    store = runs.RunStore(spark, _folder(spark))
    f = checkpoint(features_at(spark, d).select(F.lit("momentum").alias("model"), "as_of", "security_id", "return_1m", "return_3m"))
    store.save_predictions(f.withColumn("score", F.col("return_1m")), 0)
    store.save_predictions(f.where("year(as_of) >= 2020").withColumn("score", F.col("return_3m")), 1)
    return store.load_predictions().select("model", "as_of", "security_id", F.round("score", 6).alias("score"))


def S22(spark: SparkSession, d: str) -> DataFrame:
    """A coverage report written as JSON lines and read again."""
    path = _folder(spark)
    runs.report_json(A15(spark, d), path)
    return spark.read.schema("index_name string, tickers long, still_active long, coverage double").json(path)


def S25(spark: SparkSession, d: str) -> DataFrame:
    """A log of loads: one row per feed with the rows it brought, appended feed by feed of two kinds."""
    store = runs.RunStore(spark, _folder(spark))
    p = table(spark, d, "prices").groupBy("source_id").agg(F.count(F.lit(1)).alias("rows_seen")).withColumn("load", F.lit("prices"))
    a = table(spark, d, "corporate_actions").groupBy("source_id").agg(F.count(F.lit(1)).alias("rows_seen")).withColumn("load", F.lit("actions"))
    store.log(p, 0)
    store.log(a, 1)
    return store.read_log().select("load", "source_id", "rows_seen")


def S2(spark: SparkSession, d: str) -> DataFrame:
    """A guarded start: replacing a table is allowed while all its rows are synthetic, and refused once real ones are in."""
    path = _folder(spark)
    real = table(spark, d, "data_sources").where("source_id is not null").select("source_id", F.lit(False).alias("synthetic"))
    made = real.withColumn("synthetic", F.lit(True))
    guard = F.col("synthetic")
    done = [readers.reset_table(made, path, guard), readers.reset_table(made, path, guard)]
    real.write.mode("append").parquet(path)
    done.append(readers.reset_table(made, path, guard))
    n = spark.read.parquet(path).count()
    return spark.createDataFrame([(i + 1, x, n) for i, x in enumerate(done)], "attempt int, replaced boolean, rows_at_end long")


def S4(spark: SparkSession, d: str) -> DataFrame:
    """Membership lines written as delimited text, parsed again, kept for tickers that are securities."""
    path = _folder(spark)
    rows = _claims(spark, d).where("index_name = 'SP500' and effective_date is not null")
    rows.select("ticker", F.date_format("effective_date", "yyyy-MM-dd").alias("start_date"), F.coalesce(F.date_format("removal_date", "yyyy-MM-dd"), F.lit("")).alias("end_date")).write.option("header", True).option("emptyValue", "").csv(path)
    only = table(spark, d, "securities").select(ticker_key("primary_ticker").alias("raw_ticker")).where("raw_ticker is not null").distinct()
    got = readers.DelimitedMembership("SP500", only, "2015-01-01").parse(spark, path)
    return got.groupBy("raw_ticker").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("removal_date").isNull()).alias("open_claims"), F.count("note").alias("noted"))


def S14(spark: SparkSession, d: str) -> DataFrame:
    """A reference file loaded twice: wrong or empty values are null, rows of a known (ticker, valid_from) are skipped."""
    path = _folder(spark)
    k = table(spark, d, "known_identifiers_seed").select("ticker", "cik", "isin", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"), "identifier_id")
    k.write.option("header", True).csv(path)
    cols = {"ticker": "string", "cik": "string", "isin": "string", "valid_from": "date", "identifier_id": "long"}
    new = readers.read_table(spark, path, cols).where("ticker is not null")
    keys = ["ticker", "valid_from"]
    first = upsert.first_per_key(new, keys, ["identifier_id"])
    again = upsert.insert_new(first, new, keys, ["identifier_id"])
    rows = first.select("cik", F.lit(False).alias("again")).unionByName(again.select("cik", F.lit(True).alias("again")))
    return rows.agg(F.count_if(~F.col("again")).alias("loaded"), F.count(F.when(~F.col("again"), F.col("cik"))).alias("with_cik"), F.count_if("again").alias("loaded_again"))


def U4(spark: SparkSession, d: str) -> DataFrame:
    """Claims of several parsers in one table: those of the records and of the history, by kind."""
    a = _claims(spark, d).select("ticker", F.col("effective_date").alias("start"), F.lit("claims").alias("parser"))
    b = table(spark, d, "ticker_history").select(ticker_key("ticker").alias("ticker"), F.col("valid_from").alias("start"), F.lit("history").alias("parser")).where("ticker is not null")
    return a.unionByName(b).groupBy("parser").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("ticker").alias("tickers"))


def U2(spark: SparkSession, d: str) -> DataFrame:
    """Names to trade at each month start: those held (a price before) or wanted (one within five days), less those without a price on the day."""
    a = asof.asof_backward(probes(spark, d), panel(spark, d), ["security_id"], "as_of", "date", ["close"])
    held = a.where("fact_time < as_of").select("as_of", "security_id")
    want = a.where("datediff(as_of, fact_time) <= 5").select("as_of", "security_id")
    skip = a.where("fact_time < date_sub(as_of, 5)").select("as_of", "security_id")
    left = held.union(want).distinct().join(skip, ["as_of", "security_id"], "left_anti")
    return left.groupBy("as_of").agg(F.count(F.lit(1)).alias("names"))


def P2(spark: SparkSession, d: str) -> DataFrame:
    """Open and close of exactly the probe's day, null where missing or not positive: an equi-join, no fallback."""
    p = panel(spark, d).select("security_id", F.col("date").alias("as_of"), *[F.when(F.col(c) > 0, F.col(c)).alias(c) for c in ("open", "close")])
    return probes(spark, d).join(p, ["security_id", "as_of"], "left").select("security_id", "as_of", "open", "close")


def P10(spark: SparkSession, d: str) -> DataFrame:
    """Bars per security of a list of ids, as a semi join; an empty list keeps nothing."""
    ids = table(spark, d, "securities").where("identifier_quality = 'resolved'").select("security_id")
    return panel(spark, d).join(ids, "security_id", "left_semi").groupBy("security_id").agg(F.count(F.lit(1)).alias("bars"))


def P7(spark: SparkSession, d: str) -> DataFrame:
    """As-of lookups under a guard that fails the job if one returns a bar later than it may see."""
    a = asof.asof_backward(probes(spark, d), panel(spark, d), ["security_id"], "as_of", "date", ["close"])
    return readers.guarded(a, F.col("fact_time"), F.col("as_of")).select("security_id", "as_of", "fact_time")


def D2(spark: SparkSession, d: str) -> DataFrame:
    """Review flags that claims ingested since 2019-04 add to those that the earlier ones gave: a null-safe anti join."""
    c = _claims(spark, d).join(table(spark, d, "membership_records").select("membership_id", "ingested_at"), "membership_id").where("removal_date is null or removal_date > effective_date")
    gaps = lambda x: reuse_gaps(x, "ticker", "effective_date", "removal_date", 365)
    queued, found = gaps(c.where("ingested_at < timestamp '2019-04-01 00:00:00'")), gaps(c)
    return upsert.insert_new(queued, found, ["ticker", "period_1_start", "period_1_end", "period_2_start", "gap_days"], ["gap_days"])


def A18(spark: SparkSession, d: str) -> DataFrame:
    """Times of attempts by kind and what they come to for more securities: an attempt a security, its bars' span of ingestion as time."""
    p = table(spark, d, "prices").groupBy("security_id").agg(F.count(F.lit(1)).alias("bars"), (F.unix_timestamp(F.max("ingested_at")) - F.unix_timestamp(F.min("ingested_at"))).cast("double").alias("seconds"))
    s = table(spark, d, "securities").select("security_id", "active_flag").join(p, "security_id", "left")
    r = s.select(F.coalesce(~F.col("active_flag"), F.lit(False)).alias("skipped"), F.coalesce("bars", F.lit(0)).alias("bars"), F.col("seconds"), F.when(F.col("bars").isNull(), "no rows").alias("error"))
    return readers.timing(r)


def J14(spark: SparkSession, d: str) -> DataFrame:
    """Flagged securities (a digit for a name, or suspicious bars) against bars, claims and review flags, and whether a claim overlaps the calendar."""
    a, z = month_bounds(spark, d)
    s = table(spark, d, "securities").select("security_id", ticker_key("primary_ticker").alias("ticker"), quality.is_digits(F.col("name")).alias("placeholder"))
    p = panel(spark, d).groupBy("security_id").agg(F.count(F.lit(1)).alias("bars"), F.count_if(F.col("price_data_quality") == "suspicious").alias("suspicious"))
    c = _claims(spark, d)
    m = c.groupBy("ticker").agg(F.count(F.lit(1)).alias("claims"), F.max(F.coalesce((F.col("effective_date") <= F.lit(z).cast("date")) & (F.col("removal_date").isNull() | (F.col("removal_date") >= F.lit(a).cast("date"))), F.lit(False))).alias("relevant"))
    g = reuse_gaps(c.where("removal_date is null or removal_date > effective_date"), "ticker", "effective_date", "removal_date", 365).select("ticker", F.lit(True).alias("review_flag"))
    j = s.join(p, "security_id", "left").join(m, "ticker", "left").join(g, "ticker", "left")
    n, no = (lambda x: F.coalesce(x, F.lit(0).cast("long")).alias(x)), (lambda x: F.coalesce(x, F.lit(False)).alias(x))
    return j.select("security_id", "ticker", "placeholder", n("bars"), n("suspicious"), n("claims"), no("relevant"), no("review_flag")).where("placeholder or suspicious > 0")


def I14(spark: SparkSession, d: str) -> DataFrame:
    """Delisting dates put into securities that lack one, from the last snapshot that says so."""
    gone = F.lower(F.trim("listing_status")) == "delisted"
    last = table(spark, d, "ticker_snapshots").groupBy("security_id").agg(F.max_by("listing_status", F.struct("snapshot_date", "loaded_at")).alias("listing_status"), F.max("snapshot_date").alias("delisted_date")).where(gone)
    s = table(spark, d, "securities").select("security_id", "delisted_date", "delisting_reason")
    u = last.select("security_id", "delisted_date", F.lit("last snapshot").alias("delisting_reason"))
    return upsert.update_metadata(s, u, "security_id", ["delisted_date", "delisting_reason"])


def A35(spark: SparkSession, d: str) -> DataFrame:
    """A profile of each security with contradictory bars: how many, when, fields stuck on one value, actions near and review flags."""
    p = panel(spark, d)
    total = p.groupBy("security_id").agg(F.count(F.lit(1)).alias("bars"))
    bad = checkpoint(p.where(quality.bad_ohlc()))
    b = bad.groupBy("security_id").agg(F.count(F.lit(1)).alias("bad"), F.min("date").alias("first_bad"), F.max("date").alias("last_bad"))
    v = bad.unpivot(["security_id"], ["open", "high", "low", "close"], "field", "value").groupBy("security_id", "field", "value").agg(F.count(F.lit(1)).alias("n"))
    frozen = v.groupBy("security_id", "field").agg(F.max("n").alias("n"), F.sum("n").alias("of")).where("n >= 5 and n >= 0.3 * of").groupBy("security_id").agg(F.count(F.lit(1)).alias("frozen_fields"))
    near = J13(spark, d).groupBy("security_id").agg(F.count(F.lit(1)).alias("actions_near_suspicious"))
    s = table(spark, d, "securities").select("security_id", ticker_key("primary_ticker").alias("ticker"), "identifier_quality")
    z = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return b.join(total, "security_id").join(s, "security_id", "left").join(frozen, "security_id", "left").join(near, "security_id", "left").select("security_id", "ticker", "identifier_quality", "bars", "bad", F.round(100 * F.col("bad") / F.col("bars"), 2).alias("bad_pct"), "first_bad", "last_bad", z("frozen_fields"), z("actions_near_suspicious"))


def M11(spark: SparkSession, d: str) -> DataFrame:
    """The decision table: a ridge on each step of the family ladder against momentum alone, by the frozen gates."""
    p = training_panel(spark, d, full=True)
    train, val = p.where("part = 'train'"), p.where("part = 'validation'")
    out = ~F.date_format("as_of", "yyyy-MM").isin("2020-08", "2020-09", "2020-10", "2020-11")

    def figures(step: str, model: str, scored: DataFrame) -> DataFrame:
        per = rank_correlation(scored, ["as_of"], "score", "y", 5)
        return per.agg(F.avg("ic").alias("mean_ic"), F.avg(F.when(out, F.col("ic"))).alias("mean_ic_excluding")).select(F.lit(step).alias("step"), F.lit(model).alias("model"), "*")

    new = old = None
    for step, families in LADDER.items():
        f = figures(step, "ridge", models.fit_linear(features_of(families), "y", 1.0)(train)(val))
        g = figures(step, "momentum", val.withColumn("score", F.col("return_3m")))
        new, old = (f, g) if new is None else (new.unionByName(f), old.unionByName(g))
    without = figures("full_v1_feature_set", "ridge", models.fit_linear(features_of(tuple(x for x in LADDER["full_v1_feature_set"] if x != "volume_liquidity")), "y", 1.0)(train)(val))
    new = new.join(without.select("step", "model", F.col("mean_ic").alias("mean_ic_without_family")), ["step", "model"], "left").withColumn("history_ok", F.lit(None).cast("boolean"))
    r = decisions.decide(new, old)
    return r.select("step", "model", *[F.round(c, 6).alias(c) for c in ("mean_ic", "gain")], "clears_threshold", *[F.round(c, 6).alias(c) for c in ("from_regime", "from_family")], "survives")


QUERIES = {
    "S20_run_store": S20, "S21_predictions": S21, "S22_report": S22, "S25_load_log": S25, "S2_guarded_reset": S2, "S4_delimited_claims": S4, "S14_reference_load": S14, "U4_parsers_united": U4, "U2_names_to_trade": U2, "P2_exact_prices": P2,
    "P10_listed_only": P10, "P7_date_guard": P7, "D2_review_flags": D2, "A18_timing": A18, "J14_cross_reference": J14, "I14_delisting_update": I14, "A35_profile": A35, "M11_decisions": M11,
}

_P = f"with {PANEL}, {MONTHS}, {PROBES}"
_AT = "a as (select p.security_id, p.as_of, b.date, b.close from probes p asof left join panel b on p.security_id = b.security_id and p.as_of >= b.date)"


def _flags(src: str, name: str) -> str:
    return f"{name}_s as (select distinct ticker, effective_date as a, removal_date as e from {src} where effective_date is not null and (removal_date is null or removal_date > effective_date)), {name} as (select ticker, a as period_1_start, e as period_1_end, n as period_2_start, (n - e)::bigint as gap_days from (select *, lead(a) over (partition by ticker order by a, e nulls first) as n from {name}_s) where n - e >= 365 qualify row_number() over (partition by ticker order by a, e) = 1)"


_PR = "pr as (select security_id, count(*) as bars, date_diff('second', min(ingested_at), max(ingested_at))::double as seconds from prices group by 1), r as (select coalesce(not active_flag, false) as skipped, coalesce(bars, 0) as bars, seconds, bars is null as failed from securities left join pr using (security_id))"
_VAL = " union all ".join(f"select security_id, '{c}' as field, {c} as value from bad" for c in ("open", "high", "low", "close"))
SQL = {
    "S20_run_store": f"with {PANEL}, w as (select security_id::varchar as run_id, round(max(close), 6) as top, round(min(close), 6) as low, count(*)::double as bars from panel group by 1) select run_id, 'top' as metric_name, top as value from w union all select run_id, 'low', low from w union all select run_id, 'bars', bars from w",
    "S21_predictions": f"{_P}, {_F1} select 'momentum' as model, as_of, sid as security_id, round(case when year(as_of) >= 2020 then return_3m else return_1m end, 6) as score from fat",
    "S22_report": CLAIMS_SQL["A15_coverage"],
    "S25_load_log": "select 'prices' as load, source_id, count(*) as rows_seen from prices group by 2 union all select 'actions', source_id, count(*) from corporate_actions group by 2",
    "S4_delimited_claims": f"with {_CL} select ticker as raw_ticker, count(*) as claims, count(*) - count(removal_date) as open_claims, count(case when effective_date < date '2015-01-01' then 1 end) as noted from cl where index_name = 'SP500' and effective_date is not null and ticker in (select {_K.format('primary_ticker')} from securities) group by 1",
    "S14_reference_load": "with k as (select nullif(trim(ticker), '') as t, valid_from, arg_min(nullif(trim(cik), ''), identifier_id) as cik0, min(identifier_id) as i from known_identifiers_seed where nullif(trim(ticker), '') is not null group by 1, 2) select count(*) as loaded, (select count(nullif(trim(s.cik), '')) from known_identifiers_seed s where identifier_id in (select i from k)) as with_cik, 0::bigint as loaded_again from k",
    "U4_parsers_united": f"with {_CL}, u as (select 'claims' as parser, ticker from cl union all select 'history', {_K.format('ticker')} from ticker_history where {_K.format('ticker')} is not null) select parser, count(*) as rows, count(distinct ticker) as tickers from u group by 1",
    "U2_names_to_trade": f"{_P}, {_AT}, t as (select as_of, security_id from a where date < as_of union select as_of, security_id from a where as_of - date <= 5 except select as_of, security_id from a where date < as_of - 5) select as_of, count(*) as names from t group by 1",
    "P2_exact_prices": f"{_P} select p.security_id, p.as_of, case when open > 0 then open end as open, case when close > 0 then close end as close from probes p left join panel b on b.security_id = p.security_id and b.date = p.as_of",
    "P10_listed_only": f"with {PANEL} select security_id, count(*) as bars from panel where security_id in (select security_id from securities where identifier_quality = 'resolved') group by 1",
    "P7_date_guard": f"{_P}, {_AT} select security_id, as_of, date as fact_time from a",
    "D2_review_flags": f"with {_CL}, ci as (select cl.*, m.ingested_at from cl join membership_records m using (membership_id)), old as (select * from ci where ingested_at < timestamp '2019-04-01 00:00:00'), {_flags('old', 'q')}, {_flags('ci', 'f')} select f.* from f where not exists (select 1 from q where q.ticker = f.ticker and q.period_1_start is not distinct from f.period_1_start and q.period_1_end is not distinct from f.period_1_end and q.period_2_start is not distinct from f.period_2_start and q.gap_days is not distinct from f.gap_days)",
    "A18_timing": f"with {_PR} select count(*) as attempts, count(case when not skipped then 1 end) as fresh, count(case when not skipped and bars > 0 then 1 end) as fresh_with_data, count(case when not skipped and bars = 0 then 1 end) as fresh_without_data, count(case when skipped then 1 end) as skipped, count(case when failed then 1 end) as errors, round(avg(seconds), 4) as mean_all, round(avg(case when not skipped then seconds end), 4) as mean_fresh, round(avg(case when not skipped and bars > 0 then seconds end), 4) as mean_with_data, round(coalesce(avg(case when not skipped and bars > 0 then seconds end), avg(case when not skipped then seconds end)) * 200 / 60, 1) as minutes_for_200, round(coalesce(avg(case when not skipped and bars > 0 then seconds end), avg(case when not skipped then seconds end)) * 1200 / 60, 1) as minutes_for_1200 from r",
    "J14_cross_reference": f"with {PANEL}, {MONTHS}, {_CL}, {_flags('cl', 'g')}, p as (select security_id, count(*) as bars, count(case when price_data_quality = 'suspicious' then 1 end) as suspicious from panel group by 1), m as (select ticker, count(*) as claims, bool_or(coalesce(effective_date <= (select max(as_of) from months) and (removal_date is null or removal_date >= (select min(as_of) from months)), false)) as relevant from cl group by 1), j as (select s.security_id, {_K.format('s.primary_ticker')} as ticker, coalesce(regexp_matches(trim(s.name), '^[0-9]+$'), false) as placeholder from securities s) select j.*, coalesce(bars, 0) as bars, coalesce(suspicious, 0) as suspicious, coalesce(claims, 0) as claims, coalesce(relevant, false) as relevant, g.ticker is not null as review_flag from j left join p using (security_id) left join m on m.ticker = j.ticker left join g on g.ticker = j.ticker where placeholder or suspicious > 0",
    "I14_delisting_update": "with u as (select security_id, max(snapshot_date) as dd from ticker_snapshots group by 1 having lower(trim(arg_max(coalesce(listing_status, ''), {'s': snapshot_date, 'l': loaded_at}))) = 'delisted') select s.security_id, coalesce(s.delisted_date, u.dd) as delisted_date, coalesce(s.delisting_reason, case when u.dd is not null then 'last snapshot' end) as delisting_reason from securities s left join u using (security_id)",
    "A35_profile": f"with {PANEL}, bad as (select * from panel where {_BAD}), b as (select security_id, count(*) as bad, min(date) as first_bad, max(date) as last_bad from bad group by 1), v as (select security_id, field, value, count(*) as n from ({_VAL}) where value is not null group by 1, 2, 3), f as (select security_id, count(*) as frozen_fields from (select security_id, field from v group by 1, 2 having max(n) >= 5 and max(n) >= 0.3 * sum(n)) group by 1), nr as (select security_id, count(*) as near from (select distinct p.security_id, p.date, c.action_type, c.ex_date from panel p join corporate_actions c on c.security_id = p.security_id and c.ex_date between p.date - 10 and p.date + 10 where p.price_data_quality = 'suspicious') group by 1), t as (select security_id, count(*) as bars from panel group by 1) select b.security_id, {_K.format('s.primary_ticker')} as ticker, s.identifier_quality, bars, bad, round(100 * bad / bars, 2) as bad_pct, first_bad, last_bad, coalesce(frozen_fields, 0) as frozen_fields, coalesce(near, 0) as actions_near_suspicious from b join t using (security_id) left join securities s on s.security_id = b.security_id left join f on f.security_id = b.security_id left join nr on nr.security_id = b.security_id",
}
