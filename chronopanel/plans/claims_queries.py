"""Quality, claims, identity, universe, coverage and load queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronopanel.functions.keys import open_end, source_key, ticker_key
from chronopanel.operators import asof, claims, quality, trailing, upsert
from chronopanel.operators.calendar import business_days
from chronopanel.operators.ranking import number_rows
from chronopanel.operators.universe import member_months
from chronopanel.plans.fixtures import MONTHS, PANEL, month_bounds, panel
from chronopanel.session import table


def P3(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "prices")
    flag = quality.bad_ohlc() | F.coalesce(F.col("volume") < 0, F.lit(False))
    return p.select("price_id", F.when(flag, "suspicious").otherwise(F.col("price_data_quality")).alias("price_data_quality")).where("price_data_quality = 'suspicious'")


def A1(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d)
    return p.groupBy("security_id").agg(F.count(F.lit(1)).alias("bars"), F.round(F.avg(F.when(F.col("price_data_quality") == "suspicious", 1.0).otherwise(0.0)), 6).alias("suspicious_share"))


def P5(spark: SparkSession, d: str) -> DataFrame:
    """Sessions a security lacks in its span: generated from the calendar's numbers, then an anti join."""
    p = panel(spark, d).select("security_id", "date")
    cal = table(spark, d, "trading_sessions").select(F.col("session_date").alias("date")).dropna().distinct().select("date", F.row_number().over(Window.orderBy("date")).alias("i"))
    on = p.join(F.broadcast(cal), "date")
    span = on.groupBy("security_id").agg(F.min("i").alias("a"), F.max("i").alias("z")).select("security_id", F.explode(F.sequence("a", "z")).alias("i"))
    return span.join(on.select("security_id", "i"), ["security_id", "i"], "left_anti").join(F.broadcast(cal), "i").select("security_id", F.col("date").alias("missing_date"))


def P6(spark: SparkSession, d: str) -> DataFrame:
    """Names that several securities bear, ignoring case and outer blanks."""
    n = table(spark, d, "securities").where("name is not null").groupBy(F.lower(F.trim("name")).alias("name"))
    return n.agg(F.count(F.lit(1)).alias("securities"), F.min("security_id").alias("first_id"), F.max("security_id").alias("last_id")).where("securities > 1")


def P8(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "securities")
    return s.select("security_id", quality.is_digits(F.col("cik")).alias("cik_is_digits"), quality.is_digits(F.col("name")).alias("name_is_digits"))


def P12(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "prices")
    ok = lambda c: F.avg(F.when((F.col(c) > 0) & ~F.isnan(c), 1.0).otherwise(0.0))
    return p.groupBy("source_id").agg(F.count(F.lit(1)).alias("rows"), F.round(ok("open"), 6).alias("open_coverage"), F.round(ok("close"), 6).alias("close_coverage"))


def P13(spark: SparkSession, d: str) -> DataFrame:
    out = (F.col("open") > F.col("high")) | (F.col("open") < F.col("low"))
    return panel(spark, d).groupBy("security_id").agg(F.count_if(F.col("open").isNotNull()).alias("with_open"), F.count_if(out).alias("violations"), F.count_if(out & (F.col("price_data_quality") == "suspicious")).alias("already_flagged"))


def A34(spark: SparkSession, d: str) -> DataFrame:
    """Most common close per security and how often: two aggregates."""
    c = panel(spark, d).groupBy("security_id", "close").agg(F.count(F.lit(1)).alias("n"))
    c = c.groupBy("security_id").agg(F.max(F.struct("n", (-F.col("close")).alias("c"))).alias("b"), F.sum("n").alias("bars"))
    return c.select("security_id", (-F.col("b.c")).alias("mode_close"), F.col("b.n").alias("times"), ((F.col("b.n") >= 5) & (F.col("b.n") >= 0.3 * F.col("bars"))).alias("frozen"))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    said = F.regexp_replace(F.lower(F.coalesce("confidence", F.lit(""))), "[^a-z]", "")
    return table(spark, d, "membership_records").select("membership_id", "security_id", ticker_key("raw_ticker").alias("ticker"), "index_name", "effective_date", open_end("removal_date").alias("removal_date"), source_key("source_name").alias("source"), said.alias("confidence")).where("ticker is not null and index_name is not null")


def J9(spark: SparkSession, d: str) -> DataFrame:
    """Members per month start and index, and how many of them are unresolved."""
    m = member_months(_claims(spark, d).where("confidence in ('verified', 'unverified')"), *month_bounds(spark, d))
    return m.groupBy("index_name", "as_of").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("security_id").isNull()).alias("unresolved"))


def J10(spark: SparkSession, d: str) -> DataFrame:
    """The identifier row in force for each ticker at each month start; closed intervals, the latest start wins.

    A row's months are generated from its bounds.
    """
    a, z = (F.lit(x).cast("date") for x in month_bounds(spark, d))
    k = table(spark, d, "known_identifiers_seed").select(ticker_key("ticker").alias("ticker"), "identifier_id", "valid_from", "valid_to").where("ticker is not null and valid_from is not null")
    first = F.greatest(F.when(F.dayofmonth("valid_from") == 1, F.col("valid_from")).otherwise(F.add_months(F.trunc("valid_from", "month"), 1)), a)
    last = F.least(F.coalesce(F.trunc("valid_to", "month"), z), z)
    k = k.withColumn("_a", first).withColumn("_z", last).where("_a <= _z").select("ticker", "identifier_id", "valid_from", F.explode(F.expr("sequence(_a, _z, interval 1 month)")).alias("as_of"))
    return k.groupBy("ticker", "as_of").agg(F.max(F.struct("valid_from", "identifier_id")).alias("b")).select("ticker", "as_of", "b.identifier_id", "b.valid_from")


def J11(spark: SparkSession, d: str) -> DataFrame:
    """Securities found by CIK for identifier rows; the smallest id where several bear it."""
    cik = F.nullif(F.regexp_replace(F.regexp_replace("cik", "[^0-9]", ""), "^0+", ""), F.lit(""))
    s = table(spark, d, "securities").select(cik.alias("cik"), "security_id").where("cik is not null").groupBy("cik").agg(F.min("security_id").alias("security_id"))
    return table(spark, d, "known_identifiers_seed").select("identifier_id", cik.alias("cik")).join(s, "cik").select("identifier_id", "cik", "security_id")


def J12(spark: SparkSession, d: str) -> DataFrame:
    c = _claims(spark, d).where("confidence <> 'conflicting'")
    return claims.conflicting(c, ["ticker", "index_name"], "source", "effective_date", "removal_date", "membership_id")


def W19(spark: SparkSession, d: str) -> DataFrame:
    c = _claims(spark, d).where("removal_date is null or removal_date > effective_date")
    return claims.reuse_gaps(c, "ticker", "effective_date", "removal_date", 365)


def A15(spark: SparkSession, d: str) -> DataFrame:
    """Per index: tickers with a claim in a window, those still active, and coverage."""
    a, z = F.lit("2016-01-01").cast("date"), F.lit("2019-12-31").cast("date")
    c = _claims(spark, d).where((F.col("effective_date") <= z) & (F.col("removal_date").isNull() | (F.col("removal_date") >= a)))
    t = c.groupBy("index_name", "ticker").agg(F.max(F.col("removal_date").isNull()).alias("active"))
    return t.groupBy("index_name").agg(F.count(F.lit(1)).alias("tickers"), F.count_if("active").alias("still_active"), F.round(F.avg(F.col("active").cast("double")), 4).alias("coverage"))


def A16(spark: SparkSession, d: str) -> DataFrame:
    """The twenty longest gone tickers of a window, a top-k report."""
    c = _claims(spark, d)
    t = c.groupBy("ticker").agg(F.max("removal_date").alias("last_end"), F.max(F.col("removal_date").isNull()).alias("active")).where("not active")
    return t.select("ticker", "last_end").orderBy("last_end", "ticker").limit(20)


def E3(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d)
    dv = F.coalesce(F.col("close") * F.col("volume"), F.lit(0.0))
    s = p.groupBy("security_id").agg(F.max_by("close", "date").alias("latest_price"), F.avg(dv).alias("v"), F.count(F.lit(1)).alias("days"))
    return s.select("security_id", F.round("latest_price", 2).alias("latest_price"), F.round("v").alias("avg_dollar_volume"), "days", ((F.col("latest_price") >= 5) & (F.col("v") >= 1e6) & (F.col("days") >= 252)).alias("passed"))


def D1(spark: SparkSession, d: str) -> DataFrame:
    """Entities from identifier rows: one per CIK, else one per ticker; ids from the key's hash."""
    k = table(spark, d, "known_identifiers_seed")
    cik = F.nullif(F.regexp_replace(F.regexp_replace("cik", "[^0-9]", ""), "^0+", ""), F.lit(""))
    k = k.select("identifier_id", cik.alias("cik"), ticker_key("ticker").alias("ticker"))
    key = F.coalesce(F.concat(F.lit("cik:"), "cik"), F.concat(F.lit("ticker:"), "ticker"), F.concat(F.lit("row:"), F.col("identifier_id").cast("string")))
    return k.withColumn("entity", key).groupBy("entity").agg(F.min("identifier_id").alias("first_id"), F.count(F.lit(1)).alias("rows"), F.countDistinct("ticker").alias("tickers"))


def I2(spark: SparkSession, d: str) -> DataFrame:
    """Ticker links to add: first per (ticker, valid_from) that the history does not have."""
    key = ticker_key("ticker")
    have = table(spark, d, "ticker_history").select(key.alias("ticker"), F.col("valid_from").alias("valid_from"))
    new = table(spark, d, "ticker_snapshots").select(key.alias("ticker"), F.col("snapshot_date").alias("valid_from"), "security_id", "loaded_at").where("ticker is not null")
    out = upsert.insert_new(have, new, ["ticker", "valid_from"], ["loaded_at", "security_id"])
    return out.groupBy(F.year("valid_from").alias("year")).agg(F.count(F.lit(1)).alias("inserted"), F.countDistinct("ticker").alias("tickers"))


def I3(spark: SparkSession, d: str) -> DataFrame:
    """Claims to insert by source: new, duplicates on (ticker, index, start, source), unresolved."""
    c = _claims(spark, d)
    n = c.groupBy("ticker", "index_name", "effective_date", "source").agg(F.count(F.lit(1)).alias("n"), F.min_by("security_id", "membership_id").alias("sid"))
    return n.groupBy("source").agg(F.count(F.lit(1)).alias("inserted"), F.sum(F.col("n") - 1).alias("duplicates"), F.count_if(F.col("sid").isNull()).alias("unresolved"))


def I4(spark: SparkSession, d: str) -> DataFrame:
    """First-written bar per (security, date, feed) and how many later ones are dropped."""
    p = table(spark, d, "prices").groupBy("security_id", "date", "source_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ingested_at", "price_id")).alias("b"))
    return p.groupBy("source_id").agg(F.count(F.lit(1)).alias("written"), F.sum(F.col("n") - 1).alias("rejected"), F.max("b.price_id").alias("last_id"))


def I5(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "corporate_actions")
    return upsert.first_per_key(a.select("security_id", "action_type", "ex_date", "ratio_or_value", "ingested_at", "source_id"), ["security_id", "action_type", "ex_date"], ["ingested_at", "source_id", "ratio_or_value"])


def I13(spark: SparkSession, d: str) -> DataFrame:
    """Identifier rows kept by null-safe de-duplication on five columns."""
    k = table(spark, d, "known_identifiers_seed")
    return k.groupBy("ticker", "cik", "isin", "valid_from", "valid_to").agg(F.min("identifier_id").alias("identifier_id")).select("identifier_id")


def O6(spark: SparkSession, d: str) -> DataFrame:
    """A seeded order of all tickers by hash, and the ordered distinct list."""
    t = _claims(spark, d).select("ticker").distinct()
    return t.select("ticker", F.md5(F.concat(F.lit("7:"), "ticker")).alias("k")).transform(lambda x: number_rows(x, [], ["k", "ticker"], "place")).select("ticker", "place")


def U_sets(spark: SparkSession, d: str) -> DataFrame:
    """Tickers of the claims against those of the securities: both, only claims, only securities."""
    a = _claims(spark, d).select("ticker").distinct()
    b = table(spark, d, "securities").select(ticker_key("primary_ticker").alias("ticker")).where("ticker is not null").distinct()
    parts = [("both", a.intersect(b)), ("only_claims", a.exceptAll(b)), ("only_securities", b.exceptAll(a)), ("either", a.union(b).distinct())]
    out = None
    for name, p in parts:
        c = p.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = c if out is None else out.unionByName(c)
    return out


def A19(spark: SparkSession, d: str) -> DataFrame:
    """Securities by how complete their prices are, with empty categories."""
    p = panel(spark, d).groupBy("security_id").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("a"), F.max("date").alias("z"))
    s = table(spark, d, "securities").join(p, "security_id", "left")
    share = F.try_divide(F.col("n"), business_days(F.col("a"), F.col("z")))
    cat = F.when(F.col("n").isNull() & F.col("delisted_date").isNotNull(), "delisted_without_prices").when(F.col("n").isNull(), "without_prices").when(share >= 0.9, "full").when(share >= 0.5, "partial").otherwise("sparse")
    got = s.select(cat.alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    names = spark.createDataFrame([(x,) for x in ("delisted_without_prices", "without_prices", "full", "partial", "sparse")], "category string")
    return names.join(got, "category", "left").select("category", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.round(100 * F.coalesce("n", F.lit(0)) / F.sum("n").over(Window.partitionBy()), 1).alias("pct"))


def A17(spark: SparkSession, d: str) -> DataFrame:
    """One row of quality figures: each block an aggregate of its own, united as metric and value."""
    acts, sec, m = table(spark, d, "corporate_actions"), table(spark, d, "securities"), _claims(spark, d)
    p = panel(spark, d)

    def one(name: str, df: DataFrame, agg: F.Column) -> DataFrame:
        return df.agg(agg.cast("long").alias("value")).select(F.lit(name).alias("metric"), "value")

    parts = [
        one("securities", sec, F.count(F.lit(1))),
        one("resolved", sec, F.count_if(F.col("identifier_quality") == "resolved")),
        one("delisted", sec, F.count_if(F.col("delisted_date").isNotNull())),
        one("unsupported_actions", sec, F.count_if("has_unsupported_corporate_action")),
        one("price_rows", p, F.count(F.lit(1))),
        one("priced_securities", p, F.countDistinct("security_id")),
        one("suspicious_rows", p, F.count_if(F.col("price_data_quality") == "suspicious")),
        one("dividends", acts, F.count_if(F.col("action_type") == "dividend")),
        one("splits", acts, F.count_if(F.col("action_type").isin("split", "reverse_split"))),
        one("claims", m, F.count(F.lit(1))),
        one("conflicting_claims", m, F.count_if(F.col("confidence") == "conflicting")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


QUERIES = {
    "P3_validate_ohlc": P3, "A1_suspicious_share": A1, "P5_missing_dates": P5, "P6_duplicate_names": P6, "P8_digit_names": P8, "P12_field_coverage": P12, "P13_open_violations": P13, "A34_frozen_value": A34,
    "J9_members_as_of": J9, "J10_identifier_in_force": J10, "J11_security_by_cik": J11, "J12_conflicts": J12, "W19_reuse_gaps": W19, "A15_coverage": A15, "A16_removed_tickers": A16, "E3_universe_filters": E3,
    "D1_entities": D1, "I2_ticker_links": I2, "I3_claims_ingest": I3, "I4_prices_ingest": I4, "I5_actions_ingest": I5, "I13_dedupe": I13, "O6_seeded_order": O6, "U_set_operations": U_sets, "A19_categories": A19, "A17_quality_report": A17,
}

_K = "nullif(regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g'), '')"
_C = "nullif(ltrim(regexp_replace({0}, '[^0-9]', '', 'g'), '0'), '')"
_CL = f"cl as (select membership_id, security_id, {_K.format('raw_ticker')} as ticker, index_name, effective_date, case when removal_date < date '9999-12-31' then removal_date end as removal_date, regexp_replace(lower(source_name), '\\s+', '', 'g') as source, regexp_replace(lower(coalesce(confidence, '')), '[^a-z]', '', 'g') as confidence from membership_records where {_K.format('raw_ticker')} is not null and index_name is not null)"
_BAD = "high < low or high < open or high < close or low > open or low > close or open <= 0 or close <= 0"
_BD = "(select count(*) from generate_series({0}, {1}, interval 1 day) t(x) where isodow(x) <= 5)"


def _n(cond: str) -> str:
    return f"count(case when {cond} then 1 end)"


SQL = {
    "P3_validate_ohlc": f"select price_id, 'suspicious' as price_data_quality from prices where ({_BAD}) or volume < 0 or price_data_quality = 'suspicious'",
    "A1_suspicious_share": f"with {PANEL} select security_id, count(*) as bars, round(avg(case when price_data_quality = 'suspicious' then 1.0 else 0.0 end), 6) as suspicious_share from panel group by 1",
    "P5_missing_dates": f"with {PANEL}, s as (select distinct session_date as date from trading_sessions), b as (select p.security_id, p.date from panel p join s using (date)), r as (select security_id, min(date) as a, max(date) as z from b group by 1) select r.security_id, s.date as missing_date from r join s on s.date between r.a and r.z where not exists (select 1 from b where b.security_id = r.security_id and b.date = s.date)",
    "P6_duplicate_names": "select lower(trim(name)) as name, count(*) as securities, min(security_id) as first_id, max(security_id) as last_id from securities where name is not null group by 1 having count(*) > 1",
    "P8_digit_names": "select security_id, coalesce(regexp_matches(trim(cik), '^[0-9]+$'), false) as cik_is_digits, coalesce(regexp_matches(trim(name), '^[0-9]+$'), false) as name_is_digits from securities",
    "P12_field_coverage": "select source_id, count(*) as rows, round(avg(case when open > 0 and not isnan(open) then 1.0 else 0.0 end), 6) as open_coverage, round(avg(case when close > 0 and not isnan(close) then 1.0 else 0.0 end), 6) as close_coverage from prices group by 1",
    "P13_open_violations": f"with {PANEL} select security_id, count(open) as with_open, {_n('open > high or open < low')} as violations, {_n('''(open > high or open < low) and price_data_quality = 'suspicious' ''')} as already_flagged from panel group by 1",
    "A34_frozen_value": f"with {PANEL}, c as (select security_id, close, count(*) as n from panel group by 1, 2), r as (select *, sum(n) over (partition by security_id) as bars, row_number() over (partition by security_id order by n desc, close) as k from c) select security_id, close as mode_close, n as times, (n >= 5 and n >= 0.3 * bars) as frozen from r where k = 1",
    "J9_members_as_of": f"with {MONTHS}, {_CL} select index_name, as_of, count(distinct coalesce(security_id::varchar, 'unresolved:' || ticker)) as members, count(distinct case when security_id is null then 'unresolved:' || ticker end) as unresolved from months join cl on effective_date <= as_of and (removal_date is null or removal_date > as_of) and confidence in ('verified', 'unverified') group by 1, 2",
    "J10_identifier_in_force": f"with {MONTHS} select {_K.format('ticker')} as ticker, as_of, identifier_id, valid_from from months join known_identifiers_seed on valid_from <= as_of and (valid_to is null or valid_to >= as_of) where {_K.format('ticker')} is not null qualify row_number() over (partition by {_K.format('ticker')}, as_of order by valid_from desc, identifier_id desc) = 1",
    "J11_security_by_cik": f"with s as (select {_C.format('cik')} as cik, min(security_id) as security_id from securities where {_C.format('cik')} is not null group by 1) select identifier_id, s.cik, s.security_id from known_identifiers_seed k join s on s.cik = {_C.format('k.cik')}",
    "J12_conflicts": f"with {_CL}, x as (select *, coalesce(removal_date, date '9999-12-31') as e from cl where confidence <> 'conflicting' and effective_date is not null) select a.membership_id from x a where exists (select 1 from x b where a.ticker = b.ticker and a.index_name = b.index_name and a.source <> b.source and a.effective_date <= b.e and b.effective_date <= a.e and (a.effective_date <> b.effective_date or a.e <> b.e))",
    "W19_reuse_gaps": f"with {_CL}, s as (select distinct ticker, effective_date as a, removal_date as e from cl where effective_date is not null and (removal_date is null or removal_date > effective_date)), g as (select *, lead(a) over (partition by ticker order by a, e nulls first) as n from s) select ticker, a as period_1_start, e as period_1_end, n as period_2_start, (n - e)::bigint as gap_days from g where n - e >= 365 qualify row_number() over (partition by ticker order by a, e) = 1",
    "A15_coverage": f"with {_CL}, t as (select index_name, ticker, bool_or(removal_date is null) as active from cl where effective_date <= date '2019-12-31' and (removal_date is null or removal_date >= date '2016-01-01') group by 1, 2) select index_name, count(*) as tickers, {_n('active')} as still_active, round(avg(active::int), 4) as coverage from t group by 1",
    "A16_removed_tickers": f"with {_CL} select ticker, max(removal_date) as last_end from cl group by 1 having not bool_or(removal_date is null) order by last_end, ticker limit 20",
    "E3_universe_filters": f"with {PANEL}, s as (select security_id, arg_max(close, date) as p, avg(coalesce(close * volume, 0)) as v, count(*) as days from panel group by 1) select security_id, round(p, 2) as latest_price, round(v, 0) as avg_dollar_volume, days, (p >= 5 and v >= 1e6 and days >= 252) as passed from s",
    "D1_entities": f"with k as (select identifier_id, nullif(ltrim(regexp_replace(cik, '[^0-9]', '', 'g'), '0'), '') as cik, {_K.format('ticker')} as ticker from known_identifiers_seed) select coalesce('cik:' || cik, 'ticker:' || ticker, 'row:' || identifier_id) as entity, min(identifier_id) as first_id, count(*) as rows, count(distinct ticker) as tickers from k group by 1",
    "I2_ticker_links": f"with n as (select distinct {_K.format('ticker')} as ticker, snapshot_date as valid_from from ticker_snapshots where {_K.format('ticker')} is not null) select year(valid_from)::bigint as year, count(*) as inserted, count(distinct ticker) as tickers from n where not exists (select 1 from ticker_history h where {_K.format('h.ticker')} = n.ticker and h.valid_from = n.valid_from) group by 1",
    "I3_claims_ingest": f"with {_CL}, n as (select ticker, index_name, effective_date, source, count(*) as n, (array_agg(security_id order by membership_id))[1] as sid from cl group by 1, 2, 3, 4) select source, count(*) as inserted, sum(n - 1)::bigint as duplicates, {_n('sid is null')} as unresolved from n group by 1",
    "I4_prices_ingest": "with g as (select security_id, date, source_id, count(*) as n, arg_min(price_id, {'i': ingested_at, 'p': price_id}) as first_id from prices group by 1, 2, 3) select source_id, count(*) as written, sum(n - 1)::bigint as rejected, max(first_id) as last_id from g group by 1",
    "I5_actions_ingest": "select security_id, action_type, ex_date, ratio_or_value, ingested_at, source_id from corporate_actions qualify row_number() over (partition by security_id, action_type, ex_date order by ingested_at, source_id, ratio_or_value) = 1",
    "I13_dedupe": "select min(identifier_id) as identifier_id from known_identifiers_seed group by ticker, cik, isin, valid_from, valid_to",
    "O6_seeded_order": f"with {_CL}, t as (select distinct ticker from cl) select ticker, row_number() over (order by md5('7:' || ticker), ticker) as place from t",
    "U_set_operations": f"with {_CL}, a as (select distinct ticker from cl), b as (select distinct {_K.format('primary_ticker')} as ticker from securities where {_K.format('primary_ticker')} is not null) select 'both' as part, count(*) as n from (select * from a intersect select * from b) union all select 'only_claims', count(*) from (select * from a except select * from b) union all select 'only_securities', count(*) from (select * from b except select * from a) union all select 'either', count(*) from (select * from a union select * from b)",
    "A19_categories": f"with {PANEL}, p as (select security_id, count(*) as n, min(date) as a, max(date) as z from panel group by 1), s as (select case when p.n is null and s.delisted_date is not null then 'delisted_without_prices' when p.n is null then 'without_prices' when p.n / {_BD.format('p.a', 'p.z')} >= 0.9 then 'full' when p.n / {_BD.format('p.a', 'p.z')} >= 0.5 then 'partial' else 'sparse' end as category from securities s left join p using (security_id)), c as (select unnest(['delisted_without_prices', 'without_prices', 'full', 'partial', 'sparse']) as category) select c.category, count(s.category) as n, round(100 * count(s.category) / (select count(*) from s), 1) as pct from c left join s using (category) group by 1",
    "A17_quality_report": f"with {PANEL}, {_CL} select 'securities' as metric, count(*) as value from securities union all select 'resolved', {_n('''identifier_quality = 'resolved' ''')} from securities union all select 'delisted', count(delisted_date) from securities union all select 'unsupported_actions', {_n('has_unsupported_corporate_action')} from securities union all select 'price_rows', count(*) from panel union all select 'priced_securities', count(distinct security_id) from panel union all select 'suspicious_rows', {_n('''price_data_quality = 'suspicious' ''')} from panel union all select 'dividends', {_n('''action_type = 'dividend' ''')} from corporate_actions union all select 'splits', {_n('''action_type in ('split', 'reverse_split')''')} from corporate_actions union all select 'claims', count(*) from cl union all select 'conflicting_claims', {_n('''confidence = 'conflicting' ''')} from cl",
}
