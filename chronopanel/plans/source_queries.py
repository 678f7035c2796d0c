"""Sources, sinks and reshaping of results, and optional streaming over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronopanel.functions.keys import is_real, ticker_key
from chronopanel.operators import asof
from chronopanel.operators.adjust import split_kind
from chronopanel.plans.fixtures import MONTHS, PANEL, PROBES, panel, probes
from chronopanel.session import table
from chronopanel.sources import readers
from chronopanel.streaming import events as streams


def S8(spark: SparkSession, d: str) -> DataFrame:
    return readers.SyntheticPrices(empty=["NONE"], gaps={"GAPS": ("2020-03-02", "2020-04-30")}).fetch(spark, ["AAA", "BBB", "GAPS", "NONE"], "2020-01-01", "2020-12-31")


def S9(spark: SparkSession, d: str) -> DataFrame:
    days = spark.range(1).select(F.explode(F.expr("sequence(date '2020-01-01', date '2020-12-31', interval 1 day)")).alias("date"))
    return days.where(F.weekday("date") < 5)


def S11(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "corporate_actions").select("security_id", "action_type", "ex_date", F.col("ratio_or_value").cast("string").alias("value"))
    return readers.clean_actions(raw, "2016-01-01", "2018-12-31").groupBy("action_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def S13(spark: SparkSession, d: str) -> DataFrame:
    """Attempt outcomes of all securities: no bars and delisted, no bars, or bars."""
    n = panel(spark, d).groupBy("security_id").agg(F.count(F.lit(1)).alias("n"))
    s = table(spark, d, "securities").join(n, "security_id", "left")
    error = F.when(F.col("n").isNull() & F.col("delisted_date").isNotNull(), F.lit("symbol may be delisted"))
    return s.select(readers.attempt_status(F.coalesce("n", F.lit(0)), error).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def S18(spark: SparkSession, d: str) -> DataFrame:
    """Per-security figures turned long, one row per metric."""
    wide = panel(spark, d).groupBy("security_id").agg(F.round(F.max("close"), 6).alias("top"), F.round(F.min("close"), 6).alias("low"), F.count(F.lit(1)).alias("bars"))
    return readers.long_metrics(wide, "security_id")


def B11(spark: SparkSession, d: str) -> DataFrame:
    return readers.wide_metrics(S18(spark, d), "security_id", ["top", "low"])


def S19(spark: SparkSession, d: str) -> DataFrame:
    """Holdings of 100 shares at each probe, valued as of it; names without a price are left out."""
    p = asof.asof_backward(probes(spark, d), panel(spark, d), ["security_id"], "as_of", "date", ["close"]).where("close is not null")
    by = F.sum(F.col("close") * 100).over(Window.partitionBy("as_of"))
    return p.select("as_of", "security_id", F.round(F.col("close") * 100, 4).alias("value"), F.round(F.coalesce(F.try_divide(F.col("close") * 100, by), F.lit(0.0)), 6).alias("weight"))


def S23(spark: SparkSession, d: str) -> DataFrame:
    """Securities still to fetch: those without a bar."""
    return readers.pending(table(spark, d, "securities").select("security_id"), panel(spark, d), ["security_id"])


def I6(spark: SparkSession, d: str) -> DataFrame:
    """Renames by exact lookup: claims whose ticker is a former one, with the present ticker."""
    hist = table(spark, d, "ticker_history").select("security_id", ticker_key("ticker").alias("old")).where("old is not null").distinct()
    now = table(spark, d, "securities").select("security_id", ticker_key("primary_ticker").alias("new"))
    pairs = hist.join(now, "security_id").where("old <> new").groupBy("old").agg(F.min("new").alias("new"), F.countDistinct("new").alias("n")).where("n = 1")
    c = table(spark, d, "membership_records").select("membership_id", ticker_key("raw_ticker").alias("old"))
    return c.join(pairs, "old").select("membership_id", "old", "new")


def I8(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "securities").where("has_unsupported_corporate_action")
    return s.select("security_id", F.concat_ws(" | ", "unsupported_corporate_action_note", F.lit("needs review")).alias("note"))


def I12(spark: SparkSession, d: str) -> DataFrame:
    """Actions whose recomputed quality differs, null-safe."""
    a = table(spark, d, "corporate_actions").where("action_type in ('split', 'reverse_split')")
    a = a.withColumn("fresh", split_kind(F.col("ratio_or_value")))
    return a.where(~F.col("fresh").eqNullSafe(F.col("corporate_action_quality"))).groupBy("corporate_action_quality", "fresh").agg(F.count(F.lit(1)).alias("n"))


def A36(spark: SparkSession, d: str) -> DataFrame:
    """Two reports side by side: metric, both values, difference."""
    def rep(y: int) -> DataFrame:
        p = table(spark, d, "prices").where(is_real("close") & (F.year("date") == y))
        return readers.long_metrics(p.agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("close"), 4).alias("mean_close")).withColumn("k", F.lit("r")), "k")

    a, b = rep(2018), rep(2019)
    return a.withColumnRenamed("value", "first").join(b.withColumnRenamed("value", "second"), ["k", "metric_name"], "full").select("metric_name", "first", "second", F.round(F.col("second") - F.col("first"), 4).alias("change"))


def ST4(spark: SparkSession, d: str) -> DataFrame:
    """Daily event counts by type over the whole table, as a batch."""
    return streams.daily_counts(table(spark, d, "events")).select(F.col("window.start").cast("date").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def ST4_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same as a stream run to its end."""
    return streams.run_daily_counts(spark, d)


def ST2(spark: SparkSession, d: str) -> DataFrame:
    return streams.run_first_seen(spark, d)


def ST1(spark: SparkSession, d: str) -> DataFrame:
    return streams.run_ordered_totals(spark, d)


QUERIES = {
    "S8_synthetic_bars": S8, "S9_weekdays": S9, "S11_clean_actions": S11, "S13_attempt_status": S13, "S18_long_metrics": S18, "B11_wide_metrics": B11, "S19_positions": S19, "S23_pending": S23, "I6_renames": I6, "I8_unsupported": I8,
    "I12_reclassified": I12, "A36_compare": A36, "ST4_daily_counts": ST4, "ST4_stream": ST4_stream, "ST2_stream_dedupe": ST2, "ST1_stream_state": ST1,
}

_K = "nullif(regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g'), '')"
_PNB = f"with {PANEL}"
_KIND = "case when ratio_or_value is null then null when list_bool_or([abs(ratio_or_value - c) / c <= 0.03 for c in [1.5,2,2.5,3,4,5,6,7,8,10,15,20,25,50,100]] || [abs(ratio_or_value - 1/c) / (1/c) <= 0.03 for c in [1.5,2,2.5,3,4,5,6,7,8,10,15,20,25,50,100]]) then 'genuine' else 'likely_spinoff_artifact' end"
_DAY = "select date_trunc('day', ts)::date as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2"
SQL = {
    "S9_weekdays": "select d::date as date from generate_series(date '2020-01-01', date '2020-12-31', interval 1 day) t(d) where isodow(d) <= 5",
    "S11_clean_actions": "select action_type, count(*) as n, round(sum(ratio_or_value), 4) as total from corporate_actions where ex_date between date '2016-01-01' and date '2018-12-31' and (case when action_type = 'dividend' then ratio_or_value > 0 else ratio_or_value > 0 and ratio_or_value <> 1 end) group by 1",
    "S13_attempt_status": f"{_PNB}, n as (select security_id, count(*) as n from panel group by 1), s as (select case when n is null and delisted_date is not null then 'PERMANENT_FAILURE' when n is null then 'SUCCESS_EMPTY_PROVIDER' else 'SUCCESS_WITH_DATA' end as status from securities left join n using (security_id)) select status, count(*) as n from s group by 1",
    "S18_long_metrics": f"{_PNB}, w as (select security_id, round(max(close), 6) as top, round(min(close), 6) as low, count(*)::double as bars from panel group by 1) select security_id, 'top' as metric_name, top as value from w union all select security_id, 'low', low from w union all select security_id, 'bars', bars from w",
    "B11_wide_metrics": f"{_PNB} select security_id, round(max(close), 6) as top, round(min(close), 6) as low from panel group by 1",
    "S19_positions": f"with {PANEL}, {MONTHS}, {PROBES}, v as (select p.as_of, p.security_id, b.close * 100 as v from probes p asof join panel b on p.security_id = b.security_id and p.as_of >= b.date) select as_of, security_id, round(v, 4) as value, round(coalesce(v / sum(v) over (partition by as_of), 0), 6) as weight from v",
    "S23_pending": f"{_PNB} select security_id from securities s where not exists (select 1 from panel p where p.security_id = s.security_id)",
    "I6_renames": f"with h as (select distinct security_id, {_K.format('ticker')} as old from ticker_history where {_K.format('ticker')} is not null), p as (select old, min({_K.format('primary_ticker')}) as new from h join securities s using (security_id) where old <> {_K.format('primary_ticker')} group by 1 having count(distinct {_K.format('primary_ticker')}) = 1) select membership_id, old, new from membership_records m join p on p.old = {_K.format('m.raw_ticker')}",
    "I8_unsupported": "select security_id, concat_ws(' | ', unsupported_corporate_action_note, 'needs review') as note from securities where has_unsupported_corporate_action",
    "I12_reclassified": f"with a as (select corporate_action_quality, {_KIND} as fresh from corporate_actions where action_type in ('split', 'reverse_split')) select corporate_action_quality, fresh, count(*) as n from a where fresh is distinct from corporate_action_quality group by 1, 2",
    "A36_compare": "with p as (select year(date) as y, count(*)::double as rows, round(avg(close), 4) as mean_close from prices where close is not null and not isnan(close) and year(date) in (2018, 2019) group by 1), l as (select y, 'rows' as metric_name, rows as v from p union all select y, 'mean_close', mean_close from p) select a.metric_name, a.v as first, b.v as second, round(b.v - a.v, 4) as change from (select * from l where y = 2018) a full join (select * from l where y = 2019) b using (metric_name)",
    "ST4_daily_counts": _DAY,
    "ST4_stream": _DAY,
    "ST2_stream_dedupe": "select count(*) as n, count(distinct user_id) as users from (select distinct event_id, user_id from events)",
    "ST1_stream_state": "select user_id, count(*) as n, round(sum(value), 4) as total from events group by 1",
}
