"""Trailing features, cross-sections, adjustments, labels and return decomposition."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronopanel.operators import adjust, asof, trailing
from chronopanel.operators.crosssection import mid_rank
from chronopanel.plans.asof_queries import _dividends
from chronopanel.plans.fixtures import MONTHS, PANEL, PROBES, months, panel, probes
from chronopanel.session import checkpoint, table

FEATURES = ("return_1m", "return_3m", "return_6m", "return_12m", "momentum_acceleration", "distance_from_200d_ma", "realised_volatility_63d", "downside_volatility_63d", "dollar_volume", "rolling_avg_dollar_volume_20d", "volume_trend_20d_100d", "history_length")
#: Families in the order in which an ablation adds them.
FAMILIES = {
    "price_momentum": FEATURES[:6],
    "volatility_risk": (*FEATURES[6:8], "max_drawdown_252d"),
    "volume_liquidity": FEATURES[8:11],
    "relative_cross_sectional": ("return_relative_to_eligible_mean_63d", "momentum_percentile_rank", "volatility_percentile_rank"),
    "market_regime": ("proxy_index_trend", "proxy_index_volatility", "breadth_proxy"),
}
#: The ladder of an ablation: which families each step has.
LADDER = {
    "price_only": ("price_momentum",),
    "price_plus_volatility": ("price_momentum", "volatility_risk"),
    "price_plus_volume": ("price_momentum", "volatility_risk", "volume_liquidity"),
    "price_plus_market_regime": ("price_momentum", "volatility_risk", "volume_liquidity", "market_regime"),
    "full_v1_feature_set": tuple(FAMILIES),
}


def features_of(families: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(c for x in families for c in FAMILIES[x])


def price_features(p: DataFrame) -> DataFrame:
    """The panel with every trailing feature as of each bar: one sort serves all windows."""
    t = trailing
    p = p.withColumn("ret", t.daily_return("close")).withColumn("dv", F.col("close") * F.col("volume"))
    p = t.cumulated(p, {"close": F.col("close"), "ret": F.col("ret"), "neg": F.when(F.col("ret") < 0, F.col("ret")), "dv": F.col("dv")})
    rb = t.return_between
    whole = (t.count("close", 64) == 64) & (t.count("ret", 63) == 63)
    ma, a20, a100 = t.mean("close", 200), t.mean("dv", 20), t.mean("dv", 100)
    return p.select(
        "security_id",
        "date",
        "close",
        "ret",
        rb("close", 0, 21).alias("return_1m"),
        rb("close", 0, 63).alias("return_3m"),
        rb("close", 0, 126).alias("return_6m"),
        rb("close", 0, 252).alias("return_12m"),
        (rb("close", 0, 63) - rb("close", 63, 63)).alias("momentum_acceleration"),
        F.when(ma != 0, F.col("close") / ma - 1).alias("distance_from_200d_ma"),
        F.when(whole, t.deviation("ret", 63)).alias("realised_volatility_63d"),
        F.when(whole, t.deviation("neg", 63)).alias("downside_volatility_63d"),
        F.col("dv").alias("dollar_volume"),
        a20.alias("rolling_avg_dollar_volume_20d"),
        F.when(a100 != 0, a20 / a100 - 1).alias("volume_trend_20d_100d"),
        F.row_number().over(t.series()).cast("long").alias("history_length"),
    )


def features_at(spark: SparkSession, d: str, p: DataFrame | None = None) -> DataFrame:
    """Features at each probe: computed per bar, then one as-of join. p: the panel, where it is at hand."""
    p = panel(spark, d) if p is None else p
    return asof.asof_backward(probes(spark, d, p), price_features(p), ["security_id"], "as_of", "date", ["close", *FEATURES])


def W_features(spark: SparkSession, d: str) -> DataFrame:
    return features_at(spark, d).select("security_id", "as_of", *[F.round(c, 6).alias(c) for c in FEATURES[:8]], *[F.round(c).alias(c) for c in FEATURES[8:10]], F.round(FEATURES[10], 6).alias(FEATURES[10]), F.coalesce(FEATURES[11], F.lit(0).cast("long")).alias(FEATURES[11]))


def drawdowns(spark: SparkSession, d: str, p: DataFrame | None = None) -> DataFrame:
    """Drawdown within the last 252 rows, only for the bars a probe sees."""
    p = panel(spark, d) if p is None else p
    at = probes(spark, d, p)
    p = p.select("security_id", "date", "close").withColumn("n", F.row_number().over(trailing.series()))
    seen = asof.asof_backward(at, p, ["security_id"], "as_of", "date", ["n"]).where("n >= 252").select("security_id", "as_of", "n")
    # a security's closes, as many as the calendar has days, travel once; each probe cuts its 252 out of them
    closes = p.groupBy("security_id").agg(F.array_sort(F.collect_list(F.struct("n", "close"))).alias("x"))
    got = seen.join(closes, "security_id")
    return got.select("security_id", "as_of", trailing.drawdown(F.slice("x.close", F.col("n") - 251, 252)).alias("max_drawdown_252d"))


def W8(spark: SparkSession, d: str) -> DataFrame:
    return drawdowns(spark, d).select("security_id", "as_of", F.round("max_drawdown_252d", 6).alias("max_drawdown_252d"))


def W13(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("security_id").orderBy(F.col("date").desc())
    return panel(spark, d).where("date <= date '2016-06-30'").withColumn("age", F.row_number().over(w)).where("age <= 5").select("security_id", "date", "close", "age")


def W14(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d)
    first = F.lag("close", 251).over(trailing.series())
    p = p.withColumn("trailing_return", F.when(first != 0, F.col("close") / first - 1))
    return asof.asof_backward(probes(spark, d), p, ["security_id"], "as_of", "date", ["trailing_return"]).select("security_id", "as_of", F.round("trailing_return", 6).alias("trailing_return"))


def A_cross_section(spark: SparkSession, d: str) -> DataFrame:
    """Mean, trend, breadth and relative return per month start."""
    f = features_at(spark, d)
    above = F.when(F.col("distance_from_200d_ma") > 0, 1.0).when(F.col("distance_from_200d_ma") <= 0, 0.0)
    return f.groupBy("as_of").agg(F.round(F.avg("return_1m"), 6).alias("mean_return_1m"), F.round(F.avg("return_3m"), 6).alias("proxy_index_trend"), F.round(F.avg(above), 6).alias("breadth_proxy"), F.count("return_3m").alias("n"))


def W10(spark: SparkSession, d: str) -> DataFrame:
    f = features_at(spark, d).withColumn("rel", F.col("return_3m") - F.avg("return_3m").over(Window.partitionBy("as_of"))).withColumn("rank_v", mid_rank("realised_volatility_63d", ["as_of"]))
    return f.where("return_3m is not null").select("security_id", "as_of", F.round("rel", 6).alias("return_relative_to_mean"), F.round("rank_v", 6).alias("volatility_percentile_rank"))


def proxy_returns(p: DataFrame) -> DataFrame:
    """Mean return per pair of consecutive market sessions over members priced at both."""
    cal = F.broadcast(asof.sessions(p, "date").select("date", "prev_session"))
    prev = p.select("security_id", F.col("date").alias("prev_session"), F.col("close").alias("before"))
    both = p.join(cal, "date").join(prev, ["security_id", "prev_session"]).where("before <> 0")
    return both.groupBy("date").agg(F.avg(F.col("close") / F.col("before") - 1).alias("r"), F.count(F.lit(1)).alias("members"))


def A5(spark: SparkSession, d: str) -> DataFrame:
    return proxy_returns(panel(spark, d)).select("date", F.round("r", 6).alias("proxy_return"), "members")


def A6(spark: SparkSession, d: str) -> DataFrame:
    """Volatility of the proxy over 63 returns; the calendar, a few thousand rows, is one window."""
    w = Window.orderBy("date").rowsBetween(-62, 0)
    r = proxy_returns(panel(spark, d))
    v = r.select("date", F.when(F.count("r").over(w) >= 2, F.stddev_samp("r").over(w)).alias("v"))
    return v.select("date", F.round("v", 6).alias("proxy_index_volatility"))


def proxy_volatility_at(spark: SparkSession, d: str, sessions: int = 63, p: DataFrame | None = None) -> DataFrame:
    """Volatility at each month start of the mean return, over the last sessions, of the securities probed there."""
    p = (panel(spark, d) if p is None else p).select("security_id", "date", "close")
    cal = asof.sessions(p, "date").select("date", "prev_session")
    days = sorted(r["date"] for r in cal.select("date").collect())  # the calendar
    windows = [(m["as_of"], x) for m in months(spark, d).collect() for i in [bisect_right(days, m["as_of"])] for x in days[max(0, i - sessions) : i]]
    windows = spark.createDataFrame(windows, "as_of date, date date")
    last = p.groupBy("security_id").agg(F.max("date").alias("last"))
    prev = p.select("security_id", F.col("date").alias("prev_session"), F.col("close").alias("before"))
    both = p.join(F.broadcast(cal), "date").join(prev, ["security_id", "prev_session"]).where("before <> 0").join(last, "security_id")
    r = both.select("date", "last", (F.col("close") / F.col("before") - 1).alias("r")).join(F.broadcast(windows), "date").where(F.col("as_of") <= F.date_add("last", 40))
    return r.groupBy("as_of", "date").agg(F.avg("r").alias("r")).groupBy("as_of").agg(F.stddev_samp("r").alias("proxy_index_volatility"))


def family_features(spark: SparkSession, d: str, p: DataFrame | None = None) -> DataFrame:
    """Each probe with the features of all families and the length of its history. The panel is made once, as four plans read it."""
    p = checkpoint(panel(spark, d).select("security_id", "date", "close", "volume")) if p is None else p
    by = Window.partitionBy("as_of")
    above = F.when(F.col("distance_from_200d_ma") > 0, 1.0).when(F.col("distance_from_200d_ma") <= 0, 0.0)
    f = features_at(spark, d, p).join(drawdowns(spark, d, p), ["security_id", "as_of"], "left").join(F.broadcast(proxy_volatility_at(spark, d, p=p)), "as_of", "left")
    f = f.withColumns({
        "return_relative_to_eligible_mean_63d": F.col("return_3m") - F.avg("return_3m").over(by), "momentum_percentile_rank": mid_rank("return_12m", ["as_of"]), "volatility_percentile_rank": mid_rank("realised_volatility_63d", ["as_of"]),
        "proxy_index_trend": F.avg("return_3m").over(by), "breadth_proxy": F.avg(above).over(by),
    })
    return f.select("security_id", "as_of", "history_length", *[c for x in FAMILIES.values() for c in x])


def A31(spark: SparkSession, d: str) -> DataFrame:
    """Members, mean pairwise correlation by the variance ratio, and breadth N / (1 + (N - 1) rho) per year."""
    f = price_features(panel(spark, d)).where("ret is not null").select("security_id", "date", "ret", F.year("date").alias("y"))
    s = f.groupBy("y", "security_id").agg(F.var_pop("ret").alias("v"))
    s = s.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean_var"), F.avg(F.sqrt("v")).alias("mean_sd"))
    i = f.groupBy("y", "date").agg(F.avg("ret").alias("r")).groupBy("y").agg(F.var_pop("r").alias("iv"))
    rho = F.try_divide(F.col("iv"), F.col("mean_sd") * F.col("mean_sd"))
    out = s.join(i, "y").withColumn("rho", F.greatest(F.lit(0.0), F.least(F.lit(1.0), rho)))
    return out.select(F.col("y").alias("year"), "n", F.round("rho", 6).alias("rho"), F.round(F.col("n") / (1 + (F.col("n") - 1) * F.col("rho")), 4).alias("effective_breadth"))


def _splits(spark: SparkSession, d: str) -> DataFrame:
    acts = table(spark, d, "corporate_actions").where("action_type in ('split', 'reverse_split') and ex_date is not null and security_id is not null")
    return acts.groupBy("security_id", "ex_date").agg(F.max("ratio_or_value").alias("ratio"))


def P9(spark: SparkSession, d: str) -> DataFrame:
    return _splits(spark, d).select("security_id", "ex_date", "ratio", adjust.split_kind(F.col("ratio")).alias("kind"))


def W20(spark: SparkSession, d: str) -> DataFrame:
    out = adjust.split_adjusted(panel(spark, d), _splits(spark, d))
    return out.select("security_id", "date", F.round("close", 6).alias("close"), F.round("volume").alias("volume"))


def W21(spark: SparkSession, d: str) -> DataFrame:
    base = adjust.split_adjusted(panel(spark, d), _splits(spark, d))
    out = adjust.total_return(base, _dividends(spark, d))
    return out.select("security_id", "date", F.round("close", 6).alias("close"), F.round("volume").alias("volume"))


def labels(spark: SparkSession, d: str, months: int = 3, p: DataFrame | None = None) -> DataFrame:
    p = (panel(spark, d) if p is None else p).select("security_id", "date", "close")
    start = asof.asof_backward(probes(spark, d, p).withColumn("target_date", F.add_months("as_of", months)), p, ["security_id"], "as_of", "date", [F.col("close").alias("close0")]).drop("fact_time")
    end = asof.resolve_forward(start, p, ["security_id"], "target_date", "date", "close")
    end = end.withColumn("r", F.when(F.col("close0") != 0, F.col("close") / F.col("close0") - 1)).where("r is not null")
    by = Window.partitionBy("as_of")
    return end.withColumn("y", F.col("r") - F.avg("r").over(by)).withColumn("rank", mid_rank("r", ["as_of"]))


def M4(spark: SparkSession, d: str) -> DataFrame:
    lab = labels(spark, d)
    return lab.select("security_id", "as_of", F.round("r", 6).alias("r"), F.round("y", 6).alias("y"), F.round("rank", 6).alias("rank"), (F.round("y", 6) > 0).cast("int").alias("z"), "truncated")


def A8(spark: SparkSession, d: str) -> DataFrame:
    return labels(spark, d).groupBy("as_of").agg(F.count(F.lit(1)).alias("n_labels"), F.count_if("truncated").alias("n_truncated"), F.round(F.avg("r"), 6).alias("benchmark"))


def M2(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the panel per month: complete ones, and why others fall out."""
    f = features_at(spark, d).select("security_id", "as_of", *FEATURES)
    lab = labels(spark, d).select("security_id", "as_of", "y", "truncated")
    missing = None
    for c in FEATURES:
        missing = F.col(c).isNull() if missing is None else missing | F.col(c).isNull()
    j = f.join(lab, ["security_id", "as_of"], "left").withColumn("gap", missing)
    return j.groupBy("as_of").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("gap").alias("missing_feature"), F.count_if(~F.col("gap") & F.col("y").isNull()).alias("missing_label"), F.count_if(~F.col("gap") & F.col("y").isNotNull()).alias("rows"), F.count_if(~F.col("gap") & F.col("truncated")).alias("truncated_rows"))


def W15(spark: SparkSession, d: str) -> DataFrame:
    """Overnight and intraday log returns; overnight needs the market's session before."""
    p = panel(spark, d)
    cal = F.broadcast(asof.sessions(p, "date").select("date", "prev_session"))
    w = trailing.series()
    j = p.join(cal, "date").withColumn("pd", F.lag("date").over(w)).withColumn("pc", F.lag("close").over(w))
    up = lambda a, b: F.when((F.col(a) > 0) & (F.col(b) > 0), F.ln(F.col(a) / F.col(b)))
    return j.select("security_id", "date", F.round(F.when(F.col("pd") == F.col("prev_session"), up("open", "pc")), 6).alias("overnight"), F.round(up("close", "open"), 6).alias("intraday"))


def overnight_series(spark: SparkSession, d: str) -> DataFrame:
    """Mean overnight and intraday return per session over securities with all three prices."""
    p = panel(spark, d)
    cal = F.broadcast(asof.sessions(p, "date").select("date", "prev_session"))
    w = trailing.series()
    j = p.join(cal, "date").withColumn("pd", F.lag("date").over(w)).withColumn("pc", F.lag("close").over(w))
    ok = (F.col("pd") == F.col("prev_session")) & (F.col("open") > 0) & (F.col("close") > 0) & (F.col("pc") > 0)
    ok = F.coalesce(ok, F.lit(False))
    return j.groupBy("date").agg(F.avg(F.when(ok, F.ln(F.col("open") / F.col("pc")))).alias("overnight"), F.avg(F.when(ok, F.ln(F.col("close") / F.col("open")))).alias("intraday"), F.count_if(ok).alias("n_securities"), F.count_if(~ok).alias("n_missing"))


def A7(spark: SparkSession, d: str) -> DataFrame:
    return overnight_series(spark, d).select("date", F.round("overnight", 6).alias("overnight"), F.round("intraday", 6).alias("intraday"), "n_securities", "n_missing")


QUERIES = {
    "W1_W12_features": W_features, "W8_max_drawdown": W8, "W10_relative_return": W10, "W13_price_history": W13, "W14_trailing_return": W14, "A2_A4_cross_section": A_cross_section, "A5_proxy_returns": A5, "A6_proxy_volatility": A6,
    "A31_effective_breadth": A31, "P9_split_kind": P9, "W20_split_adjusted": W20, "W21_total_return": W21, "M4_labels": M4, "A8_label_counts": A8, "M2_panel_counts": M2, "W15_return_parts": W15, "A7_overnight_series": A7,
}

_P = f"with {PANEL}, {MONTHS}, {PROBES}"
_W = "window w as (partition by security_id order by date)"


def _lag(n: int) -> str:
    return f"lag(close, {n}) over w"


_F1 = f"""r1 as (select *, case when {_lag(1)} <> 0 then close / {_lag(1)} - 1 end as ret, close * volume as dv from panel {_W}),
 feats as (select security_id, date, close, ret,
  case when {_lag(21)} <> 0 then close / {_lag(21)} - 1 end as return_1m, case when {_lag(63)} <> 0 then close / {_lag(63)} - 1 end as return_3m,
  case when {_lag(126)} <> 0 then close / {_lag(126)} - 1 end as return_6m, case when {_lag(252)} <> 0 then close / {_lag(252)} - 1 end as return_12m,
  (case when {_lag(63)} <> 0 then close / {_lag(63)} - 1 end) - (case when {_lag(126)} <> 0 then {_lag(63)} / {_lag(126)} - 1 end) as momentum_acceleration,
  case when count(close) over m200 = 200 and avg(close) over m200 <> 0 then close / avg(close) over m200 - 1 end as distance_from_200d_ma,
  case when count(close) over m64 = 64 and count(ret) over m63 = 63 then stddev_samp(ret) over m63 end as realised_volatility_63d,
  case when count(close) over m64 = 64 and count(ret) over m63 = 63 and count(case when ret < 0 then ret end) over m63 >= 2 then stddev_samp(case when ret < 0 then ret end) over m63 end as downside_volatility_63d,
  dv as dollar_volume, case when count(dv) over m20 = 20 then avg(dv) over m20 end as rolling_avg_dollar_volume_20d,
  case when count(dv) over m100 = 100 and avg(dv) over m100 <> 0 then (case when count(dv) over m20 = 20 then avg(dv) over m20 end) / avg(dv) over m100 - 1 end as volume_trend_20d_100d,
  row_number() over w as history_length
  from r1 window w as (partition by security_id order by date), m20 as (partition by security_id order by date rows 19 preceding), m63 as (partition by security_id order by date rows 62 preceding),
  m64 as (partition by security_id order by date rows 63 preceding), m100 as (partition by security_id order by date rows 99 preceding), m200 as (partition by security_id order by date rows 199 preceding)),
 fat as (select p.security_id as sid, p.as_of, b.* exclude (security_id) from probes p asof left join feats b on p.security_id = b.security_id and p.as_of >= b.date)"""
_SPL = "spl as (select security_id, ex_date, max(ratio_or_value) as ratio from corporate_actions where action_type in ('split', 'reverse_split') and ex_date is not null and security_id is not null group by 1, 2)"
_KIND = "case when ratio is null then null when list_bool_or([abs(ratio - c) / c <= 0.03 for c in [1.5,2,2.5,3,4,5,6,7,8,10,15,20,25,50,100]] || [abs(ratio - 1/c) / (1/c) <= 0.03 for c in [1.5,2,2.5,3,4,5,6,7,8,10,15,20,25,50,100]]) then 'genuine' else 'likely_spinoff_artifact' end"
_ADJ = f"""{_SPL}, gen as (select * from spl where ratio <> 0 and ({_KIND}) = 'genuine'),
 adj as (select p.security_id, p.date, p.close / coalesce((select product(ratio) from gen g where g.security_id = p.security_id and g.ex_date > p.date), 1.0) as close,
   p.volume * coalesce((select product(ratio) from gen g where g.security_id = p.security_id and g.ex_date > p.date), 1.0) as volume from panel p)"""
_LAB = """st as (select p.security_id, p.as_of, (p.as_of + interval 3 month)::date as target, b.close as c0 from probes p asof left join panel b on p.security_id = b.security_id and p.as_of >= b.date),
 fw as (select st.*, b.date as fd, b.close as fc from st asof left join panel b on st.security_id = b.security_id and st.target <= b.date),
 bw as (select fw.*, b.close as bc from fw asof left join panel b on fw.security_id = b.security_id and fw.target >= b.date),
 en as (select security_id, as_of, c0, case when fc is not null and fd - target <= 10 then fc else bc end as c1, not (fc is not null and fd - target <= 10) as truncated from bw),
 lab as (select security_id, as_of, c1 / c0 - 1 as r, truncated from en where c0 <> 0 and c1 is not null)"""
_CALP = "cal as (select date, lag(date) over (order by date) as prev_session from (select distinct date from panel))"
_PROXY = f"{_CALP}, prox as (select a.date, avg(a.close / b.close - 1) as r, count(*) as members from panel a join cal using (date) join panel b on b.security_id = a.security_id and b.date = cal.prev_session where b.close <> 0 group by 1)"
_ON = f"{_CALP}, jj as (select p.*, prev_session, lag(p.date) over w as pd, lag(close) over w as pc from panel p join cal using (date) window w as (partition by security_id order by p.date))"
SQL = {
    "W1_W12_features": f"{_P}, {_F1} select sid as security_id, as_of, {', '.join(f'round({c}, 6) as {c}' for c in FEATURES[:8])}, {', '.join(f'round({c}, 0) as {c}' for c in FEATURES[8:10])}, round({FEATURES[10]}, 6) as {FEATURES[10]}, coalesce({FEATURES[11]}, 0) as {FEATURES[11]} from fat",
    "W8_max_drawdown": f"""{_P}, n as (select *, row_number() over (partition by security_id order by date) as n from panel), s as (select p.security_id, p.as_of, b.n from probes p asof left join n b on p.security_id = b.security_id and p.as_of >= b.date),
      x as (select s.security_id, s.as_of, n.n, n.close, max(n.close) over (partition by s.security_id, s.as_of order by n.n) as peak from s join n on n.security_id = s.security_id and n.n between s.n - 251 and s.n where s.n >= 252)
      select security_id, as_of, round(min(least(0, case when peak > 0 then (close - peak) / peak else 0 end)), 6) as max_drawdown_252d from x group by 1, 2""",
    "W10_relative_return": f"{_P}, {_F1}, x as (select *, return_3m - avg(return_3m) over (partition by as_of) as rel, case when realised_volatility_63d is not null and count(realised_volatility_63d) over (partition by as_of) >= 2 then (rank() over (partition by as_of order by realised_volatility_63d nulls last) - 1 + 0.5 * count(*) over (partition by as_of, realised_volatility_63d)) / count(realised_volatility_63d) over (partition by as_of) end as rv from fat) select sid as security_id, as_of, round(rel, 6) as return_relative_to_mean, round(rv, 6) as volatility_percentile_rank from x where return_3m is not null",
    "W13_price_history": f"with {PANEL}, r as (select security_id, date, close, row_number() over (partition by security_id order by date desc) as age from panel where date <= date '2016-06-30') select * from r where age <= 5",
    "W14_trailing_return": f"{_P}, r as (select *, case when {_lag(251)} <> 0 then close / {_lag(251)} - 1 end as tr from panel {_W}) select p.security_id, p.as_of, round(b.tr, 6) as trailing_return from probes p asof left join r b on p.security_id = b.security_id and p.as_of >= b.date",
    "A2_A4_cross_section": f"{_P}, {_F1} select as_of, round(avg(return_1m), 6) as mean_return_1m, round(avg(return_3m), 6) as proxy_index_trend, round(avg(case when distance_from_200d_ma > 0 then 1.0 when distance_from_200d_ma <= 0 then 0.0 end), 6) as breadth_proxy, count(return_3m) as n from fat group by 1",
    "A5_proxy_returns": f"with {PANEL}, {_PROXY} select date, round(r, 6) as proxy_return, members from prox",
    "A6_proxy_volatility": f"with {PANEL}, {_PROXY} select date, round(case when count(r) over w >= 2 then stddev_samp(r) over w end, 6) as proxy_index_volatility from prox window w as (order by date rows 62 preceding)",
    "A31_effective_breadth": f"with {PANEL}, r as (select security_id, date, year(date) as y, case when {_lag(1)} <> 0 then close / {_lag(1)} - 1 end as ret from panel {_W}), f as (select * from r where ret is not null), s as (select y, count(*) as n, avg(sqrt(v)) as sd from (select y, security_id, var_pop(ret) as v from f group by 1, 2) group by 1), i as (select y, var_pop(r) as iv from (select y, date, avg(ret) as r from f group by 1, 2) group by 1), z as (select s.y, n, case when sd <> 0 then greatest(0, least(1, iv / (sd * sd))) else 0 end as rho from s join i using (y)) select y::bigint as year, n, round(rho, 6) as rho, round(n / (1 + (n - 1) * rho), 4) as effective_breadth from z",
    "P9_split_kind": f"with {_SPL} select security_id, ex_date, ratio, {_KIND} as kind from spl",
    "W20_split_adjusted": f"with {PANEL}, {_ADJ} select security_id, date, round(close, 6) as close, round(volume, 0) as volume from adj",
    "W21_total_return": f"""with {PANEL}, {_ADJ}, div as (select security_id, ex_date, max(ratio_or_value) as amount from corporate_actions where action_type = 'dividend' and security_id is not null and ex_date is not null group by 1, 2),
      an as (select d.*, a.close from div d asof join adj a on a.security_id = d.security_id and a.date < d.ex_date where amount > 0), fc as (select security_id, ex_date, greatest(1 - amount / close, 0.01) as f from an where close > 0),
      z as (select a.*, coalesce((select product(f) from fc where fc.security_id = a.security_id and fc.ex_date > a.date), 1.0) as k from adj a)
      select security_id, date, round(close * k, 6) as close, round(volume / k, 0) as volume from z""",
    "M4_labels": f"{_P}, {_LAB}, q as (select *, r - avg(r) over (partition by as_of) as y, case when count(r) over (partition by as_of) >= 2 then (rank() over (partition by as_of order by r) - 1 + 0.5 * count(*) over (partition by as_of, r)) / count(r) over (partition by as_of) end as rk from lab) select security_id, as_of, round(r, 6) as r, round(y, 6) as y, round(rk, 6) as rank, (round(y, 6) > 0)::bigint as z, truncated from q",
    "A8_label_counts": f"{_P}, {_LAB} select as_of, count(*) as n_labels, count(case when truncated then 1 end) as n_truncated, round(avg(r), 6) as benchmark from lab group by 1",
    "M2_panel_counts": f"{_P}, {_F1}, {_LAB}, j as (select fat.*, lab.r, lab.truncated, ({' or '.join(c + ' is null' for c in FEATURES)}) as gap from fat left join lab on lab.security_id = fat.sid and lab.as_of = fat.as_of) select as_of, count(*) as candidates, count(case when gap then 1 end) as missing_feature, count(case when not gap and r is null then 1 end) as missing_label, count(case when not gap and r is not null then 1 end) as rows, count(case when not gap and truncated then 1 end) as truncated_rows from j group by 1",
    "W15_return_parts": f"with {PANEL}, {_ON} select security_id, date, round(case when pd = prev_session and open > 0 and pc > 0 then ln(open / pc) end, 6) as overnight, round(case when close > 0 and open > 0 then ln(close / open) end, 6) as intraday from jj",
    "A7_overnight_series": f"with {PANEL}, {_ON}, k as (select *, coalesce(pd = prev_session and open > 0 and close > 0 and pc > 0, false) as ok from jj) select date, round(avg(case when ok then ln(open / pc) end), 6) as overnight, round(avg(case when ok then ln(close / open) end), 6) as intraday, count(case when ok then 1 end) as n_securities, count(case when not ok then 1 end) as n_missing from k group by 1",
}
