"""Evaluation, significance, splits, top-k and distribution queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronopanel.operators import bootstrap, splits
from chronopanel.operators.crosssection import average_rank, rank_correlation, safe_corr
from chronopanel.plans.feature_queries import _F1, _LAB, _ON, features_at, labels, overnight_series, price_features
from chronopanel.operators.ranking import number_rows, quantiles
from chronopanel.plans.fixtures import MONTHS, PANEL, PROBES, months, panel
from chronopanel.session import checkpoint, table


def _scored(spark: SparkSession, d: str) -> DataFrame:
    f = features_at(spark, d).select("security_id", "as_of", F.col("return_1m").alias("score"))
    return f.join(labels(spark, d).select("security_id", "as_of", "r"), ["security_id", "as_of"]).where("score is not null")


def A9(spark: SparkSession, d: str) -> DataFrame:
    return rank_correlation(_scored(spark, d), ["as_of"], "score", "r", 5).select("as_of", "n", F.round("ic", 6).alias("ic"), F.round("hit_rate", 6).alias("hit_rate"))


def A9_summary(spark: SparkSession, d: str) -> DataFrame:
    p = rank_correlation(_scored(spark, d), ["as_of"], "score", "r", 5)
    return p.agg(F.round(F.avg("ic"), 6).alias("mean_ic"), F.round(F.median("ic"), 6).alias("median_ic"), F.round(F.stddev_samp("ic"), 6).alias("sd_ic"), F.round(F.avg("hit_rate"), 6).alias("mean_hit_rate"), F.count(F.lit(1)).alias("dates"))


def P11(spark: SparkSession, d: str) -> DataFrame:
    """The summary with and without four months."""
    p = rank_correlation(_scored(spark, d), ["as_of"], "score", "r", 5)
    out = ~F.date_format("as_of", "yyyy-MM").isin("2020-02", "2020-03", "2020-04", "2020-05")
    return p.agg(F.round(F.avg("ic"), 6).alias("all_dates"), F.round(F.avg(F.when(out, F.col("ic"))), 6).alias("without_months"), F.count_if(out).alias("dates_left"))


def A10(spark: SparkSession, d: str) -> DataFrame:
    f = price_features(panel(spark, d)).where("ret is not null and dollar_volume is not null")
    return f.groupBy("security_id").agg(F.round(safe_corr("ret", "dollar_volume", 0.0), 6).alias("corr"), F.count(F.lit(1)).alias("n"))


def A11(spark: SparkSession, d: str) -> DataFrame:
    by = ["security_id"]
    f = price_features(panel(spark, d)).where("ret is not null and dollar_volume is not null").withColumn("a", average_rank("ret", by)).withColumn("b", average_rank("dollar_volume", by))
    return f.groupBy("security_id").agg(F.round(safe_corr("a", "b"), 6).alias("spearman"))


def A12(spark: SparkSession, d: str) -> DataFrame:
    f = price_features(panel(spark, d)).where("ret is not null")
    q = F.percentile("ret", F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    return f.groupBy("security_id").agg(q.alias("q")).select("security_id", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p05", "p25", "p50", "p75", "p95"))])


def A13(spark: SparkSession, d: str) -> DataFrame:
    f = price_features(panel(spark, d)).where("ret is not null").select(F.year("date").alias("year"), "ret")
    f = checkpoint(f)  # read for the moments and for the ranks
    mid = quantiles(f, ["year"], "ret", [0.5]).select("year", F.round("quantile", 6).alias("median"))
    m = f.groupBy("year").agg(F.round(F.avg("ret"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("ret"), F.lit(0.0)), 6).alias("sd"), F.round(F.min("ret"), 6).alias("least"), F.round(F.max("ret"), 6).alias("greatest"))
    return m.join(mid, "year").select("year", "mean", "median", "sd", "least", "greatest")


def A14(spark: SparkSession, d: str) -> DataFrame:
    per = features_at(spark, d).groupBy("as_of").agg(F.count("return_3m").alias("n"))
    return per.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 4).alias("mean"), F.count_if(F.col("n") == 0).alias("empty_dates"))


#: Random pairs of securities of which the mean correlation is taken, and draws to find them.
PAIRS, PAIR_DRAWS = 2000, 6000


def A30(spark: SparkSession, d: str) -> DataFrame:
    """Mean correlation of returns over up to PAIRS seeded random pairs with 60 common dates or more.

    The pairs are the feature, a sample as large at any size. Securities are
    numbered in id order; both of a pair are drawn by hash, the second from the
    others; only the rows of drawn securities are joined, on date.
    """
    f = price_features(panel(spark, d)).where("ret is not null").select("security_id", "date", "ret")
    f = checkpoint(f)
    ids = number_rows(f.select("security_id").distinct(), [], ["security_id"], "place")
    n = ids.agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    h = lambda x: F.conv(F.substring(F.md5(F.concat(F.lit(f"42|{x}|"), "j")), 1, 8), 16, 10).cast("long")
    draws = n.select("n", F.explode(F.sequence(F.lit(1), F.lit(PAIR_DRAWS))).alias("j"))
    draws = draws.select("j", (h("a") % F.col("n") + 1).alias("pa"), (h("b") % (F.col("n") - 1) + 1).alias("pb")).withColumn("pb", F.when(F.col("pb") >= F.col("pa"), F.col("pb") + 1).otherwise(F.col("pb")))
    a = ids.select(F.col("security_id").alias("a"), F.col("place").alias("pa"))
    b = ids.select(F.col("security_id").alias("b"), F.col("place").alias("pb"))
    pairs = draws.join(a, "pa").join(b, "pb").select("j", "a", "b")
    x = f.select(F.col("security_id").alias("a"), "date", F.col("ret").alias("x"))
    y = f.select(F.col("security_id").alias("b"), "date", F.col("ret").alias("y"))
    c = x.join(F.broadcast(pairs), "a").join(y, ["b", "date"]).groupBy("j").agg(F.count(F.lit(1)).alias("n"), safe_corr("x", "y").alias("r")).where("n >= 60 and r is not null")
    best = c.orderBy("j").limit(PAIRS)
    return best.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("r"), 6).alias("mean_correlation"))


def A29(spark: SparkSession, d: str) -> DataFrame:
    s = overnight_series(spark, d).where("overnight is not null")
    return s.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("days"), F.round(F.avg("overnight") * 252 * 100, 4).alias("annualised_pct"))


def A29_top(spark: SparkSession, d: str) -> DataFrame:
    """Mean overnight return without the k greatest days by absolute value."""
    s = overnight_series(spark, d).where("overnight is not null").select("date", "overnight")
    s = s.withColumn("place", F.row_number().over(Window.orderBy(F.round(F.abs("overnight"), 12).desc(), "date")))
    k = F.explode(F.array(*[F.lit(x) for x in (0, 1, 3, 5, 10, 20)]))
    return s.withColumn("k", k).where("place > k").groupBy("k").agg(F.round(F.avg("overnight"), 8).alias("mean"), F.count(F.lit(1)).alias("days"))


def O3(spark: SparkSession, d: str) -> DataFrame:
    s = overnight_series(spark, d).where("overnight is not null")
    return s.select("date", F.round("overnight", 6).alias("overnight")).orderBy(F.abs("overnight").desc(), "date").limit(20)


def W17(spark: SparkSession, d: str) -> DataFrame:
    return bootstrap.autocorrelation(overnight_series(spark, d), "date", "overnight").select("lag", F.round("rho", 6).alias("rho"))


def G2(spark: SparkSession, d: str) -> DataFrame:
    s = overnight_series(spark, d).where("overnight is not null")
    acf = {r["lag"]: r["rho"] for r in bootstrap.autocorrelation(s, "date", "overnight").collect()}  # twenty lags
    return spark.createDataFrame([(bootstrap.choose_block_length(acf, s.count()),)], "block_length int")


def _series(spark: SparkSession, d: str) -> tuple[list[float], list[float]]:
    rows = overnight_series(spark, d).where("overnight is not null").orderBy("date").select("overnight", "intraday").collect()  # one row per calendar day
    return [r[0] for r in rows], [r[1] for r in rows]


def G5(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the mean overnight return and of its difference to the intraday one."""
    night, intraday = _series(spark, d)
    acf = {r["lag"]: r["rho"] for r in bootstrap.autocorrelation(overnight_series(spark, d), "date", "overnight").collect()}
    block = bootstrap.choose_block_length(acf, len(night))
    a = bootstrap.mean_interval(spark, night, block)
    b = bootstrap.mean_interval(spark, [x - y for x, y in zip(night, intraday, strict=True)], block)
    rows = [(n, *(float(r[k]) * 25200 for k in ("mean", "low", "high")), bool(r["excludes_zero"]), bootstrap.verdict(a, b)) if r else (n, None, None, None, None, "inconclusive") for n, r in (("overnight", a), ("difference", b))]
    return spark.createDataFrame(rows, "series string, annualised_pct double, low double, high double, excludes_zero boolean, verdict string")


def G6(spark: SparkSession, d: str) -> DataFrame:
    """Effective number of observations: variance over that of the block-bootstrap mean."""
    night, _ = _series(spark, d)
    means = bootstrap.block_means(spark, night, 5, 1000, 42)
    n, mean = len(night), sum(night) / max(1, len(night))
    var = sum((x - mean) ** 2 for x in night) / max(1, n)
    return means.agg(F.least(F.lit(float(n)), F.lit(var) / F.var_pop("mean")).alias("effective_n")).select(F.lit(n).alias("n"), F.round("effective_n", 2).alias("effective_n"))


def M9(spark: SparkSession, d: str) -> DataFrame:
    return splits.primary_split(months(spark, d), "as_of", 0.6, 0.15, 0.25, 3)


def A32(spark: SparkSession, d: str) -> DataFrame:
    parts = splits.primary_split(months(spark, d), "as_of", 0.6, 0.15, 0.25, 3)
    per = labels(spark, d).groupBy("as_of").agg(F.count(F.lit(1)).alias("pairs"))
    j = parts.join(per, "as_of", "left")
    return j.groupBy("part").agg(F.count(F.lit(1)).alias("months"), F.sum(F.coalesce("pairs", F.lit(0))).alias("pairs"), F.floor(F.count(F.lit(1)) / 3).alias("blocks"))


def ST3(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(splits.expanding_checkpoints(108, 24, 3, 3), "retrain_at long, train_until long")


def O2(spark: SparkSession, d: str) -> DataFrame:
    """The twenty greatest trailing returns per month, equal weights; ties in id order."""
    f = features_at(spark, d).where("return_12m is not null")
    w = Window.partitionBy("as_of").orderBy(F.round("return_12m", 9).desc(), "security_id")
    f = f.withColumn("place", F.row_number().over(w)).where("place <= 20")
    return f.select("as_of", "security_id", "place", F.round(1 / F.count(F.lit(1)).over(Window.partitionBy("as_of")), 6).alias("weight"))


def O4(spark: SparkSession, d: str) -> DataFrame:
    """A repeatable spot check: thirty corporate actions in order of a seeded hash; the limit is the feature."""
    a = table(spark, d, "corporate_actions").select("security_id", "action_type", "ex_date").distinct()
    k = F.md5(F.concat_ws("|", F.lit("42"), "security_id", "action_type", F.date_format("ex_date", "yyyy-MM-dd")))
    return a.orderBy(k, "security_id", "action_type", "ex_date").limit(30)


def O8(spark: SparkSession, d: str) -> DataFrame:
    """The feature with the greatest mean rank correlation: features unpivoted, one pass."""
    names = ["return_1m", "return_3m", "return_6m", "return_12m", "momentum_acceleration", "distance_from_200d_ma"]
    f = features_at(spark, d).select("security_id", "as_of", *names).join(labels(spark, d).select("security_id", "as_of", "r"), ["security_id", "as_of"])
    long = f.unpivot(["security_id", "as_of", "r"], names, "feature", "score").where("score is not null")
    per = rank_correlation(long, ["feature", "as_of"], "score", "r", 5)
    return per.groupBy("feature").agg(F.round(F.avg("ic"), 6).alias("mean_ic"), F.count("ic").alias("dates"))


QUERIES = {
    "A9_rank_correlation": A9, "A9_summary": A9_summary, "P11_regime_exclusion": P11, "A10_pearson": A10, "A11_spearman": A11, "A12_percentiles": A12, "A13_distribution": A13, "A14_coverage_summary": A14, "A30_pairwise_correlation": A30,
    "A29_by_year": A29, "A29_without_extremes": A29_top, "O3_extreme_days": O3, "W17_autocorrelation": W17, "G2_block_length": G2, "G5_significance": G5, "G6_effective_n": G6, "M9_primary_split": M9, "A32_sample_sizes": A32,
    "ST3_retrain_checkpoints": ST3, "O2_top_momentum": O2, "O4_spot_check": O4, "O8_best_feature": O8,
}

_P = f"with {PANEL}, {MONTHS}, {PROBES}"
_SC = f"{_P}, {_F1}, {_LAB}, sc as (select f.sid as security_id, f.as_of, f.return_1m as score, l.r from fat f join lab l on l.security_id = f.sid and l.as_of = f.as_of where f.return_1m is not null)"


def _ar(c: str, by: str) -> str:
    return f"rank() over (partition by {by} order by {c}) - 1 + (count(*) over (partition by {by}, {c}) - 1) / 2"


def _ic(src: str, by: str) -> str:
    return f"rk as (select *, {_ar('score', by)} as rx, {_ar('r', by)} as ry from {src}), per as (select {by}, count(*) as n, case when stddev_pop(rx) > 0 and stddev_pop(ry) > 0 then corr(rx, ry) end as ic, avg(((score > 0) = (r > 0))::int) as hit_rate from rk group by {by} having count(*) >= 5)"


_RET = f"{_F1.split(' fat as')[0].rstrip().rstrip(',')}"
_S = f"with {PANEL}, {_ON}, k as (select *, coalesce(pd = prev_session and open > 0 and close > 0 and pc > 0, false) as ok from jj), s as (select date, avg(ln(open / pc)) as overnight, avg(ln(close / open)) as intraday from k where ok group by 1)"
_SPLIT = "sp as (select as_of, row_number() over (order by as_of) - 1 as i, count(*) over () as n from months), pt as (select as_of, case when i < round_even(n * 0.6, 0) - 3 then 'train' when i < round_even(n * 0.6, 0) then 'purged' when i < round_even(n * 0.75, 0) - 3 then 'validation' when i < round_even(n * 0.75, 0) then 'purged' else 'test' end as part from sp)"
SQL = {
    "A9_rank_correlation": f"{_SC}, {_ic('sc', 'as_of')} select as_of, n, round(ic, 6) as ic, round(hit_rate, 6) as hit_rate from per",
    "A9_summary": f"{_SC}, {_ic('sc', 'as_of')} select round(avg(ic), 6) as mean_ic, round(median(ic), 6) as median_ic, round(stddev_samp(ic), 6) as sd_ic, round(avg(hit_rate), 6) as mean_hit_rate, count(*) as dates from per",
    "P11_regime_exclusion": f"{_SC}, {_ic('sc', 'as_of')} select round(avg(ic), 6) as all_dates, round(avg(case when strftime(as_of, '%Y-%m') not in ('2020-02', '2020-03', '2020-04', '2020-05') then ic end), 6) as without_months, count(case when strftime(as_of, '%Y-%m') not in ('2020-02', '2020-03', '2020-04', '2020-05') then 1 end) as dates_left from per",
    "A10_pearson": f"with {PANEL}, {_RET} select security_id, round(case when count(*) >= 2 and stddev_pop(ret) > 0 and stddev_pop(dollar_volume) > 0 then corr(ret, dollar_volume) else 0 end, 6) as corr, count(*) as n from feats where ret is not null and dollar_volume is not null group by 1",
    "A11_spearman": f"with {PANEL}, {_RET}, f as (select * from feats where ret is not null and dollar_volume is not null), q as (select security_id, {_ar('ret', 'security_id')} as a, {_ar('dollar_volume', 'security_id')} as b from f) select security_id, round(case when count(*) >= 2 and stddev_pop(a) > 0 and stddev_pop(b) > 0 then corr(a, b) end, 6) as spearman from q group by 1",
    "A12_percentiles": f"with {PANEL}, {_RET}, q as (select security_id, quantile_cont(ret, [0.05, 0.25, 0.5, 0.75, 0.95]) as q from feats where ret is not null group by 1) select security_id, round(q[1], 6) as p05, round(q[2], 6) as p25, round(q[3], 6) as p50, round(q[4], 6) as p75, round(q[5], 6) as p95 from q",
    "A13_distribution": f"with {PANEL}, {_RET} select year(date)::bigint as year, round(avg(ret), 6) as mean, round(median(ret), 6) as median, round(coalesce(stddev_samp(ret), 0), 6) as sd, round(min(ret), 6) as least, round(max(ret), 6) as greatest from feats where ret is not null group by 1",
    "A14_coverage_summary": f"{_P}, {_F1}, p as (select as_of, count(return_3m) as n from fat group by 1) select min(n) as least, max(n) as most, round(avg(n), 4) as mean, count(case when n = 0 then 1 end) as empty_dates from p",
    "A30_pairwise_correlation": f"with {PANEL}, {_RET}, f as (select security_id, date, ret from feats where ret is not null), i as (select security_id, row_number() over (order by security_id) as place, count(*) over () as n from (select distinct security_id from f)), dr as (select j, ('0x' || substr(md5('42|a|' || j), 1, 8))::bigint % n + 1 as pa, ('0x' || substr(md5('42|b|' || j), 1, 8))::bigint % (n - 1) + 1 as pb from (select unnest(range(1, {PAIR_DRAWS + 1})) as j), (select max(n) as n from i) where n > 1), pr as (select j, a.security_id as a, b.security_id as b from dr join i a on a.place = pa join i b on b.place = case when pb >= pa then pb + 1 else pb end), c as (select j, count(*) as n, case when stddev_pop(x.ret) > 0 and stddev_pop(y.ret) > 0 then corr(x.ret, y.ret) end as r from pr join f x on x.security_id = a join f y on y.security_id = b and y.date = x.date group by 1), t as (select r from c where n >= 60 and r is not null order by j limit {PAIRS}) select count(*) as pairs, round(avg(r), 6) as mean_correlation from t",
    "A29_by_year": f"{_S} select year(date)::bigint as year, count(*) as days, round(avg(overnight) * 252 * 100, 4) as annualised_pct from s group by 1",
    "A29_without_extremes": f"{_S}, o as (select overnight, row_number() over (order by round(abs(overnight), 12) desc, date) as place from s), kk as (select unnest([0, 1, 3, 5, 10, 20])::bigint as k) select k, round(avg(overnight), 8) as mean, count(*) as days from o join kk on place > k group by 1",
    "O3_extreme_days": f"{_S} select date, round(overnight, 6) as overnight from s order by abs(round(overnight, 6)) desc, date limit 20",
    "W17_autocorrelation": f"{_S}, i as (select row_number() over (order by date) as i, overnight - avg(overnight) over () as x from s), v as (select sum(x * x) as v from i), l as (select unnest(range(1, 21)) as lag) select lag, round((select sum(a.x * b.x) from i a join i b on b.i = a.i + lag) / v, 6) as rho from l, v",
    "G2_block_length": f"{_S}, i as (select row_number() over (order by date) as i, overnight - avg(overnight) over () as x, count(*) over () as n from s), v as (select sum(x * x) as v, max(n) as n from i), l as (select unnest(range(1, 21)) as lag), r as (select lag, (select sum(a.x * b.x) from i a join i b on b.i = a.i + lag) / v as rho, n from l, v), f as (select coalesce(min(case when rho is null or abs(rho) < 2 / sqrt(n) then lag end) - 1, 20) as k, max(n) as n from r) select (case when n < 8 then 5 else greatest(5, least(20, 2 * k + 3)) end)::bigint as block_length from f",
    "M9_primary_split": f"with {MONTHS}, {_SPLIT} select as_of, part from pt",
    "A32_sample_sizes": f"{_P}, {_LAB}, {_SPLIT}, c as (select as_of, count(*) as pairs from lab group by 1) select part, count(*) as months, sum(coalesce(pairs, 0))::bigint as pairs, (count(*) // 3)::bigint as blocks from pt left join c using (as_of) group by 1",
    "ST3_retrain_checkpoints": "select i as retrain_at, greatest(0, i - 4) as train_until from (select unnest(range(24, 108, 3)) as i)",
    "O2_top_momentum": f"{_P}, {_F1}, t as (select as_of, sid, row_number() over (partition by as_of order by round(return_12m, 9) desc, sid) as place from fat where return_12m is not null) select as_of, sid as security_id, place, round(1 / count(*) over (partition by as_of), 6) as weight from t where place <= 20",
    "O4_spot_check": "select security_id, action_type, ex_date from (select distinct security_id, action_type, ex_date from corporate_actions) order by md5('42|' || security_id || '|' || action_type || '|' || strftime(ex_date, '%Y-%m-%d')), 1, 2, 3 limit 30",
    "O8_best_feature": f"{_P}, {_F1}, {_LAB}, lg as (select feature, f.as_of, score, r from (unpivot (select sid, as_of, return_1m, return_3m, return_6m, return_12m, momentum_acceleration, distance_from_200d_ma from fat) on return_1m, return_3m, return_6m, return_12m, momentum_acceleration, distance_from_200d_ma into name feature value score) f join lab l on l.security_id = f.sid and l.as_of = f.as_of), {_ic('lg', 'feature, as_of')} select feature, round(avg(ic), 6) as mean_ic, count(ic) as dates from per group by 1",
}
