"""As-of family and calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronopanel.operators import asof, ranking, trailing
from chronopanel.operators.calendar import business_days, month_starts
from chronopanel.plans.fixtures import MONTHS, PANEL, PROBES, months, panel, probes
from chronopanel.session import checkpoint, table

R = 6


def _r(c: str) -> F.Column:
    return F.round(c, R).alias(c)


def J1(spark: SparkSession, d: str) -> DataFrame:
    return asof.asof_backward(probes(spark, d), panel(spark, d), ["security_id"], "as_of", "date", ["close"]).select("security_id", "as_of", F.col("fact_time").alias("price_date"), "close")


def J1_chunked(spark: SparkSession, d: str) -> DataFrame:
    return asof.asof_backward(probes(spark, d), panel(spark, d), ["security_id"], "as_of", "date", ["close"], chunk_days=256).select("security_id", "as_of", F.col("fact_time").alias("price_date"), "close")


def J2(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d).withColumn("close_21", asof.nth_prior(None, ["security_id"], "date", "close", 21))
    return asof.asof_backward(probes(spark, d), p, ["security_id"], "as_of", "date", ["close_21"]).select("security_id", "as_of", "close_21")


def _dividends(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corporate_actions").where("action_type = 'dividend' and security_id is not null and ex_date is not null").groupBy("security_id", "ex_date").agg(F.max("ratio_or_value").alias("amount"))


def J3(spark: SparkSession, d: str) -> DataFrame:
    return asof.asof_backward(_dividends(spark, d), panel(spark, d), ["security_id"], "ex_date", "date", ["close"], strict=True).select("security_id", "ex_date", "amount", F.col("fact_time").alias("anchor_date"), F.col("close").alias("anchor_close"))


def J4(spark: SparkSession, d: str) -> DataFrame:
    p = probes(spark, d).withColumn("target", F.add_months("as_of", 3))
    return asof.resolve_forward(p, panel(spark, d), ["security_id"], "target", "date", "close").select("security_id", "as_of", "target", F.col("fact_time").alias("price_date"), "close", "truncated")


def J5(spark: SparkSession, d: str) -> DataFrame:
    cal = panel(spark, d).select("date").distinct().withColumn("g", F.lit(1))
    return asof.asof_forward(months(spark, d).withColumn("g", F.lit(1)), cal, ["g"], "as_of", "date", [], strict=True).select("as_of", F.col("fact_time").alias("next_session"))


def J6(spark: SparkSession, d: str) -> DataFrame:
    return asof.sessions(panel(spark, d), "date").select("date", "prev_session", "next_session")


def J7(spark: SparkSession, d: str) -> DataFrame:
    cal = panel(spark, d).select("date").distinct().withColumn("g", F.lit(1))
    return asof.asof_forward(months(spark, d).withColumn("g", F.lit(1)), cal, ["g"], "as_of", "date", []).select("as_of", F.col("fact_time").alias("session"))


def J8(spark: SparkSession, d: str) -> DataFrame:
    return asof.asof_forward(probes(spark, d), panel(spark, d), ["security_id"], "as_of", "date", ["open"], strict=True).select("security_id", "as_of", F.col("fact_time").alias("next_date"), "open")


def J13(spark: SparkSession, d: str) -> DataFrame:
    """Corporate actions within ten days of a suspicious bar: an equi-join on the security and a month of 32 days, two of which a bar may touch."""
    bad = panel(spark, d).where("price_data_quality = 'suspicious'").select("security_id", "date")
    span = lambda c: F.floor(F.unix_date(c) / 32)
    bad = bad.withColumn("m", F.explode(F.sequence(span(F.date_sub("date", 10)), span(F.date_add("date", 10)))))
    acts = table(spark, d, "corporate_actions").select("security_id", "action_type", "ex_date").where("ex_date is not null").distinct().withColumn("m", span(F.col("ex_date")))
    near = F.col("ex_date").between(F.date_sub("date", 10), F.date_add("date", 10))
    return bad.join(acts, ["security_id", "m"]).where(near).select("security_id", "date", "action_type", "ex_date")


def J17(spark: SparkSession, d: str) -> DataFrame:
    """Open and close of a session with the close of the market's session before, where the security has both."""
    p = panel(spark, d)
    prev = p.select("security_id", F.col("date").alias("prev_session"), F.col("close").alias("prev_close"))
    cal = asof.sessions(p, "date").select("date", "prev_session")
    return p.join(F.broadcast(cal), "date").join(prev, ["security_id", "prev_session"]).select("security_id", "date", "open", "close", "prev_close")


def J18(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "securities").join(panel(spark, d).select("security_id").distinct(), "security_id", "left_anti").select("security_id")


def J20(spark: SparkSession, d: str) -> DataFrame:
    """The session nearest to each mid-month day, the earlier of two: nearest of the as-of pair."""
    mids = months(spark, d).select(F.date_add("as_of", 14).alias("day")).withColumn("g", F.lit(1))
    cal = panel(spark, d).select("date").distinct().withColumn("g", F.lit(1))
    b = asof.asof_backward(mids, cal, ["g"], "day", "date", []).withColumnRenamed("fact_time", "before")
    a = asof.asof_forward(b, cal, ["g"], "day", "date", []).withColumnRenamed("fact_time", "after")
    nearer = F.when(F.col("before").isNull() | (F.datediff("after", "day") < F.datediff("day", "before")), F.col("after")).otherwise(F.col("before"))
    return a.select("day", nearer.alias("nearest"))


def J21(spark: SparkSession, d: str) -> DataFrame:
    """Latest snapshot per security: an aggregate, no sort."""
    s = table(spark, d, "ticker_snapshots")
    best = F.max(F.struct("snapshot_date", "loaded_at", "ticker")).alias("b")
    return s.groupBy("security_id").agg(best).select("security_id", "b.snapshot_date", "b.loaded_at", "b.ticker")


def F2(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d).groupBy("security_id").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("bars"))
    return p.withColumn("business_days", business_days(F.col("first_date"), F.col("last_date"))).withColumn("completeness", F.round(F.col("bars") / F.col("business_days"), R))


def F3(spark: SparkSession, d: str) -> DataFrame:
    return month_starts(spark, "2014-01-15", "2023-12-31")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Mid-rank of the trailing 21-row return at each month start."""
    p = panel(spark, d).withColumn("ret", trailing.return_between("close", 0, 21))
    at = asof.asof_backward(probes(spark, d), p, ["security_id"], "as_of", "date", ["ret"])
    at = checkpoint(at.where("ret is not null"))  # read for the counts and for the join
    ranked = ranking.value_ranks(at, ["as_of"], "ret")
    return ranked.withColumn("pct", F.when(F.col("_n") >= 2, (F.col("_below") + 0.5 * F.col("_equal")) / F.col("_n"))).select("security_id", "as_of", _r("ret"), _r("pct"))


QUERIES = {
    "J1_asof_backward": J1, "J1_asof_chunked": J1_chunked, "J2_nth_prior_session": J2, "J3_asof_strict": J3, "J4_asof_forward_tolerance": J4, "J5_next_session": J5, "J6_previous_session": J6,
    "J7_session_on_or_after": J7, "J8_next_bar_open": J8, "J13_nearby_actions": J13, "J17_session_pairs": J17, "J18_no_prices": J18, "J20_nearest_session": J20, "J21_latest_row": J21,
    "F2_business_days": F2, "F3_month_starts": F3, "W9_momentum_rank": flagship,
}

_P = f"with {PANEL}, {MONTHS}, {PROBES}"
_CAL = "cal as (select distinct date from panel)"
_DIV = "div as (select security_id, ex_date, max(ratio_or_value) as amount from corporate_actions where action_type = 'dividend' and security_id is not null and ex_date is not null group by 1, 2)"
_J1 = _P + " select p.security_id, p.as_of, b.date as price_date, b.close from probes p asof left join panel b on p.security_id = b.security_id and p.as_of >= b.date"
SQL = {
    "J1_asof_backward": _J1,
    "J1_asof_chunked": _J1,
    "J2_nth_prior_session": _P + ", l as (select *, lag(close, 21) over (partition by security_id order by date) as close_21 from panel) select p.security_id, p.as_of, b.close_21 from probes p asof left join l b on p.security_id = b.security_id and p.as_of >= b.date",
    "J3_asof_strict": f"with {PANEL}, {_DIV} select p.security_id, p.ex_date, p.amount, b.date as anchor_date, b.close as anchor_close from div p asof left join panel b on p.security_id = b.security_id and p.ex_date > b.date",
    "J4_asof_forward_tolerance": _P + """, t as (select *, (as_of + interval 3 month)::date as target from probes),
      f as (select t.*, b.date as fd, b.close as fc from t asof left join panel b on t.security_id = b.security_id and t.target <= b.date),
      g as (select f.*, b.date as bd, b.close as bc from f asof left join panel b on f.security_id = b.security_id and f.target >= b.date)
      select security_id, as_of, target, case when fc is not null and fd - target <= 10 then fd else bd end as price_date,
      case when fc is not null and fd - target <= 10 then fc else bc end as close, case when fc is not null and fd - target <= 10 then false when bc is not null then true end as truncated from g""",
    "J5_next_session": f"with {PANEL}, {MONTHS}, {_CAL} select as_of, (select min(date) from cal where date > as_of) as next_session from months",
    "J6_previous_session": f"with {PANEL}, {_CAL} select date, lag(date) over (order by date) as prev_session, lead(date) over (order by date) as next_session from cal",
    "J7_session_on_or_after": f"with {PANEL}, {MONTHS}, {_CAL} select as_of, (select min(date) from cal where date >= as_of) as session from months",
    "J8_next_bar_open": _P + " select p.security_id, p.as_of, b.date as next_date, b.open from probes p asof left join panel b on p.security_id = b.security_id and p.as_of < b.date",
    "J13_nearby_actions": f"with {PANEL}, a as (select distinct security_id, action_type, ex_date from corporate_actions) select p.security_id, p.date, a.action_type, a.ex_date from panel p join a on a.security_id = p.security_id and a.ex_date between p.date - 10 and p.date + 10 where price_data_quality = 'suspicious'",
    "J17_session_pairs": f"with {PANEL}, {_CAL}, s as (select date, lag(date) over (order by date) as prev_session from cal) select a.security_id, a.date, a.open, a.close, b.close as prev_close from panel a join s using (date) join panel b on b.security_id = a.security_id and b.date = s.prev_session",
    "J18_no_prices": f"with {PANEL} select security_id from securities s where not exists (select 1 from panel p where p.security_id = s.security_id)",
    "J20_nearest_session": f"with {PANEL}, {_CAL}, {MONTHS}, m as (select as_of + 14 as day from months) select day, (select date from cal order by abs(date - day), date limit 1) as nearest from m",
    "J21_latest_row": "select security_id, snapshot_date, loaded_at, ticker from ticker_snapshots qualify row_number() over (partition by security_id order by snapshot_date desc, loaded_at desc, ticker desc nulls last) = 1",
    "F2_business_days": f"with {PANEL}, s as (select security_id, min(date) as first_date, max(date) as last_date, count(*) as bars from panel group by 1) select *, n as business_days, round(bars / n, 6) as completeness from (select s.*, (select count(*) from generate_series(first_date, last_date, interval 1 day) t(x) where isodow(x) <= 5) as n from s)".replace("select *, n as", "select security_id, first_date, last_date, bars, n as"),
    "F3_month_starts": "select unnest(generate_series(date '2014-01-15', date '2023-12-31', interval 1 month))::date as rebalance_date",
    "W9_momentum_rank": _P + """, l as (select *, case when lag(close, 21) over w <> 0 then close / lag(close, 21) over w - 1 end as ret from panel window w as (partition by security_id order by date)),
      a as (select p.security_id, p.as_of, b.ret from probes p asof left join l b on p.security_id = b.security_id and p.as_of >= b.date),
      r as (select *, case when count(ret) over (partition by as_of) >= 2 then (rank() over (partition by as_of order by ret nulls last) - 1 + 0.5 * count(*) over (partition by as_of, ret)) / count(ret) over (partition by as_of) end as pct from a)
      select security_id, as_of, round(ret, 6) as ret, round(pct, 6) as pct from r where ret is not null""",
}
