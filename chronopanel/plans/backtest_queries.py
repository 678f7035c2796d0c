"""Strategies over the eligible universe, portfolio folds, metrics and comparisons of runs."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronopanel.operators import adjust, asof, fold, trailing
from chronopanel.operators.crosssection import safe_corr
from chronopanel.operators.ranking import number_rows
from chronopanel.plans.asof_queries import _dividends
from chronopanel.plans.feature_queries import _splits
from chronopanel.plans.fixtures import PANEL, panel
from chronopanel.plans.universe_queries import _EL, A20, eligible, universe
from chronopanel.session import checkpoint, table

#: Random portfolios of the benchmark distribution.
SEEDS = 200
#: Names a selecting strategy holds.
SIZE = 20

#: A strategy: (policy, as_of, security_id, momentum) of the eligible to (strategy, policy, as_of, security_id, weight).
Strategy = Callable[[DataFrame], DataFrame]


def _weights(name: str, picked: DataFrame) -> DataFrame:
    here = Window.partitionBy("policy", "as_of")
    return picked.select(F.lit(name).alias("strategy"), "policy", "as_of", "security_id", (1 / F.count(F.lit(1)).over(here)).alias("weight"))


def equal_weight(e: DataFrame) -> DataFrame:
    return _weights("equal_weight", e)


def buy_and_hold(e: DataFrame) -> DataFrame:
    """Equal weights on a policy's first date with anyone eligible, then nothing."""
    first = e.groupBy("policy").agg(F.min("as_of").alias("as_of"))
    return _weights("buy_and_hold", e.join(F.broadcast(first), ["policy", "as_of"]))


def by_momentum(name: str, greatest: bool) -> Strategy:
    """The SIZE greatest or smallest: an aggregate that keeps no more than SIZE rows a task and date."""

    def run(e: DataFrame) -> DataFrame:
        m = F.round("momentum", 9)
        w = Window.partitionBy("policy", "as_of").orderBy(m.desc() if greatest else m.asc(), "security_id")
        return _weights(name, e.where("momentum is not null").withColumn("k", F.row_number().over(w)).where(f"k <= {SIZE}"))

    return run


def random_selection(seeds: int) -> Strategy:
    """SIZE names a seed and date, drawn without replacement by places in id order, so the work does not grow with the universe.

    Floyd's sampling: for j from n - SIZE + 1 to n a place up to j is drawn by
    hash, and j itself where that is taken. Every seed is in the same job. Of a
    universe of up to SIZE names all are held.
    """

    def run(e: DataFrame) -> DataFrame:
        placed = number_rows(e, ["policy", "as_of"], ["security_id"], "place")
        n = e.groupBy("policy", "as_of").agg(F.count(F.lit(1)).alias("n"))
        seeded = n.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds))))
        head = F.concat_ws("|", F.col("seed"), F.date_format("as_of", "yyyy-MM-dd"))
        draw = lambda j: F.conv(F.substring(F.md5(F.concat(head, F.lit("|"), j.cast("string"))), 1, 8), 16, 10).cast("long") % j + 1
        add = lambda got, j: F.when(F.array_contains(got, draw(j)), F.array_append(got, j)).otherwise(F.array_append(got, draw(j)))
        some = F.aggregate(F.sequence(F.greatest(F.col("n") - SIZE, F.lit(0)) + 1, F.col("n")), F.array().cast("array<bigint>"), add)
        drawn = seeded.select("policy", "as_of", "seed", F.explode(some).alias("place"))
        picked = drawn.join(placed, ["policy", "as_of", "place"])
        return picked.select(F.concat(F.lit("random_"), "seed").alias("strategy"), "policy", "as_of", "security_id", (1 / F.count(F.lit(1)).over(Window.partitionBy("policy", "as_of", "seed"))).alias("weight"))

    return run


def strategies(seeds: int = SEEDS) -> tuple[Strategy, ...]:
    return (equal_weight, buy_and_hold, by_momentum("top_momentum", True), by_momentum("bottom_momentum", False), *((random_selection(seeds),) if seeds else ()))


def total_return_panel(spark: SparkSession, d: str) -> DataFrame:
    """The panel with prices adjusted for splits and dividends."""
    return adjust.total_return(adjust.split_adjusted(panel(spark, d), _splits(spark, d)), _dividends(spark, d))


def with_momentum(e: DataFrame, p: DataFrame, rows: int = 252) -> DataFrame:
    """The eligible with the return over their last `rows` bars up to as_of; never a later bar."""
    first = F.lag("close", rows - 1).over(trailing.series())
    bars = p.withColumn("momentum", F.when(first != 0, F.col("close") / first - 1)).select("security_id", "date", "momentum")
    return asof.asof_backward(e, bars, ["security_id"], "as_of", "date", ["momentum"]).select("policy", "as_of", "security_id", "momentum")


def strategy_weights(spark: SparkSession, d: str, seeds: int = SEEDS, p: DataFrame | None = None) -> DataFrame:
    """(run_id, as_of, security_id, weight) of all strategies under all policies, from one universe."""
    e = checkpoint(with_momentum(eligible(spark, d), p if p is not None else total_return_panel(spark, d)))  # every strategy reads it
    out = None
    for s in strategies(seeds):
        w = s(e)
        out = w if out is None else out.unionByName(w)
    return out.select(F.concat_ws(":", "policy", "strategy").alias("run_id"), "as_of", "security_id", "weight")


def plan_of(weights: DataFrame, p: DataFrame) -> DataFrame:
    """Execution dates and prices: the next market session after the signal, marks as of that day.

    A row for each target, and one without weight on every later date of the
    schedule up to the run's next trading date, where a name without a target is
    sold, or to the end if it has none; so held names are marked and closed. The
    schedule, a row per date, is joined on, so no date is a constant of the plan.
    """
    cal = asof.sessions(p, "date")
    dates = weights.select("as_of").distinct().withColumn("g", F.lit(1))
    exe = asof.asof_forward(dates, cal.select("date").withColumn("g", F.lit(1)), ["g"], "as_of", "date", [], strict=True).select("as_of", F.coalesce("fact_time", "as_of").alias("date"))
    exe = checkpoint(exe)
    t = weights.join(F.broadcast(exe), "as_of")
    own = t.select("run_id", "date").distinct().withColumn("until", F.lead("date").over(Window.partitionBy("run_id").orderBy("date")))
    days = exe.agg(F.array_sort(F.collect_set("date")).alias("days")).withColumn("g", F.lit(1))  # the schedule as one row
    later = F.filter("days", lambda x: (x >= F.col("date")) & (F.col("until").isNull() | (x <= F.col("until"))))
    spans = own.withColumn("g", F.lit(1)).join(F.broadcast(days), "g").select("run_id", "date", later.alias("later"))
    grid = t.join(spans, ["run_id", "date"]).select("run_id", "security_id", F.explode("later").alias("date")).distinct()
    rows = grid.join(t.select("run_id", "security_id", "date", "weight"), ["run_id", "security_id", "date"], "left")
    need = rows.select("security_id", "date").distinct()
    marks = asof.asof_backward(need.withColumnRenamed("date", "at"), p, ["security_id"], "at", "date", ["close"]).select("security_id", F.col("at").alias("date"), F.col("close").alias("mark"), F.when(F.col("fact_time") == F.col("at"), F.col("close")).alias("price"))
    return rows.join(marks, ["security_id", "date"], "left").select("run_id", "date", "security_id", "weight", "price", "mark")


def B1(spark: SparkSession, d: str) -> DataFrame:
    p = checkpoint(total_return_panel(spark, d).select("security_id", "date", "close"))
    return fold.simulate(plan_of(strategy_weights(spark, d, p=p), p))


def B8(spark: SparkSession, d: str) -> DataFrame:
    return fold.performance(B1(spark, d))


def B8_annual(spark: SparkSession, d: str) -> DataFrame:
    return fold.annual_returns(B1(spark, d))


def B6(spark: SparkSession, d: str) -> DataFrame:
    e = eligible(spark, d)
    w = equal_weight(e).unionByName(buy_and_hold(e))
    return w.groupBy("policy", "strategy", "as_of").agg(F.count(F.lit(1)).alias("names"), F.round(F.sum("weight"), 6).alias("weight"))


def B7(spark: SparkSession, d: str) -> DataFrame:
    """Random portfolios: names per seed and date."""
    r = random_selection(SEEDS)(eligible(spark, d))
    return r.groupBy("policy", "strategy", "as_of").agg(F.count(F.lit(1)).alias("names"), F.sum("security_id").alias("sum_of_ids"))


def B9(spark: SparkSession, d: str) -> DataFrame:
    """The distribution of the random runs beside the other strategies, per policy."""
    m = B8(spark, d).select(F.split("run_id", ":")[0].alias("policy"), F.regexp_replace(F.split("run_id", ":")[1], "_[0-9]+$", "").alias("strategy"), "cumulative_return", "sharpe_ratio", "max_drawdown")
    return m.groupBy("policy", "strategy").agg(F.count(F.lit(1)).alias("runs"), *[F.round(f(c), 6).alias(f"{n}_{c}") for c in ("cumulative_return", "sharpe_ratio", "max_drawdown") for n, f in (("mean", F.avg), ("median", F.median), ("least", F.min), ("greatest", F.max))])


def B10(spark: SparkSession, d: str) -> DataFrame:
    """Two evaluations of the same runs, compared by digests of their rows: a row of equal counts and whether all agree."""
    p = checkpoint(total_return_panel(spark, d).select("security_id", "date", "close"))

    def digest(name: str) -> DataFrame:
        s = fold.simulate(plan_of(strategy_weights(spark, d, 5, p), p))
        return s.groupBy("run_id").agg(F.count(F.lit(1)).alias(f"n_{name}"), F.sum(F.xxhash64("date", "cash", "value", "holdings").cast("decimal(38,0)")).alias(f"h_{name}"))

    j = digest("a").join(digest("b"), "run_id", "full")
    same = F.col("n_a").eqNullSafe(F.col("n_b")) & F.col("h_a").eqNullSafe(F.col("h_b"))
    return j.agg(F.count(F.lit(1)).alias("runs"), F.count_if(same).alias("equal_runs"), F.bool_and(same).alias("reproducible"))


def A21(spark: SparkSession, d: str) -> DataFrame:
    """How many names each kind of run holds per date: least, most, mean."""
    w = strategy_weights(spark, d).groupBy("run_id", "as_of").agg(F.count(F.lit(1)).alias("n"))
    return w.groupBy(F.regexp_replace("run_id", "_[0-9]+$", "").alias("kind")).agg(F.count(F.lit(1)).alias("dates"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 4).alias("mean"))


def A25(spark: SparkSession, d: str) -> DataFrame:
    """How many distinct sets each random run holds, as ids in order."""
    w = random_selection(SEEDS)(eligible(spark, d)).groupBy("policy", "strategy", "as_of").agg(F.array_join(F.array_sort(F.collect_list("security_id")), ",").alias("s"))
    return w.groupBy("policy", "strategy").agg(F.count(F.lit(1)).alias("dates"), F.countDistinct("s").alias("distinct_sets"))


def _selected(spark: SparkSession, d: str) -> DataFrame:
    e = eligible(spark, d)
    could = e.groupBy("policy", "security_id").agg((SEEDS * F.count(F.lit(1))).alias("opportunities"))
    did = random_selection(SEEDS)(e).groupBy("policy", "security_id").agg(F.count(F.lit(1)).alias("picked"))
    return could.join(did, ["policy", "security_id"], "left").withColumn("picked", F.coalesce("picked", F.lit(0).cast("long")))


def A22(spark: SparkSession, d: str) -> DataFrame:
    """Is the random choice even: does how often a security is picked go with its id, its ticker's order or its history."""
    bars = panel(spark, d).groupBy("security_id").agg(F.count(F.lit(1)).alias("bars"))
    t = table(spark, d, "securities").select("security_id", F.conv(F.substring(F.hex(F.upper("primary_ticker")), 1, 8), 16, 10).cast("double").alias("letters"))
    s = _selected(spark, d).withColumn("rate", F.col("picked") / F.col("opportunities")).join(bars, "security_id", "left").join(t, "security_id", "left")
    return s.groupBy("policy").agg(F.count(F.lit(1)).alias("securities"), F.sum("picked").alias("picks"), *[F.round(safe_corr("rate", c), 6).alias(f"with_{c}") for c in ("security_id", "letters", "bars")])


def A23(spark: SparkSession, d: str) -> DataFrame:
    """How often random runs pick each security against how often they could."""
    return _selected(spark, d).select("policy", "security_id", "opportunities", "picked", F.round(F.col("picked") / F.col("opportunities"), 6).alias("rate"))


def A24(spark: SparkSession, d: str) -> DataFrame:
    """Do all runs of a policy trade the same series of universes, and under one configuration."""
    n = A20(spark, d).where("usable > 0").select("policy", "as_of", "usable")
    dates = strategy_weights(spark, d, 5).withColumn("policy", F.split("run_id", ":")[0]).select("policy", "run_id", "as_of").distinct()
    seen = dates.where("run_id not like '%buy_and_hold%'").join(n, ["policy", "as_of"]).groupBy("policy", "run_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("as_of", "usable"))), lambda x: F.concat_ws("=", x["as_of"].cast("string"), x["usable"].cast("string"))), ","), 256).alias("series"))
    config = F.sha2(F.lit(json.dumps(dataclasses.asdict(fold.Costs()), sort_keys=True)), 256)
    return seen.withColumn("config", config).groupBy("policy").agg(F.count(F.lit(1)).alias("runs"), F.countDistinct("series").alias("universes"), F.countDistinct("config").alias("configurations"))


def A27(spark: SparkSession, d: str) -> DataFrame:
    """Do the costs of runs rise with their turnover, in order of turnover, per policy."""
    s = B1(spark, d).groupBy("run_id").agg(F.sum("turnover").alias("turnover"), F.sum("costs").alias("costs"))
    w = Window.partitionBy("policy").orderBy("turnover", "run_id")
    s = s.withColumn("policy", F.split("run_id", ":")[0]).withColumn("ok", F.coalesce(F.col("costs") >= F.lag("costs").over(w), F.lit(True)))
    return s.groupBy("policy").agg(F.count(F.lit(1)).alias("runs"), F.bool_and("ok").alias("monotone"), F.round(safe_corr("turnover", "costs"), 4).alias("corr"))


def A28(spark: SparkSession, d: str) -> DataFrame:
    """Runs that ever hold a security with suspicious bars, and how many of these."""
    bad = panel(spark, d).where("price_data_quality = 'suspicious'").select("security_id").distinct()
    e = eligible(spark, d)
    w = equal_weight(e).unionByName(random_selection(SEEDS)(e))
    return w.join(bad, "security_id", "left_semi").groupBy("policy", "strategy").agg(F.countDistinct("security_id").alias("flagged"))


def J19(spark: SparkSession, d: str) -> DataFrame:
    """Random holdings that the equal-weighted run of the same date lacks, by an anti join with an independently built universe."""
    e = universe(spark, d).where("reason is null").select("policy", "as_of", "security_id").distinct()
    r = random_selection(SEEDS)(eligible(spark, d))
    out = r.join(e, ["policy", "as_of", "security_id"], "left_anti").groupBy("policy").agg(F.count(F.lit(1)).alias("outside"))
    n = r.groupBy("policy").agg(F.count(F.lit(1)).alias("held"), F.countDistinct("strategy", "as_of").alias("sets"))
    return n.join(out, "policy", "left").select("policy", "held", "sets", F.coalesce("outside", F.lit(0).cast("long")).alias("outside"))


def A26(spark: SparkSession, d: str) -> DataFrame:
    """Days from signal to execution, and signals whose execution is over six days off."""
    p = panel(spark, d)
    dates = eligible(spark, d).select("policy", "as_of").distinct().withColumn("g", F.lit(1))
    e = asof.asof_forward(dates, p.select("date").distinct().withColumn("g", F.lit(1)), ["g"], "as_of", "date", [], strict=True).where("fact_time is not null")
    gap = F.datediff("fact_time", "as_of")
    return e.groupBy("policy").agg(F.count(F.lit(1)).alias("signals"), F.max(gap).alias("longest"), F.count_if(gap > 6).alias("over_six"))


def F12(spark: SparkSession, d: str) -> DataFrame:
    """Costs of one trade per action row, buys and sells."""
    a = table(spark, d, "corporate_actions").where("ratio_or_value is not null").select("security_id", "ex_date", "ratio_or_value", "source_id")
    value = F.col("ratio_or_value") * 1000
    return a.groupBy("security_id").agg(F.round(F.sum(fold.trade_cost(value, F.lit(False))), 4).alias("buy_costs"), F.round(F.sum(fold.trade_cost(value, F.lit(True))), 4).alias("sell_costs"))


def F13(spark: SparkSession, d: str) -> DataFrame:
    """Gross to net: the return of one bar less a trade's costs as a share of its value."""
    p = panel(spark, d).withColumn("value", F.col("close") * F.least(F.coalesce("volume", F.lit(0.0)), F.lit(100.0)))
    gross = F.col("close") / F.col("open") - 1
    net = fold.net_return(gross, fold.trade_cost(F.col("value"), F.lit(True)), F.col("value"))
    return p.where("open <> 0").groupBy("security_id").agg(F.round(F.avg(gross), 8).alias("gross"), F.round(F.avg(net), 8).alias("net"))


def F14(spark: SparkSession, d: str) -> DataFrame:
    """Dividends of 100 shares in each (month, next month]: the month is a truncation of the day before."""
    a = table(spark, d, "corporate_actions").where("action_type = 'dividend' and ex_date is not null")
    m = F.trunc(F.date_sub("ex_date", 1), "month")
    return a.groupBy("security_id", m.alias("month")).agg(F.round(F.sum(F.col("ratio_or_value") * 100), 4).alias("received"))


QUERIES = {
    "B1_backtest": B1, "B8_metrics": B8, "B8_annual_returns": B8_annual, "B6_equal_weights": B6, "B7_random_selection": B7, "B9_distribution": B9, "B10_reproducibility": B10, "A21_holding_counts": A21, "A25_holding_sets": A25,
    "A22_evenness": A22, "A23_selection_rates": A23, "A24_identical_universe": A24, "A27_costs_and_turnover": A27, "A28_flagged_exposure": A28, "J19_fairness": J19, "A26_execution_gap": A26, "F12_trade_cost": F12, "F13_net_return": F13, "F14_dividends_between": F14,
}

_N = "nn as (select policy, as_of, count(*) as n from el group by 1, 2), pl as (select *, row_number() over (partition by policy, as_of order by security_id) as place from el)"
_DR = f"""fl0 as (select policy, as_of, seed, n, greatest(n - {SIZE}, 0) + 1 as j, []::bigint[] as got from nn, (select unnest(range(1, {SEEDS + 1})) as seed)),
 fl1(policy, as_of, seed, n, j, got) as (select * from fl0 union all select policy, as_of, seed, n, j + 1, case when list_contains(got, t) then list_append(got, j) else list_append(got, t) end from (select *, ('0x' || substr(md5(seed || '|' || strftime(as_of, '%Y-%m-%d') || '|' || j), 1, 8))::bigint % j + 1 as t from fl1 where j <= n)),
 rd as (select r.policy, 'random_' || r.seed as strategy, r.as_of, pl.security_id from (select policy, as_of, seed, unnest(got) as place from fl1 where j = n + 1) r join pl using (policy, as_of, place))"""
_R = f"with recursive {_EL}, {_N}, {_DR}"
_SEL = f"cd as (select policy, security_id, {SEEDS} * count(*) as opportunities from el group by 1, 2), dd as (select policy, security_id, count(*) as picked from rd group by 1, 2), sl as (select cd.policy, cd.security_id, opportunities, coalesce(picked, 0) as picked from cd left join dd using (policy, security_id))"
SQL = {
    "B6_equal_weights": f"with {_EL}, e as (select policy, as_of, count(*) as names from el group by 1, 2) select policy, 'equal_weight' as strategy, as_of, names, 1.0::double as weight from e union all select policy, 'buy_and_hold', as_of, names, 1.0 from e qualify row_number() over (partition by policy order by as_of) = 1",
    "B7_random_selection": f"{_R} select policy, strategy, as_of, count(*) as names, sum(security_id)::bigint as sum_of_ids from rd group by 1, 2, 3",
    "A25_holding_sets": f"{_R}, hs as (select policy, strategy, as_of, string_agg(security_id::varchar, ',' order by security_id) as s from rd group by 1, 2, 3) select policy, strategy, count(*) as dates, count(distinct s) as distinct_sets from hs group by 1, 2",
    "A23_selection_rates": f"{_R}, {_SEL} select policy, security_id, opportunities, picked, round(picked / opportunities, 6) as rate from sl",
    "A28_flagged_exposure": f"{_R}, h as (select policy, strategy, security_id from rd union all select policy, 'equal_weight', security_id from el) select policy, strategy, count(distinct security_id) as flagged from h where security_id in (select security_id from panel where price_data_quality = 'suspicious') group by 1, 2",
    "J19_fairness": f"{_R} select policy, count(*) as held, count(distinct strategy || as_of) as sets, count(case when not exists (select 1 from el where el.policy = rd.policy and el.as_of = rd.as_of and el.security_id = rd.security_id) then 1 end) as outside from rd group by 1",
    "A26_execution_gap": f"with {_EL}, dd as (select distinct policy, as_of from el), g as (select policy, as_of, (select min(date) from panel where date > as_of) - as_of as gap from dd) select policy, count(*) as signals, max(gap)::bigint as longest, count(case when gap > 6 then 1 end) as over_six from g where gap is not null group by 1",
    "F12_trade_cost": "select security_id, round(sum(ratio_or_value * 1000 * (0.0015 + 5 / 1e4)), 4) as buy_costs, round(sum(ratio_or_value * 1000 * (0.0015 + 5 / 1e4) + ratio_or_value * 1000 * 0.0000221), 4) as sell_costs from corporate_actions where ratio_or_value is not null group by 1",
    "F14_dividends_between": "select security_id, date_trunc('month', ex_date - 1)::date as month, round(sum(ratio_or_value * 100), 4) as received from corporate_actions where action_type = 'dividend' and ex_date is not null group by 1, 2",
    "F13_net_return": f"with {PANEL}, v as (select security_id, close / open - 1 as g, close * least(coalesce(volume, 0), 100) as v from panel where open <> 0), n as (select security_id, g, case when v = 0 then g else g - (v * (0.0015 + 5 / 1e4) + v * 0.0000221) / v end as n from v) select security_id, round(avg(g), 8) as gross, round(avg(n), 8) as net from n group by 1",
}
