"""Path-dependent portfolio state as a grouped fold, trade costs and performance metrics."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Costs:
    commission: float = 0.0
    fx: float = 0.0015
    stamp: float = 0.0
    levy: float = 0.0
    sale_fee: float = 0.0000221
    spread_bps: float = 5.0
    slippage_bps: float = 0.0

    @property
    def rate(self) -> float:
        return self.commission + self.fx + self.stamp + (self.spread_bps + self.slippage_bps) / 1e4


def trade_cost(value: Column, is_sell: Column, costs: Costs = Costs()) -> Column:
    return value * costs.rate + F.lit(costs.levy) + F.when(is_sell, value * costs.sale_fee).otherwise(0.0)


def net_return(gross: Column, costs: Column, value: Column) -> Column:
    return F.when(value == 0, gross).otherwise(gross - costs / value)


def simulate(plan: DataFrame, cash: float = 100_000.0, costs: Costs = Costs(), tolerance: float = 1e-6) -> DataFrame:
    """Snapshots of each run's portfolio.

    plan: (run_id, date, security_id, weight, price, mark), a row per security
    that the run holds a target for (weight not null) or may hold (weight null):
    price is the exact price of the day, null if it has none, mark the last
    known one. A target without a positive exact price keeps its position; a
    held security without a target is sold at its mark; targets are sized on the
    value before trading and costs come out of cash. `skipped` counts the
    targets and held names of a date that could not be traded.

    Two invariants end the job where they fail: a run's dates rise strictly, and
    trading changes the value by no more than its costs (to `tolerance`, relative).

    A run is sequential by nature and is one group; runs are parallel. A run's
    plan has as many rows as its universe times its dates, a parameter of the
    study, not of the facts.
    """
    c = asdict(costs) | {"rate": costs.rate}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        money, held, marks, out, last = cash, {}, {}, [], None
        for day, g in pdf.sort_values(["date", "security_id"]).groupby("date", sort=True):
            if last is not None and not day > last:
                raise ValueError(f"a portfolio's dates must rise: {day} after {last}")
            last = day
            for sid, mark in zip(g["security_id"], g["mark"], strict=True):
                if pd.notna(mark):
                    marks[sid] = mark
            value = money + sum(n * marks.get(s, 0.0) for s, n in held.items())
            targets = g[g["weight"].notna()]
            skip, want = set(), {}
            for sid, w, price in zip(targets["security_id"], targets["weight"], targets["price"], strict=True):
                if pd.isna(price) or price <= 0:
                    skip.add(sid)
                else:
                    want[sid] = w * value / price
            turnover = paid = 0.0
            trades = 0
            if len(targets):
                for sid in sorted((held.keys() | want.keys()) - skip):
                    delta = want.get(sid, 0.0) - held.get(sid, 0.0)
                    if abs(delta) < 1e-9:
                        continue
                    price = marks.get(sid)
                    if price is None:
                        held.pop(sid, None)
                        continue
                    size = abs(delta) * price
                    fee = size * c["rate"] + c["levy"] + (size * c["sale_fee"] if delta < 0 else 0.0)
                    money -= delta * price + fee
                    paid, turnover, trades = paid + fee, turnover + size, trades + 1
                    left = held.get(sid, 0.0) + delta
                    if abs(left) < 1e-9:
                        held.pop(sid, None)
                    else:
                        held[sid] = left
            after = money + sum(n * marks.get(s, 0.0) for s, n in held.items())
            if abs(after - (value - paid)) > tolerance * max(1.0, abs(value)):
                raise ValueError(f"value {after} on {day} is not {value} less costs {paid}")
            out.append((g["run_id"].iloc[0], day, money, after, turnover, turnover / value if value else 0.0, paid, trades, len(held), len(skip)))
        return pd.DataFrame(out, columns=["run_id", "date", "cash", "value", "turnover", "turnover_pct", "costs", "trades", "holdings", "skipped"])

    return plan.groupBy("run_id").applyInPandas(run, "run_id string, date date, cash double, value double, turnover double, turnover_pct double, costs double, trades int, holdings int, skipped int")


def performance(snapshots: DataFrame, per_year: int = 12) -> DataFrame:
    """Metrics of each run; undefined ones are 0."""
    w = Window.partitionBy("run_id").orderBy("date")
    before = F.lag("value").over(w)
    s = snapshots.withColumn("r", F.when(before != 0, F.col("value") / before - 1)).withColumn("peak", F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    root = F.sqrt(F.lit(float(per_year)))
    a = s.groupBy("run_id").agg(
        F.min_by("value", "date").alias("v0"),
        F.max_by("value", "date").alias("v1"),
        (F.datediff(F.max("date"), F.min("date")) / 365.25).alias("years"),
        F.count("r").alias("n"),
        F.avg("r").alias("m"),
        F.stddev_samp("r").alias("sd"),
        F.sqrt(F.avg(F.when(F.col("r").isNotNull(), F.pow(F.least(F.lit(0.0), F.col("r")), 2)))).alias("dsd"),
        F.min(F.when(F.col("peak") > 0, (F.col("value") - F.col("peak")) / F.col("peak"))).alias("mdd"),
        F.avg(F.when(F.col("r").isNotNull(), (F.col("r") > 0).cast("double"))).alias("win"),
        F.avg("turnover_pct").alias("avg_turnover_pct"),
        F.sum("costs").alias("total_costs"),
        F.sum("trades").alias("trades"),
    )
    z = lambda c: F.coalesce(c, F.lit(0.0))
    cagr = z(F.when((F.col("v0") > 0) & (F.col("years") > 0), F.pow(F.col("v1") / F.col("v0"), 1 / F.col("years")) - 1))
    two = F.col("n") >= 2
    return a.select(
        "run_id",
        z(F.when(F.col("v0") != 0, F.col("v1") / F.col("v0") - 1)).alias("cumulative_return"),
        cagr.alias("cagr"),
        z(F.when(two, F.col("sd") * root)).alias("annualized_volatility"),
        z(F.when(two & (F.col("sd") > 0), F.col("m") / F.col("sd") * root)).alias("sharpe_ratio"),
        z(F.when(two & (F.col("dsd") > 0), F.col("m") / F.col("dsd") * root)).alias("sortino_ratio"),
        z(F.col("mdd")).alias("max_drawdown"),
        z(F.when(F.col("mdd") < 0, cagr / F.abs("mdd"))).alias("calmar_ratio"),
        z(F.col("win")).alias("win_rate"),
        z(F.col("avg_turnover_pct")).alias("avg_turnover_pct"),
        "total_costs",
        "trades",
    )


def annual_returns(snapshots: DataFrame) -> DataFrame:
    """Last over first value within each year of two or more snapshots."""
    y = snapshots.groupBy("run_id", F.year("date").alias("year")).agg(F.min_by("value", "date").alias("a"), F.max_by("value", "date").alias("z"), F.count(F.lit(1)).alias("n"))
    return y.where("n >= 2 and a <> 0").select("run_id", "year", (F.col("z") / F.col("a") - 1).alias("annual_return"))
