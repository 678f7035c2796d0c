"""As-of lookups: backward, strict, forward with tolerance, n-th prior, market sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(probes: DataFrame, facts: DataFrame, keys: Sequence[str], at: str, time: str, values: Sequence[str], strict: bool = False, chunk_days: int | None = None) -> DataFrame:
    """probes with fact_time and the values of the last fact at or before (strict: before) `at`.

    The fact's values come as they are, null if they are null; without a fact
    all are null. Both sides are united, sorted by key and time, and the last
    fact is carried on: one shuffle, no range join. With `chunk_days` a key's
    rows are spread over chunks of time and the state at a chunk's start is
    carried in, so a key with any share of the rows is no single task.
    """
    fact = facts.select(*keys, F.col(time).alias("_t"), F.struct(F.col(time).alias("fact_time"), *values).alias("_f")).where("_t is not null")
    extra = [c for c in probes.columns if c not in keys]
    probe = probes.select(*keys, F.col(at).alias("_t"), F.struct(*extra).alias("_p"))
    # strict: a probe sorts before the facts of its own time
    rows = fact.select(*keys, "_t", F.lit(1 if strict else 0).alias("_o"), "_f", F.lit(None).cast(probe.schema["_p"].dataType).alias("_p")).unionByName(
        probe.select(*keys, "_t", F.lit(0 if strict else 1).alias("_o"), F.lit(None).cast(fact.schema["_f"].dataType).alias("_f"), "_p")
    )
    by = list(keys)
    if chunk_days:
        chunk = F.floor(F.unix_date(F.col("_t").cast("date")) / chunk_days).alias("_c")
        rows = rows.withColumn("_c", chunk)
        state = rows.groupBy(*keys, "_c").agg(F.max("_f").alias("_f"), F.max(F.col("_p").isNotNull()).alias("_has"))
        before = F.last("_f", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
        state = state.select(*keys, "_c", before.alias("_f"), "_has").where("_has and _f is not null")
        rows = rows.unionByName(state.select(*keys, F.col("_f.fact_time").alias("_t"), F.lit(0).alias("_o"), "_f", F.lit(None).cast(probe.schema["_p"].dataType).alias("_p"), "_c"))
        by.append("_c")
    w = Window.partitionBy(*by).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("_f", F.last("_f", ignorenulls=True).over(w)).where("_p is not null")
    return out.select(*keys, "_p.*", "_f.*")


def asof_forward(probes: DataFrame, facts: DataFrame, keys: Sequence[str], at: str, time: str, values: Sequence[str], within_days: int | None = None, strict: bool = False) -> DataFrame:
    """probes with the first fact at or after (strict: after) `at`, if within so many days."""
    back = F.col(at)
    neg = lambda df, c: df.withColumn("_neg", -F.unix_date(F.col(c).cast("date")))
    out = asof_backward(neg(probes, at), neg(facts, time), keys, "_neg", "_neg", [F.col(time).alias("found_time"), *values], strict=strict).drop("_neg")
    if within_days is not None:
        ok = F.datediff("found_time", back) <= within_days
        for c in ["found_time", *values]:
            out = out.withColumn(c, F.when(ok, F.col(c)))
    return out.drop("fact_time").withColumnRenamed("found_time", "fact_time")


def resolve_forward(probes: DataFrame, facts: DataFrame, keys: Sequence[str], at: str, time: str, value: str, gap_days: int = 10) -> DataFrame:
    """The value at a horizon: the first fact at or after it within gap_days with a value, else the last before, marked truncated."""
    ahead = asof_forward(probes, facts, keys, at, time, [value]).withColumnRenamed(value, "_av").withColumnRenamed("fact_time", "_at")
    both = asof_backward(ahead, facts, keys, at, time, [value])
    ok = F.col("_av").isNotNull() & (F.datediff("_at", F.col(at)) <= gap_days)
    return both.select(
        *[c for c in probes.columns],
        F.when(ok, F.col("_at")).otherwise(F.col("fact_time")).alias("fact_time"),
        F.when(ok, F.col("_av")).otherwise(F.col(value)).alias(value),
        F.when(F.coalesce(ok, F.lit(False)), F.lit(False)).when(F.col(value).isNotNull(), F.lit(True)).alias("truncated"),
    )


def sessions(facts: DataFrame, date: str) -> DataFrame:
    """The market's sessions: date, prev_session, next_session and its number.

    The distinct dates of all facts; numbered in one task, as a calendar has a
    few thousand days however many facts there are.
    """
    w = Window.orderBy(date)
    return facts.select(date).where(F.col(date).isNotNull()).distinct().select(date, F.lag(date).over(w).alias("prev_session"), F.lead(date).over(w).alias("next_session"), F.row_number().over(w).alias("session_no"))


def nth_prior(df: DataFrame, keys: Sequence[str], time: str, value: str, n: int) -> Column:
    """The value n rows before, per key in time order."""
    return F.lag(value, n).over(Window.partitionBy(*keys).orderBy(time))


def interval_at(probes: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, closed_end: bool = False) -> DataFrame:
    """Join of probes with all spans of their key that hold at `at`; a null end is open.

    Half open unless `closed_end`. The keys are joined by hash; the time bounds
    are a condition of that join.
    """
    p, s = probes.alias("_p"), spans.alias("_s")
    on = [F.col(f"_p.{k}") == F.col(f"_s.{k}") for k in keys]
    until = F.col(f"_s.{end}") >= F.col(f"_p.{at}") if closed_end else F.col(f"_s.{end}") > F.col(f"_p.{at}")
    cond = (F.col(f"_s.{start}") <= F.col(f"_p.{at}")) & (F.col(f"_s.{end}").isNull() | until)
    for c in on:
        cond = c & cond
    return p.join(s, cond).select("_p.*", *[f"_s.{c}" for c in spans.columns if c not in probes.columns])
