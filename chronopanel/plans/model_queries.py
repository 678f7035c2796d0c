"""Model fits on the feature panel."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.operators import forest, linear, models, splits
from chronopanel.operators.crosssection import rank_correlation, safe_corr
from chronopanel.plans.feature_queries import _F1, _LAB, FAMILIES, LADDER, family_features, features_at, features_of, labels
from chronopanel.plans.fixtures import MONTHS, PANEL, PROBES, months, panel
from chronopanel.plans.stats_queries import _SPLIT, _ic
from chronopanel.session import checkpoint

X = ("return_1m", "return_3m", "distance_from_200d_ma", "realised_volatility_63d", "volume_trend_20d_100d")
ALL = features_of(tuple(FAMILIES))
#: Penalties of each linear model, by what a report calls them.
LINEAR = {
    "ridge": {f"alpha={a:g}": a for a in (10.0, 3.0, 1.0, 0.3, 0.1)},
    "logistic": {f"C={c:g}": c for c in (0.03, 0.1, 0.3, 1.0, 3.0)},
    "elastic_net": {f"alpha={a:g}": a for a in (0.01, 0.003, 0.001, 0.0003, 0.0001, 0.00003)},
}
#: Settings of each tree model, by what a report calls them.
TREES = {
    "random_forest": {f"trees={n} depth={k} least={m}": {"trees": n, "depth": k, "least": m} for n in (100, 300) for k in (3, 5, 8) for m in (20, 50)},
    "boosted_trees": {f"depth={k} step={r:g} trees={n} least={m}": {"trees": n, "depth": k, "least": m, "step": r} for k in (2, 3) for r in (0.01, 0.05) for n in (50, 150) for m in (20, 50)},
}
#: Rows of the training dates that trees are fitted on at most, drawn by hash; all rows of the validation dates are scored.
TREE_ROWS = 25_000
#: Tasks that share the fits; the sample is sent to each.
TREE_TASKS = 64
PENALTIES = (0.01, 0.003, 0.001, 0.0003, 0.0001, 0.00003, 0.00001)
FOLDS = 3


def training_panel(spark: SparkSession, d: str, full: bool = False) -> DataFrame:
    """Complete rows (of X, or of all families) with label, class and part of the split; cut once, as every fit reads it many times."""
    p = checkpoint(panel(spark, d).select("security_id", "date", "close", "volume"))  # features and labels read it
    f = family_features(spark, d, p).dropna(subset=list(ALL)) if full else features_at(spark, d, p).select("security_id", "as_of", "history_length", "return_12m", *X).dropna(subset=list(X))
    lab = labels(spark, d, p=p).select("security_id", "as_of", "y")
    parts = splits.primary_split(months(spark, d), "as_of", 0.6, 0.15, 0.25, 3)
    return checkpoint(f.join(lab, ["security_id", "as_of"]).join(F.broadcast(parts), "as_of").withColumn("z", (F.col("y") > 0).cast("double")))


def _report(spark: SparkSession, rows: list[tuple[str, DataFrame]]) -> DataFrame:
    out = None
    for name, scored in rows:
        e = models.evaluate(scored, "as_of", "score", "y").select(F.lit(name).alias("model"), *[F.round(c, 6).alias(c) for c in ("mean_ic", "median_ic", "sd_ic", "hit_rate")], "dates")
        out = e if out is None else out.unionByName(e)
    return out


def M5(spark: SparkSession, d: str) -> DataFrame:
    """Baselines without a fit: a twelfth of the yearly return, and the momentum itself."""
    v = training_panel(spark, d).where("part = 'validation'")
    return _report(spark, [("historical_mean", v.withColumn("score", F.coalesce("return_12m", F.lit(0.0)) / 12)), ("momentum", v.withColumn("score", F.col("return_3m")))])


def _folds(train: DataFrame) -> list[tuple[list, list]]:
    """Expanding inner folds with embargo on the training dates."""
    dates = sorted(r["as_of"] for r in train.select("as_of").distinct().collect())  # the calendar
    return [([dates[i] for i in a], [dates[i] for i in b]) for a, b in splits.inner_folds(len(dates), FOLDS, 3)]


def _fits(p: DataFrame, moments: dict, jobs: list[tuple[str, tuple[str, ...], float, list]]) -> list[np.ndarray]:
    """Coefficients over ALL of each job (model, features, penalty, dates): linear ones from sums, logistic ones all together."""
    place = {c: i for i, c in enumerate(ALL)}
    cols = [tuple(place[c] for c in x) for _, x, _, _ in jobs]
    logits = [i for i, job in enumerate(jobs) if job[0] == "logistic"]
    many = linear.logistic_all(p, "as_of", ALL, "z", [linear.Logit(cols[i], frozenset(jobs[i][3]), jobs[i][2]) for i in logits], moments) if logits else []
    got = dict(zip(logits, many, strict=True))
    out = []
    for i, (model, _, penalty, dates) in enumerate(jobs):
        m = linear.total(moments, dates, len(ALL) + 2)
        c = got[i] if i in got else linear.ridge(m, cols[i], penalty) if model == "ridge" else linear.elastic_net(m, cols[i], penalty)
        whole = np.zeros(len(ALL) + 1)
        whole[[0, *[1 + k for k in cols[i]]]] = c
        # a logistic score is the log-odds, whose sign is that of the probability less a half
        out.append(whole)
    return out


def _tuned(p: DataFrame) -> tuple[dict, list[tuple[str, str, str, float, float | None, int]]]:
    """Moments of the training dates; and of every candidate of every step (step, model, name, penalty, mean correlation in the inner folds, folds)."""
    train = p.where("part = 'train'")
    moments, folds = linear.moments_by(train, "as_of", ALL, "y"), _folds(train)
    grid = [(step, model, name, penalty) for step in LADDER for model, g in LINEAR.items() for name, penalty in g.items()]
    jobs = [(model, features_of(LADDER[step]), penalty, inner) for step, model, _, penalty in grid for inner, _ in folds]
    coefs = _fits(train, moments, jobs) if folds else []
    at = [(i, f) for i in range(len(grid)) for f in range(len(folds))]
    got: dict[int, list[float]] = {i: [] for i in range(len(grid))}
    if at:
        s = linear.scored(train, "as_of", ALL, "y", [(f"{i}|{f}", folds[f][1], c) for (i, f), c in zip(at, coefs, strict=True)])
        per = rank_correlation(s, ["model", "as_of"], "score", "y", 5)
        for r in per.groupBy("model").agg(F.avg("ic").alias("ic")).where("ic is not null").collect():  # a number for each fit
            got[int(r["model"].split("|")[0])].append(r["ic"])
    return moments, [(*g, sum(got[i]) / len(got[i]) if got[i] else None, len(got[i])) for i, g in enumerate(grid)]


def _best(tuned: list[tuple[str, str, str, float, float | None, int]]) -> dict[tuple[str, str], tuple[str, float]]:
    """The candidate of each (step, model) with the greatest mean, the first if all are undefined."""
    out: dict[tuple[str, str], tuple[str, float, float]] = {}
    for step, model, name, penalty, mean, _ in tuned:
        m = -np.inf if mean is None else mean
        if (step, model) not in out or m > out[step, model][2]:
            out[step, model] = (name, penalty, m)
    return {k: v[:2] for k, v in out.items()}


def M6(spark: SparkSession, d: str) -> DataFrame:
    """Ridge, logistic and elastic net on each step of the ladder: tuned on the training dates, fitted on all of them, judged on validation.

    All fits come from sums per date and a few joint passes; all are scored in one job.
    """
    p = training_panel(spark, d, full=True)
    moments, tuned = _tuned(p)
    best = _best(tuned)
    train, val = p.where("part = 'train'"), p.where("part = 'validation'")
    jobs = [(model, features_of(LADDER[step]), penalty, list(moments)) for (step, model), (_, penalty) in best.items()]
    dates = sorted(r["as_of"] for r in val.select("as_of").distinct().collect())  # the calendar
    coefs = _fits(train, moments, jobs)
    s = linear.scored(val, "as_of", ALL, "y", [("|".join(k), dates, c) for k, c in zip(best, coefs, strict=True)])
    per = rank_correlation(s, ["model", "as_of"], "score", "y", 5)
    e = per.groupBy("model").agg(F.avg("ic").alias("mean_ic"), F.median("ic").alias("median_ic"), F.stddev_samp("ic").alias("sd_ic"), F.avg("hit_rate").alias("hit_rate"), F.count(F.lit(1)).alias("dates"))
    names = spark.createDataFrame([("|".join(k), *k, v[0]) for k, v in best.items()], "key string, step string, model string, chosen string")
    return names.join(e.withColumnRenamed("model", "key"), "key", "left").select("step", "model", *[F.round(c, 6).alias(c) for c in ("mean_ic", "median_ic", "sd_ic", "hit_rate")], F.coalesce("dates", F.lit(0).cast("long")).alias("dates"), "chosen")


def M7(spark: SparkSession, d: str) -> DataFrame:
    """Forests and boosted trees on each step of the ladder, and on all families but volume: tuned, fitted and judged as the linear models.

    The fits are spread over TREE_TASKS tasks, each on a bounded sample of the
    training rows (TREE_ROWS, a parameter); the tuned trees score all rows of the validation
    dates where these lie.
    """
    steps = LADDER | {"full_v1_minus_volume_liquidity": tuple(x for x in FAMILIES if x != "volume_liquidity")}
    p = training_panel(spark, d, full=True)
    train, val = p.where("part = 'train'"), p.where("part = 'validation'")
    n = train.count()
    sample = checkpoint(train.select("as_of", "y", F.array(*[F.col(c).cast("double") for c in ALL]).alias("x"), F.xxhash64("security_id", "as_of").alias("h")).where(F.lit(n <= TREE_ROWS) | (F.pmod("h", F.lit(1_000_000)) < F.lit(int(1_000_000 * TREE_ROWS / max(n, 1))))))
    folds = _folds(train)
    place = {c: i for i, c in enumerate(ALL)}
    cols = {step: [place[c] for c in features_of(x)] for step, x in steps.items()}
    grid = [(step, model, name) for step in steps for model, g in TREES.items() for name in g]

    def fitted(pdf: pd.DataFrame, job: tuple[str, str, str], dates: list | None) -> forest.Trees:
        step, model, name = job
        t = pdf if dates is None else pdf[pdf["as_of"].isin(dates)]
        t = t.sort_values(["as_of", "h"])
        x = np.stack(t["x"].to_list())[:, cols[step]] if len(t) else np.zeros((0, len(cols[step])))
        return forest.fit(x, t["y"].to_numpy(float), model == "boosted_trees", **TREES[model][name])

    def tune(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k in range(int(pdf["task"].iloc[0]), len(grid) * len(folds), TREE_TASKS):
            i, f = divmod(k, len(folds))
            trees, o = fitted(pdf, grid[i], folds[f][0]), pdf[pdf["as_of"].isin(folds[f][1])]
            ics = forest.rank_correlations(o["as_of"].to_numpy(), trees.predict(np.stack(o["x"].to_list())[:, cols[grid[i][0]]]), o["y"].to_numpy(float)) if len(o) else []
            out.append((i, f, float(np.mean(ics)) if ics else None))
        return pd.DataFrame(out, columns=["i", "f", "ic"])

    each = sample.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(TREE_TASKS - 1)))) if folds else None
    means: dict[int, list[float]] = {}
    if each is not None:
        for r in each.repartition(TREE_TASKS, "task").groupBy("task").applyInPandas(tune, "i int, f int, ic double").where("ic is not null").collect():  # a number for each fit
            means.setdefault(r["i"], []).append(r["ic"])
    best: dict[tuple[str, str], int] = {}
    for i, (step, model, _) in enumerate(grid):
        mean = lambda k: float(np.mean(means[k])) if k in means else -np.inf
        if (step, model) not in best or mean(i) > mean(best[step, model]):
            best[step, model] = i

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        i = int(pdf["i"].iloc[0])
        return pd.DataFrame({"i": [i], "trees": [pickle.dumps(fitted(pdf, grid[i], None))]})

    chosen = F.explode(F.array(*[F.lit(i) for i in best.values()])).alias("i")
    done = {r["i"]: pickle.loads(r["trees"]) for r in sample.select("*", chosen).groupBy("i").applyInPandas(last, "i int, trees binary").collect()}  # a model per step

    def score(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                x = np.stack(pdf["x"].to_list())
                for i, trees in done.items():
                    yield pd.DataFrame({"i": i, "as_of": pdf["as_of"], "score": trees.predict(x[:, cols[grid[i][0]]]), "y": pdf["y"]})

    s = val.select("as_of", "y", F.array(*[F.col(c).cast("double") for c in ALL]).alias("x")).mapInPandas(score, "i int, as_of date, score double, y double")
    per = rank_correlation(s, ["i", "as_of"], "score", "y", 5)
    e = per.groupBy("i").agg(F.avg("ic").alias("mean_ic"), F.median("ic").alias("median_ic"), F.stddev_samp("ic").alias("sd_ic"), F.avg("hit_rate").alias("hit_rate"), F.count(F.lit(1)).alias("dates"))
    names = spark.createDataFrame([(i, step, model, grid[i][2]) for (step, model), i in best.items()], "i int, step string, model string, chosen string")
    return names.join(e, "i", "left").select("step", "model", *[F.round(c, 6).alias(c) for c in ("mean_ic", "median_ic", "sd_ic", "hit_rate")], F.coalesce("dates", F.lit(0).cast("long")).alias("dates"), "chosen")


def M8(spark: SparkSession, d: str) -> DataFrame:
    """What every candidate of the linear models gets in the inner folds, and which is chosen, on each step of the ladder."""
    _, tuned = _tuned(training_panel(spark, d, full=True))
    best = _best(tuned)
    rows = [(step, model, name, mean, folds, best[step, model][0] == name) for step, model, name, _, mean, folds in tuned]
    return spark.createDataFrame(rows, "step string, model string, candidate string, mean_ic double, folds int, chosen boolean").withColumn("mean_ic", F.round("mean_ic", 6))


def M10(spark: SparkSession, d: str) -> DataFrame:
    """Does a prediction only follow how long a series is: pooled and per-date correlation with history length."""
    p = training_panel(spark, d)
    scored = models.fit_linear(X, "y", 10.0)(p.where("part = 'train'"))(p.where("part = 'validation'")).withColumn("h", F.col("history_length").cast("double"))
    per = rank_correlation(scored, ["as_of"], "score", "h", 5).agg(F.avg("ic").alias("ic")).withColumn("k", F.lit(1))
    pooled = scored.agg(safe_corr("score", "h").alias("pooled")).withColumn("k", F.lit(1))
    j = pooled.join(per, "k")
    return j.select(F.round("pooled", 6).alias("pooled_pearson"), F.round("ic", 6).alias("mean_spearman"), ((F.abs("pooled") >= 0.9 * 0.386) | (F.abs("ic") >= 0.9 * 0.20)).alias("flagged"))


def M13(spark: SparkSession, d: str) -> DataFrame:
    """Along a path of elastic-net penalties on the features of all families: coefficients kept, spread of predictions, validation figures."""
    p = training_panel(spark, d, full=True)
    train, val = p.where("part = 'train'"), p.where("part = 'validation'")
    moments = linear.moments_by(train, "as_of", ALL, "y")
    coefs = _fits(train, moments, [("elastic_net", ALL, a, list(moments)) for a in PENALTIES])
    names = [f"alpha_{a:g}" for a in PENALTIES]
    dates = sorted(r["as_of"] for r in val.select("as_of").distinct().collect())  # the calendar
    s = checkpoint(linear.scored(val, "as_of", ALL, "y", [(n, dates, c) for n, c in zip(names, coefs, strict=True)]))
    per = rank_correlation(s, ["model", "as_of"], "score", "y", 5)
    e = per.groupBy("model").agg(F.avg("ic").alias("mean_ic"), F.median("ic").alias("median_ic"), F.stddev_samp("ic").alias("sd_ic"), F.avg("hit_rate").alias("hit_rate"), F.count(F.lit(1)).alias("dates"))
    spread = s.groupBy("model").agg(F.stddev_samp("score").alias("prediction_sd"))
    kept = spark.createDataFrame([(n, int((np.abs(c[1:]) > 1e-12).sum())) for n, c in zip(names, coefs, strict=True)], "model string, coefficients int")
    j = kept.join(spread, "model", "left").join(e, "model", "left")
    return j.select("model", "coefficients", F.round("prediction_sd", 6).alias("prediction_sd"), *[F.round(c, 6).alias(c) for c in ("mean_ic", "median_ic", "sd_ic", "hit_rate")], F.coalesce("dates", F.lit(0).cast("long")).alias("dates"))


QUERIES = {"M5_baselines": M5, "M6_linear_models": M6, "M7_tree_models": M7, "M8_tuning": M8, "M10_history_diagnostic": M10, "M13_penalty_path": M13}
_HAVE = " and ".join(f"{c} is not null" for c in X)
_FIG = "round(avg(ic), 6) as mean_ic, round(median(ic), 6) as median_ic, round(stddev_samp(ic), 6) as sd_ic, round(avg(hit_rate), 6) as hit_rate, count(n) as dates"
SQL = {
    "M5_baselines": f"with {PANEL}, {MONTHS}, {PROBES}, {_F1}, {_LAB}, {_SPLIT}, yy as (select security_id, as_of, r - avg(r) over (partition by as_of) as y from lab), v as (select f.as_of, return_12m, return_3m, y as r from fat f join yy on yy.security_id = f.sid and yy.as_of = f.as_of join pt on pt.as_of = f.as_of where part = 'validation' and {_HAVE}), sc as (select 'historical_mean' as model, as_of, coalesce(return_12m, 0) / 12 as score, r from v union all select 'momentum', as_of, return_3m, r from v), {_ic('sc', 'model, as_of')} select k.model, {_FIG} from (select unnest(['historical_mean', 'momentum']) as model) k left join per on per.model = k.model group by 1",
}
