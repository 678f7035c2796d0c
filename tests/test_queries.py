"""Every query against its SQL, and what the plans must not contain."""

import ast
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronopanel.operators import bootstrap, fold, forest, linear, models
from chronopanel.plans import backtest_queries, feature_queries, model_queries, registry, universe_queries
from chronopanel.plans.fixtures import panel

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="session")
def con(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind not in "fiub":
            df[c] = df[c].astype(str).replace({"NaT": "None", "nan": "None", "<NA>": "None"})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, sf, con, name):
    a, b = normal(registry.QUERIES[name](spark, sf).toPandas()), normal(con.sql(registry.SQL[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        if a[c].dtype.kind in "fiub" and b[c].dtype.kind in "fiub":
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-6, atol=2e-6, equal_nan=True), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


@pytest.mark.parametrize("name", ["p3_found", "p6_grid", "G2_block_length", "M6_linear_models", "S2_guarded_reset", "S8_synthetic_bars"])
def test_query_without_sql_gives_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["p2_found", "p3_found", "p4_found", "p6_found", "p7_found", "J1_asof_backward", "J4_asof_forward_tolerance", "W21_total_return", "J12_conflicts"])
def test_no_nested_loops(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_core_does_not_import_llm():
    for p in [*(ROOT / "chronopanel").rglob("*.py"), *(ROOT / "tests").rglob("*.py")]:
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("chronopanel.llm") for n in names), p


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_all_random_runs(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    runs = [r["run_id"] for r in registry.QUERIES["B8_metrics"](spark, d).select("run_id").collect()]
    for policy in ("STRICT", "PERMISSIVE"):
        assert sum(r.startswith(f"{policy}:random_") for r in runs) == 200 and {f"{policy}:{x}" for x in ("equal_weight", "buy_and_hold", "top_momentum", "bottom_momentum")} <= set(runs)
    assert len(set(runs)) == len(runs) == 408


def test_random_names_are_eligible_different_and_as_many_as_there_can_be(spark, sf):
    e = universe_queries.eligible(spark, sf.replace("sf0.001", "sf0.01"))
    here = {}
    for r in e.collect():
        here.setdefault((r["policy"], r["as_of"]), set()).add(r["security_id"])
    got = {}
    for r in backtest_queries.random_selection(7)(e).collect():
        got.setdefault((r["policy"], r["as_of"], r["strategy"]), []).append((r["security_id"], r["weight"]))
    assert len(got) == 7 * len(here)
    for (policy, as_of, _), names in got.items():
        ids = [x for x, _ in names]
        assert len(ids) == len(set(ids)) == min(20, len(here[policy, as_of])) and set(ids) <= here[policy, as_of] and sum(w for _, w in names) == pytest.approx(1)


def test_reruns_agree(spark, sf):
    r = registry.QUERIES["B10_reproducibility"](spark, sf.replace("sf0.001", "sf0.01")).first()
    assert r["reproducible"] and r["runs"] == r["equal_runs"] == 18


def test_plan_has_all_rows_that_trading_needs(spark, sf):
    """The same snapshots as from a row for every name a run ever targets on every later date."""
    d = sf.replace("sf0.001", "sf0.01")
    p = panel(spark, d).cache()
    w = backtest_queries.strategy_weights(spark, d, 2, p).where("run_id like 'PERMISSIVE:%'").withColumn("run_id", F.split("run_id", ":")[1])
    # every third date of one run, and few names of another, so that names stay untargeted for some time
    w = w.where("run_id <> 'random_1' or month(as_of) % 3 = 0").where("run_id <> 'random_2' or (security_id + month(as_of)) % 2 = 0").cache()
    plan = backtest_queries.plan_of(w, p).toPandas()
    days, closes = sorted(plan["date"].unique()), {s: g.sort_values("date") for s, g in p.select("security_id", "date", "close").toPandas().groupby("security_id")}
    rows = [plan]
    for (run, sid), g in plan[plan["weight"].notna()].groupby(["run_id", "security_id"]):
        have = set(plan.loc[(plan["run_id"] == run) & (plan["security_id"] == sid), "date"])
        for day in days:
            if day >= g["date"].min() and day not in have:
                c = closes[sid][closes[sid]["date"] <= day]
                mark = float(c["close"].iloc[-1])
                rows.append(pd.DataFrame({"run_id": [run], "date": [day], "security_id": [sid], "weight": [np.nan], "price": [mark if c["date"].iloc[-1] == day else np.nan], "mark": [mark]}))
    full = pd.concat(rows)
    assert len(full) > len(plan)
    schema = "run_id string, date date, security_id long, weight double, price double, mark double"
    a, b = (normal(fold.simulate(spark.createDataFrame(x[["run_id", "date", "security_id", "weight", "price", "mark"]], schema).replace(float("nan"), None)).toPandas()) for x in (plan, full))
    assert len(a) == len(b)
    for c in a.columns:
        assert np.allclose(a[c], b[c], rtol=1e-9) if a[c].dtype.kind in "fi" else (a[c] == b[c]).all(), c


def test_models_run_the_whole_grid(spark, sf):
    """Every candidate of the grids, three folds, each step of the ladder, and the features of all families."""
    d = sf.replace("sf0.001", "sf0.01")
    assert len(model_queries.ALL) == len(set(model_queries.ALL)) == 18
    assert [len(g) for g in model_queries.LINEAR.values()] == [5, 5, 6] and [len(g) for g in model_queries.TREES.values()] == [12, 16]
    tuned = registry.QUERIES["M8_tuning"](spark, d).collect()
    assert len(tuned) == 5 * (5 + 5 + 6) and all(r["folds"] == 3 for r in tuned) and sum(r["chosen"] for r in tuned) == 15
    fitted = registry.QUERIES["M6_linear_models"](spark, d).collect()
    assert {(r["step"], r["model"], r["chosen"]) for r in fitted} == {(r["step"], r["model"], r["candidate"]) for r in tuned if r["chosen"]} and all(r["dates"] for r in fitted)
    trees = registry.QUERIES["M7_tree_models"](spark, d).collect()
    assert len(trees) == 12 and all(r["dates"] and r["chosen"] in model_queries.TREES[r["model"]] for r in trees)
    assert registry.QUERIES["M13_penalty_path"](spark, d).count() == 7


def test_trees_split_where_a_search_over_all_cuts_does_and_learn():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 20, (300, 3)).astype(float)
    y = np.where(x[:, 1] > 11, 3.0, 0.0) + np.where(x[:, 0] > 4, 1.0, 0.0) + rng.normal(0, 0.1, 300)
    one = forest.fit(x, y, True, trees=1, depth=1, least=10, step=1.0)

    def error(j, c):
        a, b = y[x[:, j] <= c], y[x[:, j] > c]
        return ((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum() if min(len(a), len(b)) >= 10 else np.inf

    best = min(error(j, c) for j in range(3) for c in range(20))
    assert ((y - one.predict(x)) ** 2).sum() == pytest.approx(best)
    test = rng.integers(0, 20, (200, 3)).astype(float)
    want = np.where(test[:, 1] > 11, 3.0, 0.0) + np.where(test[:, 0] > 4, 1.0, 0.0)
    for boosted, kw in ((False, {}), (True, {"step": 0.1})):
        got = forest.fit(x, y, boosted, trees=60, depth=3, least=5, **kw).predict(test)
        assert np.sqrt(((got - want) ** 2).mean()) < 0.15
    same = [forest.fit(x, y, False, trees=5, depth=3, least=5).predict(test) for _ in range(2)]
    assert (same[0] == same[1]).all()
    assert (forest.fit(np.zeros((0, 3)), np.zeros(0), False, trees=3, depth=2, least=1).predict(test) == 0).all()
    assert forest.rank_correlations(np.repeat([1, 2, 3], [6, 6, 3]), np.r_[np.arange(6.0), np.zeros(6), 1.0, 2.0, 3.0], np.arange(15.0)) == [pytest.approx(1.0)]


def test_grids_from_sums_equal_single_fits(spark):
    """The coefficients from moments and joint passes score as the engine's own solvers do."""
    rng = np.random.default_rng(6)
    x = rng.normal(0, [1, 5, 0.2], (600, 3)) + [0, 3, -1]
    y = 0.5 * x[:, 0] - 0.1 * x[:, 1] + rng.normal(0, 1, 600)
    rows = [(i % 6, *map(float, x[i]), float(y[i]), float(y[i] > 0)) for i in range(600)] + [(0, None, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "day int, a double, b double, c double, y double, z double").repartition(5)
    names, days = ["a", "b", "c"], [0, 1, 2, 3]
    m = linear.moments_by(df, "day", names, "y")
    assert set(m) == set(range(6)) and m[0].products[0, 0] == 100
    train, rest = df.dropna().where("day < 4"), df.dropna().where("day >= 4")
    some = linear.total(m, days, 5)
    fits = {
        "ridge": (linear.ridge(some, (0, 1, 2), 3.0), models.fit_linear(names, "y", 3.0)),
        "net": (linear.elastic_net(some, (0, 1, 2), 0.05), models.fit_linear(names, "y", 0.05, 0.5)),
        "some": (np.insert(linear.ridge(some, (0, 2), 1.0), 2, 0.0), models.fit_linear(["a", "c"], "y", 1.0)),
    }
    for name, (c, fit) in fits.items():
        got = sorted(r["score"] for r in linear.scored(rest, "day", names, "y", [(name, [4, 5], c)]).collect())
        want = sorted(r["score"] for r in fit(train)(rest).select("score").collect())
        assert np.allclose(got, want, atol=2e-4), name
    logits = linear.logistic_all(df, "day", names, "z", [linear.Logit((0, 1, 2), frozenset(days), 0.3), linear.Logit((1,), frozenset([0, 1]), 1.0)], m)
    want = [r["score"] for r in models.fit_logistic(names, "z", 0.3)(train)(rest).orderBy("a").select("score").collect()]
    p = [1 / (1 + np.exp(-r["score"])) - 0.5 for r in linear.scored(rest.withColumn("y", F.col("a")), "day", names, "y", [("m", [4, 5], logits[0])]).orderBy("y").collect()]
    assert np.allclose(p, want, atol=1e-4) and len(logits[1]) == 2
    with pytest.raises(RuntimeError):
        linear.logistic_all(df, "day", names, "z", [linear.Logit((0, 1, 2), frozenset(days), 0.3)], m, most=1)


def test_proxy_volatility_by_hand(spark, sf):
    p = panel(spark, sf).select("security_id", "date", "close").toPandas()
    days = sorted(p["date"].unique())
    wide = p.pivot(index="date", columns="security_id", values="close").reindex(days)
    last = p.groupby("security_id")["date"].max()
    for r in feature_queries.proxy_volatility_at(spark, sf).orderBy("as_of").limit(30).collect():
        at = wide[wide.index <= r["as_of"]].iloc[-64:]
        at = at[[s for s in at.columns if (r["as_of"] - last[s]).days <= 40]]
        means = (at / at.shift(1) - 1).mean(axis=1).dropna()
        assert r["proxy_index_volatility"] == pytest.approx(means.std(), rel=1e-9, nan_ok=True) if r["proxy_index_volatility"] is not None else len(means) < 2


def test_significance_draws_the_default_replicates(spark, sf, monkeypatch):
    drawn, block_means = [], bootstrap.block_means

    def spy(spark, values, block, draws, *rest):
        drawn.append(draws)
        return block_means(spark, values, block, draws, *rest)

    monkeypatch.setattr(bootstrap, "block_means", spy)
    assert registry.QUERIES["G5_significance"](spark, sf).count() == 2
    assert drawn == [5000, 5000]
