"""Point-in-time operators against brute force, hand-computed values and changed futures."""

import datetime as dt
import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from chronopanel.operators import adjust, asof, bootstrap, calendar, claims, crosssection, decisions, fold, quality, ranking, splits, trailing, universe, upsert
from chronopanel.sources import readers, runs

D = dt.date


def d(s):
    return D.fromisoformat(s)


def prices(spark, rows):
    return spark.createDataFrame([(i, d(x), c) for i, x, c in rows], "security_id long, date date, close double")


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("chunk", [None, 20])
def test_asof_equals_brute_force(spark, strict, chunk):
    rng = random.Random(3)
    base = d("2020-01-01")
    facts = {(rng.choice([1, 1, 2]), base + dt.timedelta(days=rng.randrange(200))): rng.choice([None, rng.random()]) for _ in range(150)}
    probes = [(rng.choice([1, 2, 3]), base + dt.timedelta(days=rng.randrange(-5, 210))) for _ in range(100)]
    f = spark.createDataFrame([(k, t, v) for (k, t), v in facts.items()], "k long, t date, v double")
    p = spark.createDataFrame(probes, "k long, at date")
    got = sorted((r["k"], r["at"], r["fact_time"] or D.min, r["v"] if r["v"] is not None else -1.0) for r in asof.asof_backward(p, f, ["k"], "at", "t", ["v"], strict, chunk).collect())
    want = []
    for k, at in probes:
        ok = [t for kk, t in facts if kk == k and (t < at if strict else t <= at)]
        t = max(ok) if ok else None
        v = facts[k, t] if t else None
        want.append((k, at, t or D.min, v if v is not None else -1.0))
    assert got == sorted(want)


def test_forward_tolerance_weekend_and_truncation(spark):
    p = prices(spark, [(1, "2020-01-02", 100.0), (1, "2020-02-03", 105.0), (2, "2020-01-02", 100.0), (2, "2020-01-15", 40.0)])
    probe = spark.createDataFrame([(1, d("2020-02-01")), (2, d("2020-06-01"))], "security_id long, target date")
    got = {r["security_id"]: (r["close"], r["truncated"]) for r in asof.resolve_forward(probe, p, ["security_id"], "target", "date", "close").collect()}
    assert got == {1: (105.0, False), 2: (40.0, True)}


def test_previous_session_is_the_markets(spark):
    p = prices(spark, [(1, "2020-01-02", 1.0), (1, "2020-01-06", 1.0), (2, "2020-01-03", 1.0)])
    got = {r["date"]: r["prev_session"] for r in asof.sessions(p, "date").collect()}
    assert got[d("2020-01-06")] == d("2020-01-03") and got[d("2020-01-02")] is None


def test_interval_join_half_open_and_closed(spark):
    s = spark.createDataFrame([(1, d("2020-01-01"), d("2020-02-01")), (1, d("2020-03-01"), None)], "k long, a date, z date")
    p = spark.createDataFrame([(1, d("2020-02-01")), (1, d("2020-03-01"))], "k long, at date")
    assert asof.interval_at(p, s, ["k"], "at", "a", "z").count() == 1
    assert asof.interval_at(p, s, ["k"], "at", "a", "z", closed_end=True).count() == 2


@pytest.mark.parametrize("a,z", [("2020-01-01", "2020-01-01"), ("2020-01-04", "2020-01-05"), ("2019-12-30", "2021-03-07"), ("2020-05-02", "2020-05-01"), ("1960-02-01", "1975-07-07")])
def test_business_days(spark, a, z):
    got = spark.range(1).select(calendar.business_days(F.lit(a).cast("date"), F.lit(z).cast("date"))).first()[0]
    x, n = d(a), 0
    while x <= d(z):
        n += x.weekday() < 5
        x += dt.timedelta(days=1)
    assert got == n


def test_month_schedule_refuses_late_days(spark):
    with pytest.raises(ValueError):
        calendar.month_starts(spark, "2020-01-31", "2020-12-31")
    with pytest.raises(ValueError):
        calendar.schedule(spark, "2020-01-01", "2020-02-01", "hourly")
    assert calendar.schedule(spark, "2020-01-01", "2020-01-15", "weekly").count() == 3


def test_mid_rank_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", None), ("b", 5.0)], "g string, v double")
    got = sorted((r["g"], r["v"] or -1, r["m"]) for r in df.withColumn("m", crosssection.mid_rank("v", ["g"])).collect() if r["m"] is not None)
    assert got == [("a", 1.0, pytest.approx(0.5 / 3)), ("a", 2.0, pytest.approx(2 / 3)), ("a", 2.0, pytest.approx(2 / 3))]


def test_rank_correlation(spark):
    rows = [("up", float(i), float(i * i)) for i in range(6)] + [("down", float(i), float(-i)) for i in range(6)] + [("flat", 1.0, float(i)) for i in range(6)]
    got = {r["g"]: r["ic"] for r in crosssection.rank_correlation(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y", 5).collect()}
    assert got["up"] == pytest.approx(1) and got["down"] == pytest.approx(-1) and got["flat"] is None


def test_trailing_windows_need_full_history_and_no_future(spark):
    rows = [(1, (d("2020-01-01") + dt.timedelta(days=i)).isoformat(), float(100 + i)) for i in range(30)]
    f = lambda rs: {r["date"]: r["x"] for r in prices(spark, rs).withColumn("x", trailing.return_between("close", 0, 21)).collect()}
    a = f(rows)
    assert a[d("2020-01-21")] is None and a[d("2020-01-22")] == pytest.approx(121 / 100 - 1)
    b = f([(i, x, c if x <= "2020-01-25" else c * 7) for i, x, c in rows])
    assert all(a[k] == b[k] for k in a if k <= d("2020-01-25"))


def test_drawdown(spark):
    got = spark.range(1).select(trailing.drawdown(F.array(*[F.lit(x) for x in (10.0, 12.0, 6.0, 9.0)]))).first()[0]
    assert got == pytest.approx(-0.5)


def test_split_kinds(spark):
    want = {2.0: "genuine", 1.998: "genuine", 0.1: "genuine", 1.017: "likely_spinoff_artifact", 1.324: "likely_spinoff_artifact", 1.0: "likely_spinoff_artifact"}
    got = {r["r"]: r["k"] for r in spark.createDataFrame([(x,) for x in want], "r double").select("r", adjust.split_kind(F.col("r")).alias("k")).collect()}
    assert got == want


def test_dividends_scale_earlier_bars(spark):
    p = spark.createDataFrame([(1, d(f"2020-01-0{i}"), 100.0, 100.0, 100.0, 100.0, 10.0) for i in range(1, 8)], "security_id long, date date, open double, high double, low double, close double, volume double")
    div = spark.createDataFrame([(1, d("2020-01-03"), 1.0), (1, d("2020-01-05"), 1.0), (1, d("2020-01-07"), 1.0), (1, d("2020-01-01"), 5.0), (1, d("2020-01-04"), None)], "security_id long, ex_date date, amount double")
    got = {r["date"].day: r["close"] for r in adjust.total_return(p, div).collect()}
    assert got[7] == 100 and got[6] == pytest.approx(99) and got[1] == pytest.approx(100 * 0.99**3)
    # an event between or after the sessions works on every bar before it
    late = spark.createDataFrame([(1, d("2020-03-01"), 2.0)], "security_id long, ex_date date, ratio double")
    assert {r["close"] for r in adjust.split_adjusted(p, late).collect()} == {50.0}


def test_bad_ohlc(spark):
    rows = [(1.0, 2.0, 0.5, 1.5), (1.0, 0.4, 0.5, 0.45), (3.0, 2.0, 0.5, 1.0), (0.0, 2.0, 0.0, 1.0), (1.0, 2.0, 1.2, 1.5), (None, 2.0, 0.5, 1.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "open double, high double, low double, close double").select(quality.bad_ohlc()).collect()]
    assert got == [False, True, True, True, True, False]


def test_conflicts_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(200):
        s = rng.randrange(0, 3000)
        rows.append((i, rng.choice("ab"), rng.choice("xyz"), d("2012-01-01") + dt.timedelta(days=s), rng.choice([None, d("2012-01-01") + dt.timedelta(days=s + rng.randrange(1, 500))])))
    got = {r[0] for r in claims.conflicting(spark.createDataFrame(rows, "id long, k string, src string, s date, e date"), ["k"], "src", "s", "e", "id").collect()}
    far = D.max
    want = {a[0] for a in rows for b in rows if a[1] == b[1] and a[2] != b[2] and a[3] <= (b[4] or far) and b[3] <= (a[4] or far) and (a[3], a[4]) != (b[3], b[4])}
    assert got == want


def test_loads_are_idempotent(spark):
    t = spark.createDataFrame([(1, "a", 1), (None, "n", 1)], "k long, v string, o int")
    new = spark.createDataFrame([(1, "z", 1), (2, "b", 2), (2, "c", 1), (None, "m", 1)], "k long, v string, o int")
    add = upsert.insert_new(t, new, ["k"], ["o", "v"])
    assert [tuple(r) for r in add.collect()] == [(2, "c", 1)]
    assert upsert.insert_new(t.unionByName(add), new, ["k"], ["o", "v"]).count() == 0
    assert {r["v"] for r in upsert.overwrite_latest(t, new, ["k"], "o").where("k = 2").collect()} == {"b"}


def test_split_of_108_months(spark):
    m = spark.range(108).select(F.add_months(F.lit("2015-01-01").cast("date"), F.col("id").cast("int")).alias("m"))
    n = {r["part"]: r["count"] for r in splits.primary_split(m, "m", 0.6, 0.15, 0.25, 3).groupBy("part").count().collect()}
    assert n == {"train": 62, "validation": 13, "test": 27, "purged": 6}
    with pytest.raises(ValueError):
        splits.primary_split(m, "m", 0.6, 0.15, 0.3, 3)
    assert all(max(a) + 3 < min(b) for a, b in splits.inner_folds(60, 3, 3))


def test_bootstrap(spark):
    rng = random.Random(1)
    noise = [rng.gauss(0, 1) for _ in range(400)]
    a, b = bootstrap.mean_interval(spark, noise, 5, 400), bootstrap.mean_interval(spark, [x + 1 for x in noise], 5, 400)
    assert not a["excludes_zero"] and b["excludes_zero"] and bootstrap.mean_interval(spark, noise[:10], 5) is None
    assert bootstrap.choose_block_length({1: 0.9, 2: 0.8, 3: 0.01}, 400) == 7 and bootstrap.choose_block_length({}, 4) == 5


def test_trade_cost_and_fold(spark):
    c = spark.range(1).select(fold.trade_cost(F.lit(10_000.0), F.lit(False), fold.Costs(sale_fee=0.0))).first()[0]
    assert c == pytest.approx(20.0)
    free = fold.Costs(0, 0, 0, 0, 0, 0, 0)
    rows = [
        ("r", d("2020-01-31"), 1, 0.5, 100.0, 100.0), ("r", d("2020-01-31"), 2, 0.5, 50.0, 50.0),
        ("r", d("2020-02-28"), 1, 0.5, 110.0, 110.0), ("r", d("2020-02-28"), 2, 0.5, None, 50.0),
        ("r", d("2020-03-31"), 1, None, 120.0, 120.0), ("r", d("2020-03-31"), 2, 1.0, 60.0, 60.0),
    ]
    plan = spark.createDataFrame(rows, "run_id string, date date, security_id long, weight double, price double, mark double")
    s = {r["date"].month: r for r in fold.simulate(plan, 1000.0, free).collect()}
    assert s[1]["value"] == pytest.approx(1000) and s[1]["holdings"] == 2
    assert s[2]["value"] == pytest.approx(1050)  # 5 x 110 + 10 x 50, the one without a price kept
    assert s[3]["holdings"] == 1 and s[3]["value"] == pytest.approx(1050 + (525 / 110) * 10 + 10 * 10)


def test_metrics(spark):
    rows = [("r", d(f"2020-{m:02d}-01"), v) for m, v in enumerate((100.0, 110.0, 99.0, 120.0), 1)]
    snap = spark.createDataFrame(rows, "run_id string, date date, value double").select("*", F.lit(0.1).alias("turnover_pct"), F.lit(1.0).alias("costs"), F.lit(1).alias("trades"))
    r = fold.performance(snap).first()
    assert r["cumulative_return"] == pytest.approx(0.2) and r["max_drawdown"] == pytest.approx(-0.1) and r["win_rate"] == pytest.approx(2 / 3)
    rets = [0.1, -0.1, 120 / 99 - 1]
    m = sum(rets) / 3
    sd = math.sqrt(sum((x - m) ** 2 for x in rets) / 2)
    assert r["sharpe_ratio"] == pytest.approx(m / sd * math.sqrt(12)) and r["sortino_ratio"] == pytest.approx(m / math.sqrt(0.01 / 3) * math.sqrt(12))
    assert fold.annual_returns(snap).first()["annual_return"] == pytest.approx(0.2)


def test_readers(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("ticker,start_date,end_date\nAAA,2000-01-01,\n\nBBB,2005-01-01,2006-01-01\nCCC\n")
    m = {r["raw_ticker"]: r for r in readers.DelimitedMembership("X").parse(spark, str(p)).collect()}
    assert set(m) == {"AAA", "BBB"} and m["AAA"]["removal_date"] is None and m["AAA"]["note"] and m["BBB"]["note"] is None
    src = readers.SyntheticPrices(empty=["N"])
    a, b = (sorted(map(tuple, src.fetch(spark, ["A", "N"], "2020-01-01", "2020-02-01").collect())) for _ in range(2))
    assert a == b and {r[0] for r in a} == {"A"} and all(r[1].weekday() < 5 for r in a)
    assert readers.claims_from_records(spark, []).count() == 0
    e = readers.evolve(spark.range(1), {"id": "long", "x": "string"})
    assert readers.evolve(e, {"x": "string"}).columns == ["id", "x"]


@pytest.mark.parametrize(
    ("night", "difference", "mean", "want"),
    [(True, True, 1e-3, "genuine_effect_candidate"), (True, True, -1e-3, "genuine_effect_candidate"), (True, True, 1e-5, "inconclusive"), (False, True, 1e-3, "failure"), (True, False, 1e-3, "failure"), (False, False, 1e-5, "failure"), (None, True, 1e-3, "inconclusive"), (True, None, 1e-3, "inconclusive")],
)
def test_verdict_of_two_intervals(night, difference, mean, want):
    of = lambda x: None if x is None else {"excludes_zero": x, "mean": mean}
    assert bootstrap.verdict(of(night), of(difference)) == want


def test_numbers_ranks_and_quantiles_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *map(float, range(12))]), i) for i in range(500)] + [("hot", float(i % 7), 1000 + i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v double, id long")
    got = {r["id"]: (r["g"], r["n"]) for r in ranking.number_rows(df, ["g"], ["v", "id"], "n").collect()}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0.0, r[2]))
        assert [got[r[2]] for r in mine] == [(g, k + 1) for k in range(len(mine))]
    assert [r["n"] for r in ranking.number_rows(df, [], ["id"], "n").orderBy("id").collect()] == list(range(1, 901))
    named = [r for r in rows if r[0] is not None]
    for r in ranking.value_ranks(df.where("g is not null"), ["g"], "v").collect():
        vs = [x[1] for x in named if x[0] == r["g"] and x[1] is not None]
        want = (None, None, None) if r["v"] is None else (sum(x < r["v"] for x in vs), vs.count(r["v"]), len(vs))
        assert (r["_below"], r["_equal"], r["_n"]) == want
    import numpy as np

    for r in ranking.quantiles(df.where("g is not null"), ["g"], "v", [0.0, 0.3, 0.5, 1.0]).collect():
        assert r["quantile"] == pytest.approx(np.quantile([x[1] for x in named if x[0] == r["g"] and x[1] is not None], r["share"]))
    assert ranking.number_rows(df.limit(0), ["g"], ["id"], "n").count() == 0


def test_trailing_windows_survive_nan_and_extremes(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, 900)
    x[100], x[101], x[300] = np.nan, np.inf, 1e9
    df = spark.createDataFrame([(1, d("2020-01-01") + dt.timedelta(days=i), float(v)) for i, v in enumerate(x)], "security_id long, date date, x double")
    c = trailing.cumulated(df, {"x": F.col("x")})
    got = c.select("date", trailing.count("x", 63).alias("n"), trailing.mean("x", 200).alias("m"), trailing.deviation("x", 63).alias("s")).orderBy("date").collect()
    ok = np.isfinite(x)
    for i, r in enumerate(got):
        w = x[max(0, i - 62) : i + 1][ok[max(0, i - 62) : i + 1]]
        assert r["n"] == len(w)
        if i > 600:  # a chunk and more after the extreme value
            assert r["s"] == pytest.approx(w.std(ddof=1), rel=1e-9) and r["m"] == pytest.approx(x[i - 199 : i + 1].mean(), rel=1e-7, abs=1e-12)
    with pytest.raises(ValueError):
        trailing.count("x", 257)


CANDIDATE = {"security_id": 1, "known_security": True, "identifier_quality": "resolved", "flagged": False, "any_data": True, "near_date": True, "lookback": True, "liquidity": True, "completeness": 0.99, "bad_share": 0.0, "passed_filters": True}
WRONG = [
    ({}, None, None), ({"security_id": None}, "identity_unresolved", "identity_unresolved"), ({"known_security": False}, "security_row_not_found", "security_row_not_found"),
    ({"identifier_quality": "unresolved"}, "identity_unresolved_by_policy", None), ({"flagged": True}, "review_flagged_by_policy", None), ({"any_data": False}, "no_data", "no_data"), ({"near_date": False}, "short_history_by_policy", None),
    ({"completeness": 0.9}, "short_history_by_policy", None), ({"completeness": 0.7}, "short_history_by_policy", "incomplete"), ({"lookback": False}, "short_history_by_policy", "short_lookback"), ({"liquidity": False}, "short_history_by_policy", "no_volume"),
    ({"passed_filters": False}, "failed_filters", "failed_filters"), ({"flagged": True, "any_data": False}, "review_flagged_by_policy", "no_data"),
]


def test_each_candidate_has_its_first_reason(spark):
    rows = [(i, *(CANDIDATE | change).values()) for i, (change, _, _) in enumerate(WRONG)]
    types = {"security_id": "long", "identifier_quality": "string", "completeness": "double", "bad_share": "double"}
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{k} {types.get(k, 'boolean')}" for k in CANDIDATE))
    got = {(r["policy"], r["i"]): r["reason"] for r in universe.judged(df, (universe.STRICT, universe.PERMISSIVE)).collect()}
    for i, (_, strict, loose) in enumerate(WRONG):
        assert (got["STRICT", i], got["PERMISSIVE", i]) == (strict, loose), i
    worst = universe.Policy("W", 0.5, bad_share=0.1)
    assert universe.judged(df.withColumn("bad_share", F.lit(0.2)), (worst,)).where("i = 0").first()["reason"] == "bad_bars_by_policy"


def test_availability_never_sees_the_future(spark):
    rng = random.Random(4)
    days = [d("2019-01-01") + dt.timedelta(days=i) for i in range(500) if (d("2019-01-01") + dt.timedelta(days=i)).weekday() < 5]
    bars = [(s, x, 10.0, rng.choice([0.0, 5.0])) for s in (1, 2) for x in days if rng.random() < 0.9]
    t = d("2020-02-03")
    changed = [(s, x, c * (9 if x > t else 1), None if x > t else v) for s, x, c, v in bars if x <= t or rng.random() < 0.5]
    points = spark.createDataFrame([(s, t - dt.timedelta(days=k)) for s in (1, 2, 3) for k in (0, 5, 40, 300, 500)], "security_id long, as_of date")
    out = [sorted(map(tuple, universe.availability(points, spark.createDataFrame(b, "security_id long, date date, close double, volume double"), 50).collect())) for b in (bars, changed)]
    assert out[0] == out[1] and any(r[4] for r in out[0]) and not all(r[2] for r in out[0])


def fold_by_hand(plan, cash, costs):
    """The portfolio fold written another way: one dict of names a date, no pandas."""
    out, money, held, seen = [], cash, {}, {}
    for day in sorted({r[0] for r in plan}):
        rows = {r[1]: r for r in plan if r[0] == day}
        seen.update({s: r[4] for s, r in rows.items() if r[4] is not None})
        worth = money + sum(q * seen.get(s, 0) for s, q in held.items())
        goal = {s: r[2] for s, r in rows.items() if r[2] is not None}
        fee = 0.0
        if goal:
            bad = {s for s in goal if not rows[s][3] or rows[s][3] <= 0}
            for s in sorted((set(held) | set(goal)) - bad):
                q = goal[s] * worth / rows[s][3] if s in goal else 0.0
                step = q - held.get(s, 0.0)
                if abs(step) < 1e-9:
                    continue
                amount = abs(step) * seen[s]
                cost = amount * costs.rate + (amount * costs.sale_fee if step < 0 else 0)
                money, fee = money - step * seen[s] - cost, fee + cost
                held[s] = q
                if abs(q) < 1e-9:
                    del held[s]
        out.append((day, money, money + sum(q * seen.get(s, 0) for s, q in held.items()), fee, len(held)))
    return out


def test_fold_equals_the_one_by_hand_and_ignores_later_prices(spark):
    rng = random.Random(8)
    days = [d("2020-01-01") + dt.timedelta(days=30 * i) for i in range(8)]
    plan = []
    for i, day in enumerate(days):
        for s in range(6):
            price = 50 + 10 * rng.random()
            want = round(rng.random() / 4, 3) if rng.random() < 0.6 and i != 5 else None
            plan.append((day, s, want, None if rng.random() < 0.15 else price, price))
    schema = "run_id string, date date, security_id long, weight double, price double, mark double"
    frame = lambda rows: spark.createDataFrame([("r", *x) for x in rows], schema)
    got = [(r["date"], r["cash"], r["value"], r["costs"], r["holdings"]) for r in fold.simulate(frame(plan), 1e5).orderBy("date").collect()]
    for a, b in zip(got, fold_by_hand(plan, 1e5, fold.Costs()), strict=True):
        assert a[0] == b[0] and a[4] == b[4] and a[1:4] == pytest.approx(b[1:4], rel=1e-9, abs=1e-6)
    later = [(x, s, w, p and p * 3, m * 3) if x > days[4] else (x, s, w, p, m) for x, s, w, p, m in plan]
    again = [tuple(r) for r in fold.simulate(frame(later), 1e5).where(F.col("date") <= days[4]).orderBy("date").collect()]
    assert again == [tuple(r) for r in fold.simulate(frame(plan), 1e5).where(F.col("date") <= days[4]).orderBy("date").collect()]


def test_decisions_and_outcome(spark):
    new = spark.createDataFrame([("s", "good", 0.10, 0.09, True, 0.09), ("s", "small", 0.06, 0.06, None, None), ("s", "regime", 0.10, 0.051, None, None), ("s", "history", 0.10, 0.10, False, None), ("s", "family", 0.10, 0.10, None, 0.055)], "step string, model string, mean_ic double, mean_ic_excluding double, history_ok boolean, mean_ic_without_family double")
    old = spark.createDataFrame([("s", "a", 0.05, 0.05), ("s", "b", 0.01, 0.02)], "step string, model string, mean_ic double, mean_ic_excluding double")
    r = {x["model"]: x for x in decisions.decide(new, old).collect()}
    assert {m for m, x in r.items() if x["survives"]} == {"good"} and not r["small"]["clears_threshold"] and r["regime"]["from_regime"] == pytest.approx(0.98)
    assert decisions.outcome(decisions.decide(new, old)).first()["outcome"] == decisions.OUTCOMES[1]
    assert decisions.outcome(decisions.decide(new.where("model = 'small'"), old)).first()["outcome"] == decisions.OUTCOMES[0]


def test_run_store_config_and_reports(spark, tmp_path):
    store = runs.RunStore(spark, str(tmp_path / "store"))
    one = spark.createDataFrame([("r1",)], "run_id string")
    m = spark.createDataFrame([("r1", "sharpe", 1.0)], "run_id string, metric_name string, value double")
    years = spark.createDataFrame([("r1", 2020, 0.1), ("r1", 2021, 0.2)], "run_id string, year int, annual_return double")
    store.save_run(one, m, years, write=0)
    store.save_run(one, m.withColumn("value", F.lit(2.0)), write=1)
    assert [(r["metric_name"], r["period"], r["value"]) for r in store.load_results("r1").collect()] == [("annual_return", "2020", 0.1), ("annual_return", "2021", 0.2), ("sharpe", None, 2.0)]
    (tmp_path / "c.toml").write_text('indices = ["SP400"]\nseeds = 3\n')
    c = runs.Config.load(str(tmp_path / "c.toml"))
    assert c.seeds == 3 and c.indices == ("SP400",) and list(json.loads(c.to_json())) == sorted(json.loads(c.to_json()))
    (tmp_path / "bad.toml").write_text("speed = 3\n")
    with pytest.raises(ValueError):
        runs.Config.load(str(tmp_path / "bad.toml"))
    assert runs.report_markdown(m, "T").splitlines()[-1] == "| r1 | sharpe | 1 |"
    with pytest.raises(ValueError):
        runs.report_markdown(m.union(m), "T", 1)


def test_guard_fails_the_job(spark):
    df = spark.createDataFrame([(d("2020-01-02"), d("2020-01-01")), (None, d("2020-01-01"))], "seen date, bound date")
    assert readers.guarded(df.where("seen is null"), F.col("seen"), F.col("bound")).count() == 1
    with pytest.raises(Exception, match="later|dated after"):
        readers.guarded(df, F.col("seen"), F.col("bound")).collect()


def test_synthetic_bars_by_hand(spark):
    got = readers.SyntheticPrices(["NONE"], {"GAP": ("2020-01-03", "2020-01-06")}).fetch(spark, ["AAA", "GAP", "NONE"], "2020-01-01", "2020-01-08").orderBy("ticker", "date").collect()
    assert [r["date"].day for r in got if r["ticker"] == "GAP"] == [1, 2, 7, 8] and not [r for r in got if r["ticker"] == "NONE"]
    seed = int(hashlib.sha256(b"AAA").hexdigest(), 16) % 2**32
    s1 = (1103515245 * seed + 12345) % 2**31
    assert got[0]["close"] == round((100 + seed % 200) * (1 + (s1 / 2**31 - 0.5) * 0.02), 4)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from chronopanel.session import shared_folder

    fake = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda k, x: folder), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    assert shared_folder(fake("yarn", "hdfs:///x")) == "hdfs:///x" and shared_folder(fake("local[2]", None))
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_folder(fake(master, None))


def test_metadata_is_put_where_it_is_missing(spark):
    t = spark.createDataFrame([(1, None, "x"), (2, "a", None), (3, None, None)], "id long, a string, b string")
    u = spark.createDataFrame([(1, "new", "y"), (2, "new", "z")], "id long, a string, b string")
    assert sorted(map(tuple, upsert.update_metadata(t, u, "id", ["a", "b"]).collect())) == [(1, "new", "x"), (2, "a", "z"), (3, None, None)]
