"""Operators for data preparation against brute force, and their edge cases."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from chronopanel.operators.grid import regular_grid
from chronopanel.operators.history import version_history
from chronopanel.operators.intervals import merge_intervals
from chronopanel.operators.known_asof import PersistentTree, known_asof
from chronopanel.operators.spikes import implausible_bars, isolation_scores

D0 = dt.date(2015, 1, 1)
OPEN = dt.date(9999, 12, 31)


def day(n):
    return D0 + dt.timedelta(days=n)


# --- intervals -------------------------------------------------------------


def spans_brute(rows):
    out = set()
    for k in {r[0] for r in rows}:
        iv = sorted((s, e or OPEN) for kk, s, e in rows if kk == k and s is not None and (e is None or e > s))
        merged = []
        for s, e in iv:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(k, "covered", s, e) for s, e in merged}
        out |= {(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_intervals_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        s = rng.randrange(-3000, 9000)
        e = rng.choice([None, s - 1, s, s + 1, s + rng.randrange(1, 30), s + rng.randrange(1, 4000)])
        rows.append((rng.choice(["hot", "hot", "hot", "a", "b", None]), day(s), None if e is None else day(e)))
    rows += [("a", None, day(5)), ("a", day(1), day(4)), ("a", day(1), day(4)), ("a", day(4), day(7))]
    df = spark.createDataFrame(rows, "k string, s date, e date")
    got = {tuple(r) for r in merge_intervals(df, ["k"], "s", "e", shard_days=64).collect()}
    assert got == spans_brute(rows)


def test_intervals_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "k string, s date, e date, _s int, _sh int, span_kind string")
    assert merge_intervals(df, ["k"], "s", "e").count() == 0
    df = spark.createDataFrame([("x", day(0), day(3), 7, 7, "?")], "k string, s date, e date, _s int, _sh int, span_kind string")
    assert [tuple(r) for r in merge_intervals(df, ["k"], "s", "e").collect()] == [("x", "covered", day(0), day(3))]


# --- history ---------------------------------------------------------------


def history_brute(rows):
    out = set()
    for ent in {r[0] for r in rows if r[0] is not None}:
        best = {}
        for e, d, p, o in rows:
            if e == ent and d is not None and (d not in best or (o, p is not None, p or "") > best[d][0]):
                best[d] = ((o, p is not None, p or ""), p)
        seq = [(d, best[d][1]) for d in sorted(best)]
        turns = [x for i, x in enumerate(seq) if i == 0 or x[1] != seq[i - 1][1]]
        for i, (d, p) in enumerate(turns):
            if p is not None:
                out.add((ent, p, d, turns[i + 1][0] if i + 1 < len(turns) else OPEN))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_history_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None] + [day(rng.randrange(0, 4000))] * 9), rng.choice(["A", "B", None, ""]), rng.randrange(4)) for _ in range(900)]
    rows += rows[:40]
    df = spark.createDataFrame(rows, "ent long, d date, p string, o int")
    got = {tuple(r) for r in version_history(df, "ent", "d", "p", "o", chunk_days=50).collect()}
    assert got == history_brute(rows)


def test_history_single_empty_and_clashing(spark):
    schema = "ent string, d date, p string, salt int, chunk int, done string"
    assert version_history(spark.createDataFrame([], schema), "ent", "d", "p").count() == 0
    one = spark.createDataFrame([("x", day(1), "T" * 10_000, 1, 1, "?")], schema)
    assert [tuple(r) for r in version_history(one, "ent", "d", "p").collect()] == [("x", "T" * 10_000, day(1), OPEN)]


# --- known as of -----------------------------------------------------------


def known_brute(events, claims):
    out = set()
    for ent, d in {e for e in events if None not in e}:
        for lane in {c[1] for c in claims if c[0] == ent}:
            ok = [(c[5] or c[3], c[2], c[4]) for c in claims if c[0] == ent and c[1] == lane and lane is not None and c[3] is not None and c[3] <= d and (c[5] or c[3]) <= d]
            if ok:
                _, cid, end = max(ok, key=lambda x: (x[0], x[1]))
                if end is None or end > d:
                    out.add((ent, d, lane, cid))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_known_asof_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    events = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([day(rng.randrange(-400, 6500))] * 20 + [None])) for _ in range(1500)]
    claims = []
    for i in range(300):
        s = rng.randrange(-300, 6000)
        claims.append((rng.choice([1, 1, 2, 4, None]), rng.choice(["X", "Y", None]), i, rng.choice([day(s)] * 9 + [None]), rng.choice([None, day(s + rng.randrange(1, 900))]), rng.choice([None, day(s + rng.randrange(-200, 400))])))
    e = spark.createDataFrame(events, "ent long, d date")
    c = spark.createDataFrame(claims, "ent long, lane string, cid long, s date, e date, a date")
    got = known_asof(e, c, entity="ent", event_date="d", lane="lane", claim_id="cid", valid_from="s", valid_to="e", known_from="a", horizon="2024-01-01")
    assert {tuple(r) for r in got.collect()} == known_brute(events, claims)


def test_known_asof_future_claims_change_nothing(spark):
    e = spark.createDataFrame([(1, day(100))], "ent long, d date")
    base = [(1, "X", 1, day(0), None, day(5))]
    schema = "ent long, lane string, cid long, s date, e date, a date"
    kw = {"entity": "ent", "event_date": "d", "lane": "lane", "claim_id": "cid", "valid_from": "s", "valid_to": "e", "known_from": "a"}
    first = known_asof(e, spark.createDataFrame(base, schema), **kw).collect()
    later = known_asof(e, spark.createDataFrame([*base, (1, "X", 2, day(0), day(50), day(101))], schema), **kw).collect()
    assert first == later != []
    assert known_asof(e, spark.createDataFrame([], schema), **kw).count() == 0


def test_old_roots_stay_as_they_were():
    tree = PersistentTree(np.zeros(4, int), np.array([30, 10, 20, 10]))
    q = lambda root, until: tree.latest(np.zeros(1, int), np.array([root]), np.array([until]))[0]
    assert [q(r, 15) for r in range(4)] == [-1, 1, 1, 3]
    assert [q(r, 25) for r in range(4)] == [-1, 1, 2, 3]
    assert q(-1, 99) == -1 and q(0, 99) == 0 and q(0, 29) == -1


# --- grid ------------------------------------------------------------------


def calendar(spark, n=200):
    return spark.createDataFrame([(day(i),) for i in range(n) if day(i).weekday() < 5], "session_date date")


def test_grid_fills_between_first_and_last(spark):
    cal = calendar(spark)
    days = sorted(r[0] for r in cal.collect())
    vals = {d: 10 + 0.1 * i for i, d in enumerate(days)}
    miss = {days[5], days[6], days[40]}
    rows = [(1, d, v, 100.0) for d, v in vals.items() if d not in miss and days[2] <= d <= days[60]]
    rows += [(1, days[5], math.nan, 1.0), (1, days[6], None, 1.0), (1, day(3), 99.0, 1.0) if day(3).weekday() > 4 else (1, day(2), 99.0, 1.0)]
    rows += [(2, days[9], 5.0, None), (None, days[9], 5.0, 1.0), (3, days[3], None, 1.0), *rows[:4]]
    df = spark.createDataFrame(rows, "id long, date date, close double, volume double").withColumnsRenamed({})
    out = regular_grid(df, cal, keys=["id"], date="date", value="close", also=["volume"], order=["volume"]).collect()
    one = {r["date"]: r for r in out if r["id"] == 1}
    assert {d for d, r in one.items() if r["status"] == "filled"} == miss
    for d in miss:
        assert one[d]["close"] == pytest.approx(vals[d], abs=0.05)
        assert one[d]["volume"] >= 0
    assert [(r["id"], r["close"], r["status"]) for r in out if r["id"] != 1] == [(2, 5.0, "observed")]


def test_grid_empty(spark):
    df = spark.createDataFrame([], "id long, date date, close double, _i int, status string")
    assert regular_grid(df, calendar(spark), keys=["id"], date="date", value="close").count() == 0


# --- spikes ----------------------------------------------------------------


def walk(seed, n=300):
    rng = np.random.default_rng(seed)
    return 50 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))


def bars(c, sid=1):
    return [[sid, day(i), float(x), float(x * 1.004), float(x * 0.996), float(x * 1.001), i] for i, x in enumerate(c)]


SCHEMA = "sid long, date date, open double, high double, low double, close double, pid long"


def judged(spark, rows, **kw):
    out = implausible_bars(spark.createDataFrame(rows, SCHEMA), keys=["sid"], date="date", order=["pid"], **kw).collect()
    return {(r["sid"], r["date"]): r for r in out}


def test_spikes_rules_and_lasting_changes(spark):
    c = walk(1)
    c[200:] /= 4  # a split is no case
    rows = bars(c)
    for i in (50, 51):
        rows[i][2:6] = [x * 10 for x in rows[i][2:6]]
    rows[80][3] *= 1.9  # one price alone
    rows[100][5] = 0.0
    rows[110][3], rows[110][4] = rows[110][4], rows[110][3]
    for i in range(130, 138):
        rows[i][2] = rows[129][2] if i > 130 else rows[130][2]
    for i in range(130, 138):
        rows[i][2] = 41.0
        rows[i][3], rows[i][4] = max(rows[i][3], 41.0), min(rows[i][4], 41.0)
    rows.append(list(rows[50]))  # a bar sent twice
    rows.append([1, day(160), None, None, None, None, 9999])
    rows.append([None, day(1), 1.0, 1.0, 1.0, 1.0, 1])
    got = judged(spark, rows)
    spike = {d for (_, d), r in got.items() if r["spike"]}
    assert {day(50), day(51), day(80)} <= spike and not spike & {day(199), day(200), day(201)}
    assert got[1, day(100)]["impossible"] and got[1, day(110)]["impossible"]
    assert {d for (_, d), r in got.items() if r["stuck"]} == {day(i) for i in range(131, 138)}
    assert len(got) == 300


def test_spike_scores_do_not_depend_on_neighbours(spark):
    a, b = bars(walk(2), 1), bars(walk(3), 2)
    alone, both = judged(spark, a), judged(spark, a + b)
    assert all(alone[k]["score"] == both[k]["score"] for k in alone)
    assert implausible_bars(spark.createDataFrame([], SCHEMA), keys=["sid"], date="date").count() == 0


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (500, 3))
    x[17] = 12
    s = isolation_scores(x, np.zeros(500, int), np.array([5]), 50, 128, 1)
    assert s.argmax() == 17 and s[17] > 0.65 and np.median(s) < 0.5
    same = isolation_scores(np.ones((4, 2)), np.zeros(4, int), np.array([5]), 5, 8, 1)
    assert np.isfinite(same).all()
