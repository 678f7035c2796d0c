"""Operators for training data: brute force, invariants and edge cases."""

import datetime as dt
import json
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.llm.abuse import AbuseScorer, LevenshteinAutomaton, Reach, Trie, abuse_rates, abuse_scores, budget, fold
from chronopanel.llm.linkage import common_words, components, phrases, soft_match, without, words_of, words_similarity
from chronopanel.llm.mixing import mix_sources
from chronopanel.llm.packing import best_fit, empty_bins, pack_containers
from chronopanel.llm.queries import clean_source, withdrawn
from chronopanel.llm.tokens import token_counts
from chronopanel.llm.truth import best_claims, chain_groups, discover_truth

# --- best representative ---------------------------------------------------


def test_chains(spark):
    d0 = dt.date(2020, 1, 1)
    rows = [(1, "a", 0), (2, "a", 10), (3, "a", 20), (4, "a", 31), (5, "b", 0), (6, None, 0), (7, "a", None), (8, "a", 0)]
    df = spark.createDataFrame([(i, k, None if n is None else d0 + dt.timedelta(days=n)) for i, k, n in rows], "id long, k string, d date")
    got = {r["id"]: (r["group_id"], r["group_size"]) for r in chain_groups(df, ["k"], "d", "id", 10).collect()}
    assert got == {1: (1, 4), 2: (1, 4), 3: (1, 4), 8: (1, 4), 4: (4, 1), 5: (5, 1)}


def claims(spark, rows):
    return spark.createDataFrame(rows, "g long, id long, s string, rank int, v string, w string")


def test_truth_learns_reliability_and_respects_precedence(spark):
    rows, n = [], 0
    for g in range(40):  # good and fair agree, bad is alone
        for s in ("good", "fair", "bad"):
            n += 1
            rows.append((g, n, s, 3 if s == "bad" else 1, "wrong" if s == "bad" else "right", None))
    kw = {"group": "g", "claim_id": "id", "source": "s", "weight": F.lit(1.0), "fields": ["v", "w"]}
    values, sources = discover_truth(claims(spark, rows), **kw)
    assert {r["value"] for r in values.collect()} == {"right"} and {r["field_name"] for r in values.collect()} == {"v"}
    rel = {r["s"]: r["reliability"] for r in sources.collect()}
    assert rel["good"] > 0.9 > 0.3 > rel["bad"]
    best = best_claims(claims(spark, rows), group="g", claim_id="id", order=["rank", "id"], fields=["v", "w"]).collect()
    assert len(best) == 40 and {(r["field_name"], r["value"]) for r in best} == {("v", "wrong")}


def test_best_claims_edges(spark):
    kw = {"group": "g", "claim_id": "id", "order": ["rank", "id"], "fields": ["v", "w"]}
    assert best_claims(claims(spark, []), **kw).count() == 0
    rows = [(1, 1, "a", 2, None, "x"), (1, 2, "b", 1, "y", None), (1, 3, "b", None, "z", None), (1, 2, "b", 1, "y", None), (2, 4, "c", 1, None, None)]
    got = {(r["g"], r["field_name"]): (r["id"], r["value"]) for r in best_claims(claims(spark, rows), **kw).collect()}
    assert got == {(1, "v"): (2, "y"), (1, "w"): (1, "x")}


def test_truth_beats_majority_on_planted_reliabilities(spark):
    """Six sources, each right as often as planted; the bad ones are in the majority and err alike at times."""
    rng, rel = random.Random(5), {"a": 0.97, "b": 0.9, "c": 0.5, "d": 0.4, "e": 0.35, "f": 0.3}
    rows, n = [], 0
    for g in range(3000):
        for s, r in rel.items():
            n += 1
            v = "t" if rng.random() < r else f"w{rng.randrange(2)}"
            rows.append((g, n, s, 1, v, None))
    df = claims(spark, rows)
    values, sources = discover_truth(df, group="g", claim_id="id", source="s", weight=F.lit(1.0), fields=["v"])
    learned = {r["s"]: r["reliability"] for r in sources.collect()}
    assert sorted(learned, key=learned.get, reverse=True) == list(rel)
    assert all(abs(learned[s] - r) < 0.15 for s, r in rel.items())
    right = values.where("value = 't'").count() / 3000
    votes = df.groupBy("g", "v").count().groupBy("g").agg(F.max_by("v", F.struct("count", "v")).alias("v"))
    assert right > 0.9 and right > votes.where("v = 't'").count() / 3000 + 0.02


def test_truth_edges(spark):
    kw = {"group": "g", "claim_id": "id", "source": "s", "weight": F.lit(1.0), "fields": ["v"]}
    assert discover_truth(claims(spark, []), **kw)[0].count() == 0
    rows = [(1, 1, None, 1, "a", None), (1, 1, None, 1, "a", None), (1, 2, "x", 1, "b", None), (2, 3, "x", 1, None, None)]
    got = [tuple(r)[:4] for r in discover_truth(claims(spark, rows), **kw)[0].collect()]
    assert got == [(1, "v", "a", 1)]


def test_withdrawn(spark):
    want = {"Withdrawn by the source on review.": True, "Not withdrawn as of the last check.": False, "No retraction on record.": False, "RESCINDED - published in error.": True, "voided by correction bulletin": True, "Entry taken back by its maintainer.": True, "Compared with a notice that withdrew another ticker; this one stands.": False, "Seen in two editions.": False, "": False, None: False, "claim was retracted; kept for the record": True}
    df = spark.createDataFrame([(k,) for k in want], "t string").select("t", withdrawn(F.col("t")).alias("w"))
    assert {r["t"]: r["w"] for r in df.collect()} == want


# --- matching --------------------------------------------------------------


def solve_brute(pairs, alike_weight=2.0):
    """Projected gradient on the same convex problem."""
    n = len(pairs)
    x = np.full(n, 0.3)
    p, q = np.array([a[2] for a in pairs]), np.array([a[3] for a in pairs])
    groups = {}
    for i, a in enumerate(pairs):
        groups.setdefault(a[1], []).append(i)
    same = [(i, j) for i in range(n) for j in range(n) if i < j and pairs[i][0] == pairs[j][0] and pairs[i][4] is not None and pairs[i][4] == pairs[j][4]]
    for _ in range(40_000):
        g = -2 * p * (1 - x) + 2 * q * x
        for i, j in same:
            g[i] += 2 * alike_weight * (x[i] - x[j])
            g[j] += 2 * alike_weight * (x[j] - x[i])
        x = x - 0.005 * g
        for ids in groups.values():  # projection on sum <= 1, x >= 0
            v = np.maximum(x[ids], 0)
            if v.sum() > 1:
                u = np.sort(x[ids])[::-1]
                c = (np.cumsum(u) - 1) / np.arange(1, len(u) + 1)
                v = np.maximum(x[ids] - c[np.flatnonzero(u > c)[-1]], 0)
            x[ids] = v
    return x


@pytest.mark.parametrize("together", [100_000, 0])
def test_soft_match_reaches_the_optimum(spark, together):
    pairs = [(1, 10, 3.0, 1.0, "k"), (2, 10, 2.5, 1.0, None), (1, 11, 0.2, 1.0, "k"), (3, 12, 4.0, 1.0, None), (4, 13, 0.0, 9.0, None), (5, 13, 2.0, 1.0, "m"), (5, 14, 2.0, 1.0, "m")]
    df = spark.createDataFrame(pairs, "l long, r long, p double, n double, k string")
    got = {(r["l"], r["r"]): r["confidence"] for r in soft_match(df, "l", "r", "p", "n", "k", together=together).collect()}
    for a, want in zip(pairs, solve_brute(pairs), strict=True):
        assert got[a[0], a[1]] == pytest.approx(want, abs=0.02), a
    assert soft_match(spark.createDataFrame([], df.schema), "l", "r", "p", "n", "k").count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, f"c{i // 2}") for i in range(40)] + [(i + 1, f"c{i // 2}") for i in range(0, 20)] + [(100 + rng.randrange(30), f"d{rng.randrange(12)}") for _ in range(30)]
    got = {r["r"]: r["part"] for r in components(spark.createDataFrame(edges, "r long, c string")).collect()}
    want = {r: r for r, _ in edges}
    for _ in range(60):
        for r, c in edges:
            want[r] = min(want[r], *(want[x] for x, y in edges if y == c))
    assert got == want


def test_common_words_and_phrases(spark):
    rows = [(i, f"The {'Rail' if i % 2 else 'Media'} co{chr(97 + i % 26)}x of w{chr(97 + i // 26)}q") for i in range(100)] + [(200, "The Rail Media"), (201, None), (202, "")]
    df = spark.createDataFrame(rows, "id long, t string").withColumn("w", words_of(F.col("t")))
    common = common_words(df, "w")
    assert {"the", "rail", "media"} <= set(common) and "coax" not in common
    kept = {r["id"]: r["w"] for r in df.select("id", without(F.col("w"), common).alias("w")).collect()}
    assert kept[200] == [] and kept[201] == [] and kept[0] == ["coax"]
    names, texts = df.where("id in (200, 202)"), spark.createDataFrame([(7, "see: the RAIL media, page"), (8, "rail the media"), (9, None)], "tid long, t string")
    assert [tuple(r) for r in phrases(names, texts, "t", "id", "tid").collect()] == [(200, 7)]


def test_names(spark):
    df = spark.createDataFrame([("The Bohai-Gaeli Rail Trust", "Rail Tr of BOHAI Gaeil"), ("Aaaa Bbbb Inc", "Aaaa Cccc Ltd"), (None, "x"), ("Rail Inc", "Rail Inc")], "a string, b string")
    generic = ["the", "rail", "trust", "inc", "ltd"]
    got = [r[0] for r in df.select(words_similarity(without(words_of(F.col("a")), generic), without(words_of(F.col("b")), generic))).collect()]
    assert got[0] == pytest.approx(0.8) and got[1] < 0.5 and got[2] is None and got[3] is None


# --- tokens, containers, mixes ---------------------------------------------


def test_token_counts(spark):
    long = "word " * 50_000
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, long), (1, "hello world")], "id long, t string")
    got = sorted((r["id"], r["tokens"]) for r in token_counts(df, "t", ["id"]).collect())
    assert got[0] == got[1] and got[0][1] >= 2 and got[2] == (2, 0) and got[3] == (3, 0) and got[4][1] >= 50_000


@pytest.mark.parametrize("seed", range(4))
def test_swaps_empty_bins_and_keep_items(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 70, 400)
    start = [list(b) for b in np.array_split(rng.permutation(400), 250)]
    start = [b for b in start if sizes[b].sum() <= 100 and len(b)] + [[i] for b in start if sizes[b].sum() > 100 for i in b]
    before = len(start)
    bins = empty_bins(start, sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(400)) and all(sizes[b].sum() <= 100 for b in bins)
    assert len(bins) < 0.6 * before  # a poor start, one or two items a bin
    fit = best_fit(sizes, 100)
    better = empty_bins([list(b) for b in fit], sizes, 100)
    assert all(sizes[b].sum() <= 100 for b in fit) and len(better) <= min(len(fit), 1.02 * -(-sizes.sum() // 100) + 1)


def test_swap_that_moving_alone_cannot_find():
    # 45 fits nowhere; given for 20 and 20 it does, and these fill the other two
    bins = empty_bins([[0, 1, 2], [3], [4], [5]], np.array([20, 20, 50, 45, 80, 80]), 100)
    assert len(bins) == 3


def test_swaps_save_bins_over_best_fit():
    sizes = np.random.default_rng(0).integers(260, 450, 1500)
    fit = best_fit(sizes, 1000)
    bins = empty_bins([list(b) for b in fit], sizes, 1000)
    assert sorted(i for b in bins for i in b) == list(range(1500)) and all(sizes[b].sum() <= 1000 for b in bins)
    assert len(bins) < 0.97 * len(fit)
    # pairs of long bins are searched, not listed
    few = empty_bins([list(b) for b in fit], sizes, 1000, table=1)
    assert sorted(i for b in few for i in b) == list(range(1500)) and all(sizes[b].sum() <= 1000 for b in few) and len(few) < 0.97 * len(fit)


def test_pack(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(0, 400)) for i in range(3000)] + [(5000, 2500), (5001, 1000), (5002, None), (5003, 0)]
    out = pack_containers(spark.createDataFrame(rows, "doc long, n long"), {"small": 500, "big": 1000}, item="doc", size="n", items_per_shard=700, merge=2).collect()
    for name, cap in (("small", 500), ("big", 1000)):
        mine = [r for r in out if r["container_name"] == name]
        fill, total = {}, {}
        for r in mine:
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n"]
            total[r["doc"]] = total.get(r["doc"], 0) + r["n"]
        assert max(fill.values()) <= cap and total == {i: n or 0 for i, n in rows}
        assert len(fill) <= 1.02 * sum(fill.values()) / cap + 3
        assert all(r["piece"] == 0 for r in mine if (dict(rows)[r["doc"]] or 0) <= cap)
    assert pack_containers(spark.createDataFrame([], "doc long, n long"), {"a": 5}, item="doc", size="n").count() == 0


MIX = "mix string, source string, share double, reps int"


def test_mix(spark):
    rng = random.Random(2)
    docs = [(i, "big" if i % 10 else "small", rng.randrange(1, 60)) for i in range(4000)] + [(9001, None, 5), (9002, "big", None), (9003, "other", 7)]
    goal = [("m", "big", 0.6, 1), ("m", "small", 0.3, 3), ("m", "absent", 0.1, 2)]
    df, g = spark.createDataFrame(docs, "doc long, source string, n long"), spark.createDataFrame(goal, MIX)
    picks, shares = mix_sources(df, g, doc="doc", source="source", size="n", mix="mix", share="share", repeats="reps", rows_per_bucket=300)
    p = picks.orderBy("upto").collect()
    assert len({(r["doc"], r["copy"]) for r in p}) == len(p) and max(r["copy"] for r in p) <= 3 and max(r["copy"] for r in p if r["source"] == "big") == 1
    assert [r["finish"] for r in p] == sorted(r["finish"] for r in p)
    run = 0
    for r in p:
        run += r["n"]
        assert r["upto"] == run
    s = {r["source"]: r for r in shares.collect()}
    assert s["absent"]["tokens"] == 0 and s["big"]["reached_share"] == pytest.approx(2 / 3, abs=0.01) and s["small"]["reached_share"] == pytest.approx(1 / 3, abs=0.01)
    assert run == pytest.approx(s["big"]["budget"], rel=0.01)
    half = [r["source"] for r in p[: len(p) // 2]]
    size = {k: sum(r["n"] for r in p[: len(p) // 2] if r["source"] == k) for k in set(half)}
    assert size["big"] / sum(size.values()) == pytest.approx(2 / 3, abs=0.03)
    assert mix_sources(df.limit(0), g, doc="doc", source="source", size="n", mix="mix", share="share", repeats="reps")[0].count() == 0


def test_clean_source(spark):
    df = spark.createDataFrame([(" Course-Hub ",), ("public repo",), ("",), (None,)], "source string")
    assert [r[0] for r in df.select(clean_source()).collect()] == ["course_hub", "public_repo", None, None]


# --- abuse -----------------------------------------------------------------


def cost(word, token):
    """The weighted edit distance, straight from its definition."""
    lost = lambda c: 1 if c in "aeiou" else 2
    more = [1 if t == "*" else 3 for t in token]
    rows = [[sum(more[:j]) for j in range(len(token) + 1)]]
    for c in word:
        r = [rows[-1][0] + lost(c)]
        for j, t in enumerate(token, 1):
            swap = 0 if t == c or (t == "*" and c in "aeiou") else 1 if t == "*" else 3 if (c in "aeiou") == (t in "aeiou") else 4
            r.append(min(rows[-1][j - 1] + swap, rows[-1][j] + lost(c), r[-1] + more[j - 1]))
        rows.append(r)
    return rows[-1][-1]


def test_automaton_equals_brute_force():
    rng = random.Random(0)
    words = sorted({"".join(rng.choice("abeiorst") for _ in range(rng.randrange(3, 10))) for _ in range(300)})
    trie = Trie(words)
    for _ in range(150):
        w = list(rng.choice(words))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice(["", "*", "x", "o"])
        t = "".join(w)
        if t:
            assert sorted(LevenshteinAutomaton(t, 4).intersect(trie)) == [x for x in words if cost(x, t) <= min(4, budget(len(x)))]


def test_prefilter_loses_nothing_the_automaton_accepts():
    scorer = AbuseScorer()
    rng = random.Random(4)
    words = [w for w in scorer.labels if len(w) > 3]
    accepted = 0
    for w in words:
        for _ in range(12):
            t = list(w)
            for _ in range(rng.randrange(1, 4)):
                i = rng.randrange(len(t))
                t[i] = rng.choice(["", "", t[i] + rng.choice("aeioxkt"), rng.choice("aeioxkt")])
            t = "".join(t)
            most = min(4, max(1, len(t) // 2))
            if len(t) > 2 and any(len(x) > 3 for x in LevenshteinAutomaton(t, most).intersect(scorer.trie)):
                accepted += 1
                assert scorer.reach.may(t), (w, t)
    assert accepted > 1000 and not Reach(["motherfucker"]).may("banana")


def test_phrases():
    """Sentences of many kinds; not a held-out set, as rules were made more general with them."""
    scorer, found, total = AbuseScorer(), [0, 0], [0, 0]
    for line in (Path(__file__).parent / "data" / "abuse_phrases.txt").read_text().splitlines():
        if not line.startswith("#"):
            label, text = line.split("\t")
            total[int(label)] += 1
            found[int(label)] += max(scorer.score(f"x = 1\n{text}\nprint(x)")[0].values()) >= 1
    assert total[1] >= 140 and found[1] >= 0.95 * total[1] and found[0] <= 0.03 * total[0], found


@pytest.mark.parametrize("pad", ["", "x" * 250])
def test_abuse_behind_any_amount_of_metadata(pad):
    book = json.dumps({"metadata": {"note": pad}, "cells": [{"source": "shut up you pathetic loser"}]})
    assert max(AbuseScorer().score(book)[0].values()) >= 1


LONG = ["you " + "asshole" * 5, "youareamotherfucker" * 4, "youareamotherfucker" * 40, "Motherfucker!", "you-stupid-idiot", "YouStupidIdiot", "you are a moherfuker"]


@pytest.mark.parametrize("text", LONG)
def test_words_run_together_or_alone(text):
    assert max(AbuseScorer().score(f"x = load(path)\n{text}\nprint(x + 1)")[0].values()) >= 1


def test_lists_of_words_and_encoded_data_are_no_cases():
    import base64

    scorer = AbuseScorer()
    assert max(scorer.score("counts by word\n\nidiot\nasshole\nmoron\n")[0].values()) < 1
    assert max(scorer.score("data:image/png;base64," + base64.b64encode(random.Random(3).randbytes(400_000)).decode())[0].values()) < 1


CASES = [
    "shut up you pathetic loser", "5hu+ up y0u p4+h3+1c l053r", "sh*t up you p*thetic l*ser", "shut up you p a t h e t i c loser", "SHUT UP YOU PATHETIC LOSER!!!",
    "shut_up_you_pathetic_loser = 3", "shuut uup youu paatheetic looser", "sh​ut​ up​ yo​u p​at​he​ti​c l​os​er", "shut uр yоu раthеtiс lоsеr",
    "print('you are a worthless piece of shit')", "I know where you live, watch your back tonight", "du bist ein dummer Vollidiot", "ferme ta gueule, pauvre imbécile", "te voy a encontrar y romperte los dedos",
    "all those foreigners are vermin and should be wiped out", "send me nudes, I want to see your tits", "nobody would miss you if you died, kill yourself",
]
NEUTRAL = [
    "kill the zombie child process before you rerun", "the word 'moron' is labelled as an insult in the toxic comment task", "bare except hides errors, never use a naked except", "damn, the kernel died again",
    "breast cancer table: age, sex, race", "the classifier flags threats like 'I will kill you' with recall 0.9", "master and slave replicas drift apart", "assess the cumulative analysis of class titles", "my laptop is a piece of junk",
    "a stupid bug of mine: I had the sign wrong", "a report on how foreigners and immigrants were counted", "Scunthorpe cocktail analysis", "execute the query, then abort the job", "",
]


@pytest.mark.parametrize("text", CASES)
def test_abuse_is_found(text):
    found, _ = AbuseScorer().score("x = 1\n" + text + "\nprint(x)")
    assert max(found.values()) >= 1, found


@pytest.mark.parametrize("text", NEUTRAL)
def test_neutral_is_not(text):
    found, _ = AbuseScorer().score("x = 1\n" + text + "\nprint(x)")
    assert max(found.values()) < 1, found


def test_abuse_in_any_layout_and_edge_texts(spark):
    book = json.dumps({"cells": [{"cell_type": "markdown", "source": "# t\ndu bist ein blöder Vollidiot"}]})
    rows = [(1, book, "s"), (2, None, "s"), (3, "", None), (4, "A" * 300_000, None), (5, "a " * 50_000, "s"), (6, "{\"cells\": broken", "s"), (1, book, "s")]
    out = abuse_scores(spark.createDataFrame(rows, "id long, text string, source string"), "text", ["id", "source"])
    got = {r["id"]: r["score"] for r in out.collect()}
    assert got[1] >= 0.5 and all(got[i] == 0 for i in (2, 3, 4, 5, 6)) and out.count() == 7
    rates = {r["source"]: (r["documents"], r["flagged"]) for r in abuse_rates(out, "source", 0.5).collect()}
    assert rates == {"s": (5, 2), None: (2, 0)}


def test_fold():
    assert fold("BLÖD") == "blod" and fold("loooser") == "loser" and fold("brain-dead") == "braindead"
