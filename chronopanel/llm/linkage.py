"""Matching entities without a shared key: soft-logic linkage solved by distributed ADMM."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.session import checkpoint

def words_of(text: Column) -> Column:
    """The distinct words of three or more letters, in lower case."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+", " ")), " ")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 2))


def common_words(rows: DataFrame, words: str, share: float = 0.002, least: int = 6) -> list[str]:
    """Words that too many rows have to tell one from another.

    Common is a word of more than `share` of the rows and of more than `least`
    of them, however many rows there are: in a text of w words on average there
    are at most w / share. Any other word tells one from another, in a large
    table also one of thousands of rows.
    """
    n = rows.count()
    df = rows.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return sorted(r["w"] for r in df.where(F.col("n") > max(least, share * n)).select("w").collect())


def without(words: Column, drop: list[str]) -> Column:
    """words less those in `drop`."""
    return F.array_except(words, F.array(*[F.lit(w) for w in drop]).cast("array<string>"))


def phrases(names: DataFrame, texts: DataFrame, text: str, name_id: str, text_id: str) -> DataFrame:
    """Pairs where a text has all words of a name in a row: an equi-join on runs of words of the names' lengths."""
    tokens = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z]+"), lambda w: w != "")
    n = names.select(name_id, tokens.alias("t")).where("size(t) > 0").select(name_id, F.size("t").alias("k"), F.array_join("t", " ").alias("g"))
    lengths = n.agg(F.collect_set("k").alias("ks")).withColumn("one", F.lit(1))  # one row: the lengths of names
    t = texts.select(text_id, tokens.alias("t"), F.lit(1).alias("one")).join(F.broadcast(lengths), "one")
    t = t.select(text_id, "t", F.explode(F.filter("ks", lambda k: k <= F.size("t"))).alias("k"))
    t = t.select(text_id, F.explode(F.expr("transform(sequence(0, size(t) - k), i -> array_join(slice(t, i + 1, k), ' '))")).alias("g")).distinct()
    return n.join(t, "g").select(name_id, text_id).distinct()


def word_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / length; two neighbours exchanged count as one edit."""
    n = F.greatest(F.length(a), F.length(b))
    letters = lambda x: F.array_sort(F.split(x, ""))
    swapped = (F.levenshtein(a, b) == 2) & (F.length(a) == F.length(b)) & (letters(a) == letters(b))
    return 1 - F.when(swapped, 1).otherwise(F.levenshtein(a, b)) / n


def words_similarity(a: Column, b: Column) -> Column:
    """The least, over the words of a, of the best similarity to a word of b; null if one has none."""
    best = F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: word_similarity(x, y))))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.array_min(best))


def soft_match(
    pairs: DataFrame, left: str, right: str, support: str, against: str, alike: str | None = None, *, alike_weight: float = 2.0, rho: float = 2.0, tolerance: float = 1e-5, together: int = 100_000
) -> DataFrame:
    """pairs with confidence in [0, 1]: the truth value of "left and right match".

    A hinge-loss problem over one truth value x per pair, minimised exactly:

    * similarity: weight `support` on max(0, 1 - x)^2 and `against` (the prior
      included, so above 0) on max(0, x)^2;
    * exclusivity, a constraint: the values of one `right` sum to at most 1;
    * transitivity: where two rights of one left have equal, non-null `alike`
      (a value that says both are one thing), `alike_weight` on both hinges
      max(0, x1 - x2)^2 and max(0, x2 - x1)^2.

    Pairs alone in their constraint and class have a closed form. The others
    are solved by alternating directions on copies of the values: every rule's
    copies are set by their own closed form, from sums per right and per (left,
    alike), then averaged, until no value moves by more than `tolerance`; the
    problem is convex, so this ends. It falls into components that share no
    rule: these are found by passing on the least right over (left, alike)
    classes with pointer jumping, in rounds that grow with the logarithm of the
    longest chain. Components of up to `together` pairs are solved where they
    lie, many at a time; a larger one by the same steps as joins and aggregates
    that are combined before the shuffle, so that one of any size is spread
    over tasks.

    Repeated pairs are counted once (greatest support). Null lefts or rights
    take no part. An empty table gives an empty result.
    """
    key = F.col(alike) if alike else F.lit(None).cast("string")
    one = (
        pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull())
        .groupBy(F.col(left).alias("l"), F.col(right).alias("r"))
        .agg(F.max_by(F.struct(F.col(support).cast("double").alias("p"), F.col(against).cast("double").alias("n"), key.cast("string").alias("k")), F.col(support)).alias("q"))
        .select("l", "r", "q.p", "q.n", "q.k")
    )
    peers = Window.partitionBy("l", "k")
    base = one.withColumn("nk", F.when(F.col("k").isNotNull(), F.count(F.lit(1)).over(peers)).otherwise(1)).withColumn("nr", F.count(F.lit(1)).over(Window.partitionBy("r")))
    # a class of size 1 keeps its own value; give it no key
    base = checkpoint(base.select("l", "r", "p", "n", "nr", "nk", F.when(F.col("nk") > 1, F.col("k")).alias("k"), (F.col("p") / (F.col("p") + F.col("n"))).alias("z")))
    alone = base.where("nr = 1 and nk = 1").select("l", "r", "z")
    live = base.where("nr > 1 or nk > 1").drop("nr")
    part = components(live.where("k is not null").select("r", F.struct("l", "k").alias("c")))
    live = live.join(part, "r", "left").withColumn("part", F.coalesce("part", "r"))
    live = checkpoint(live.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("part"))))
    small = live.where(F.col("size") <= together).select("part", "l", "r", "p", "n", "nk", "k", "z")
    types = dict(small.dtypes)
    solved = small.repartition("part").sortWithinPartitions("part", "r", "l").mapInArrow(_solver(alike_weight, rho, tolerance), f"l {types['l']}, r {types['r']}, z double")
    large = _spread(live.where(F.col("size") > together).drop("part", "size"), alike_weight, rho, tolerance)
    done = alone.unionByName(solved).unionByName(large)
    return done.select(F.col("l").alias(left), F.col("r").alias(right), F.col("z").alias("confidence"))


def components(edges: DataFrame) -> DataFrame:
    """(r, part): the least r that an r is linked to over shared classes c, itself included."""
    edges = checkpoint(edges.distinct())
    label = edges.groupBy("r").agg(F.min("r").alias("part"))
    while True:
        near = edges.join(label, "r").groupBy("c").agg(F.min("part").alias("part"))
        near = edges.join(near, "c").groupBy("r").agg(F.min("part").alias("near"))
        # jump to the label of one's label
        far = label.select(F.col("r").alias("near"), F.col("part").alias("far"))
        new = label.join(near, "r").join(far, "near", "left").select("r", F.least("part", "near", "far").alias("part"), F.col("part").alias("old"))
        new = checkpoint(new)
        moved = new.where("part <> old").limit(1).count()
        label = new.select("r", "part")
        if not moved:
            return label


def _solver(alike_weight: float, rho: float, tolerance: float):  # noqa: ANN202
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Whole components, some 50,000 pairs at a time."""
        held, count = [], 0
        for b in it:
            if not b.num_rows:
                continue
            held.append(b)
            count += b.num_rows
            if count < 50_000:
                continue
            t = pa.Table.from_batches(held)
            part = t.column("part").to_numpy(zero_copy_only=False)
            other = np.flatnonzero(part != part[-1])
            if len(other):
                yield t.slice(0, int(other[-1]) + 1)
                rest = t.slice(int(other[-1]) + 1)
                held, count = rest.to_batches(), rest.num_rows
        if count:
            yield pa.Table.from_batches(held)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches(it):
            num = lambda c: t.column(c).to_numpy(zero_copy_only=False).astype(float)
            code = lambda x: pd.factorize(x)[0]
            keys = [t.column(c).to_pandas() for c in ("l", "k", "r")]
            known = keys[1].notna().to_numpy()
            cls = np.where(known, code(pd.MultiIndex.from_arrays([keys[0], keys[1].fillna("")])), -1)
            z = admm(num("p"), num("n"), code(keys[2]), cls, num("z"), alike_weight, rho, tolerance)
            z = pa.array(z)
            cols = [pa.concat_arrays(t.column(c).chunks) if t.column(c).num_chunks != 1 else t.column(c).chunk(0) for c in ("l", "r")]
            yield pa.RecordBatch.from_arrays([*cols, z], names=["l", "r", "z"])

    return run


def admm(p: np.ndarray, n: np.ndarray, right: np.ndarray, cls: np.ndarray, z: np.ndarray, alike_weight: float, rho: float, tolerance: float) -> np.ndarray:
    """The values that minimise the losses; right and cls number constraints and classes, -1 for no class."""
    size = np.bincount(right)
    own = np.where(cls >= 0, cls, cls.max(initial=-1) + 1)
    members = np.bincount(own)[own]
    shrink = rho / (rho + 2 * alike_weight * members)
    ua, ub, uc = np.zeros_like(z), np.zeros_like(z), np.zeros_like(z)
    while True:
        a = (2 * p + rho * (z - ua)) / (2 * p + 2 * n + rho)
        vb, vc = z - ub, z - uc
        b = vb - np.maximum(0.0, (np.bincount(right, vb) - 1) / size)[right]
        mean = (np.bincount(own, vc) / np.maximum(np.bincount(own), 1))[own]
        c = np.where(cls >= 0, mean + (vc - mean) * shrink, vc)
        new = np.clip((a + ua + b + ub + c + uc) / 3, 0.0, 1.0)
        ua, ub, uc = ua + a - new, ub + b - new, uc + c - new
        moved, z = np.abs(new - z).max(initial=0.0), new
        if moved <= tolerance:
            return z


def _spread(live: DataFrame, alike_weight: float, rho: float, tolerance: float, every: int = 5) -> DataFrame:
    """The same steps as joins and aggregates, for components too large for a task."""
    live = checkpoint(live.select("*", *[F.lit(0.0).alias(f"u{i}") for i in "abc"], F.lit(1.0).alias("moved")))
    i = 0
    while True:
        if i % every == 0:
            moved = live.agg(F.max("moved")).first()[0]
            if moved is None or moved <= tolerance:
                return live.select("l", "r", "z")
        i += 1
        v = live.withColumn("vb", F.col("z") - F.col("ub")).withColumn("vc", F.col("z") - F.col("uc"))
        sums = v.groupBy("r").agg(F.sum("vb").alias("sb"), F.count(F.lit(1)).alias("mb"))
        means = v.where("k is not null").groupBy("l", "k").agg(F.avg("vc").alias("mc"))
        v = v.join(sums, "r").join(means, ["l", "k"], "left")
        # transitivity shrinks a class's values towards their mean
        shrink = F.lit(rho) / (F.lit(rho) + 2 * F.lit(alike_weight) * F.col("nk"))
        v = (
            v.withColumn("a", (2 * F.col("p") + rho * (F.col("z") - F.col("ua"))) / (2 * F.col("p") + 2 * F.col("n") + rho))
            .withColumn("b", F.col("vb") - F.greatest(F.lit(0.0), (F.col("sb") - 1) / F.col("mb")))
            .withColumn("c", F.when(F.col("k").isNotNull(), F.col("mc") + (F.col("vc") - F.col("mc")) * shrink).otherwise(F.col("vc")))
        )
        z = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("a") + F.col("ua") + F.col("b") + F.col("ub") + F.col("c") + F.col("uc")) / 3))
        v = v.withColumn("z2", z)
        live = checkpoint(v.select("l", "r", "p", "n", "nk", "k", F.col("z2").alias("z"), *[(F.col(f"u{c}") + F.col(c) - F.col("z2")).alias(f"u{c}") for c in "abc"], F.abs(F.col("z2") - F.col("z")).alias("moved")))
