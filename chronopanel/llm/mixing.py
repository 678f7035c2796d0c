"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.session import checkpoint


def mix_sources(docs: DataFrame, targets: DataFrame, *, doc: str, source: str, size: str, mix: str, share: str, repeats: str, rows_per_bucket: int = 20_000, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """Documents of each mix in queue order, and the shares really reached.

    docs: one row per document with its source and size. targets: for each mix
    and source a target share and the most times a document may be used. The
    budget of a mix is the largest total at which every source that has
    documents still meets its share within its repeats; shares of sources
    without documents are spread over the others in proportion.

    A source's documents are shuffled by hash and queued, pass after pass; a
    document's virtual finish time is the source's tokens up to its end divided
    by the weight. The queues are merged by finish time and cut at the budget,
    so every prefix of a mix has the target shares to within a document a
    source. Cumulative sums are taken per bucket of the hash, respectively of
    the finish time, plus the sums of the buckets before. There are as many
    buckets as the rows need, so that one holds about `rows_per_bucket` rows of
    all sources together, however many there are. The picks are range-sorted by
    mix and place in the queue.

    Returns (picks, shares): picks has the mix, doc, source, copy (from 1),
    size, finish and upto (the mix's tokens up to and with this copy); shares
    has, for every target, docs, tokens, target_share, reached_share, most_copies
    and budget; a source without documents has 0 tokens.

    Documents with null or non-positive size or null source are in no mix; a
    source absent from the targets neither; repeated ids are documents of their
    own; empty tables give empty picks.
    """
    have = docs.select(F.col(doc).alias("doc"), F.col(source).alias("source"), F.col(size).cast("long").alias("size")).where("size > 0 and source is not null")
    goal = targets.select(F.col(mix).alias("mix"), F.col(source).alias("source"), F.col(share).cast("double").alias("share"), F.col(repeats).cast("int").alias("reps"))
    h = F.xxhash64("doc", F.lit(seed))
    queue = checkpoint(have.select("*", h.alias("h")))
    n_docs = queue.count()
    queue = queue.withColumn("b", F.pmod("h", F.lit(max(1, -(-n_docs // rows_per_bucket)))).cast("int"))
    sums = queue.groupBy("source", "b").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("k"))
    start = sums.select("source", "b", (F.sum("n").over(Window.partitionBy("source").orderBy("b")) - F.col("n")).alias("start"))
    totals = sums.groupBy("source").agg(F.sum("n").alias("total"), F.sum("k").alias("docs"))

    plan = goal.join(totals, "source", "left").withColumn("weight", F.when((F.col("total") > 0) & (F.col("share") > 0) & (F.col("reps") > 0), F.col("share")))
    every = Window.partitionBy("mix")
    plan = plan.withColumn("weight", F.col("weight") / F.sum("weight").over(every))
    plan = checkpoint(plan.withColumn("budget", F.min(F.col("reps") * F.col("total") / F.col("weight")).over(every)))

    own = Window.partitionBy("source", "b").orderBy("h", "doc", "size")
    line = queue.withColumn("cum", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    line = line.join(start, ["source", "b"]).select("doc", "source", "size", "h", (F.col("cum") + F.col("start")).alias("cum"))
    copies = line.join(plan.where("weight is not null").select("mix", "source", "weight", "reps", "total", "budget"), "source")
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("reps")))).withColumn("finish", (F.col("cum") + (F.col("copy") - 1) * F.col("total")) / F.col("weight"))
    # Nothing that ends after the budget can be in; this keeps the merge small.
    # The tolerance is for the division; a source that is used up ends on the budget.
    # Finish times of a source are even, so buckets of equal time hold about equally many rows.
    most = max(1, -(-n_docs * (plan.agg(F.max("reps")).first()[0] or 1) // rows_per_bucket))
    copies = copies.where(F.col("finish") <= F.col("budget") * (1 + 1e-12)).withColumn("fb", F.least(F.lit(most - 1), F.floor(F.col("finish") / F.col("budget") * most)).cast("int"))
    # The same rows are summed by bucket and then ordered within buckets.
    copies = checkpoint(copies.select("mix", "doc", "source", "copy", "size", "finish", "fb", "budget", "h"))
    heads = copies.groupBy("mix", "fb").agg(F.sum("size").alias("n"))
    heads = heads.select("mix", "fb", (F.sum("n").over(Window.partitionBy("mix").orderBy("fb")) - F.col("n")).alias("start"))
    merge = Window.partitionBy("mix", "fb").orderBy("finish", "source", "h", "doc", "copy")
    picks = copies.withColumn("cum", F.sum("size").over(merge.rowsBetween(Window.unboundedPreceding, 0))).join(heads, ["mix", "fb"]).withColumn("upto", F.col("cum") + F.col("start")).where(F.col("upto") <= F.col("budget") * (1 + 1e-12))
    got = picks.groupBy("mix", "source").agg(F.sum("size").alias("tokens"), F.countDistinct("doc").alias("used"), F.max("copy").alias("most_copies"))
    shares = (
        plan.join(got, ["mix", "source"], "left")
        .withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("long")))
        .select(
            F.col("mix").alias(mix),
            F.col("source").alias(source),
            F.col("share").alias("target_share"),
            F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(every)), F.lit(0.0)).alias("reached_share"),
            "tokens",
            F.coalesce("used", F.lit(0).cast("long")).alias("documents"),
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
            F.coalesce("budget", F.lit(0.0)).alias("budget"),
        )
    )
    picks = picks.orderBy("mix", "upto", "doc", "copy")
    return picks.select(F.col("mix").alias(mix), F.col("doc").alias(doc), F.col("source").alias(source), "copy", F.col("size").alias(size), "finish", "upto"), shares
