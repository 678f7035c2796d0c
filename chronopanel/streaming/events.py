"""Structured Streaming over an event table: windowed counts, de-duplication, keyed state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.session import shared_folder


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table of a directory as a file stream."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs a zoned time


def daily_counts(events: DataFrame, late: str | None = None) -> DataFrame:
    """Count and total per day and type; with `late`, days close that long after the newest event."""
    if late:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and give its result as a table in the shared folder.

    Every batch is written by the executors to a folder of its own, so a batch
    that is run again replaces what it wrote, and nothing passes the driver. In
    complete mode the last batch is the result; otherwise it is all of them,
    with the batch's number as `batch`.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out, last = f"{base}/out", []

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        last.append(batch)

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(0))
    got = spark.read.option("basePath", out).parquet(f"{out}/batch={max(last)}" if mode == "complete" else out)
    return got


def run_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    out = drain(daily_counts(event_stream(spark, d)), "complete")
    return out.select(F.col("window.start").cast("date").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def run_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Events without repeats of their id within the watermark, counted at the end."""
    once = event_stream(spark, d).withWatermark("ts", "30 days").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id")
    return drain(once, "append").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


def run_ordered_totals(spark: SparkSession, d: str) -> DataFrame:
    """Keyed state: count and total per user, carried over batches; the last state of each user."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    out = event_stream(spark, d).groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, total double", "n long, total double", "update", "NoTimeout")
    return drain(out, "update").groupBy("user_id").agg(F.max_by("total", "batch").alias("total"), F.max_by("n", "batch").alias("n")).select("user_id", "n", F.round("total", 4).alias("total"))
