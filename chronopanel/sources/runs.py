"""The store of runs: run rows, long metrics, coverage, predictions and logs as tables of a folder, and reports."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Sequence
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.operators import upsert


@dataclass(frozen=True)
class Config:
    """Settings of a study; what a file does not name keeps its default, an unknown name is an error."""

    price_start: str = "2015-01-01"
    price_end: str = "2023-12-31"
    indices: tuple[str, ...] = ("SP500",)
    min_price: float = 5.0
    min_dollar_volume: float = 1e6
    min_days: int = 252
    lookback: int = 252
    size: int = 20
    seeds: int = 200
    frequency: str = "monthly"
    costs: dict[str, float] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Config:
        """From a TOML file."""
        with open(path, "rb") as f:
            got = tomllib.load(f)
        known = {f.name for f in fields(cls)}
        if extra := set(got) - known:
            raise ValueError(f"unknown settings: {sorted(extra)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in got.items()})

    def to_json(self) -> str:
        """Sorted by key, so that equal settings are equal texts."""
        return json.dumps({f.name: getattr(self, f.name) for f in fields(self)}, sort_keys=True, default=str)


class RunStore:
    """Tables `runs`, `metrics`, `coverage`, `predictions` and `log` under one folder.

    Writers append; readers resolve repeats: of a run or prediction key written
    again the latest counts, by the number of the write.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _append(self, df: DataFrame, name: str, write: int) -> None:
        df.withColumn("_write", F.lit(write).cast("long")).write.mode("append").parquet(f"{self.folder}/{name}")

    def _read(self, name: str, keys: Sequence[str]) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}")
        return upsert.latest_per_key(df, list(keys), ["_write"]).drop("_write")

    def save_run(self, run: DataFrame, metrics: DataFrame, annual: DataFrame | None = None, coverage: DataFrame | None = None, config: Config = Config(), write: int = 0) -> None:
        """Run rows with their configuration; metrics (run_id, metric_name, value) long, annual returns as rows with a period."""
        self._append(run.withColumn("config", F.lit(config.to_json())), "runs", write)
        long = metrics.select("run_id", "metric_name", F.lit(None).cast("string").alias("period"), F.col("value").cast("double").alias("value"))
        if annual is not None:
            long = long.unionByName(annual.select("run_id", F.lit("annual_return").alias("metric_name"), F.col("year").cast("string").alias("period"), F.col("annual_return").cast("double").alias("value")))
        self._append(long, "metrics", write)
        if coverage is not None:
            self._append(coverage, "coverage", write)

    def load_results(self, run_id: str | None = None) -> DataFrame:
        """Metrics of one run or all, by run, metric and period."""
        m = self._read("metrics", ["run_id", "metric_name", "period"])
        return (m if run_id is None else m.where(F.col("run_id") == run_id)).orderBy("run_id", "metric_name", "period")

    def save_predictions(self, df: DataFrame, write: int) -> None:
        """Predictions of (model, as_of, security_id); a key saved again is replaced."""
        self._append(df.select("model", "as_of", "security_id", "score"), "predictions", write)

    def load_predictions(self) -> DataFrame:
        return self._read("predictions", ["model", "as_of", "security_id"])

    def log(self, df: DataFrame, write: int) -> None:
        """Counts of a load or an experiment, one row each."""
        self._append(df, "log", write)

    def read_log(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/log").drop("_write")


def report_json(df: DataFrame, path: str) -> None:
    """A table as JSON lines, written by the executors."""
    df.write.mode("overwrite").json(path)


def report_markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A report's table in Markdown: the first rows of what is small by nature; more than `most` is an error, not a cut."""
    rows: list[Any] = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]) + "\n"
