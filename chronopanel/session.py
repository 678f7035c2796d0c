"""Session helpers: building a local session, reading tables, reliable checkpoints."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "chronopanel", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CHRONOPANEL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data directory (a file or a directory of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of df with a copy in the folder all executors share."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir, or its checkpoint directory.

    Only on a local master, where all is one machine, is one made if neither is
    set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    have = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if have:
        return have
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="chronopanel-")
