"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.plans import asof_queries, backtest_queries, claims_queries, feature_queries, model_queries, more_queries, preparation, run_queries, source_queries, stats_queries, universe_queries

_PARTS = (preparation, asof_queries, feature_queries, claims_queries, universe_queries, stats_queries, backtest_queries, model_queries, source_queries, more_queries, run_queries)


def widened(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with integers as long and floats as double, as its SQL has them."""
    wide = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}

    @wraps(query)
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = query(spark, d)
        return df.select(*[F.col(f"`{c}`").cast(wide[t]).alias(c) if t in wide else F.col(f"`{c}`") for c, t in df.dtypes])

    return run


QUERIES = {k: widened(v) for m in _PARTS for k, v in m.QUERIES.items()}
SQL = {k: v for m in _PARTS for k, v in m.SQL.items()}
