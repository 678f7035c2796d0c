"""Linear and logistic models on panels, with rank-correlation evaluation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.operators.crosssection import rank_correlation

FitFunc = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def standardizer(train: DataFrame, features: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Centre and scale by the training rows' mean and population deviation (1 where it is 0)."""
    r = train.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    params = {f: (r[f"m_{f}"] or 0.0, r[f"s_{f}"] or 1.0) for f in features}
    return lambda df: df.select("*", *[((F.col(f) - params[f][0]) / params[f][1]).alias(f"z_{f}") for f in features])


def _assembled(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=[f"z_{f}" for f in features], outputCol="_x")


def fit_linear(features: Sequence[str], label: str, alpha: float, l1_ratio: float | None = None) -> FitFunc:
    """Ridge (l1_ratio None: penalty alpha on the sum of squares) or elastic net (on the mean), on standardized features.

    The engine scales the label by its population deviation s inside, so the
    squared penalty is multiplied by s to mean the same. The normal solver makes
    one pass over the rows; the penalties are then met on their cross products.
    """

    def fit(train: DataFrame) -> Callable[[DataFrame], DataFrame]:
        scale = standardizer(train, features)
        s, n = train.agg(F.stddev_pop(label), F.count(F.lit(1))).first()
        s = s or 1.0
        if l1_ratio is None:
            reg, mix = alpha * s / n, 0.0
        else:
            reg = alpha * (l1_ratio + s * (1 - l1_ratio))
            mix = alpha * l1_ratio / reg if reg else 0.0
        lr = LinearRegression(featuresCol="_x", labelCol=label, predictionCol="score", regParam=reg, elasticNetParam=mix, standardization=False, solver="normal", tol=1e-10, maxIter=500)
        model = lr.fit(_assembled(features).transform(scale(train)))
        return lambda df: model.transform(_assembled(features).transform(scale(df))).drop("_x", *[f"z_{f}" for f in features])

    return fit


def fit_logistic(features: Sequence[str], label: str, c: float = 1.0) -> FitFunc:
    """Logistic regression with penalty 1 / c; the score is the probability less a half."""

    def fit(train: DataFrame) -> Callable[[DataFrame], DataFrame]:
        scale = standardizer(train, features)
        n = train.count()
        model = LogisticRegression(featuresCol="_x", labelCol=label, regParam=1 / (c * n), standardization=False, tol=1e-10, maxIter=500).fit(_assembled(features).transform(scale(train)))

        def predict(df: DataFrame) -> DataFrame:
            p = model.transform(_assembled(features).transform(scale(df)))
            return p.withColumn("score", vector_to_array("probability")[1] - 0.5).drop("_x", "rawPrediction", "probability", "prediction", *[f"z_{f}" for f in features])

        return predict

    return fit


def evaluate(scored: DataFrame, by: str, score: str, label: str, least: int = 5) -> DataFrame:
    """Per-date rank correlations, then their mean, median, deviation; hit rate over all dates kept."""
    per = rank_correlation(scored, [by], score, label, least)
    return per.agg(F.avg("ic").alias("mean_ic"), F.median("ic").alias("median_ic"), F.stddev_samp("ic").alias("sd_ic"), F.avg("hit_rate").alias("hit_rate"), F.count(F.lit(1)).alias("dates"))
