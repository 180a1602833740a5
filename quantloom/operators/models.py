"""Fitted models on MLlib, and strategies by name. Not equivalent to the boosting packages they stand in for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators.frames import linear_score, ridge_weights, select_turnover
from quantloom.plans.registry import Registry

MODELS, STRATEGIES = Registry(), Registry()


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    filled = Imputer(inputCols=features, outputCols=[f"_i_{f}" for f in features]).fit(df).transform(df)
    return VectorAssembler(inputCols=[f"_i_{f}" for f in features], outputCol="_v").transform(filled)


@MODELS.register("gbt")
def gbt(train: DataFrame, test: DataFrame, features: list[str], label: str, seed: int = 0, **params) -> DataFrame:
    """Gradient-boosted trees: test with a column score."""
    model = GBTRegressor(featuresCol="_v", labelCol=label, predictionCol="score", seed=seed, **params).fit(_assembled(train.where(F.col(label).isNotNull()), features))
    return model.transform(_assembled(test, features)).select(*test.columns, "score")


@MODELS.register("linear")
def linear(train: DataFrame, test: DataFrame, features: list[str], label: str, alpha: float = 1.0, clip: float | None = None) -> DataFrame:
    """Ridge weights as a weighted mean."""
    return linear_score(test, features, ridge_weights(train, features, label, alpha), clip)


@MODELS.register("elastic")
def elastic(train: DataFrame, test: DataFrame, features: list[str], label: str, **params) -> DataFrame:
    """Elastic-net regression."""
    model = LinearRegression(featuresCol="_v", labelCol=label, predictionCol="score", **params).fit(_assembled(train.where(F.col(label).isNotNull()), features))
    return model.transform(_assembled(test, features)).select(*test.columns, "score")


STRATEGIES.register("topk_turnover")(select_turnover)


def select_signals(strategy: str, scores: DataFrame | None, **params) -> DataFrame | None:
    """Positions by a strategy's name; nothing for no scores."""
    return None if scores is None else STRATEGIES.get(strategy)(scores, **params)


def rolling_fit(df: DataFrame, model: str | Callable[..., DataFrame], features: list[str], label: str, window: int, refit_days: int, day: str = "day_idx", **params) -> DataFrame:
    """Scores of consecutive days by a model of the window days before each refit: one fit and one scored slice by refit."""
    fit = MODELS.get(model) if isinstance(model, str) else model
    first, last = df.agg(F.min(day), F.max(day)).first()
    out = None
    for t in range(first + window, last + 1, refit_days):
        part = fit(df.where(F.col(day).between(t - window, t - 1)), df.where(F.col(day).between(t, t + refit_days - 1)), features, label, **params)
        out = part if out is None else out.unionByName(part)
    return df.limit(0).withColumn("score", F.lit(None).cast("double")) if out is None else out
