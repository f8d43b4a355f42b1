"""Scoring an ensemble: mean, spread, mean score and confidence of each request; error metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillcast.functions.values import clamp

MISSING_SCORE = 0.8


def combine(predictions: DataFrame, request: str, scores: DataFrame | None = None, *more: Column) -> DataFrame:
    """From (request, model, prediction) and (model, score), or from predictions with their own `score`: prediction, spread, mean_score, confidence, n_models per request, and `more` aggregates.

    A model without a score counts as 0.8. confidence = (0.7 * mean score + 0.3 * agreement) * 100 within 60 and
    99; agreement = 1 - min(spread / mean, 0.3), or 0.85 if the mean isn't positive."""
    if scores is not None:
        # A row for each model: by a shuffle each model's predictions would meet in one task.
        predictions = predictions.join(F.broadcast(scores.select("model", "score")), "model", "left")
    elif "score" not in predictions.columns:
        predictions = predictions.withColumn("score", F.lit(None).cast("double"))
    return with_confidence(predictions.groupBy(request).agg(
        F.avg("prediction").alias("prediction"), F.stddev_pop("prediction").alias("spread"),
        F.avg(F.coalesce("score", F.lit(MISSING_SCORE))).alias("mean_score"), F.count("*").alias("n_models"), *more,
    ))


def with_confidence(df: DataFrame) -> DataFrame:
    agreement = F.when(F.col("prediction") > 0, 1 - F.least(F.col("spread") / F.col("prediction"), F.lit(0.3))).otherwise(0.85)
    return df.withColumn("confidence", clamp((0.7 * F.col("mean_score") + 0.3 * agreement) * 100, 60.0, 99.0))


def mae(y: str, p: str) -> Column:
    return F.avg(F.abs(F.col(y) - F.col(p)))


def r2(y: str, p: str) -> Column:
    """1 - residual / total sum of squares, in one pass; null where y doesn't vary."""
    return 1 - F.sum((F.col(y) - F.col(p)) ** 2) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))
