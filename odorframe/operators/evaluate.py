"""Scores of many runs in one job."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(predictions: DataFrame, run: list[str]) -> DataFrame:
    """``run..., label, prediction, n``; everything below works on these counts."""
    return predictions.groupBy(*run, "label", "prediction").agg(F.count("*").alias("n"))


def scores(predictions: DataFrame, run: list[str]) -> DataFrame:
    """``run..., n_test, accuracy, f1``: accuracy and support-weighted F1.

    F1 of a label is 0 where undefined. A predicted label without support has weight 0.
    """
    cells = confusion(predictions, run)
    true = F.struct(F.col("label").alias("l"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"))
    pred = F.struct(F.col("prediction").alias("l"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"))
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0).cast("bigint"))
    per_label = (
        cells.withColumn("__hit", hit)
        .withColumn("__e", F.explode(F.array(true, pred)))
        .groupBy(*run, F.col("__e.l").alias("l"))
        .agg(
            F.sum("__e.support").alias("support"),
            F.sum("__e.predicted").alias("predicted"),
            F.sum(F.when(F.col("__e.support") > 0, F.col("__hit")).otherwise(0)).alias("tp"),
        )
    )
    f1 = F.coalesce(2.0 * F.col("tp") / F.nullif(F.col("support") + F.col("predicted"), F.lit(0)), F.lit(0.0))
    return per_label.groupBy(*run).agg(
        F.sum("support").alias("n_test"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1"),
    )


def timed(action: Callable[[], Any]) -> tuple[Any, float]:
    """Result and wall-clock seconds of an action."""
    start = time.perf_counter()
    result = action()
    return result, time.perf_counter() - start
