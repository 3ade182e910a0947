"""Standard scaling per channel, fitted per run on its seed set only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odorframe.session import small_side


def fit_scaler(seqs: DataFrame, run: list[str]) -> DataFrame:
    """``run..., mean[], std[]`` over all points of a run; population std, 0 taken as 1.

    Points never leave their task: moments combine map-side per (run, channel).
    """
    cells = seqs.select(*run, F.posexplode("x").alias("__c", "__v")).select(
        *run, "__c", F.explode("__v").alias("__v")
    )
    std = F.stddev_pop("__v")
    per = cells.groupBy(*run, "__c").agg(
        F.avg("__v").alias("__m"), F.when(std == 0, F.lit(1.0)).otherwise(std).alias("__s")
    )
    ordered = F.array_sort(F.collect_list(F.struct("__c", "__m", "__s"))).alias("__a")
    return (
        per.groupBy(*run).agg(ordered).select(*run, F.col("__a.__m").alias("mean"), F.col("__a.__s").alias("std"))
    )


def apply_scaler(seqs: DataFrame, scaler: DataFrame, run: list[str]) -> DataFrame:
    """Scales ``x`` with the scaler of its run, two values per run and channel."""
    scaled = F.transform(
        F.col("x"),
        lambda c, i: F.transform(c, lambda v: (v - F.get(F.col("mean"), i)) / F.get(F.col("std"), i)),
    )
    channels = scaler.select(F.size("mean")).first()
    return seqs.join(small_side(scaler, 2 * channels[0] if channels else 1), run).withColumn("x", scaled).drop("mean", "std")
