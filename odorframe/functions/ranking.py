"""Row numbers in hash order that no single task has to compute for a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(
    df: DataFrame,
    hash_col: Column,
    tie: str,
    partition: list[str] = (),
    prefix: list[str] = (),
    name: str = "rank",
    digits: int = 3,
) -> DataFrame:
    """``row_number() over (partition by partition order by prefix, hash, tie)``.

    The hash is a uniform hex string, so its leading digits cut every group into
    16**digits even slices in the same order as the full hash. A row's number is
    the count of the earlier slices plus its number inside its own slice: the
    sort runs per slice, and only the slice counts (map-side combined) are
    summed per group. A group holding a third of all rows is spread like the rest.
    """
    group = [*partition, *prefix]
    keys = [*group, "__slice"]
    h = df.withColumn("__hash", hash_col).withColumn("__slice", F.substring("__hash", 1, digits))
    counts = h.groupBy(*keys).agg(F.count("*").alias("__n"))
    slices = counts.select(*keys, _sum_before("__n", group, ["__slice"]).alias("__before"))
    if prefix:
        # Offsets of the prefix groups: one row per group, e.g. per label.
        totals = counts.groupBy(*group).agg(F.sum("__n").alias("__n"))
        offsets = totals.select(*group, _sum_before("__n", list(partition), list(prefix)).alias("__offset"))
        slices = slices.join(offsets, group).withColumn("__before", F.col("__before") + F.col("__offset"))
        slices = slices.drop("__offset")
    inside = Window.partitionBy(*keys).orderBy("__hash", tie)
    return (
        h.withColumn("__in", F.row_number().over(inside))
        .join(slices, keys)
        .withColumn(name, (F.col("__before") + F.col("__in")).cast("bigint"))
        .drop("__hash", "__slice", "__in", "__before")
    )


def _sum_before(column: str, partition: list[str], order: list[str]) -> Column:
    w = Window.partitionBy(*(partition or [F.lit(0)])).orderBy(*order)
    return F.coalesce(F.sum(column).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
