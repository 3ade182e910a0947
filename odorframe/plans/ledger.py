"""Analytics on the results ledger: how much augmentation helps.

Every aggregate combines map-side before its shuffle, and group flags are joined
instead of windowed, so one group holding most of the ledger does not end in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ledger column names and method names.
KEY = ["Dataset", "Fold", "SeedsPerLabel", "SeedFoldSelection", "ScaleFactor", "Model", "Method"]
NOT_GROUPED = ["SeedFoldSelection", "Accuracy", "F1_Score", "ExecutionTime_Sec", "Hyperparameters"]
BASELINE, TUNED = "Baseline", "Tuned_Baseline"
GROUP = ["Dataset", "Model", "SeedsPerLabel"]


def union_ledgers(*ledgers: DataFrame) -> DataFrame:
    """One ledger from many; columns an older ledger lacks become NULL."""
    out = ledgers[0]
    for df in ledgers[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def dedup(ledger: DataFrame, order: Column, key: list[str] | None = None) -> DataFrame:
    """The latest row per natural key, by ``order``.

    ``max_by`` keeps one row per key already on the map side, which a window would not.
    """
    key = [c for c in (key or KEY) if c in ledger.columns]
    rest = [c for c in ledger.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(order, *rest)).alias("__r")
    return ledger.groupBy(*key).agg(best).select(*key, "__r.*").select(*ledger.columns)


def average_selections(ledger: DataFrame) -> DataFrame:
    """Means over the seed selections; unchanged when the ledger has no selections.

    Rows with a NULL key column are left out. ``Hyperparameters`` is the smallest
    string of the group.
    """
    if "SeedFoldSelection" not in ledger.columns:
        return ledger
    keys = [c for c in ledger.columns if c not in NOT_GROUPED]
    return (
        ledger.dropna(subset=keys)
        .groupBy(*keys)
        .agg(
            F.avg("Accuracy").alias("Accuracy"),
            F.avg("F1_Score").alias("F1_Score"),
            F.avg("ExecutionTime_Sec").alias("ExecutionTime_Sec"),
            F.min(F.col("Hyperparameters").cast("string")).alias("Hyperparameters"),
        )
    )


def is_baseline() -> Column:
    return F.col("Method").isin(BASELINE, TUNED)


def baselines(ledger: DataFrame) -> DataFrame:
    return ledger.filter(is_baseline())


def generated(ledger: DataFrame) -> DataFrame:
    return ledger.filter(~is_baseline())


def baseline_means(ledger: DataFrame) -> DataFrame:
    """Mean baseline accuracy by dataset, model, seed size and method."""
    return baselines(ledger).groupBy(*GROUP, "Method").agg(F.avg("Accuracy").alias("Accuracy"))


def prefer_tuned(base: DataFrame, group: list[str]) -> DataFrame:
    """All tuned rows of a group that has any, else its plain baseline rows."""
    has_tuned = base.groupBy(*group).agg(F.max(F.col("Method") == TUNED).alias("__tuned"))
    return (
        base.filter(is_baseline())
        .join(has_tuned, group)
        .filter(F.col("__tuned") == (F.col("Method") == TUNED))
        .select(*base.columns)
    )


def best_baseline(ledger: DataFrame) -> DataFrame:
    """Baseline accuracy per dataset, model and seed size, tuned where available."""
    return prefer_tuned(baseline_means(ledger), GROUP)


def overall_baseline(ledger: DataFrame) -> DataFrame:
    """Mean of the dataset means by model and seed size."""
    return best_baseline(ledger).groupBy("Model", "SeedsPerLabel").agg(F.avg("Accuracy").alias("Accuracy"))


def dataset_tables(ledger: DataFrame) -> DataFrame:
    """The per-dataset baseline tables as one frame, ordered by dataset, model and seed size."""
    return best_baseline(ledger).orderBy("Dataset", "Model", "SeedsPerLabel")


def accuracy_change(ledger: DataFrame) -> DataFrame:
    """Generated rows with the change against the baseline of their fold.

    Generated rows without a baseline drop out.
    """
    by_fold = [*GROUP, "Fold"]
    base = prefer_tuned(baselines(ledger), by_fold).select(
        *by_fold, F.col("Accuracy").alias("Baseline_Accuracy")
    )
    return generated(ledger).join(base, by_fold).withColumn(
        "Accuracy_Change", F.col("Accuracy") - F.col("Baseline_Accuracy")
    )


def change_table(ledger: DataFrame, methods: list[str]) -> DataFrame:
    """Mean accuracy change, one row per model and one column per method."""
    return accuracy_change(ledger).groupBy("Model").pivot("Method", methods).agg(F.avg("Accuracy_Change"))


def anchor_rows(ledger: DataFrame) -> DataFrame:
    """The scale-1 rows: tuned baselines if the ledger has any at all, else plain ones."""
    any_tuned = ledger.agg(F.max(F.col("Method") == TUNED).alias("t"))
    wanted = F.when(any_tuned.scalar(), F.lit(TUNED)).otherwise(F.lit(BASELINE))
    return (
        baselines(ledger).withColumn("__w", wanted).filter(F.col("Method") == F.col("__w"))
        .withColumn("ScaleFactor", F.lit(1)).drop("__w")
    )


def _per_method(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """``rows`` once for every generated method of the ledger."""
    methods = generated(ledger).agg(F.array_sort(F.collect_set("Method")).alias("m"))
    return (
        rows.withColumn("__m", methods.scalar())
        .withColumn("Method", F.explode("__m"))
        .drop("__m")
    )


def scale_one_anchor(ledger: DataFrame) -> DataFrame:
    """The scale-1 rows attached to every generated method."""
    return _per_method(anchor_rows(ledger), ledger).select(*ledger.columns)


def scaling_curve(ledger: DataFrame) -> DataFrame:
    """Mean accuracy by model, method, seed size and scale, starting at scale 1.

    The anchor is summed before it is attached to the methods, so a few hundred
    sums are replicated instead of ledger rows.
    """
    grain = ["Model", "SeedsPerLabel", "ScaleFactor"]
    sums = [F.sum("Accuracy").alias("s"), F.count("Accuracy").alias("n")]
    start = _per_method(anchor_rows(ledger).groupBy(*grain).agg(*sums), ledger)
    rest = generated(ledger).groupBy(*grain, "Method").agg(*sums)
    return (
        start.unionByName(rest)
        .groupBy("Model", "Method", "SeedsPerLabel", "ScaleFactor")
        .agg((F.sum("s") / F.sum("n")).alias("Accuracy"))
    )


def series_by_method(ledger: DataFrame) -> DataFrame:
    """Curves over the scale: panel (model, seed size), one series per method."""
    return scaling_curve(ledger).select(
        F.col("Model").alias("panel_model"),
        F.col("SeedsPerLabel").alias("panel_seeds"),
        F.col("Method").alias("series"),
        F.col("ScaleFactor").alias("scale"),
        F.col("Accuracy").alias("accuracy"),
    ).orderBy("panel_model", "panel_seeds", "series", "scale")


def series_by_seed_size(ledger: DataFrame) -> DataFrame:
    """Curves over the scale: panel (model, method), one series per seed size.

    The series name is a string; ``series_order`` keeps the numeric order.
    """
    return scaling_curve(ledger).select(
        F.col("Model").alias("panel_model"),
        F.col("Method").alias("panel_method"),
        F.col("SeedsPerLabel").cast("string").alias("series"),
        F.col("SeedsPerLabel").alias("series_order"),
        F.col("ScaleFactor").alias("scale"),
        F.col("Accuracy").alias("accuracy"),
    ).orderBy("panel_model", "panel_method", "series_order", "scale")


def headline(ledger: DataFrame, seeds: int = 20, scale: int = 10) -> DataFrame:
    """Mean accuracy by method and model at one seed size and scale."""
    return (
        ledger.filter((F.col("SeedsPerLabel") == seeds) & (F.col("ScaleFactor") == scale))
        .groupBy("Method", "Model")
        .agg(F.avg("Accuracy").alias("Accuracy"))
    )


def distinct_sets(ledger: DataFrame) -> DataFrame:
    """Datasets, models, seed sizes and generated methods in long form, with their order."""
    tagged = F.array(
        F.struct(F.lit("dataset").alias("kind"), F.col("Dataset").alias("value"), F.lit(0).alias("rank")),
        F.struct(F.lit("model").alias("kind"), F.col("Model").alias("value"), F.lit(0).alias("rank")),
        F.struct(
            F.lit("seed_size").alias("kind"),
            F.col("SeedsPerLabel").cast("string").alias("value"),
            F.col("SeedsPerLabel").alias("rank"),
        ),
        F.struct(
            F.lit("method").alias("kind"),
            F.when(~is_baseline(), F.col("Method")).alias("value"),
            F.lit(0).alias("rank"),
        ),
    )
    return (
        ledger.select("Dataset", "Model", "SeedsPerLabel", "Method").distinct()
        .select(F.inline(tagged))
        .filter(F.col("value").isNotNull())
        .distinct()
        .orderBy("kind", "rank", "value")
    )
