"""Leak-free folds, nested seed subsets and row caps. Keys only: sequences are joined later."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odorframe.functions.draws import key_hash
from odorframe.functions.ranking import number_rows

ID, LABEL = "measurement_id", "label"


def measurements(df: DataFrame) -> DataFrame:
    """One row per measurement with its label."""
    return df.select(ID, LABEL)


def assign_folds(groups: DataFrame, k: int = 10, seed: int = 42, run: list[str] = ()) -> DataFrame:
    """Adds ``fold`` (1..k): stratified by label, whole measurements, shuffled by the seed.

    Measurements are dealt round robin in (label, hash) order, so label counts and
    fold sizes differ by at most one between folds. ``run`` columns split
    independently, e.g. for cross-validation inside each seed set.
    """
    h = key_hash(seed, "fold", *run, ID)
    ranked = number_rows(groups, h, tie=ID, partition=list(run), prefix=[LABEL])
    return ranked.withColumn("fold", ((F.col("rank") - 1) % k + 1).cast("int")).drop("rank")


def train_test(folds: DataFrame, k: int = 10) -> DataFrame:
    """Every measurement in every run: ``run_fold`` and ``part`` (test where its fold is held out)."""
    return folds.withColumn("run_fold", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumn(
        "part", F.when(F.col("fold") == F.col("run_fold"), "test").otherwise("train")
    )


def seed_sets(
    folds: DataFrame,
    sizes: tuple[int, ...] = (1, 2, 5, 10, 20),
    selections: int = 10,
    k: int = 10,
    seed: int = 42,
) -> DataFrame:
    """Nested seed subsets: ``run_fold, selection, n_seeds, label, measurement_id, n_available``.

    Within (run fold, selection, label) the training measurements are taken in
    hash order, so the set for 2 is part of the set for 5, and all are taken where
    fewer than asked for exist. A measurement that is not among the first max(sizes)
    of its own (selection, label, fold) cannot be chosen for any run fold; that first
    cut keeps a bounded number per group map-side, before runs multiply the rows.
    """
    top = max(sizes)
    chosen = folds.withColumn("selection", F.explode(F.sequence(F.lit(1), F.lit(selections)))).withColumn(
        "__h", key_hash(seed, "seeds", "selection", LABEL, ID)
    )
    own = Window.partitionBy("selection", LABEL, "fold").orderBy("__h", ID)
    first_cut = chosen.withColumn("__r", F.row_number().over(own)).filter(F.col("__r") <= top).drop("__r")
    runs = first_cut.withColumn("run_fold", F.explode(F.sequence(F.lit(1), F.lit(k)))).filter(
        F.col("run_fold") != F.col("fold")
    )
    order = Window.partitionBy("run_fold", "selection", LABEL).orderBy("__h", ID)
    ranked = runs.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= top)
    return (
        ranked.join(available(folds, k), ["run_fold", LABEL])
        .withColumn("n_seeds", F.explode(F.filter(F.lit(list(sizes)), lambda s: s >= F.col("__r"))))
        .select("run_fold", "selection", "n_seeds", LABEL, ID, "n_available")
    )


def available(folds: DataFrame, k: int = 10) -> DataFrame:
    """Training measurements per (run fold, label)."""
    counts = folds.groupBy(LABEL, "fold").agg(F.count("*").alias("__n"))
    return (
        counts.withColumn("run_fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
        .filter(F.col("run_fold") != F.col("fold"))
        .groupBy("run_fold", LABEL)
        .agg(F.sum("__n").alias("n_available"))
    )


def cap_rows(rows: DataFrame, key: list[str], cap: int = 100_000, seed: int = 42, run: list[str] = ()) -> DataFrame:
    """A random ``cap`` rows per run, all rows where a run has no more.

    The sample is the ``cap`` smallest key hashes, found through slice counts.
    """
    tagged = rows.withColumn("__tie", F.concat_ws("|", *[F.col(c).cast("string") for c in key]))
    ranked = number_rows(
        tagged, key_hash(seed, "cap", *run, *key), tie="__tie", partition=list(run), name="__rank"
    )
    return ranked.filter(F.col("__rank") <= cap).drop("__rank", "__tie")


def cv_folds(seeds: DataFrame, seed: int = 42) -> DataFrame:
    """Cross-validation folds inside each seed set: min(5, n) grouped folds, 2 for a single seed.

    With one measurement per label a grouped split would leave a label out of
    training; ``grouped`` is false there, and points are split instead of measurements.
    """
    run = ["run_fold", "selection", "n_seeds"]
    ranked = number_rows(
        seeds, key_hash(seed, "cv", *run, ID), tie=ID, partition=run, prefix=[LABEL], name="__r"
    )
    k = F.when(F.col("n_seeds") < 2, F.lit(2)).otherwise(F.least(F.lit(5), F.col("n_seeds")))
    return (
        ranked.withColumn("cv_k", k.cast("int"))
        .withColumn("cv_fold", ((F.col("__r") - 1) % F.col("cv_k") + 1).cast("int"))
        .withColumn("grouped", F.col("n_seeds") >= 2)
        .drop("__r")
    )
