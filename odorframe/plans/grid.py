"""The experiment plan as a table: one row per run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odorframe.plans.ledger import KEY

# Run settings, methods with the smallest seed size they are run at, models.
METHOD_MIN_SEEDS = {
    "Jittering": 1,
    "Scaling": 1,
    "Magnitude_Warping": 1,
    "Time_Warping": 1,
    "SMOTE": 3,
    "ADASYN": 10,
    "Mixup": 3,
    "GMM": 3,
    "HMM_GMM": 3,
    "TimeVAE": 11,
}
ARCHIVED_MIN_SEEDS = {
    "Jittering": 1,
    "Scaling": 1,
    "Permutation": 1,
    "Magnitude_Warping": 1,
    "Time_Warping": 1,
    "Window_Slicing": 1,
    "SMOTE": 5,
    "ADASYN": 5,
    "Mixup": 1,
    "CTGAN": 11,
    "VAE": 11,
}
MODELS = ("KNN", "RandomForest", "LinearSVC", "LogisticRegression", "RNN")
BASELINES = ("Baseline", "Tuned_Baseline")


@dataclass(frozen=True)
class GridSpec:
    folds: int = 10
    selections: int = 10
    seed_sizes: tuple[int, ...] = (1, 2, 5, 10, 20)
    scales: tuple[int, ...] = (2, 3, 5, 10)
    min_seeds: tuple[tuple[str, int], ...] = tuple(METHOD_MIN_SEEDS.items())
    models: tuple[str, ...] = MODELS


CURRENT = GridSpec()
ARCHIVED = GridSpec(
    selections=1,
    seed_sizes=(1, 3, 5, 7, 10, 15, 18, 20),
    scales=(2, 5, 10, 20),
    min_seeds=tuple(ARCHIVED_MIN_SEEDS.items()),
)
SCENARIOS = {
    "short": GridSpec(),
    "full": GridSpec(seed_sizes=tuple(range(1, 21)), scales=tuple(range(2, 11))),
}


def gate(spec: GridSpec = CURRENT) -> Column:
    """ARRAY of (method, min_seeds): a method runs where ``SeedsPerLabel >= min_seeds``."""
    return F.array(
        *[F.struct(F.lit(m).alias("Method"), F.lit(n).alias("min_seeds")) for m, n in spec.min_seeds]
    )


def experiment_grid(datasets: DataFrame, spec: GridSpec = CURRENT) -> DataFrame:
    """All runs for the ``Dataset`` values of ``datasets``.

    The dimensions are literal lists, exploded on the way through one scan: no join, no shuffle
    beyond the distinct of the dataset names.
    """
    base = (
        datasets.select("Dataset").distinct()
        .withColumn("Fold", F.explode(F.sequence(F.lit(1), F.lit(spec.folds))))
        .withColumn("SeedsPerLabel", F.explode(F.lit(list(spec.seed_sizes))))
        .withColumn("SeedFoldSelection", F.explode(F.sequence(F.lit(1), F.lit(spec.selections))))
    )
    plain = F.array(
        *[F.struct(F.lit(1).alias("ScaleFactor"), F.lit(b).alias("Method")) for b in BASELINES]
    )
    allowed = F.filter(gate(spec), lambda g: F.col("SeedsPerLabel") >= g["min_seeds"])
    augmented = F.flatten(
        F.transform(
            allowed,
            lambda g: F.transform(
                F.lit(list(spec.scales)),
                lambda s: F.struct(s.alias("ScaleFactor"), g["Method"].alias("Method")),
            ),
        )
    )
    return (
        base.withColumn("__r", F.explode(F.concat(plain, augmented)))
        .withColumn("Model", F.explode(F.lit(list(spec.models))))
        .select(*KEY[:4], "__r.ScaleFactor", "Model", "__r.Method")
    )


def subset(
    grid: DataFrame,
    datasets: list[str] | None = None,
    folds: list[int] | None = None,
    seed_sizes: list[int] | None = None,
    selections: int | None = None,
) -> DataFrame:
    """The runs asked for on a command line; ``None`` means all."""
    for column, wanted in (("Dataset", datasets), ("Fold", folds), ("SeedsPerLabel", seed_sizes)):
        if wanted is not None:
            grid = grid.filter(F.col(column).isin(wanted))
    return grid if selections is None else grid.filter(F.col("SeedFoldSelection") <= selections)


def done_keys(ledger: DataFrame) -> DataFrame:
    return ledger.select(*KEY).distinct()


def pending(grid: DataFrame, ledger: DataFrame) -> DataFrame:
    """Runs the ledger has no row for."""
    return grid.join(done_keys(ledger), KEY, "left_anti")


def accounting(grid: DataFrame, ledger: DataFrame, by: list[str]) -> DataFrame:
    """Runs planned, done and pending per ``by`` columns."""
    marked = grid.join(done_keys(ledger).withColumn("__d", F.lit(1)), KEY, "left")
    return marked.groupBy(*by).agg(
        F.count("*").alias("planned"),
        F.count("__d").alias("done"),
        (F.count("*") - F.count("__d")).alias("pending"),
    )
