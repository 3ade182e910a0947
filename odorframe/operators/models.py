"""Classifiers: neighbour vote as a join, the others as fits keyed by run."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odorframe.operators import fits
from odorframe.operators.neighbors import knn_join

# The parameter spaces searched per model.
C_GRID = [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]
SPACES: dict[str, list[dict[str, list]]] = {
    "KNN": [
        {
            "n_neighbors": list(range(3, 20)),
            "weights": ["uniform", "distance"],
            "metric": ["euclidean", "manhattan", "minkowski"],
        }
    ],
    "RandomForest": [
        {
            "n_estimators": [50, 100],
            "max_depth": [None, 10, 20],
            "min_samples_split": [2, 5],
            "min_samples_leaf": [1, 2],
        }
    ],
    "LinearSVC": [
        {"C": C_GRID, "penalty": ["l2"], "loss": ["squared_hinge"], "dual": [True, False]},
        {"C": C_GRID, "penalty": ["l2"], "loss": ["hinge"], "dual": [True]},
        {"C": C_GRID, "penalty": ["l1"], "loss": ["squared_hinge"], "dual": [False]},
    ],
    "LogisticRegression": [{"C": C_GRID, "penalty": ["l2", None], "solver": ["lbfgs"]}],
    "RNN": [{"hidden_size": [32, 64, 128], "epochs": [20, 50], "lr": [0.001, 0.0001]}],
}


# --- neighbour vote -------------------------------------------------------------------


def vote_weight(weights: str) -> Column:
    """1, or 1/distance; a zero distance silences all others through an infinite weight."""
    return F.lit(1.0) if weights == "uniform" else F.when(F.col("distance") > 0, 1.0 / F.col("distance"))


def knn_votes(neighbors: DataFrame, run: list[str], k: int, weights: str = "uniform") -> DataFrame:
    """``run..., probe_id, label, share``: class probabilities from the first k neighbours.

    With distance weights, neighbours at distance 0 share the vote alone.
    """
    key = [*run, "probe_id"]
    near = neighbors.filter(F.col("ordinal") <= k)
    if weights == "uniform":
        per_label = near.groupBy(*key, "label").agg(F.count("*").cast("double").alias("__w"), F.lit(0).alias("__z"))
    else:
        per_label = near.groupBy(*key, "label").agg(
            F.coalesce(F.sum(vote_weight(weights)), F.lit(0.0)).alias("__w"),
            F.sum((F.col("distance") == 0).cast("int")).alias("__z"),
        )
    per_probe = per_label.groupBy(*key).agg(
        F.collect_list(F.struct("label", "__w", "__z")).alias("__v"),
        F.sum("__w").alias("__tw"),
        F.sum("__z").alias("__tz"),
    )
    share = F.when(F.col("__tz") > 0, F.col("__e.__z") / F.nullif(F.col("__tz"), F.lit(0))).otherwise(
        F.col("__e.__w") / F.nullif(F.col("__tw"), F.lit(0.0))
    )
    return per_probe.withColumn("__e", F.explode("__v")).select(*key, F.col("__e.label").alias("label"), share.alias("share"))


def knn_predict(votes: DataFrame, run: list[str]) -> DataFrame:
    """``run..., probe_id, prediction``: the largest share, ties to the smallest label."""
    return votes.groupBy(*run, "probe_id").agg(
        F.min_by("label", F.struct(-F.col("share"), F.col("label"))).alias("prediction")
    )


def knn_classify(
    train: DataFrame,
    test: DataFrame,
    run: list[str] = (),
    k: int = 5,
    weights: str = "uniform",
    metric: str = "euclidean",
    **join,
) -> DataFrame:
    """All runs at once: ``run..., probe_id, label, prediction`` for ``test``.

    ``train``: ``run..., build_id, label, v``; ``test``: ``run..., probe_id, label, v``.
    """
    nn = knn_join(test.drop("label"), train, k, within=list(run), metric=metric, **join)
    predicted = knn_predict(knn_votes(nn, list(run), k, weights), list(run))
    return predicted.join(test.select(*run, "probe_id", "label"), [*run, "probe_id"])


# --- fitted models: see fits ----------------------------------------------------------


def label_index(labels: DataFrame) -> StringIndexerModel:
    """Labels to 0..n-1 in sorted order."""
    return StringIndexer(inputCol="label", outputCol="target", stringOrderType="alphabetAsc").fit(labels)


def model_names() -> list[str]:
    return ["KNN", *fits.SOLVERS]


def register(name: str, solver, space: list[dict[str, list]]) -> None:
    """Adds a model (see :func:`fits.register`) and the space its settings are drawn from."""
    fits.register(name, solver)
    SPACES[name] = space


def settings_for(runs: DataFrame, run: list[str], params: dict | None = None) -> DataFrame:
    """``run..., candidate, fold, params``: one setting, the same for every run."""
    flat = [F.lit(x) for k, v in (params or {}).items() for x in (k, None if v is None else str(v))]
    made = F.create_map(*flat) if flat else F.create_map()
    none = F.lit(None).cast("int").alias("fold")
    return runs.select(*run).distinct().select(*run, F.lit(0).alias("candidate"), none, made.cast("map<string,string>").alias("params"))


def classify(name: str, train: DataFrame, test: DataFrame, run: list[str], params: dict | None = None) -> DataFrame:
    """All runs at once: ``run..., candidate, fold, probe_id, label, prediction, predict_seconds`` for ``test``.

    ``train`` and ``test``: ``run..., row_id, label, v``.
    """
    blocks = fits.pack(train, run)
    found = fits.fit(name, blocks, settings_for(blocks, run, params), run)
    return fits.predict(name, found, fits.pack(test, run), run)
