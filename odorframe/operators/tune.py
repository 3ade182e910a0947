"""Parameter search: keyed candidate draws and successive halving."""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odorframe.functions.draws import key_hash
from odorframe.functions.ranking import number_rows
from odorframe.operators import fits, models
from odorframe.operators.neighbors import knn_join
from odorframe.session import cut_lineage

# Number of candidates and the share kept per rung.
N_CANDIDATES = 20
FACTOR = 3
MOST_NEIGHBORS = max(models.SPACES["KNN"][0]["n_neighbors"])


def combinations(space: list[dict[str, list]]) -> list[dict]:
    """All parameter settings of a list of grids, in grid order."""
    return [
        dict(zip(grid, values)) for grid in space for values in itertools.product(*grid.values())
    ]


def candidates(runs: DataFrame, run: list[str], model: str, n: int = N_CANDIDATES, seed: int = 42) -> DataFrame:
    """``run..., model, candidate, place, params``: min(n, all) settings per run, without repeats.

    The space is a literal list ordered by keyed hash inside each row: no shuffle.
    """
    settings = [json.dumps(c) for c in combinations(models.SPACES[model])]
    drawn = F.slice(
        F.array_sort(
            F.transform(
                F.lit(settings),
                lambda s, i: F.struct(
                    key_hash(seed, f"candidate|{model}", *run, i).alias("h"),
                    i.cast("int").alias("candidate"),
                    s.alias("settings"),
                ),
            )
        ),
        1,
        min(n, len(settings)),
    )
    return runs.select(*run, F.lit(model).alias("model"), F.posexplode(drawn).alias("__p", "__c")).select(
        *run,
        "model",
        "__c.candidate",
        (F.col("__p") + 1).alias("place"),
        F.from_json("__c.settings", "map<string,string>").alias("params"),
    )


def rungs(n_candidates: int, n_rows: int, n_folds: int, n_classes: int, factor: int = FACTOR) -> list[tuple[int, int]]:
    """(candidates, rows) per rung: rows triple and a third of the candidates stays.

    The first rung has two rows per fold and class; rungs end with the rows or the candidates.
    """
    first = 2 * n_folds * n_classes
    needed = 1 + _log_floor(n_candidates, factor)
    possible = 1 + _log_floor(max(1, n_rows // first), factor)
    out, left = [], n_candidates
    for i in range(min(needed, possible)):
        out.append((left, min(n_rows, first * factor**i)))
        left = math.ceil(left / factor)
    return out


def _log_floor(value: int, base: int) -> int:
    n = 0
    while base ** (n + 1) <= value:
        n += 1
    return n


Rung = Callable[[DataFrame, list[str], DataFrame], DataFrame]


def _halving(rows: DataFrame, run: list[str], space: DataFrame, rung: Rung, seed: int, factor: int, history: list[DataFrame] | None) -> DataFrame:
    """The rungs of all runs; ``rung(rows, run, settings)`` gives ``run..., candidate, __acc``.

    A rung's rows, scores and survivors are tables keyed by run; ``history`` receives the scored
    candidates of each rung.
    """
    ranked = cut_lineage(number_rows(rows, key_hash(seed, "rung", *run, "row_id"), tie="row_id", partition=run))
    sizes = ranked.groupBy(*run).agg(
        F.count("*").alias("__rows"), (2 * F.first("cv_k") * F.count_distinct("label")).alias("__first")
    )
    alive = cut_lineage(
        space.select(*run, "candidate", "params")
        .join(sizes, run)
        .withColumns({"accuracy": F.lit(None).cast("double"), "n_rows": F.lit(0).cast("bigint")})
    )
    per_run = Window.partitionBy(*run)
    for i in range(1 + _log_floor(N_CANDIDATES, factor)):
        resources = F.least(F.col("__rows"), F.col("__first") * factor**i).cast("bigint")
        # A run goes on while its rows allow another tripling; the first rung always runs.
        going = F.lit(i == 0) | (F.col("__first") * factor**i <= F.col("__rows"))
        now = alive.filter(going)
        if i and now.isEmpty():
            break
        wanted = now.groupBy(*run).agg(F.first(resources).alias("__take"))
        part = cut_lineage(ranked.join(wanted, run).filter(F.col("rank") <= F.col("__take")).drop("__take", "rank"))
        scored = rung(part, run, now.select(*run, "candidate", "params"))
        place = F.row_number().over(per_run.orderBy(F.desc("__acc"), "candidate"))
        total = F.count("*").over(per_run)
        # A run whose folds leave nothing to learn from scores 0 and stays.
        scored = now.join(scored, [*run, "candidate"], "left").withColumn("__acc", F.coalesce("__acc", F.lit(0.0)))
        if history is not None:
            scored = cut_lineage(scored)
            history.append(scored.select(*run, "candidate", F.col("__acc").alias("accuracy"), resources.alias("n_rows")))
        kept = (
            scored.withColumn("accuracy", F.col("__acc"))
            .withColumn("n_rows", resources)
            .withColumn("__place", place)
            .withColumn("__total", total)
            .filter(F.col("__place") <= F.ceil(F.col("__total") / factor))
            .select(*alive.columns)
        )
        alive = cut_lineage(kept.unionByName(alive.filter(~going)))
    best = F.row_number().over(per_run.orderBy(F.desc("accuracy"), "candidate"))
    return alive.withColumn("__b", best).filter(F.col("__b") == 1).select(*run, "candidate", "params", "accuracy", "n_rows")


def halving_knn(
    rows: DataFrame, run: list[str], space: DataFrame, seed: int = 42, factor: int = FACTOR, history: list[DataFrame] | None = None
) -> DataFrame:
    """Best neighbour-vote setting per run: ``run..., candidate, params, accuracy, n_rows``.

    ``rows``: ``run..., row_id, cv_k, cv_fold, label, v``; ``space`` from
    :func:`candidates`. All runs, folds and candidates of a rung share two neighbour
    joins (one per metric): the list for the largest k holds the lists for all smaller
    ones. Rung sizes follow :func:`rungs`, per run.
    """
    return _halving(rows, run, space, _knn_rung, seed, factor, history)


def halving_fits(
    model: str, rows: DataFrame, run: list[str], space: DataFrame, seed: int = 42, factor: int = FACTOR, history: list[DataFrame] | None = None
) -> DataFrame:
    """The same for a fitted model: a rung is one table of fits, run x candidate x fold.

    A candidate that can't be fitted on a fold scores 0 there.
    """

    def rung(part: DataFrame, run: list[str], settings: DataFrame) -> DataFrame:
        blocks = fits.pack(part, run)
        folds = part.groupBy(*run).agg(F.first("cv_k").alias("__k"))
        asked = settings.join(folds, run).withColumn("fold", F.explode(F.sequence(F.lit(1), F.col("__k")))).drop("__k")
        found = fits.fit(model, blocks, asked, run)
        hits = fits.predict(model, found, blocks, run).groupBy(*run, "candidate", "fold").agg(
            F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("__a")
        )
        every = asked.select(*run, "candidate", "fold").join(hits, [*run, "candidate", "fold"], "left")
        return every.groupBy(*run, "candidate").agg(F.avg(F.coalesce("__a", F.lit(0.0))).alias("__acc"))

    return _halving(rows, run, space, rung, seed, factor, history)


def predict_settings(
    probe: DataFrame, build: DataFrame, key: list[str], run: list[str], settings: DataFrame, most: int = MOST_NEIGHBORS
) -> DataFrame:
    """``key..., probe_id, candidate, prediction`` for every setting of a run.

    ``settings``: ``run..., candidate, params``, where ``run`` is part of ``key``, the
    columns probe and build rows share. One neighbour join per metric serves all settings.
    """
    votes = None
    for metric in ("euclidean", "manhattan"):
        wanted = settings.filter((F.col("params")["metric"] == "manhattan") == F.lit(metric == "manhattan"))
        nn = knn_join(probe, build, most, within=key, metric=metric)
        # A neighbour at distance 0 outweighs all others.
        w = F.when(F.col("params")["weights"] == "uniform", F.lit(1.0)).otherwise(
            F.when(F.col("distance") > 0, 1.0 / F.col("distance")).otherwise(F.lit(1e300))
        )
        part = (
            nn.join(wanted, run)
            .filter(F.col("ordinal") <= F.col("params")["n_neighbors"].cast("int"))
            .groupBy(*key, "probe_id", "candidate", "label").agg(F.sum(w).alias("w"))
        )
        votes = part if votes is None else votes.unionByName(part)
    return votes.groupBy(*key, "probe_id", "candidate").agg(
        F.min_by("label", F.struct(-F.col("w"), F.col("label"))).alias("prediction")
    )


def _knn_rung(rows: DataFrame, run: list[str], space: DataFrame) -> DataFrame:
    """``run..., candidate, __acc``: mean accuracy over the folds."""
    key = [*run, "cv"]
    probe = rows.withColumn("cv", F.col("cv_fold")).select(*key, F.col("row_id").alias("probe_id"), "v")
    build = (
        rows.withColumn("cv", F.explode(F.sequence(F.lit(1), F.col("cv_k")))).filter(F.col("cv") != F.col("cv_fold"))
        .select(*key, F.col("row_id").alias("build_id"), "label", "v")
    )
    truth = rows.select(*run, F.col("cv_fold").alias("cv"), F.col("row_id").alias("probe_id"), F.col("label").alias("truth"))
    predicted = predict_settings(probe, build, key, run, space)
    hits = predicted.join(truth, [*key, "probe_id"]).groupBy(*key, "candidate").agg(
        F.avg((F.col("prediction") == F.col("truth")).cast("double")).alias("__a")
    )
    return hits.groupBy(*run, "candidate").agg(F.avg("__a").alias("__acc"))
