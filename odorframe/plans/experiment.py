"""Whole runs, many at once: fold, seed set, scaling, generation, model, scores, ledger rows.

A run is a (run_fold, selection, n_seeds) key. Runs are not looped over: their rows
carry the key, and every step works per key in one plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odorframe.operators import augment, evaluate, fits, models, oversample, scale, shape, split, tune
from odorframe.operators.mixture import LATENT_MIN_ROWS
from odorframe.plans.grid import BASELINES, METHOD_MIN_SEEDS
from odorframe.session import cut_lineage, small_side
from odorframe.sources.ledger_io import LEDGER_SCHEMA

ID, LABEL = "measurement_id", "label"
RUN = ["run_fold", "selection", "n_seeds"]
UNITS = ("point", "sequence")
DEFAULT_SETTING = '{"n_neighbors":"5","weights":"uniform","metric":"minkowski"}'


def run_tables(
    seqs: DataFrame, sizes: tuple[int, ...], selections: int, k: int = 10, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(seeds, test): scaled sequences of every run, scaler fitted on the run's seeds.

    Folds and seed sets are chosen on keys; sequences join once the choice is made. The few
    seeds are written, as every method, scale and model reads them again. The held-out
    sequences are written once per fold and scaled as they are read, so that what is stored
    does not grow with selections and seed sizes.
    """
    folds = cut_lineage(split.assign_folds(split.measurements(seqs), k, seed))
    sets = split.seed_sets(folds, sizes, selections, k, seed).select(*RUN, ID)
    seeds = cut_lineage(sets.join(seqs, ID))
    scaler = cut_lineage(scale.fit_scaler(seeds, RUN))
    held_out = cut_lineage(folds.select(ID, F.col("fold").alias("run_fold")).join(seqs, ID))
    scaled_test = scale.apply_scaler(held_out.join(small_side(scaler.select(*RUN), 3), "run_fold"), scaler, RUN)
    return cut_lineage(scale.apply_scaler(seeds, scaler, RUN)), scaled_test


def model_rows(seqs: DataFrame, unit: str, key: list[str], name: str, also: list[str] = ()) -> DataFrame:
    """``run..., <name>, label, v`` and the columns ``also``: one row per point, or the flat sequence.

    The row id is a string of the key columns, and of the step for points.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")
    if unit == "sequence":
        return seqs.select(*RUN, F.concat_ws("|", *key).alias(name), LABEL, F.flatten("x").alias("v"), *also)
    points = shape.as_points(seqs, list(dict.fromkeys([*RUN, *key, LABEL, *also])))
    return points.select(*RUN, F.concat_ws("|", *key, "t").alias(name), LABEL, "v", *also)


def _keyed(seqs: DataFrame) -> DataFrame:
    """Run-unique ids and labels, so that generators stay inside their run."""
    tag = lambda c: F.concat_ws("|", *RUN, c)
    return seqs.select(*RUN, tag(ID).alias(ID), tag(LABEL).alias(LABEL), "x")


def _unkeyed(synthetic: DataFrame) -> DataFrame:
    part = lambda c, i: F.get(F.split(c, r"\|", 4), F.lit(i))
    run = [part(ID, i).cast("int").alias(c) for i, c in enumerate(RUN)]
    return synthetic.select(*run, part(ID, 3).alias(ID), part(LABEL, 3).alias(LABEL), "copy", "x")


def generate_runs(seeds: DataFrame, method: str, scale_factor: int, seed: int = 42, **params) -> DataFrame:
    """``run..., measurement_id, label, copy, x``: the synthetic training set of every run.

    Left out are runs below the seed size gate of the method and those it cannot grow;
    :func:`run_outcomes` says why. What a run gets does not depend on the other runs.
    """
    allowed = seeds.filter(F.col("n_seeds") >= METHOD_MIN_SEEDS.get(method, 1))
    if method in ("SMOTE", "ADASYN"):
        params = {**params, "run": RUN}
        keyed = _keyed(allowed)
    else:
        keyed = _keyed(allowed).drop(*RUN)
    return _unkeyed(augment.generate(keyed, method, scale_factor, seed, **params))


def run_outcomes(seeds: DataFrame, method: str, scale_factor: int) -> DataFrame:
    """``run..., outcome``: ``ok``, or why a run has no or only partly grown training sets of a method."""
    keys = seeds.select(*RUN).distinct()
    below = F.col("n_seeds") < METHOD_MIN_SEEDS.get(method, 1)
    gate = F.when(below, F.lit("seed size below gate"))
    if method in ("SMOTE", "ADASYN"):
        allowed = _keyed(seeds.filter(~below))
        if method == "SMOTE":
            alone = F.when(F.col("k") < 1, F.lit(oversample.ALONE)).otherwise(F.lit("ok"))
            classes = oversample.run_sizes(allowed, RUN).withColumn("outcome", alone)
        else:
            classes = oversample.adasyn_outcome(allowed, scale_factor, RUN)
        worst = F.max(F.when(F.col("outcome") != "ok", F.col("outcome"))).alias("__why")
    elif method == "TimeVAE":
        classes = seeds.filter(~below).groupBy(*RUN, LABEL).agg(F.count("*").alias("n"))
        worst = F.when(F.min("n") < LATENT_MIN_ROWS, F.lit(f"a class has under {LATENT_MIN_ROWS} members")).alias("__why")
    else:
        return keys.withColumn("outcome", F.coalesce(gate, F.lit("ok")))
    found = keys.join(classes.groupBy(*RUN).agg(worst), RUN, "left")
    return found.select(*RUN, F.coalesce(gate, "__why", F.lit("ok")).alias("outcome"))


def knn_runs(
    train: DataFrame,
    test: DataFrame,
    unit: str,
    settings: DataFrame | None = None,
    cap: int = 100_000,
    seed: int = 42,
) -> DataFrame:
    """``run..., n_test, accuracy, f1`` of the neighbour vote for all runs in one plan.

    ``train`` has a ``copy`` column; beyond ``cap`` training rows a run is sampled.
    ``settings`` (``run..., candidate, params``) holds each run's tuned parameters; without it
    every run uses 5 Euclidean neighbours with equal votes.
    """
    rows = model_rows(train, unit, [ID, "copy"], "build_id")
    largest = rows.groupBy(*RUN).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if largest and largest > cap:
        rows = split.cap_rows(rows, ["build_id"], cap, seed, RUN)
    probes = model_rows(test, unit, [ID], "probe_id")
    if settings is None:
        return evaluate.scores(models.knn_classify(rows, probes, RUN), RUN)
    tuned = tune.predict_settings(probes.drop(LABEL), rows, RUN, RUN, settings)
    truth = probes.select(*RUN, "probe_id", LABEL)
    return evaluate.scores(tuned.join(truth, [*RUN, "probe_id"]), RUN)


def cv_rows(seeds: DataFrame, unit: str, seed: int = 42) -> DataFrame:
    """``run..., row_id, cv_k, cv_fold, label, v``: training rows of every run with their fold.

    Whole measurements go to a fold; with a single seed per label, where that would leave a
    label out of training, single rows do, stratified by label. Every run has rows in every fold
    that its number of rows allows.
    """
    rows = cut_lineage(model_rows(seeds, unit, [ID], "row_id", [ID]))
    grouped = split.cv_folds(seeds.select(*RUN, ID, LABEL), seed).filter("grouped")
    whole = rows.join(grouped.select(*RUN, ID, "cv_k", "cv_fold"), [*RUN, ID])
    single = rows.filter(F.col("n_seeds") < 2)
    dealt = split.assign_folds(single.select(*RUN, F.col("row_id").alias(ID), LABEL), 2, seed, RUN)
    dealt = dealt.select(*RUN, F.col(ID).alias("row_id"), F.lit(2).alias("cv_k"), F.col("fold").alias("cv_fold"))
    columns = [*RUN, "row_id", "cv_k", "cv_fold", LABEL, "v"]
    return whole.select(*columns).unionByName(single.join(dealt, [*RUN, "row_id"]).select(*columns))


def tune_knn_runs(seeds: DataFrame, unit: str, seed: int = 42) -> DataFrame:
    """``run..., candidate, params, accuracy, n_rows``: the best neighbour-vote setting of every run."""
    space = tune.candidates(seeds.select(*RUN).distinct(), RUN, "KNN", seed=seed)
    return tune.halving_knn(cv_rows(seeds, unit, seed), RUN, space, seed)


def _unit(name: str, unit: str) -> str:
    """Recurrent nets read whole sequences, whatever the others read."""
    return "sequence" if name == "RNN" else unit


def _channels(name: str, settings: DataFrame, seqs: DataFrame) -> DataFrame:
    """Tells a recurrent net how a flat sequence is cut into channels."""
    if name != "RNN":
        return settings
    channels = F.create_map(F.lit("channels"), F.lit(str(seqs.select(F.size("x")).first()[0])))
    return settings.withColumn("params", F.map_concat(F.map_filter("params", lambda k, _: k != "channels"), channels))


def tune_fit_runs(name: str, seeds: DataFrame, unit: str, seed: int = 42, candidates: int = tune.N_CANDIDATES) -> DataFrame:
    """``run..., candidate, params, accuracy, n_rows``: the best setting of a fitted model for every run.

    Recurrent nets are not searched: every run keeps the default setting.
    """
    if name == "RNN":
        plain = _channels(name, models.settings_for(seeds, RUN), seeds)
        return plain.select(*RUN, "candidate", "params", F.lit(None).cast("double").alias("accuracy"), F.lit(0).cast("bigint").alias("n_rows"))
    space = tune.candidates(seeds.select(*RUN).distinct(), RUN, name, candidates, seed)
    return tune.halving_fits(name, cv_rows(seeds, unit, seed), RUN, space, seed)


def train_blocks(train: DataFrame, unit: str, cap: int = 100_000, seed: int = 42) -> DataFrame:
    """The training rows of every run, packed; beyond ``cap`` rows a run is sampled. Models that read the same unit share them."""
    rows = model_rows(train, unit, [ID, "copy"], "row_id")
    if (rows.groupBy(*RUN).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > cap:
        rows = split.cap_rows(rows, ["row_id"], cap, seed, RUN)
    return fits.pack(rows, RUN)


def test_blocks(test: DataFrame, unit: str) -> DataFrame:
    """The held-out rows of every run, packed."""
    return fits.pack(model_rows(test, unit, [ID], "row_id"), RUN)


def fit_runs(
    name: str,
    train: DataFrame,
    test: DataFrame,
    unit: str,
    settings: DataFrame | None = None,
    cap: int = 100_000,
    seed: int = 42,
    blocks: DataFrame | None = None,
    probes: DataFrame | None = None,
) -> DataFrame:
    """One row per run of a fitted model: ``run..., n_test, accuracy, f1, params, fit_seconds, predict_seconds, error``.

    All runs are fitted in one plan, and scored in another. ``settings`` (``run..., params``) holds
    each run's tuned parameters, else the defaults hold. ``blocks`` and ``probes`` are the packed
    rows, where they are at hand. A run that can't be fitted has its error and no scores.
    """
    blocks = train_blocks(train, _unit(name, unit), cap, seed) if blocks is None else blocks
    probes = test_blocks(test, _unit(name, unit)) if probes is None else probes
    asked = models.settings_for(blocks, RUN) if settings is None else settings.select(*RUN, F.lit(0).alias("candidate"), F.lit(None).cast("int").alias("fold"), "params")
    found = fits.fit(name, blocks, _channels(name, asked, train), RUN)
    predicted = cut_lineage(fits.predict(name, found, probes, RUN))
    scored = evaluate.scores(predicted, RUN).join(predicted.groupBy(*RUN).agg(F.sum("predict_seconds").alias("predict_seconds")), RUN)
    told = found.select(*RUN, F.to_json("params").alias("params"), "fit_seconds", "error").join(scored, RUN, "left")
    return told.select(*RUN, "n_test", "accuracy", "f1", "params", "fit_seconds", "predict_seconds", "error")


def ledger_rows(
    scored: DataFrame,
    dataset: str,
    model: str,
    method: str,
    scale_factor: int,
    params: Column | str,
    seconds: Column | float,
) -> DataFrame:
    """Scores in ledger form."""
    params = params if isinstance(params, Column) else F.lit(params)
    seconds = seconds if isinstance(seconds, Column) else F.lit(float(seconds))
    return scored.select(
        F.lit(dataset).alias("Dataset"),
        F.col("run_fold").alias("Fold"),
        F.col("n_seeds").alias("SeedsPerLabel"),
        F.col("selection").alias("SeedFoldSelection"),
        F.lit(scale_factor).alias("ScaleFactor"),
        F.lit(model).alias("Model"),
        F.lit(method).alias("Method"),
        F.col("accuracy").alias("Accuracy"),
        F.col("f1").alias("F1_Score"),
        params.alias("Hyperparameters"),
        seconds.alias("ExecutionTime_Sec"),
    ).select(*LEDGER_SCHEMA.names)


OUTCOME = "run_fold int, selection int, n_seeds int, model string, method string, scale_factor int, outcome string, fit_seconds double, predict_seconds double"


def run_experiment(
    seqs: DataFrame,
    dataset: str,
    sizes: tuple[int, ...],
    selections: int,
    methods: list[str],
    scales: list[int],
    write: Callable[[DataFrame], None],
    unit: str = "point",
    k: int = 10,
    seed: int = 42,
    method_params: dict[str, dict] | None = None,
    tuned: bool = False,
    model_names: tuple[str, ...] = ("KNN",),
    candidates: int = tune.N_CANDIDATES,
    write_outcomes: Callable[[DataFrame], None] | None = None,
) -> list[tuple[str, int, str]]:
    """Runs of every model: baseline, tuned baseline, and every method and scale.

    Tuning happens once per run and model, on the run's seeds; augmented runs use those
    settings. A generator is fitted once per run and sampled for the largest scale; smaller
    scales are its first copies (the quotas of ADASYN depend on the scale, so it is run for
    each). ``write`` receives the ledger rows of a finished job: the seconds of a neighbour vote
    are its job's, shared over its runs, those of other models are a run's own fit and predict.
    ``write_outcomes`` receives one row per run, model, method and scale (see OUTCOME): ``ok``, or
    why it has no ledger row, or was grown only in part. Returns the methods a generator refused
    for all runs; the others go on.
    """
    seeds, test = run_tables(seqs, sizes, selections, k, seed)
    original = seeds.withColumn("copy", F.lit(0))
    # Packed once, for all models that read the same unit.
    units = sorted({_unit(m, unit) for m in model_names if m != "KNN"})
    probes = {u: test_blocks(test, u) for u in units}
    best: dict[str, DataFrame] = {}
    for model in model_names if tuned else ():
        found = tune_knn_runs(seeds, unit, seed) if model == "KNN" else tune_fit_runs(model, seeds, unit, seed, candidates)
        best[model] = cut_lineage(found)
    skipped = []
    outcomes: dict[tuple[str, int], DataFrame] = {}

    def sets(method: str) -> Iterator[tuple[int, DataFrame]]:
        params = (method_params or {}).get(method, {})
        if method == "ADASYN":
            for factor in scales:
                yield factor, cut_lineage(generate_runs(seeds, method, factor, seed, **params))
            return
        most = cut_lineage(generate_runs(seeds, method, max(scales), seed, **params))
        for factor in scales:
            yield factor, most.filter(F.col("copy") < factor)

    def report(method: str, factor: int, model: str, done: DataFrame | None, refusal: str | None = None) -> None:
        if write_outcomes is None:
            return
        if refusal is None and (method, factor) not in outcomes:
            outcomes[method, factor] = cut_lineage(run_outcomes(seeds, method, factor))
        out = outcomes[method, factor] if refusal is None else seeds.select(*RUN).distinct().withColumn("outcome", F.lit(refusal))
        if done is None:
            told = out.withColumns({"fit_seconds": F.lit(None).cast("double"), "predict_seconds": F.lit(None).cast("double")})
        else:
            told = out.join(done.select(*RUN, "fit_seconds", "predict_seconds", "error"), RUN, "left").withColumn("outcome", F.coalesce("error", "outcome"))
        named = told.withColumns({"model": F.lit(model), "method": F.lit(method), "scale_factor": F.lit(factor)})
        write_outcomes(named.select(*[c.split()[0] for c in OUTCOME.split(", ")]))

    def score(method: str, factor: int, train: DataFrame) -> None:
        blocks = {u: train_blocks(train, u, seed=seed) for u in units}
        for model in model_names:
            used = None if method == "Baseline" or not tuned else best[model]
            if model == "KNN":
                scored, seconds = evaluate.timed(lambda: cut_lineage(knn_runs(train, test, unit, used, seed=seed)))
                each = F.lit(float(seconds)) / F.greatest(F.lit(1), F.lit(scored.count()))
                scored = scored.withColumns({"fit_seconds": F.lit(0.0), "predict_seconds": each, "error": F.lit(None).cast("string")})
                if used is None:
                    scored = scored.withColumn("params", F.lit(DEFAULT_SETTING))
                else:
                    scored = scored.join(used.select(*RUN, F.to_json("params").alias("params")), RUN, "left")
            else:
                scored = cut_lineage(fit_runs(model, train, test, unit, used, seed=seed, blocks=blocks[_unit(model, unit)], probes=probes[_unit(model, unit)]))
            ended = scored.filter("accuracy is not null")
            write(ledger_rows(ended, dataset, model, method, factor, F.col("params"), F.col("fit_seconds") + F.col("predict_seconds")))
            report(method, factor, model, scored)

    score("Baseline", 1, original)
    if tuned:
        score("Tuned_Baseline", 1, original)
    for method in methods:
        try:
            for factor, train in sets(method):
                score(method, factor, train)
        except ValueError as problem:  # a generator's documented refusal
            told = str(problem).split("\n")[0]
            skipped += [(method, factor, told) for factor in scales]
            for factor in scales:
                for model in model_names:
                    report(method, factor, model, None, told)
    return skipped
