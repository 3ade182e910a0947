"""Queries on fitted models: forests, linear classifiers, recurrent nets, their search and the whole loop.

A fit is iterative, so its twin states what must hold for the fitted model: the first splits of
every tree, counts that the optimum reproduces, gradients that vanish there.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from checks import tables as tb
from checks.learning import _RUN_SCORE, _RUNS, _VEC, FLAT, _ID0, vectors
from checks.splits import _SEQ_HEAD
from odorframe.operators import fits, forest, models, split, tune
from odorframe.plans import experiment, grid
from odorframe.session import cut_lineage, fresh_path
from odorframe.sources import ledger_io

Q = {}
SQL = {}
FOLDED = _SEQ_HEAD.replace("WITH ", f"WITH {FLAT}, ", 1)


def folded(spark, sf) -> DataFrame:
    """All sequences as one run's rows, with the fold in which each is held out."""
    v = vectors(spark, sf)
    f = split.assign_folds(split.measurements(v)).join(v.drop("label"), "measurement_id")
    return f.select(F.lit(1).alias("run"), F.col("measurement_id").alias("row_id"), "label", "v", F.col("fold").alias("cv_fold"))


def fold_fits(spark, sf, name: str, settings: list[dict]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, fits, predictions): each setting fitted once per fold on the other folds."""
    rows = cut_lineage(folded(spark, sf))
    blocks = fits.pack(rows, ["run"])
    asked = [(1, c, f, {k: None if v is None else str(v) for k, v in p.items()}) for c, p in enumerate(settings) for f in range(1, 11)]
    asked = spark.createDataFrame(asked, "run int, candidate int, fold int, params map<string,string>")
    found = fits.fit(name, blocks, asked, ["run"])
    return rows, found, fits.predict(name, found, blocks, ["run"])


# --- forest: the first split of every tree ---------------------------------------------

TREES = 50


def random_forest(spark, sf):
    """The first split of each tree of every fold's forest, and how many held-out rows the forest labels."""
    _, found, predicted = fold_fits(spark, sf, "RandomForest", [{"n_estimators": TREES, "max_depth": 10}])
    tested = predicted.groupBy("fold").agg(F.count("prediction").alias("n_test"))
    roots = fits.forest_nodes(found, ["run"]).filter("node = 0").join(tested, "fold")
    return roots.select(F.col("fold").alias("run_fold"), "tree", "feature", tb.r6("at").alias("at"), "n_test")


def _mod(a: str, op: str, b: str) -> str:
    return f"CAST((CAST({a} AS UHUGEINT) {op} CAST({b} AS UHUGEINT)) % 18446744073709551616 AS UBIGINT)"


# The finaliser of splitmix64 and the draw for a pair of keys, as macros of the database's own.
_GOLD = "11400714819323198485"


def _spread(h: str) -> str:
    """One 64-bit value mixed; ``h`` is bound once per step by a lambda over a list of one."""
    step = lambda src, shift, factor: f"list_transform({src}, lambda z: {_mod(f'xor(z, z >> {shift})', '*', factor)})"
    mixed = step(step(f"[{h}]", 30, "13787848793156543929"), 27, "10723151780598845931")
    return f"list_transform({mixed}, lambda z: xor(z, z >> 31))[1]"


def _keyed(a: str, b: str) -> str:
    first = _spread(_mod(_mod(a, "*", _GOLD), "+", "1"))
    return _spread(_mod(first, "+", _mod(b, "*", _GOLD)))


_WEIGHT = "list_sum(list_transform([" + ", ".join(repr(float(p)) for p in forest._POISSON[:-1]) + "], lambda p: CASE WHEN u >= p THEN 1 ELSE 0 END))"
Q["random_forest"] = random_forest
SQL["random_forest"] = f"""{FOLDED},
rw AS (SELECT id, label, v, fold, CAST('0x' || substr({tb.md5_sql('row', 'id')}, 1, 16) AS UBIGINT) AS k FROM flat JOIN fld USING (id, label)),
bag AS (SELECT id, label, t, CAST({_WEIGHT} AS BIGINT) AS w FROM (
  SELECT id, label, t, CAST({_keyed('k', 't')} >> 11 AS DOUBLE) / 9007199254740992 AS u FROM rw, (SELECT unnest(range({TREES})) AS t))),
dr AS (SELECT t, f, o FROM (SELECT t, f, row_number() OVER (PARTITION BY t ORDER BY {_keyed('base', 'f')}, f) AS o
  FROM (SELECT t, {_keyed('t', '1')} AS base FROM (SELECT unnest(range({TREES})) AS t)), (SELECT unnest(range(64)) AS f)) WHERE o <= 8),
tr AS (SELECT r AS run_fold, rw.* FROM rw, (SELECT unnest(range(1, 11)) AS r) WHERE fold <> r),
ed AS (SELECT run_fold, f, x, (x + lead(x) OVER (PARTITION BY run_fold, f ORDER BY x)) / 2 AS mid
  FROM (SELECT DISTINCT run_fold, f, v[f + 1] AS x FROM tr, (SELECT unnest(range(64)) AS f))),
ce AS (SELECT run_fold, t, f, o, v[f + 1] AS x, label, sum(w) AS w, count(*) AS n FROM tr JOIN bag USING (id, label) JOIN dr USING (t) WHERE w > 0 GROUP BY ALL),
xs AS (SELECT run_fold, t, f, o, x, sum(n) AS n FROM ce GROUP BY ALL),
lb AS (SELECT DISTINCT run_fold, t, label FROM ce),
gr AS (SELECT run_fold, t, f, o, x, n, label, coalesce(w, 0) AS w FROM xs JOIN lb USING (run_fold, t) LEFT JOIN (SELECT run_fold, t, f, x, label, w FROM ce) c USING (run_fold, t, f, x, label)),
cu AS (SELECT *, sum(w) OVER (PARTITION BY run_fold, t, f, label ORDER BY x) AS l, sum(w) OVER (PARTITION BY run_fold, t, f, label) AS a FROM gr),
sp AS (SELECT run_fold, t, f, o, x, sum(l * l) / sum(l) + sum((a - l) * (a - l)) / nullif(sum(a - l), 0) AS gain FROM cu GROUP BY ALL),
best AS (SELECT * FROM sp WHERE gain IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_fold, t ORDER BY gain DESC, o, x) = 1)
SELECT CAST(run_fold AS INTEGER) AS run_fold, CAST(t AS INTEGER) AS tree, CAST(f AS INTEGER) AS feature, round(mid, 6) + 0 AS "at", n_test
FROM best JOIN ed USING (run_fold, f, x) JOIN (SELECT fold AS run_fold, count(*) AS n_test FROM fld GROUP BY 1) USING (run_fold)"""


# --- linear models: what holds at the optimum ------------------------------------------


def _dot(w: Column, v: Column) -> Column:
    """Product with the coefficients, the last of which is the intercept."""
    return F.aggregate(F.zip_with(F.slice(w, F.lit(1), F.size(v)), v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) + F.element_at(w, -1)


def margins(rows: DataFrame, weights: DataFrame, run: list[str]) -> DataFrame:
    """``run..., candidate, fold, label, m, all_m, hit, v``: the margin of each training row for each class of its fits."""
    classes = weights.groupBy(*run, "candidate", "fold").agg(F.array_sort(F.collect_list(F.struct("label", "weights"))).alias("ws"))
    joined = rows.withColumnRenamed("label", "own").join(F.broadcast(classes), run).filter("fold is null or cv_fold <> fold")
    joined = joined.withColumn("all_m", F.transform("ws", lambda w: _dot(w["weights"], F.col("v"))))
    each = joined.select(*run, "candidate", "fold", "own", "v", "all_m", F.posexplode("ws").alias("at", "w"))
    return each.select(*run, "candidate", "fold", "w.label", F.get("all_m", F.col("at")).alias("m"), "all_m", (F.col("own") == F.col("w.label")).alias("hit"), "v")


def _share() -> Column:
    """Probability of the class of a row by its margins."""
    top = F.array_max("all_m")
    return F.exp(F.col("m") - top) / F.aggregate("all_m", F.lit(0.0), lambda s, x: s + F.exp(x - top))


def _row_sums(rows: DataFrame, weights: DataFrame, back) -> DataFrame:
    """``candidate, fold, label, j, n, g, total``: sums over the training rows of each fit.

    ``back(margins, hit, candidate)`` gives (slope by margin, a value to add up) as matrices of row
    and class; ``g`` adds up slope times input j, the last input being one, and ``total`` the values.
    Weights are parameters: they go to every task, and each batch of rows sends sums alone.
    """
    fitted: dict = {}
    for r in weights.orderBy("candidate", "fold", "label").collect():
        labels, w = fitted.setdefault((r["candidate"], r["fold"]), ([], []))
        labels.append(r["label"])
        w.append(r["weights"])
    fitted = {key: (labels, np.array(w)) for key, (labels, w) in fitted.items()}
    sent = rows.sparkSession.sparkContext.broadcast(fitted)

    def sums(batches):
        for batch in batches:
            # Rows of different lengths have no fit.
            if not len(batch) or not sent.value:
                continue
            x = np.stack(batch["v"].to_list())
            x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            own, cv = batch["label"].to_numpy(), batch["cv_fold"].to_numpy()
            for (candidate, fold), (labels, w) in sent.value.items():
                use = cv != fold
                hit = own[use][:, None] == np.array(labels, object)[None, :]
                slope, value = back(x[use] @ w.T, hit, candidate)
                g, total = slope.T @ x[use], value.sum(axis=0)
                k, dim = g.shape
                yield pd.DataFrame({
                    "candidate": candidate, "fold": fold, "label": np.repeat(np.array(labels, object), dim), "j": np.tile(np.arange(dim), k),
                    "n": int(use.sum()), "g": g.ravel(), "total": np.repeat(total, dim),
                })

    found = rows.select("label", "v", "cv_fold").mapInPandas(sums, "candidate int, fold int, label string, j int, n long, g double, total double")
    return found.groupBy("candidate", "fold", "label", "j").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("total").alias("total"))


def _shares(m: np.ndarray, hit: np.ndarray, _) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the classes by margins: slope of the log loss, and the probabilities."""
    e = np.exp(m - m.max(axis=1, keepdims=True))
    share = e / e.sum(axis=1, keepdims=True)
    return share - hit, share


def _squared_hinge(m: np.ndarray, hit: np.ndarray, _) -> tuple[np.ndarray, np.ndarray]:
    t = np.where(hit, 1.0, -1.0)
    slope = -2 * t * np.maximum(0.0, 1 - t * m)
    return slope, slope


def _violation(sums: DataFrame, weights: DataFrame, strength: Column, penalised: int) -> DataFrame:
    """``candidate, fold, label, violation``: the largest entry of a class's gradient; for candidate ``l1`` the pseudo-gradient's."""
    sums = sums.withColumn("g", F.col("g") / F.col("n"))
    flat = weights.select("candidate", "fold", "label", F.posexplode("weights").alias("j", "w"))
    lam = F.when(F.col("j") < penalised, strength / F.col("n")).otherwise(0.0)
    smooth = F.abs(F.col("g") + lam * F.col("w"))
    sparse = F.when(F.col("w") != 0, F.abs(F.col("g") + lam * F.signum("w"))).otherwise(F.greatest(F.lit(0.0), F.abs("g") - lam))
    out = sums.join(flat, ["candidate", "fold", "label", "j"]).withColumn("bad", F.when(F.col("candidate") == 1, sparse).otherwise(smooth))
    return out.groupBy("candidate", "fold", "label").agg((F.round(F.max("bad"), 3) + 0).alias("violation"))


def logistic_regression(spark, sf):
    """Per fold and label: rows the model expects in its training set (at the optimum the true number), the gradient, rows predicted."""
    rows, found, predicted = fold_fits(spark, sf, "LogisticRegression", [{"C": 1.0}])
    weights = cut_lineage(fits.linear_weights(found, ["run"]))
    sums = cut_lineage(_row_sums(rows, weights, _shares))
    expected = sums.filter("j = 0").select("fold", "label", (F.round("total", 1) + 0).alias("expected_rows"))
    flat = _violation(sums, weights, F.lit(1.0), 64).select("fold", "label", "violation")
    tested = predicted.groupBy("fold").agg(F.count("prediction").alias("n_test"))
    return expected.join(flat, ["fold", "label"]).join(tested, "fold").withColumnRenamed("fold", "run_fold")


_TRAINED = """tn AS (SELECT CAST(r AS INTEGER) AS run_fold, label, count(*) AS n FROM fld, (SELECT unnest(range(1, 11)) AS r) WHERE fold <> r GROUP BY 1, 2),
te AS (SELECT fold AS run_fold, count(*) AS n_test FROM fld GROUP BY 1)"""
Q["logistic_regression"] = logistic_regression
SQL["logistic_regression"] = f"""{_SEQ_HEAD}, {_TRAINED}
SELECT run_fold, label, round(CAST(n AS DOUBLE), 1) AS expected_rows, CAST(0 AS DOUBLE) AS violation, n_test FROM tn JOIN te USING (run_fold)"""

SVC = [{"C": 1.0, "loss": "squared_hinge", "penalty": "l2"}, {"C": 0.1, "loss": "squared_hinge", "penalty": "l1"}, {"C": 0.01, "loss": "hinge", "penalty": "l2"}]


def linear_svc(spark, sf):
    """Per setting, fold and label: how far the fit is from its optimum (gradient; the duality gap for the hinge), rows predicted."""
    rows, found, predicted = fold_fits(spark, sf, "LinearSVC", SVC)
    weights = cut_lineage(fits.linear_weights(found, ["run"]))
    strength = F.lit(1.0) / F.element_at(F.lit([s["C"] for s in SVC]), F.col("candidate") + 1)
    smooth = weights.filter("candidate < 2")
    smooth = _violation(_row_sums(rows, smooth, _squared_hinge), smooth, strength, 65)
    gaps = weights.join(found.select("candidate", "fold", "optimality"), ["candidate", "fold"]).filter("candidate = 2")
    gaps = gaps.select("candidate", "fold", "label", (F.round("optimality", 3) + 0).alias("violation"))
    tested = predicted.groupBy("candidate", "fold").agg(F.count("prediction").alias("n_test"))
    return smooth.unionByName(gaps).join(tested, ["candidate", "fold"]).withColumnRenamed("fold", "run_fold")


Q["linear_svc"] = linear_svc
SQL["linear_svc"] = f"""{_SEQ_HEAD}, {_TRAINED}
SELECT CAST(c AS INTEGER) AS candidate, run_fold, label, CAST(0 AS DOUBLE) AS violation, n_test FROM tn JOIN te USING (run_fold), (SELECT unnest(range({len(SVC)})) AS c)"""


# --- recurrent net ---------------------------------------------------------------------


def recurrent_net(spark, sf):
    """Steps taken per fold with two batch sizes, and rows predicted."""
    settings = [{"channels": 8, "hidden_size": 64, "epochs": 10}, {"channels": 8, "hidden_size": 32, "epochs": 5, "batch_size": 100, "lr": 0.0001}]
    _, found, predicted = fold_fits(spark, sf, "RNN", settings)
    tested = predicted.groupBy("candidate", "fold").agg(F.count("prediction").alias("n_test"))
    return found.join(tested, ["candidate", "fold"]).select("candidate", F.col("fold").alias("run_fold"), F.col("iterations").alias("steps"), "n_test")


Q["recurrent_net"] = recurrent_net
SQL["recurrent_net"] = f"""{_SEQ_HEAD}, {_TRAINED}, al AS (SELECT run_fold, sum(n) AS n FROM tn GROUP BY 1)
SELECT CAST(c AS INTEGER) AS candidate, run_fold, CAST(CASE WHEN c = 0 THEN 10 * ceil(n / 32) ELSE 5 * ceil(n / 100) END AS INTEGER) AS steps, n_test
FROM al JOIN te USING (run_fold), (SELECT unnest([0, 1]) AS c)"""


# --- all runs of the grid --------------------------------------------------------------

SIZES = (1, 2, 5, 10, 20)
FITTED = tuple(m for m in grid.MODELS if m != "KNN")


def fitted_baseline_runs(spark, sf):
    """Every baseline run (fold, selection, seed size) of every fitted model: rows scored and how it ended."""
    seeds, test = experiment.run_tables(tb.sequences(spark, sf), SIZES, 10)
    train = seeds.withColumn("copy", F.lit(0))
    # All models read whole sequences: packed once.
    blocks, probes = experiment.train_blocks(train, "sequence"), experiment.test_blocks(test, "sequence")
    parts = [experiment.fit_runs(m, train, test, "sequence", blocks=blocks, probes=probes).withColumn("model", F.lit(m)) for m in FITTED]
    every = functools.reduce(DataFrame.unionByName, parts)
    sane = F.col("accuracy").between(0, 1) & F.col("f1").between(0, 1) & (F.col("fit_seconds") > 0) & (F.col("predict_seconds") > 0)
    return every.select(*experiment.RUN, "model", "n_test", F.coalesce("error", F.lit("ok")).alias("outcome"), sane.alias("sane"))


Q["fitted_baseline_runs"] = fitted_baseline_runs
_MODEL_LIST = "[" + ", ".join(f"'{m}'" for m in FITTED) + "]"
SQL["fitted_baseline_runs"] = f"""{_SEQ_HEAD}
SELECT fold AS run_fold, CAST(selection AS INTEGER) AS selection, CAST(n_seeds AS INTEGER) AS n_seeds, model, count(*) AS n_test, 'ok' AS outcome, true AS sane
FROM fld, (SELECT unnest(range(1, 11)) AS selection), (SELECT unnest([1, 2, 5, 10, 20]) AS n_seeds), (SELECT unnest({_MODEL_LIST}) AS model) GROUP BY ALL"""


def logistic_run_counts(spark, sf):
    """For all 500 baseline runs: the rows per label that each fitted logistic model expects in its own training set."""
    seeds, _ = experiment.run_tables(tb.sequences(spark, sf), SIZES, 10)
    rows = cut_lineage(experiment.model_rows(seeds, "sequence", [experiment.ID], "row_id"))
    blocks = fits.pack(rows, experiment.RUN)
    found = fits.fit("LogisticRegression", blocks, models.settings_for(blocks, experiment.RUN, {"C": 0.1}), experiment.RUN)
    weights = cut_lineage(fits.linear_weights(found, experiment.RUN))
    each = margins(rows.withColumn("cv_fold", F.lit(0)), weights, experiment.RUN)
    return each.groupBy(*experiment.RUN, "label").agg((F.round(F.sum(_share()), 1) + 0).alias("expected_rows"))


Q["logistic_run_counts"] = logistic_run_counts
SQL["logistic_run_counts"] = f"""{_SEQ_HEAD}, lb AS (SELECT DISTINCT label FROM fld)
SELECT CAST(r AS INTEGER) AS run_fold, CAST(s AS INTEGER) AS selection, CAST(n AS INTEGER) AS n_seeds, label, CAST(n AS DOUBLE) AS expected_rows
FROM lb, (SELECT unnest(range(1, 11)) AS r), (SELECT unnest(range(1, 11)) AS s), (SELECT unnest([1, 2, 5, 10, 20]) AS n)"""


# --- search ----------------------------------------------------------------------------


def halving_rungs(spark, sf):
    """Per model, fold and rung of a search over 20 (12) settings: candidates, rows, survivors that don't belong to the best third."""
    v = vectors(spark, sf)
    folds = split.assign_folds(split.measurements(v))
    train = split.train_test(folds).filter(F.col("part") == "train").drop("part", "fold")
    cv = split.assign_folds(train, 5, run=["run_fold"]).withColumnRenamed("fold", "cv_fold")
    rows = cut_lineage(cv.join(v.drop("label"), "measurement_id").withColumn("cv_k", F.lit(5)).withColumnRenamed("measurement_id", "row_id"))
    out = []
    for name in ("LinearSVC", "LogisticRegression"):
        history: list[DataFrame] = []
        space = tune.candidates(train.select("run_fold").distinct(), ["run_fold"], name)
        best = tune.halving_fits(name, rows, ["run_fold"], space, history=history)
        by = Window.partitionBy("run_fold")
        rungs = [h.withColumn("rung", F.lit(i)) for i, h in enumerate(history)]
        last = best.select("run_fold", "candidate", "accuracy", "n_rows").withColumn("rung", F.lit(len(rungs)))
        for before, after in zip(rungs, [*rungs[1:], last]):
            better = F.count("*").over(by.orderBy(F.desc("accuracy"), "candidate"))
            third = before.withColumn("fits", better <= F.ceil(F.count("*").over(by) / tune.FACTOR))
            wrong = after.join(third.filter("fits").select("run_fold", "candidate"), ["run_fold", "candidate"], "left_anti").groupBy("run_fold").agg(F.count("*").alias("wrong"))
            told = before.groupBy("run_fold", "rung").agg(F.count("*").alias("n_candidates"), F.max("n_rows").alias("n_rows")).join(wrong, "run_fold", "left")
            out.append(told.select(F.lit(name).alias("model"), "run_fold", "rung", "n_candidates", "n_rows", F.coalesce("wrong", F.lit(0).cast("bigint")).alias("wrong")))
    return functools.reduce(DataFrame.unionByName, out)


Q["halving_rungs"] = halving_rungs
SQL["halving_rungs"] = f"""{_SEQ_HEAD},
tr AS (SELECT r AS run_fold, count(*) AS n, 10 * count(DISTINCT label) AS first FROM fld, (SELECT unnest(range(1, 11)) AS r) WHERE fold <> r GROUP BY 1)
SELECT model, CAST(run_fold AS INTEGER) AS run_fold, CAST(rung AS INTEGER) AS rung, CAST(cands[rung + 1] AS BIGINT) AS n_candidates,
  CAST(least(n, first * CAST(pow(3, rung) AS BIGINT)) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS wrong
FROM tr, (VALUES ('LinearSVC', [20, 7, 3]), ('LogisticRegression', [12, 4, 2])) m(model, cands), (SELECT unnest([0, 1, 2]) AS rung)
WHERE rung = 0 OR first * pow(3, rung) <= n"""


# --- the whole loop --------------------------------------------------------------------

# Settings searched per run and fitted model; halving_rungs searches all twenty.
LOOP = {"sizes": (5, 10), "methods": ["Scaling", "SMOTE", "ADASYN"], "scales": [2], "candidates": 4}


def experiment_ledger(spark, sf):
    """The loop of five models over ten folds and two seed sizes, tuned, with three generators: ledger and outcomes.

    ``accuracy`` is given for the plain neighbour vote; ``pending`` is what the same grid still lacks.
    """
    path, told = fresh_path(spark, "experiment"), fresh_path(spark, "outcomes")
    skipped = experiment.run_experiment(
        tb.sequences(spark, sf), "embeddings", LOOP["sizes"], 1, LOOP["methods"], LOOP["scales"], lambda rows: ledger_io.append_results(rows, path),
        "sequence", tuned=True, model_names=grid.MODELS, candidates=LOOP["candidates"], write_outcomes=lambda rows: rows.write.mode("append").parquet(told),
    )
    if skipped:
        raise RuntimeError(f"skipped: {skipped}")
    led = ledger_io.read_ledger(spark, path)
    spec = grid.GridSpec(selections=1, seed_sizes=LOOP["sizes"], scales=tuple(LOOP["scales"]), min_seeds=tuple((m, grid.METHOD_MIN_SEEDS[m]) for m in LOOP["methods"]))
    left = grid.pending(grid.experiment_grid(led.select("Dataset").distinct(), spec), led).count()
    why = spark.read.parquet(told).select(
        F.col("run_fold").alias("Fold"), F.col("n_seeds").alias("SeedsPerLabel"), F.col("scale_factor").alias("ScaleFactor"), F.col("model").alias("Model"), F.col("method").alias("Method"), "outcome"
    )
    keys = ["Fold", "SeedsPerLabel", "ScaleFactor", "Model", "Method"]
    sane = F.col("Accuracy").between(0, 1) & F.col("F1_Score").between(0, 1) & (F.col("ExecutionTime_Sec") > 0) & F.col("Hyperparameters").isNotNull()
    sane = F.when(F.col("Accuracy").isNotNull(), sane)
    plain = F.when((F.col("Model") == "KNN") & (F.col("Method") == "Baseline"), tb.r6("Accuracy"))
    return why.join(led, keys, "left").select(*keys, "outcome", sane.alias("sane"), plain.alias("accuracy"), F.lit(left).cast("bigint").alias("pending"))


Q["experiment_ledger"] = experiment_ledger
_EVERY = "[" + ", ".join(f"'{m}'" for m in grid.MODELS) + "]"
SQL["experiment_ledger"] = f"""{_RUNS('[5, 10]', 1)},
bp AS ({_VEC('tr0', _ID0, 'c, t')}), tp AS ({_VEC('te', 'CAST(id AS VARCHAR)', 'c, t')}),
sc AS ({_RUN_SCORE.replace('kn AS', 'WITH kn AS', 1)})
SELECT CAST(f AS INTEGER) AS "Fold", CAST(s AS INTEGER) AS "SeedsPerLabel", CAST(x AS INTEGER) AS "ScaleFactor", m AS "Model", g AS "Method",
  CASE WHEN s >= least_seeds THEN 'ok' ELSE 'seed size below gate' END AS outcome, CASE WHEN s >= least_seeds THEN true END AS sane,
  CASE WHEN m = 'KNN' AND g = 'Baseline' THEN accuracy END AS accuracy, CAST(0 AS BIGINT) AS pending
FROM (SELECT unnest(range(1, 11)) AS f), (SELECT unnest([5, 10]) AS s), (SELECT unnest({_EVERY}) AS m),
  (VALUES ('Baseline', 1, 1), ('Tuned_Baseline', 1, 1), ('Scaling', 2, 1), ('SMOTE', 2, 3), ('ADASYN', 2, 10)) w(g, x, least_seeds)
  JOIN sc ON sc.run_fold = f AND sc.n_seeds = s"""
