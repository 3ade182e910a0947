import json

import pytest
from conftest import SF
from pyspark.sql import functions as F

from checks import tables as tb
from odorframe.operators import evaluate, models, split, tune
from odorframe.plans import experiment, grid, ledger
from odorframe.sources import ledger_io

NAMES = ledger_io.LEDGER_SCHEMA.names


def led(spark, rows):
    """Rows (dataset, fold, seeds, selection, scale, model, method, accuracy)."""
    full = [(*r[:8], r[7], "p", 1.0) for r in rows]
    return spark.createDataFrame(full, ledger_io.LEDGER_SCHEMA)


def test_baseline_falls_back_per_group(spark):
    df = led(
        spark,
        [
            ("D", 1, 5, 1, 1, "KNN", "Baseline", 0.1),
            ("D", 1, 5, 1, 1, "KNN", "Tuned_Baseline", 0.2),
            ("D", 1, 10, 1, 1, "KNN", "Baseline", 0.3),
            ("D", 1, 5, 1, 2, "KNN", "SMOTE", 0.5),
            ("D", 1, 10, 1, 2, "KNN", "SMOTE", 0.5),
            ("D", 2, 5, 1, 2, "KNN", "SMOTE", 0.9),
        ],
    )
    avg = ledger.average_selections(df)
    best = {r["SeedsPerLabel"]: (r["Method"], r["Accuracy"]) for r in ledger.best_baseline(avg).collect()}
    assert best == {5: ("Tuned_Baseline", 0.2), 10: ("Baseline", 0.3)}
    change = {(r["Fold"], r["SeedsPerLabel"]): round(r["Accuracy_Change"], 9) for r in ledger.accuracy_change(avg).collect()}
    assert change == {(1, 5): 0.3, (1, 10): 0.2}  # fold 2 has no baseline and drops out


def test_anchor_is_global(spark):
    rows = [("D", 1, 5, 1, 1, "KNN", "Baseline", 0.1), ("D", 1, 5, 1, 3, "KNN", "GMM", 0.7), ("D", 1, 5, 1, 3, "KNN", "SMOTE", 0.6)]
    curve = lambda df: {
        (r["Method"], r["SeedsPerLabel"], r["ScaleFactor"]): r["Accuracy"] for r in ledger.scaling_curve(df).collect()
    }
    plain = led(spark, rows)
    assert curve(plain) == {("GMM", 5, 1): 0.1, ("SMOTE", 5, 1): 0.1, ("GMM", 5, 3): 0.7, ("SMOTE", 5, 3): 0.6}
    # One tuned row anywhere switches the anchor everywhere.
    tuned = led(spark, [*rows, ("E", 1, 9, 1, 1, "KNN", "Tuned_Baseline", 0.4)])
    assert curve(tuned) == {("GMM", 9, 1): 0.4, ("SMOTE", 9, 1): 0.4, ("GMM", 5, 3): 0.7, ("SMOTE", 5, 3): 0.6}


def test_average_without_selections_is_unchanged(spark):
    df = led(spark, [("D", 1, 5, 1, 1, "KNN", "Baseline", 0.1)]).drop("SeedFoldSelection")
    assert ledger.average_selections(df) is df


def test_dedup_keeps_the_latest(spark):
    df = led(spark, [("D", 1, 5, 1, 1, "KNN", "Baseline", a) for a in (0.1, 0.9, 0.5)])
    got = ledger.dedup(df.withColumn("at", F.col("Accuracy")), F.col("at")).collect()
    assert [r["Accuracy"] for r in got] == [0.9]


def test_grid_size(spark):
    names = spark.createDataFrame([("a",), ("b",)], "Dataset string")
    full = grid.experiment_grid(names)
    assert full.count() == 2 * 10 * 10 * 750
    assert full.distinct().count() == full.count()
    assert grid.subset(full, ["a"], [1], [1], 1).count() == 4 * 4 * 5 + 10
    assert full.filter((F.col("Method") == "TimeVAE") & (F.col("SeedsPerLabel") <= 10)).count() == 0


def test_scores_against_hand_values(spark):
    rows = [(1, "a", "a"), (1, "a", "b"), (1, "b", "b"), (1, "b", "c"), (2, "a", "a")]
    got = {r["run"]: r for r in evaluate.scores(spark.createDataFrame(rows, "run int, label string, prediction string"), ["run"]).collect()}
    # run 1: a has precision 1 and recall 1/2, b precision 1/2 and recall 1/2, c no support
    assert got[1]["accuracy"] == 0.5 and got[1]["f1"] == pytest.approx((2 * (2 / 3) + 2 * 0.5) / 4)
    assert got[2]["accuracy"] == 1.0 and got[2]["f1"] == 1.0


def test_rungs():
    assert tune.rungs(20, 100_000, 5, 10) == [(20, 100), (7, 300), (3, 900)]
    assert tune.rungs(20, 250, 5, 10) == [(20, 100)]
    assert tune.rungs(12, 1000, 5, 10) == [(12, 100), (4, 300), (2, 900)]


def test_space_sizes():
    assert {m: len(tune.combinations(s)) for m, s in models.SPACES.items()} == {
        "KNN": 102, "RandomForest": 24, "LinearSVC": 24, "LogisticRegression": 12, "RNN": 12,
    }


def test_candidates_do_not_repeat(spark):
    runs = spark.createDataFrame([(1,), (2,)], "run int")
    rows = tune.candidates(runs, ["run"], "KNN").collect()
    per = {k: [json.dumps(r["params"], sort_keys=True) for r in rows if r["run"] == k] for k in (1, 2)}
    assert all(len(v) == 20 == len(set(v)) for v in per.values())
    assert per[1] != per[2]
    assert tune.candidates(runs, ["run"], "LogisticRegression").count() == 2 * 12


def points_of(toy):
    """Toy sequences as rows with cross-validation folds."""
    folds = split.assign_folds(split.measurements(toy), 3).withColumnRenamed("fold", "cv_fold")
    return folds.join(toy.drop("label"), "measurement_id").select(
        F.lit(1).alias("run"), F.col("measurement_id").alias("row_id"), F.lit(3).alias("cv_k"), "cv_fold", "label", F.flatten("x").alias("v")
    )


def test_halving_knn_finds_a_good_setting(spark, toy):
    space = tune.candidates(spark.createDataFrame([(1,)], "run int"), ["run"], "KNN")
    best = tune.halving_knn(points_of(toy), ["run"], space).collect()
    assert len(best) == 1 and best[0]["accuracy"] > 0.9 and best[0]["n_rows"] == 12


def test_halving_fits_finds_a_good_setting(spark, toy):
    space = tune.candidates(spark.createDataFrame([(1,)], "run int"), ["run"], "LogisticRegression")
    best = tune.halving_fits("LogisticRegression", points_of(toy), ["run"], space).collect()
    assert len(best) == 1 and best[0]["accuracy"] > 0.9 and best[0]["params"]["solver"] == "lbfgs"


@pytest.mark.parametrize("name", ["RandomForest", "LogisticRegression", "LinearSVC", "RNN"])
def test_models_separate_the_toy_classes(toy, name):
    rows = points_of(toy)
    params = {"n_estimators": 10} if name == "RandomForest" else {"channels": 3, "lr": 0.01, "epochs": 30} if name == "RNN" else {}
    got = models.classify(name, rows.filter("cv_fold > 1"), rows.filter("cv_fold = 1"), ["run"], params)
    assert evaluate.scores(got, ["run"]).first()["accuracy"] >= 0.9


def test_whole_experiment(spark, toy, tmp_path):
    path = str(tmp_path / "ledger")
    skipped = experiment.run_experiment(
        toy, "toy", (1, 4), 1, ["Scaling", "Time_Warping", "SMOTE", "ADASYN"], [2],
        lambda rows: ledger_io.append_results(rows, path), k=3, method_params={"Time_Warping": {"steps": 20}},
    )
    got = ledger_io.read_ledger(spark, path)
    per = {(r["Method"], r["SeedsPerLabel"]): r["count"] for r in got.groupBy("Method", "SeedsPerLabel").count().collect()}
    assert per == {
        ("Baseline", 1): 3, ("Baseline", 4): 3, ("Scaling", 1): 3, ("Scaling", 4): 3,
        ("Time_Warping", 1): 3, ("Time_Warping", 4): 3, ("SMOTE", 4): 3,
    }
    assert skipped == [] and got.agg(F.min("Accuracy")).first()[0] > 0.5
    assert grid.pending(grid.experiment_grid(got, grid.GridSpec(folds=3, selections=1, seed_sizes=(1, 4), scales=(2,), models=("KNN",))), got).count() > 0


def test_tuned_experiment(spark, toy, tmp_path):
    path = str(tmp_path / "ledger")
    skipped = experiment.run_experiment(
        toy, "toy", (1, 3), 1, ["Mixup"], [2], lambda rows: ledger_io.append_results(rows, path), unit="point", k=2, tuned=True
    )
    got = ledger_io.read_ledger(spark, path)
    per = {(r["Method"], r["SeedsPerLabel"]): r["count"] for r in got.groupBy("Method", "SeedsPerLabel").count().collect()}
    assert skipped == []
    assert per == {
        ("Baseline", 1): 2, ("Baseline", 3): 2, ("Tuned_Baseline", 1): 2, ("Tuned_Baseline", 3): 2, ("Mixup", 3): 2,
    }
    settings = {(r["Fold"], r["SeedsPerLabel"], r["Method"]): json.loads(r["Hyperparameters"]) for r in got.collect()}
    for fold in (1, 2):
        assert settings[(fold, 3, "Mixup")] == settings[(fold, 3, "Tuned_Baseline")]
        assert set(settings[(fold, 1, "Tuned_Baseline")]) == {"n_neighbors", "weights", "metric"}


def test_one_setting_agrees_with_the_plain_vote(spark, toy):
    rows = points_of(toy)
    train = rows.filter("cv_fold > 1").select("run", F.col("row_id").alias("build_id"), "label", "v")
    test = rows.filter("cv_fold = 1").select("run", F.col("row_id").alias("probe_id"), "label", "v")
    for weights, metric in (("uniform", "euclidean"), ("distance", "manhattan")):
        params = F.create_map(*[F.lit(x) for x in ("n_neighbors", "4", "weights", weights, "metric", metric)])
        one = spark.range(1).select(F.lit(1).alias("run"), F.lit(0).alias("candidate"), params.alias("params"))
        a = tune.predict_settings(test.drop("label"), train, ["run"], ["run"], one).select("probe_id", "prediction")
        b = models.knn_classify(train, test, ["run"], 4, weights, metric).select("probe_id", "prediction")
        assert sorted(a.collect()) == sorted(b.collect())


def test_seeds_are_scaled_on_themselves(spark):
    seeds, test = experiment.run_tables(tb.sequences(spark, SF), (2,), 1)
    cells = seeds.select("run_fold", F.posexplode("x").alias("c", "v")).select("run_fold", "c", F.explode("v").alias("v"))
    for r in cells.groupBy("run_fold", "c").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect():
        assert abs(r["m"]) < 1e-9 and abs(r["s"] - 1) < 1e-9
    assert test.select("measurement_id").distinct().count() == test.count()
