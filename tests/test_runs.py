"""What a run gets must not depend on the other runs of its batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from odorframe.functions import draws
from checks import fitted
from odorframe.operators import augment, fits, models, oversample
from odorframe.operators.neighbors import knn_join
from odorframe.plans import experiment

SCHEMA = "run_fold int, selection int, n_seeds int, measurement_id string, label string, x array<array<double>>"


def run_rows(fold, gap, sizes=(12, 12)):
    rng = np.random.default_rng(fold)
    rows = []
    for c, n in enumerate(sizes):
        rows += [(fold, 1, 10, f"m{c}|{i}", "ab"[c], rng.normal(c * gap, 1.0, (2, 3)).tolist()) for i in range(n)]
    return rows


@pytest.fixture(scope="module")
def batch(spark):
    """Run 1 is mixed, run 2 has a class of one member, run 3 has separated classes, run 4 a class of three."""
    rows = run_rows(1, 0.5) + run_rows(2, 0.5, (12, 1)) + run_rows(3, 1000.0) + run_rows(4, 0.5, (12, 3))
    return spark.createDataFrame(rows, SCHEMA).cache()


def grown(seeds, method):
    out = {}
    for r in experiment.generate_runs(seeds, method, 3).collect():
        out.setdefault(r["run_fold"], set()).add((r["measurement_id"], r["label"], r["copy"], str(r["x"])))
    return out


@pytest.mark.parametrize("method", ["SMOTE", "ADASYN"])
def test_runs_do_not_touch_each_other(batch, method):
    together = grown(batch, method)
    for fold in (1, 2, 3, 4):
        assert together.get(fold) == grown(batch.filter(F.col("run_fold") == fold), method).get(fold)
    assert len([r for r in together[1] if r[2] > 0]) > 0
    assert len([r for r in together[2] if r[2] > 0]) == 0
    assert (3 in together) == (method == "SMOTE")
    assert all(r[0].count("|") == 1 for rows in together.values() for r in rows)


def test_outcomes_tell_why(batch):
    why = lambda m: {r["run_fold"]: r["outcome"] for r in experiment.run_outcomes(batch, m, 3).collect()}
    assert why("SMOTE") == {1: "ok", 2: oversample.ALONE, 3: "ok", 4: "ok"}
    got = why("ADASYN")
    assert (got[2], got[3]) == (oversample.ALONE, oversample.NO_HARD) and got[1] == "ok"
    assert set(why("TimeVAE").values()) == {"seed size below gate"}


def test_lengths_come_from_the_data(spark):
    ragged = spark.createDataFrame([(1, "a", [[1.0, 2.0], [1.0]])], "measurement_id long, label string, x array<array<double>>")
    for make in (augment.magnitude_warping, augment.time_warping, augment.permutation, augment.window_slicing):
        with pytest.raises(ValueError, match="one length"):
            make(ragged)
    even = spark.createDataFrame([(1, "a", [[float(i) for i in range(37)]] * 2)], "measurement_id long, label string, x array<array<double>>")
    for make in (augment.magnitude_warping, augment.time_warping, augment.permutation, augment.window_slicing):
        for r in make(even, 3).collect():
            assert [len(c) for c in r["x"]] == [37, 37] and None not in r["x"][0]


@pytest.mark.parametrize("alpha", [0.01, 0.2, 1.0, 4.0])
def test_beta_has_its_moments(spark, alpha):
    got = np.array([r[0] for r in spark.range(20_000).select(draws.beta_symmetric(alpha, 1, "t", "id")).collect()])
    assert ((got >= 0) & (got <= 1)).all() and (got == 0.5).mean() < 0.001
    assert abs(got.mean() - 0.5) < 0.015 and abs(got.var() - 0.25 / (2 * alpha + 1)) < 0.01


def test_group_keys_do_not_collide(spark):
    probe = spark.createDataFrame([("a|b", "c", 1, [0.0])], "p string, q string, probe_id long, v array<double>")
    build = spark.createDataFrame([("a", "b|c", 2, [0.0]), ("a|b", "c", 3, [1.0])], "p string, q string, build_id long, v array<double>")
    for options in ({}, {"tile_rows": 8}):
        assert [r["build_id"] for r in knn_join(probe, build, 1, within=["p", "q"], **options).collect()] == [3]


def test_small_and_tiled_joins_agree(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i % 3), i, rng.integers(0, 4, 3).astype(float).tolist()) for i in range(150)]
    probe = spark.createDataFrame(rows, "g int, probe_id long, v array<double>")
    build = spark.createDataFrame(rows, "g int, build_id long, v array<double>")
    find = lambda **o: sorted((r["probe_id"], r["ordinal"], r["build_id"]) for r in knn_join(probe, build, 4, within=["g"], skip_self=True, **o).collect())
    assert find() == find(tile_rows=16) == find(tile_rows=16, pivots=5)


def test_models_of_the_baseline_runs_share_packed_rows(spark, monkeypatch):
    """Rows are packed twice (seeds and held-out rows), not twice a model."""
    packed, used = [], []

    def pack(rows, run):
        packed.append(rows)
        return rows

    def fit_runs(name, train, test, unit, settings=None, cap=100_000, seed=42, blocks=None, probes=None):
        blocks = experiment.train_blocks(train, unit, cap, seed) if blocks is None else blocks
        probes = experiment.test_blocks(test, unit) if probes is None else probes
        used.append((blocks, probes))
        empty = ", ".join([*[f"{c} int" for c in experiment.RUN], "n_test long, accuracy double, f1 double, params string, fit_seconds double, predict_seconds double, error string"])
        return spark.createDataFrame([], empty)

    monkeypatch.setattr(experiment.fits, "pack", pack)
    monkeypatch.setattr(experiment, "fit_runs", fit_runs)
    monkeypatch.setattr(fitted, "SIZES", (1,))
    assert fitted.fitted_baseline_runs(spark, "/root/testdata/sf0.001").columns[:4] == [*experiment.RUN, "model"]
    assert len(packed) == 2 and len(used) == len(fitted.FITTED)
    assert all(b is used[0][0] and p is used[0][1] for b, p in used)


def test_few_models_go_to_the_blocks_many_are_joined_by_shuffle(spark, batch, monkeypatch):
    rows = batch.select(*experiment.RUN, F.col("measurement_id").alias("row_id"), "label", F.flatten("x").alias("v"))
    blocks = fits.pack(rows, experiment.RUN)
    found = fits.fit("LogisticRegression", blocks, models.settings_for(blocks, experiment.RUN), experiment.RUN)
    few = fits.predict("LogisticRegression", found, blocks, experiment.RUN)
    monkeypatch.setattr(fits, "SENT_BYTES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = fits.predict("LogisticRegression", found, blocks, experiment.RUN)
        told = lambda df: sorted(tuple(r)[:-1] for r in df.collect())
        assert told(few) == told(many) and few.count() > 40
        assert "Exchange hashpartitioning" not in few._jdf.queryExecution().toString()
        assert "Exchange hashpartitioning" in many._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
