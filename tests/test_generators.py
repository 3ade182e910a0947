import numpy as np
import pytest
from pyspark.sql import functions as F

from odorframe.operators import augment, mixture, oversample

STEPS = {"Magnitude_Warping", "Time_Warping", "Permutation", "Window_Slicing"}


def made(df):
    rows = df.collect()
    return [(r["measurement_id"], r["label"], r["copy"], r["source_id"], np.array(r["x"])) for r in rows]


@pytest.mark.parametrize(
    "method",
    ["Jittering", "Scaling", "Magnitude_Warping", "Time_Warping", "Permutation", "Window_Slicing", "Mixup", "SMOTE", "GMM", "HMM_GMM", "TimeVAE"],
)
def test_counts_shapes_and_originals(toy, method):
    params = {"steps": 20} if method in STEPS else {}
    out = made(augment.generate(toy, method, 3, **params))
    assert len(out) == 90
    for label in "ab":
        assert sum(r[1] == label for r in out) == 45
    assert all(r[4].shape == (3, 20) and np.isfinite(r[4]).all() for r in out)
    originals = {r["measurement_id"]: np.array(r["x"]) for r in toy.collect()}
    kept = [r for r in out if r[2] == 0]
    assert len(kept) == 30
    assert all(np.array_equal(r[4], originals[r[0]]) for r in kept)


def test_same_draws_under_any_partitioning(toy):
    key = lambda rows: sorted((r[0], r[2], r[4].round(12).tolist()) for r in rows)
    for method in ("Jittering", "Mixup", "SMOTE", "Time_Warping"):
        params = {"steps": 20} if method in STEPS else {}
        a = key(made(augment.generate(toy.coalesce(1), method, 2, **params)))
        b = key(made(augment.generate(toy.orderBy(F.rand(1)).repartition(7), method, 2, **params)))
        assert a == b


def test_jitter_and_scaling_statistics(spark):
    rows = [(i, "a", [[1.0] * 100]) for i in range(400)]
    df = spark.createDataFrame(rows, "measurement_id bigint, label string, x array<array<double>>")
    noise = np.array([r[4] for r in made(augment.jitter(df)) if r[2] == 1]).ravel() - 1.0
    assert abs(noise.mean()) < 0.001 and abs(noise.std() - 0.03) < 0.001
    factors = np.array([r[4][0] for r in made(augment.scaling(df)) if r[2] == 1])
    assert np.allclose(factors, factors[:, :1])
    assert abs(factors[:, 0].mean() - 1) < 0.02 and abs(factors[:, 0].std() - 0.1) < 0.015


def test_permutation_keeps_the_values(toy):
    originals = {r["measurement_id"]: np.array(r["x"]) for r in toy.collect()}
    moved = 0
    for r in made(augment.permutation(toy, 2, steps=20, min_segment=3)):
        assert np.array_equal(np.sort(r[4], axis=1), np.sort(originals[r[0]], axis=1))
        moved += not np.array_equal(r[4], originals[r[0]])
    assert moved > 15


def test_permutation_falls_back_to_equal_segments(spark):
    df = spark.createDataFrame([(1, "a", [[float(i) for i in range(8)]])], "measurement_id bigint, label string, x array<array<double>>")
    x = [r[4][0] for r in made(augment.permutation(df, 2, steps=8)) if r[2] == 1][0]
    assert sorted(tuple(x[i : i + 2]) for i in range(0, 8, 2)) == [(0, 1), (2, 3), (4, 5), (6, 7)]


def test_time_warping_stays_in_range_and_keeps_the_ends(toy):
    originals = {r["measurement_id"]: np.array(r["x"]) for r in toy.collect()}
    for r in made(augment.time_warping(toy, 2, steps=20)):
        o = originals[r[0]]
        assert (r[4] >= o.min(axis=1, keepdims=True) - 1e-9).all() and (r[4] <= o.max(axis=1, keepdims=True) + 1e-9).all()
        np.testing.assert_allclose(r[4][:, -1], o[:, -1])


def test_mixed_points_lie_between_class_members(toy):
    originals = {r["measurement_id"]: (r["label"], np.array(r["x"])) for r in toy.collect()}
    for method in ("Mixup", "SMOTE"):
        for r in made(augment.generate(toy, method, 3)):
            if r[2] == 0:
                continue
            base = originals[r[3]][1]
            assert originals[r[3]][0] == r[1]
            between = [
                (np.minimum(base, x) - 1e-9 <= r[4]).all() and (r[4] <= np.maximum(base, x) + 1e-9).all()
                for label, x in originals.values()
                if label == r[1]
            ]
            assert any(between)


def test_class_of_one(spark):
    df = spark.createDataFrame(
        [(1, "a", [[1.0, 2.0]]), (2, "b", [[3.0, 4.0]]), (3, "b", [[5.0, 6.0]])], "measurement_id bigint, label string, x array<array<double>>"
    )
    assert len(made(oversample.smote(df, 3))) == 3  # nothing to interpolate with
    alone = [r[4].tolist() for r in made(augment.mixup(df, 3)) if r[1] == "a"]
    assert alone == [[[1.0, 2.0]]] * 3


def test_adasyn_refuses_separated_classes(spark):
    rows = [(i, "a", [[float(i), 0.0]]) for i in range(8)] + [(100 + i, "b", [[1000.0 + i, 0.0]]) for i in range(8)]
    df = spark.createDataFrame(rows, "measurement_id bigint, label string, x array<array<double>>")
    with pytest.raises(ValueError, match="no hard samples"):
        oversample.adasyn(df, 2)
    assert {r["outcome"] for r in oversample.adasyn_outcome(df, 2).collect()} == {"no hard samples"}


def test_adasyn_one_member_may_owe_the_whole_class(spark, monkeypatch):
    monkeypatch.setattr(oversample, "CHUNK", 7)
    rows = [(i, "a", [[float(i), 0.0]]) for i in range(12)] + [(100 + i, "b", [[11.6 + 1000.0 * i, 0.0]]) for i in range(12)]
    df = spark.createDataFrame(rows, "measurement_id bigint, label string, x array<array<double>>")
    quota = {r["measurement_id"]: r["quota"] for r in oversample.adasyn_quota(df, 4).collect()}
    out = made(oversample.adasyn(df, 4))
    per = {}
    for r in out:
        if r[2] > 0:
            per[r[3]] = per.get(r[3], 0) + 1
    assert per == {m: q for m, q in quota.items() if q > 0}
    assert max(per.values()) > 7


def test_mixture_likelihood_does_not_fall(toy):
    params, paths = mixture.fit_gmm(toy)
    for label, path in paths.items():
        assert all(b >= a - 1e-6 for a, b in zip(path, path[1:])), label
    assert all(abs(p["weight"].sum() - 1) < 1e-9 for p in params.values())


def test_markov_likelihood_does_not_fall(toy):
    params, paths = mixture.fit_hmm(toy)
    for path in paths.values():
        assert all(b >= a - 0.5 for a, b in zip(path, path[1:]))  # priors and the floor may cost a little
    for p in params.values():
        assert np.allclose(p["trans"].sum(axis=1), 1) and (p["var"] >= mixture.MIN_COVAR).all()


def test_markov_forward_backward_against_enumeration():
    import itertools

    import pandas as pd

    rng = np.random.default_rng(2)
    x = rng.normal(size=(1, 4))
    p = {"start": np.array([0.3, 0.7]), "trans": np.array([[0.9, 0.1], [0.4, 0.6]]), "mean": np.array([[-0.5], [0.8]]), "var": np.array([[1.0], [0.5]])}
    s = mixture._hmm_statistics({"a": p})("a", pd.Series([x]))
    dens = lambda k, v: np.exp(-0.5 * (v - p["mean"][k, 0]) ** 2 / p["var"][k, 0]) / np.sqrt(2 * np.pi * p["var"][k, 0])
    total, post = 0.0, np.zeros(2)
    for path in itertools.product((0, 1), repeat=4):
        w = p["start"][path[0]] * dens(path[0], x[0, 0])
        for t in range(1, 4):
            w *= p["trans"][path[t - 1], path[t]] * dens(path[t], x[0, t])
        total += w
        for k in path:
            post[k] += w
    assert np.isclose(s[-1], np.log(total))
    np.testing.assert_allclose(s[6:8], post / total)


def test_fitted_samples_follow_the_class(toy):
    for method in ("GMM", "HMM_GMM", "TimeVAE"):
        out = [r for r in made(augment.generate(toy, method, 10)) if r[2] > 0]
        for label, sign in (("a", 1.0), ("b", -1.0)):
            mean = np.mean([r[4][1] for r in out if r[1] == label])
            assert np.sign(mean) == sign and 0.25 < abs(mean) < 0.8, method


def test_registry_takes_new_generators(toy):
    augment.register("Same", lambda seqs, scale_factor, seed: augment.copies(seqs, scale_factor, "Same"))
    assert augment.generate(toy, "Same", 4).count() == 120
