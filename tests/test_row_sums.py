"""Sums over the rows of linear fits against the same sums without Spark."""

import numpy as np

from checks import fitted

ROWS = "label string, v array<double>, cv_fold int"
WEIGHTS = "candidate int, fold int, label string, weights array<double>"


def test_sums_of_a_logistic_fit(spark):
    rng = np.random.default_rng(3)
    x, y, cv = rng.normal(size=(60, 3)), rng.integers(0, 3, 60), rng.integers(1, 3, 60)
    w = rng.normal(size=(3, 4))
    rows = spark.createDataFrame([("abc"[c], v.tolist(), int(f)) for v, c, f in zip(x, y, cv)], ROWS).repartition(4)
    weights = spark.createDataFrame([(0, 1, "abc"[i], w[i].tolist()) for i in range(3)], WEIGHTS)
    got = {(r["label"], r["j"]): (r["n"], r["g"], r["total"]) for r in fitted._row_sums(rows, weights, fitted._shares).collect()}
    ones = np.c_[x, np.ones(60)][cv != 1]
    e = np.exp(ones @ w.T)
    p = e / e.sum(axis=1, keepdims=True)
    g = (p - (y[cv != 1][:, None] == np.arange(3))).T @ ones
    for (label, j), (n, slope, total) in got.items():
        c = "abc".index(label)
        assert n == len(ones) and abs(slope - g[c, j]) < 1e-9 and abs(total - p[:, c].sum()) < 1e-9
    assert len(got) == 12


def test_rows_without_fits_give_no_sums(spark):
    rows = spark.createDataFrame([("a", [1.0], 1), ("b", [1.0, 2.0], 2), ("b", None, 2)], ROWS)
    assert fitted._row_sums(rows, spark.createDataFrame([], WEIGHTS), fitted._shares).count() == 0
