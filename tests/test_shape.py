import numpy as np
import pytest
from pyspark.sql import functions as F

from odorframe.functions.arrays import spline_basis
from odorframe.operators import shape

SCHEMA = "measurement_id bigint, time double, seq bigint, label string, a double, b double"


def points(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def sequences(df, n, block=10.0):
    out = shape.to_sequences(df, ["a", "b"], block, n).collect()
    return {r["measurement_id"]: (r["label"], np.array(r["x"])) for r in out}


def test_single_row_becomes_constant(spark):
    got = sequences(points(spark, [(1, 0.0, 0, "x", 2.5, None)]), 5)
    label, x = got[1]
    assert label == "x"
    assert x[0].tolist() == [2.5] * 5
    assert x[1].tolist() == [0.0] * 5


def test_same_length_passes_through(spark):
    rows = [(1, float(t), t, "x", float(t * t), float(-t)) for t in range(7)]
    _, x = sequences(points(spark, rows), 7)[1]
    assert x[0].tolist() == [float(t * t) for t in range(7)]


def test_one_step_takes_the_first_row(spark):
    rows = [(1, float(t), t, "x", float(t + 3), 1.0) for t in range(4)]
    _, x = sequences(points(spark, rows), 1)[1]
    assert x[0].tolist() == [3.0]


@pytest.mark.parametrize("n", [2, 8, 100])
@pytest.mark.parametrize("length", [2, 3, 99, 100, 101, 250])
def test_matches_linear_interpolation(spark, n, length):
    v = np.random.default_rng(length).normal(size=length)
    rows = [(1, float(t), t, "x", float(v[t]), 0.0) for t in range(length)]
    _, x = sequences(points(spark, rows), n)[1]
    want = np.interp(np.linspace(0, 1, n), np.linspace(0, 1, length), v)
    np.testing.assert_allclose(x[0], want, atol=1e-9)


def test_gaps_are_filled_across_blocks(spark):
    a = [None, None, 1.0, None, float("nan"), None, 5.0, None]
    rows = [(1, float(t), t, "x", a[t], None) for t in range(8)]
    for block in (0.5, 1.0, 3.0, 100.0):
        got = shape.shape_points(points(spark, rows), ["a", "b"], block).orderBy("pos").collect()
        assert [r["a"] for r in got] == [1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 5.0, 5.0]
        assert [r["b"] for r in got] == [0.0] * 8
        assert [r["pos"] for r in got] == list(range(8))


def test_only_one_direction(spark):
    a = [None, 1.0, None, 2.0, None]
    df = points(spark, [(1, float(t), t, "x", a[t], None) for t in range(5)])
    ffill = [r["a"] for r in shape.shape_points(df, ["a"], 2.0, "ffill").orderBy("pos").collect()]
    bfill = [r["a"] for r in shape.shape_points(df, ["a"], 2.0, "bfill").orderBy("pos").collect()]
    assert ffill == [None, 1.0, 1.0, 2.0, 2.0]
    assert bfill == [1.0, 1.0, 2.0, 2.0, None]


def test_block_width_partitions_and_order_do_not_matter(spark):
    rng = np.random.default_rng(0)
    # Measurement 1 holds most rows, as a hot key would.
    rows = [(1, float(t), t, "hot", float(rng.normal()) if t % 5 else None, 1.0) for t in range(3000)]
    rows += [(m, float(t), t, "cold", float(m + t), 0.0) for m in range(2, 12) for t in range(10)]
    df = points(spark, rows)
    base = None
    for parts, block in ((1, 1e9), (4, 64.0), (50, 7.0)):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = sequences(df.orderBy(F.rand(parts)).repartition(parts), 50, block)
        if base is None:
            base = got
        for m in base:
            np.testing.assert_allclose(got[m][1], base[m][1], atol=1e-12)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_label_is_the_first_in_time(spark):
    rows = [(1, 5.0, 0, "late", 1.0, 1.0), (1, 1.0, 1, "second", 1.0, 1.0), (1, 1.0, 0, "first", 1.0, 1.0)]
    assert sequences(points(spark, rows), 3)[1][0] == "first"


def test_rows_without_measurement_are_dropped(spark):
    rows = [(None, 1.0, 0, "x", 1.0, 1.0), (1, 1.0, 0, "x", 1.0, 1.0)]
    assert list(sequences(points(spark, rows), 3)) == [1]


def test_unknown_imputation_is_refused(spark):
    with pytest.raises(ValueError):
        shape.shape_points(points(spark, [(1, 0.0, 0, "x", 1.0, 1.0)]), ["a"], 1.0, "mean")


def test_spline_basis_reproduces_cubics():
    for steps, knots in ((100, 6), (64, 6), (20, 4)):
        basis = spline_basis(steps, knots)
        t, k = np.arange(steps), np.linspace(0, steps - 1, knots)
        cubic = lambda z: 1 + 0.5 * z - 0.02 * z**2 + 0.0003 * z**3
        np.testing.assert_allclose(basis @ cubic(k), cubic(t), rtol=1e-10, atol=1e-9)
        np.testing.assert_allclose(basis.sum(axis=1), 1.0, atol=1e-12)
