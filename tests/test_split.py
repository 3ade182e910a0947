import pytest
from pyspark.sql import functions as F

from odorframe.operators import scale, split


@pytest.fixture(scope="module")
def groups(spark):
    """A label with most measurements, a small one and one with three."""
    rows = [(i, "hot") for i in range(700)] + [(i, "mid") for i in range(700, 790)] + [(i, "rare") for i in range(790, 793)]
    return spark.createDataFrame(rows, "measurement_id bigint, label string")


def test_folds_are_disjoint_balanced_and_stable(spark, groups):
    base = None
    for parts in ("1", "4", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r["measurement_id"]: r["fold"] for r in split.assign_folds(groups.orderBy(F.rand(int(parts)))).collect()}
        base = base or got
        assert got == base
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(base) == 793 and set(base.values()) == set(range(1, 11))
    for ids in (range(700), range(700, 790), range(790, 793), range(793)):
        n = [sum(base[i] == f for i in ids) for f in range(1, 11)]
        assert max(n) - min(n) <= 1


def test_other_seed_gives_other_folds(groups):
    a = {r["measurement_id"]: r["fold"] for r in split.assign_folds(groups, seed=1).collect()}
    b = {r["measurement_id"]: r["fold"] for r in split.assign_folds(groups, seed=2).collect()}
    assert a != b


def test_seed_sets_are_nested_and_from_training_folds(groups):
    folds = split.assign_folds(groups, 5)
    fold_of = {r["measurement_id"]: r["fold"] for r in folds.collect()}
    sets = {}
    for r in split.seed_sets(folds, (1, 2, 5, 10), 2, 5).collect():
        assert fold_of[r["measurement_id"]] != r["run_fold"]
        sets.setdefault((r["run_fold"], r["selection"], r["label"]), {}).setdefault(r["n_seeds"], set()).add(r["measurement_id"])
        assert r["n_available"] == sum(
            f != r["run_fold"] for m, f in fold_of.items() if (m < 700) == (r["label"] == "hot") and (m >= 790) == (r["label"] == "rare")
        )
    assert len(sets) == 5 * 2 * 3
    for (_, _, label), by in sets.items():
        assert by[1] < by[2] < by[5] or label == "rare"
        assert by[1] <= by[2] <= by[5] <= by[10]
        assert len(by[5]) == 5 or label == "rare"
    assert sets[(1, 1, "hot")][5] != sets[(1, 2, "hot")][5]


def test_cap_keeps_everything_below_and_exactly_the_cap_above(groups):
    assert split.cap_rows(groups, ["measurement_id"], 10_000).count() == 793
    assert split.cap_rows(groups, ["measurement_id"], 100).count() == 100
    by = split.cap_rows(groups, ["measurement_id"], 50, run=["label"]).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in by} == {"hot": 50, "mid": 50, "rare": 3}


def test_cv_folds(groups):
    sets = split.seed_sets(split.assign_folds(groups, 5), (1, 2, 10), 1, 5)
    for r in split.cv_folds(sets).collect():
        assert r["cv_k"] == {1: 2, 2: 2, 10: 5}[r["n_seeds"]]
        assert 1 <= r["cv_fold"] <= r["cv_k"]
        assert r["grouped"] == (r["n_seeds"] > 1)


def test_scaler_gives_mean_zero_and_std_one(spark):
    rows = [(1, i, [[float(i), float(i * i)], [5.0, 5.0]]) for i in range(9)]
    df = spark.createDataFrame(rows, "run int, measurement_id int, x array<array<double>>")
    scaler = scale.fit_scaler(df, ["run"])
    assert scaler.first()["std"][1] == 1.0  # a constant channel is left at its size
    cells = [c for r in scale.apply_scaler(df, scaler, ["run"]).collect() for c in r["x"][0]]
    assert abs(sum(cells)) < 1e-9 and abs(sum(c * c for c in cells) / len(cells) - 1) < 1e-9
