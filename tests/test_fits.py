"""Keyed fits: optimality, independence of partitions, blocks and other runs, and failures that stay their own."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from odorframe.operators import fits, forest, linear, models, recurrent, tune

SCHEMA = "run int, row_id long, label string, v array<double>"
SETTING = "run int, candidate int, fold int, params map<string,string>"


def data(run, n=90, dim=4, classes=3, gap=1.0):
    rng = np.random.default_rng(run)
    centre = rng.normal(0, gap, (classes, dim))
    y = rng.integers(0, classes, n)
    return [(run, i, "abcdefgh"[c], (centre[c] + rng.normal(0, 1, dim)).tolist()) for i, c in enumerate(y.tolist())]


def arrays(rows):
    labels = sorted({r[2] for r in rows})
    return np.array([r[3] for r in rows]), np.array([labels.index(r[2]) for r in rows])


def solved(model, params, x, y):
    """The same rounds without Spark."""
    s = fits.SOLVERS[model].begin(params, {"n": len(x), "dim": x.shape[1], "classes": int(y.max()) + 1})
    keys = np.arange(len(x), dtype=np.uint64)
    while not s["done"]:
        s = fits.SOLVERS[model].advance(s, [fits.SOLVERS[model].partial(s, x, y, keys)])
    return s


def settings_of(name):
    return [{k: None if v is None else str(v) for k, v in c.items()} for c in tune.combinations(models.SPACES[name])]


def numeric_gradient(f, w):
    out = np.zeros(len(w))
    for i in range(len(w)):
        step = np.zeros(len(w))
        step[i] = 1e-6
        out[i] = (f(w + step) - f(w - step)) / 2e-6
    return out


def objective(setting, x, y, k):
    """The objective written out, without the module's sums."""

    def f(flat):
        w = flat.reshape(-1, x.shape[1] + 1)
        m = x @ w[:, :-1].T + w[:, -1]
        if setting.loss == "logistic":
            m = np.concatenate([np.zeros((len(x), 1)), m], axis=1) if k == 2 else m
            loss = np.log(np.exp(m).sum(axis=1)) - m[np.arange(len(y)), y]
            size = (w[:, :-1] ** 2).sum() / 2
        else:
            t = np.where(y[:, None] == np.arange(k), 1, -1)
            loss = (np.maximum(0, 1 - t * m) ** (2 if setting.loss == "squared_hinge" else 1)).sum(axis=1)
            size = (w**2).sum() / 2 if setting.penalty == "l2" else np.abs(w).sum()
        return loss.mean() + (size / (setting.c * len(x)) if setting.penalty else 0.0)

    return f


@pytest.mark.parametrize("classes", [2, 3])
@pytest.mark.parametrize("name", ["LogisticRegression", "LinearSVC"])
def test_every_setting_reaches_its_optimum(name, classes):
    x, y = arrays(data(1, classes=classes, gap=0.7))
    found = {}
    for params in settings_of(name):
        s = solved(name, params, x, y)
        setting = s["setting"]
        f = objective(setting, x, y, classes)
        w = s["x"]
        found[json.dumps(params, sort_keys=True)] = w
        if setting.loss == "hinge":
            assert -1e-9 <= linear.optimality(setting, s) <= 1e-3 * max(1.0, f(w))
        g = numeric_gradient(f, w) if setting.loss != "hinge" else None
        if setting.penalty == "l1":
            strength = 1 / (setting.c * len(x))
            smooth = numeric_gradient(lambda v: f(v) - strength * np.abs(v).sum(), w)
            assert np.abs(smooth[w != 0] + strength * np.sign(w[w != 0])).max(initial=0) < 1e-4
            assert np.abs(smooth[w == 0]).max(initial=0) <= strength + 1e-6
        elif g is not None:
            assert np.abs(g).max() < 1e-4
        # No nearby point is better.
        rng = np.random.default_rng(0)
        assert min(f(w + rng.normal(0, 1e-2, len(w))) for _ in range(50)) >= f(w) - 1e-4 * max(1.0, abs(f(w)))
    if name == "LinearSVC":
        # dual names a solver, not an objective: the same optimum
        assert len({w.tobytes() for w in found.values()}) == 18
    else:
        assert len({w.tobytes() for w in found.values()}) == 7  # C is idle without a penalty


def test_absolute_penalty_drops_features():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (300, 20))
    y = (x[:, 0] + 0.1 * rng.normal(0, 1, 300) > 0).astype(int)
    w = linear.coefficients((s := solved("LinearSVC", {"penalty": "l1", "loss": "squared_hinge", "C": "0.01"}, x, y))["setting"], s, 2)
    assert (w[:, 0] != 0).all() and (w == 0).mean() > 0.7


def test_gradient_of_the_recurrent_net():
    rng = np.random.default_rng(1)
    s = recurrent.begin({"channels": "3", "hidden_size": "5"}, {"n": 7, "dim": 12, "classes": 3})
    x, y = rng.normal(0, 1, (7, 12)), rng.integers(0, 3, 7)
    g = numeric_gradient(lambda w: recurrent.loss_gradient({**s, "w": w}, x, y)[0], s["w"])
    assert np.abs(g - recurrent.loss_gradient(s, x, y)[1]).max() < 1e-5


def test_rate_epochs_and_batches_change_the_recurrent_fit():
    x, y = arrays(data(2, 80, 8, 2, 2.0))
    fit = lambda **p: solved("RNN", {"channels": "2", "hidden_size": "8", **{k: str(v) for k, v in p.items()}}, x, y)
    runs = [fit(), fit(lr=0.0001), fit(epochs=3), fit(batch_size=8), fit(hidden_size=16)]
    assert len({r["w"].tobytes() for r in runs}) == 5
    assert fit()["iterations"] == 10 * 3 and fit(batch_size=8)["iterations"] == 10 * 10
    good = fit(lr=0.05, epochs=40)
    assert (recurrent.decide(recurrent.model(good), x) == y).mean() > 0.9


def plain_tree(x, y, rows, weight, node, tree, features, depth, split, leaf, max_depth):
    """A tree by trying every split point, with the module's draws of features."""
    k = int(y.max()) + 1
    share = np.bincount(y[rows], weights=weight[rows], minlength=k)
    value = share / share.sum()
    if len(rows) < split or (share > 0).sum() < 2 or (max_depth is not None and depth >= max_depth):
        return value
    drawn = np.argsort(forest.keyed(forest.keyed(np.array([tree]), np.array([node], np.uint64))[:, None], np.arange(x.shape[1])[None, :]), axis=1, kind="stable")[0, :features]
    best = None
    for f in drawn.tolist():
        found = np.unique(x[rows, f])
        for low, high in zip(found, found[1:]):
            left = x[rows, f] <= low
            if min(left.sum(), (~left).sum()) < leaf:
                continue
            sides = [np.bincount(y[rows[m]], weights=weight[rows[m]], minlength=k) for m in (left, ~left)]
            gain = sum((s**2).sum() / s.sum() for s in sides)
            if best is None or gain > best[0] + 1e-12:
                best = (gain, f, low, left)
    if best is None:
        return value
    _, f, low, left = best
    with np.errstate(over="ignore"):
        child = [forest.spread(np.array([np.uint64(node) * np.uint64(2) + np.uint64(b)], np.uint64))[0] for b in (0, 1)]
    return f, low, *(plain_tree(x, y, rows[m], weight, c, tree, features, depth + 1, split, leaf, max_depth) for m, c in ((left, child[0]), (~left, child[1])))


def same_tree(plain, tree, at, x):
    if isinstance(plain, np.ndarray):
        return tree["feature"][at] == -1 and np.allclose(plain, tree["value"][at])
    f, low, left, right = plain
    above = x[x[:, f] > low, f].min()
    inside = low <= tree["at"][at] < above + 1e-12
    return tree["feature"][at] == f and inside and same_tree(left, tree, tree["left"][at], x) and same_tree(right, tree, tree["left"][at] + 1, x)


@pytest.mark.parametrize("params", [{}, {"min_samples_split": "5"}, {"min_samples_leaf": "3"}, {"max_depth": "2"}])
def test_forest_equals_trees_grown_split_by_split(params):
    x, y = arrays(data(5, 60, 5, 3, 1.0))
    grown = forest.model(solved("RandomForest", {"n_estimators": "6", **params}, x, y))
    keys = np.arange(len(x), dtype=np.uint64)
    for t, tree in enumerate(grown):
        w = forest.weights(keys, t, True)
        plain = plain_tree(x, y, np.flatnonzero(w), w, 1, t, 2, 0, int(params.get("min_samples_split", 2)), int(params.get("min_samples_leaf", 1)), int(params["max_depth"]) if "max_depth" in params else None)
        # Bins are halfway between values of all rows, so a split may lie anywhere between a node's own.
        assert same_tree(plain, tree, 0, x)


def test_forest_learns_and_lots_do_not_matter(monkeypatch):
    x, y = arrays(data(6, 300, 6, 4, 2.0))
    whole = forest.model(solved("RandomForest", {"n_estimators": "20"}, x[:200], y[:200]))
    assert (forest.decide(whole, x[200:]) == y[200:]).mean() > 0.8
    monkeypatch.setattr(forest, "ROUND_ENTRIES", 1)
    lots = forest.model(solved("RandomForest", {"n_estimators": "20"}, x[:200], y[:200]))
    assert all((a["at"] == b["at"]).all() and (a["feature"] == b["feature"]).all() for a, b in zip(whole, lots))


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(data(1) + data(2, 40, 4, 2) + data(3, 70, 4, 5), SCHEMA).withColumn("cv_fold", (F.col("row_id") % 3 + 1).cast("int")).cache()


ASKED = {
    "LogisticRegression": [{"C": "1.0", "max_iter": "5"}, {"C": "0.01", "max_iter": "5"}],
    "LinearSVC": [{"C": "1.0", "loss": "hinge", "penalty": "l2"}, {"C": "0.1", "loss": "squared_hinge", "penalty": "l1"}],
    "RandomForest": [{"n_estimators": "5"}],
    "RNN": [{"hidden_size": "4", "epochs": "2", "channels": "2"}],
}


def asked(spark, name, runs=(1, 2, 3)):
    rows = [(r, c, f, p) for r in runs for c, p in enumerate(ASKED[name]) for f in (None, 2)]
    return spark.createDataFrame(rows, SETTING)


def predictions(name, table, spark, block_values=fits.BLOCK_VALUES, runs=(1, 2, 3)):
    blocks = fits.pack(table, ["run"], block_values)
    found = fits.fit(name, blocks, asked(spark, name, runs), ["run"])
    assert found.filter("error is not null").count() == 0
    return {(r["run"], r["candidate"], r["fold"], r["probe_id"]): r["prediction"] for r in fits.predict(name, found, blocks, ["run"]).collect()}


@pytest.mark.parametrize("name", sorted(ASKED))
def test_partitions_and_other_runs_do_not_matter(spark, table, name):
    first = predictions(name, table.repartition(1), spark)
    assert len(first) == (200 + 66) * len(ASKED[name])
    assert predictions(name, table.repartition(17, "row_id"), spark) == first
    alone = predictions(name, table.filter("run = 2"), spark, runs=(2,))
    assert alone == {k: v for k, v in first.items() if k[0] == 2}


@pytest.mark.parametrize("name", ["LogisticRegression", "RandomForest"])
def test_fits_over_several_blocks(spark, table, name):
    """Rounds as jobs give what rounds in one task give."""
    whole = predictions(name, table, spark)
    split = predictions(name, table, spark, block_values=150)
    same = np.mean([whole[k] == split[k] for k in whole])
    assert split.keys() == whole.keys() and same == 1.0
    if name == "RandomForest":
        assert predictions(name, table.repartition(5), spark, block_values=150) == split


def test_a_round_over_several_blocks_is_one_job(spark, table):
    """No job more per round: states stay with the driver, blocks where they are."""
    sc = spark.sparkContext
    blocks = fits.pack(table.filter("run = 1"), ["run"], 150)
    want = spark.createDataFrame([(1, c, None, {"C": str(c + 1.0)}) for c in range(3)], SETTING)
    sc.setJobGroup("rounds", "rounds")
    found = fits.fit("LogisticRegression", blocks, want, ["run"]).collect()
    jobs = len(sc.statusTracker().getJobIdsForGroup("rounds"))
    sc.setJobGroup("", "")
    assert len(found) == 3 and all(r["error"] is None for r in found)
    assert jobs < 2 * max(r["iterations"] for r in found) + 20


def test_rounds_of_linear_fits_are_no_queries(spark, table, monkeypatch):
    """Each query leaves its plan and figures in the driver; rounds are plain jobs."""
    blocks = fits.pack(table.filter("run = 1"), ["run"], 150)
    want = spark.createDataFrame([(1, 0, None, {"C": "0.01", "loss": "hinge", "penalty": "l2"})], SETTING)
    asked, collect = [], type(blocks).collect
    monkeypatch.setattr(type(blocks), "collect", lambda df: asked.append(1) or collect(df))
    found = collect(fits.fit("LinearSVC", blocks, want, ["run"]))
    assert found[0]["error"] is None and found[0]["iterations"] > 20
    assert len(asked) < 5


def test_an_epoch_over_several_blocks_is_one_pass(spark, table):
    """Jobs grow with the epochs, not with the steps."""
    sc = spark.sparkContext
    blocks = fits.pack(table.filter("run = 1"), ["run"], 150)
    want = spark.createDataFrame([(1, 0, None, {"epochs": "3", "batch_size": "4", "hidden_size": "4"})], SETTING)
    sc.setJobGroup("epochs", "epochs")
    found = fits.fit("RNN", blocks, want, ["run"]).collect()
    jobs = len(sc.statusTracker().getJobIdsForGroup("epochs"))
    sc.setJobGroup("", "")
    assert found[0]["error"] is None and found[0]["iterations"] > 40
    assert jobs < 40


def test_a_poisoned_run_is_told_and_the_others_go_on(spark, table):
    bad = [(4, 1, "a", [1.0, 2.0]), (4, 2, "b", [1.0]), (5, 1, "a", [1.0]), (5, 2, "a", [2.0]), (6, 1, "a", [float("nan")]), (6, 2, "b", [1.0]), (7, 1, None, [1.0]), (7, 2, "b", [2.0])]
    rows = table.drop("cv_fold").unionByName(spark.createDataFrame(bad, SCHEMA))
    for size in (fits.BLOCK_VALUES, 1):
        blocks = fits.pack(rows.filter("run > 1"), ["run"], size if size > 1 else 60)
        want = spark.createDataFrame([(r, 0, None, {"C": "1.0", "max_iter": "3"}) for r in range(2, 8)] + [(2, 1, None, {"C": "-1"}), (2, 2, None, {"penalty": "l3"})], SETTING)
        found = {(r["run"], r["candidate"]): r["error"] for r in fits.fit("LogisticRegression", blocks, want, ["run"]).collect()}
        assert found[(2, 0)] is None and found[(3, 0)] is None
        for key, word in {(4, 0): "lengths", (5, 0): "one class", (6, 0): "missing", (7, 0): "label", (2, 1): "positive", (2, 2): "penalty"}.items():
            assert word in found[key]


def test_halving_keeps_a_third_of_every_rung(spark, table):
    rows = table.withColumn("cv_k", F.lit(3))
    space = tune.candidates(table.select("run").distinct(), ["run"], "LinearSVC")
    assert space.count() == 60
    history = []
    best = tune.halving_fits("LinearSVC", rows, ["run"], space, history=history).collect()
    assert {r["run"] for r in best} == {1, 2, 3}
    first = {}
    for r in history[0].collect():
        first.setdefault(r["run"], []).append((-r["accuracy"], r["candidate"]))
    for run, scored in first.items():
        assert len(scored) == 20
        kept = {r["candidate"] for r in history[1].filter(F.col("run") == run).collect()} if len(history) > 1 else set()
        assert not kept or kept == {c for _, c in sorted(scored)[:7]}
