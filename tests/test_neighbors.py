import numpy as np
import pytest

from odorframe.operators import models, neighbors
from odorframe.operators.neighbors import knn_join


def brute(pv, bv, k, metric, skip_self=False, pg=None, bg=None):
    out = {}
    for i, p in enumerate(pv):
        d = np.abs(bv - p).sum(1) if metric == "manhattan" else np.sqrt(((bv - p) ** 2).sum(1))
        c = [(d[j], j) for j in range(len(bv)) if not (skip_self and i == j) and (pg is None or pg[i] == bg[j])]
        out[i] = [j for _, j in sorted(c)[:k]]
    return out


def collect(df):
    out = {}
    for r in df.orderBy("probe_id", "ordinal").collect():
        out.setdefault(r["probe_id"], []).append(r["build_id"])
    return out


def frame(spark, v, name, g=None):
    rows = [(i, (g[i] if g is not None else "-"), [float(z) for z in r]) for i, r in enumerate(v)]
    return spark.createDataFrame(rows, f"{name} bigint, g string, v array<double>")


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("pivots,tile", [(1, 2048), (1, 17), (8, 2048), (8, 13)])
def test_exact_for_any_tiling_and_pivots(spark, metric, pivots, tile):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 10, (6, 4))
    bv = centres[rng.integers(0, 6, 200)] + rng.normal(0, 1, (200, 4))
    pv = centres[rng.integers(0, 6, 60)] + rng.normal(0, 1, (60, 4))
    got = knn_join(frame(spark, pv, "probe_id"), frame(spark, bv, "build_id"), 4, metric=metric, tile_rows=tile, pivots=pivots)
    assert collect(got) == brute(pv, bv, 4, metric)


def test_groups_and_self(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(90, 3))
    g = ["hot" if i < 60 else f"g{i % 3}" for i in range(90)]
    got = knn_join(
        frame(spark, v, "probe_id", g), frame(spark, v, "build_id", g), 3, within=["g"], skip_self=True, tile_rows=16, pivots=4
    )
    assert collect(got) == brute(v, v, 3, "euclidean", True, g, g)


def test_equal_rows_go_by_id(spark):
    v = np.zeros((40, 2))
    got = knn_join(frame(spark, v, "probe_id"), frame(spark, v, "build_id"), 3, skip_self=True, tile_rows=7, pivots=3)
    assert collect(got) == brute(v, v, 3, "euclidean", True)


def test_fewer_rows_than_neighbors(spark):
    v = np.arange(6.0).reshape(3, 2)
    got = knn_join(frame(spark, v, "probe_id"), frame(spark, v, "build_id"), 5, skip_self=True, pivots=2)
    assert collect(got) == brute(v, v, 5, "euclidean", True)


def test_votes(spark):
    train = spark.createDataFrame(
        [(0, "b", [0.0]), (1, "a", [2.0]), (2, "a", [10.0]), (3, "b", [11.0])], "build_id bigint, label string, v array<double>"
    )
    test = spark.createDataFrame([(0, "a", [1.0]), (1, "b", [0.0])], "probe_id bigint, label string, v array<double>")
    got = {r["probe_id"]: r["prediction"] for r in models.knn_classify(train, test, k=2).collect()}
    assert got == {0: "a", 1: "a"}  # one vote each: the smaller label
    got = {r["probe_id"]: r["prediction"] for r in models.knn_classify(train, test, k=2, weights="distance").collect()}
    assert got == {0: "a", 1: "b"}  # a distance of 0 decides alone


def test_unknown_metric(spark):
    f = frame(spark, np.zeros((1, 1)), "probe_id")
    with pytest.raises(ValueError):
        knn_join(f, f.withColumnRenamed("probe_id", "build_id"), 1, metric="cosine")


def test_copies_of_a_row_do_not_grow_with_the_rows():
    """A row is sent once per opposite tile: about as many tiles for ten times the rows, within a task's memory."""
    from odorframe.operators import neighbors

    for rows in (100_000, 600_000, 1_900_000):
        assert -(-rows // neighbors.tile_size(rows, 64)) <= 40
    assert neighbors.tile_size(10**9, 64) * 64 <= neighbors.TILE_VALUES
    assert neighbors.tile_size(500, 10**6) == neighbors.TILE_ROWS


def test_rough_manhattan_ranks_like_the_exact_sums():
    """Single precision only proposes; offsets, copies, near copies and huge values end as the exact distances do."""
    rng = np.random.default_rng(3)
    few = rng.normal(size=(40, 16))
    near = np.repeat(few, 20, axis=0) + rng.normal(size=(800, 16)) * 1e-7
    for b in (rng.normal(size=(9000, 16)), few[rng.integers(0, 40, 800)], near, near + 1e6, rng.normal(size=(300, 16)) * 1e35):
        p = b[:70]
        want = neighbors.exact_distances(p, b, "manhattan")
        want[np.arange(70), np.arange(70)] = np.inf
        rows, cols, d = neighbors.nearest_in_tile(p, np.arange(70), b, np.arange(len(b)), 3, "manhattan", True)
        order = np.lexsort((np.broadcast_to(np.arange(len(b)), want.shape), want), axis=1)[:, :3]
        assert rows.tolist() == np.repeat(np.arange(70), 3).tolist() and np.allclose(d, np.take_along_axis(want, order, 1).ravel(), rtol=1e-12)
        d32, off = neighbors.RoughManhattan(b)(p)
        assert d32.dtype == np.float32 and (b.max() > 1e30 or (np.abs(d32 - neighbors.exact_distances(p, b, "manhattan")) <= off + 1e-9 * np.abs(b).max()).all())


def test_codes_leave_few_pairs_to_measure():
    """Bytes propose, with or without a known bound; offsets, copies, clusters, outliers and repeated ids end as the exact distances do."""
    rng = np.random.default_rng(4)
    plain = rng.normal(size=(1501, 16))
    tight = rng.normal(0, 5, (3, 16))[rng.integers(0, 3, 1501)] + rng.normal(size=(1501, 16)) * 1e-4
    far = plain * np.where(rng.random((1501, 1)) < 0.01, 1e6, 1)
    uneven = plain * np.array([1e4] + [1.0] * 15)
    for b in (plain, plain[rng.integers(0, 300, 1501)], tight, far, uneven, plain + 1e6, np.zeros((1501, 16)), plain[:, :1], np.round(plain[:, :5])):
        for bid in (np.arange(len(b)), np.arange(len(b)).astype(str)):
            p, pid = b[700:900], bid[700:900]
            want = neighbors.exact_distances(p, b, "manhattan")
            want[np.arange(200), np.arange(700, 900)] = np.inf
            order = np.array([np.lexsort((bid, d))[:3] for d in want])
            near = np.take_along_axis(want, order, 1)
            for within in (None, near[:, 2], near[:, 2] * 1.5):
                rows, cols, d = neighbors.nearest_in_tile(p, pid, b, bid, 3, "manhattan", True, within)
                assert rows.tolist() == np.repeat(np.arange(200), 3).tolist() and cols.tolist() == order.ravel().tolist() and d.tolist() == near.ravel().tolist()

    measured, measure = [], neighbors.Nearest.measure

    def counted(self, pv, bv, rows, *rest):
        measured.append(len(rows))
        return measure(self, pv, bv, rows, *rest)

    neighbors.Nearest.measure = counted
    try:
        b = rng.normal(size=(9000, 64))
        neighbors.nearest_in_tile(b[:500], np.arange(500), b, np.arange(9000), 3, "manhattan", True)
        assert 0 < sum(measured) < 500 * 9000 // 20
    finally:
        neighbors.Nearest.measure = measure


def test_both_ways_is_each_way():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(1300, 12)), rng.normal(size=(2100, 12))
    aid, bid = np.arange(1300) * 2, np.arange(2100)
    for a, b in ((a, b), (np.round(a), np.round(b)), (np.zeros_like(a), np.zeros_like(b)), (a[:40], b), (a, b[:40])):
        for bounds in (True, False):
            x, y = aid[: len(a)], bid[: len(b)]
            one, other = neighbors.nearest_in_tile(a, x, b, y, 3, "manhattan", True), neighbors.nearest_in_tile(b, y, a, x, 3, "manhattan", True)
            last = lambda n, near: np.maximum.reduceat(near[2], np.searchsorted(near[0], np.arange(n))) if bounds else np.full(n, np.inf)
            got = neighbors.nearest_both_ways(a, x, b, y, 3, True, last(len(a), one), last(len(b), other))
            for want, have in zip((one, other), got):
                assert all(np.array_equal(i, j) for i, j in zip(want, have))


@pytest.mark.parametrize("clusters", [1, 40])
def test_rows_joined_with_themselves_meet_once(spark, monkeypatch, clusters):
    """Without structure a pair of tiles meets once, for the probes of both; with structure cells thin the pairs out."""
    rng = np.random.default_rng(6)
    v = rng.normal(0, 50, (clusters, 6))[rng.integers(0, clusters, 3000)] + rng.normal(size=(3000, 6))
    v[:20] = v[20:40]
    monkeypatch.setattr(neighbors, "BROADCAST_VALUES", 1000)
    monkeypatch.setattr(neighbors, "CELL_ROWS", 300)
    monkeypatch.setattr(neighbors, "tile_size", lambda rows, dim: 1100)
    met, once = [], neighbors._join_same
    monkeypatch.setattr(neighbors, "_join_same", lambda *a: met.append(1) or once(*a))
    rows = frame(spark, v, "id").withColumnRenamed("g", "label").repartition(3)
    probe, build = rows.selectExpr("id AS probe_id", "v"), rows.selectExpr("id AS build_id", "v", "label")
    d = neighbors.exact_distances(v, v, "manhattan")
    d[np.arange(3000), np.arange(3000)] = np.inf
    want = dict(enumerate(np.argsort(d, axis=1, kind="stable")[:, :3].tolist()))
    got = knn_join(probe, build, 3, metric="manhattan", skip_self=True)
    assert sorted(got.columns) == ["build_id", "distance", "label", "ordinal", "probe_id"]
    assert collect(got) == want
    assert bool(met) == (clusters == 1)
    other = knn_join(probe.filter("probe_id < 500"), build, 3, metric="manhattan", skip_self=True)
    assert collect(other) == {i: near for i, near in want.items() if i < 500}
    assert len(met) == (clusters == 1)
