"""Random forest from sums over rows: one level of all trees of a lot at a time.

A round sends, for every open node, the class weights of its rows by (drawn feature, bin): a sparse
table, as long as the rows that reach open nodes. Added up over all rows it gives every split of the
level. Which rows a tree sees, how often, and which features a node may use are drawn by key (Poisson
weights by row, features by tree and place of the node), so the forest is the same wherever the rows
lie.

Trees are grown without pruning on Gini impurity, features per node are the square root of all;
``min_samples_split`` and ``min_samples_leaf`` count the different rows a tree has in a node. Split
points lie halfway between neighbouring values. A feature with more than BINS different values is
split at so many quantiles.
"""

from __future__ import annotations

import math

import numpy as np

BINS = 1023
# Rows x features x trees looked at in one round.
ROUND_ENTRIES = 4_000_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)
# P(weight <= k) for Poisson weights of mean 1; more than 12 doesn't happen in 64-bit draws' resolution.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(13)])


def spread(h: np.ndarray) -> np.ndarray:
    """Mixes the bits of 64-bit keys (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def keyed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A 64-bit draw for each pair of keys."""
    with np.errstate(over="ignore"):
        return spread(spread(np.asarray(a, np.uint64) * GOLDEN + _ONE) + np.asarray(b, np.uint64) * GOLDEN)


def uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) / 2.0**53


def weights(keys: np.ndarray, tree: int, bootstrap: bool) -> np.ndarray:
    """How often each row is in the sample of a tree."""
    if not bootstrap:
        return np.ones(len(keys), np.int64)
    return np.searchsorted(_POISSON[:-1], uniform(keyed(keys, tree)), side="right")


def begin(params: dict, facts: dict) -> dict:
    depth = params.get("max_depth")
    trees = int(params.get("n_estimators") or 100)
    features = max(1, math.isqrt(facts["dim"]))
    return {
        "classes": facts["classes"], "dim": facts["dim"], "trees": trees, "features": features,
        "max_depth": int(depth) if depth not in (None, "None") else None,
        "split": int(params.get("min_samples_split") or 2), "leaf": int(params.get("min_samples_leaf") or 1),
        "bootstrap": str(params.get("bootstrap", "True")) != "False",
        "lot": max(1, min(trees, ROUND_ENTRIES // max(1, facts["n"] * features))),
        "edges": None, "grown": [], "iterations": 0, "done": False, "rows": facts["n"],
    }


def _new_lot(s: dict) -> dict:
    first = len(s["grown"])
    count = min(s["lot"], s["trees"] - first)
    empty = {
        "tree": np.arange(first, first + count), "place": np.ones(count, np.uint64), "depth": np.zeros(count, np.int64),
        "feature": np.full(count, -1), "bin": np.zeros(count, np.int64), "left": np.full(count, -1),
        "value": np.zeros((count, s["classes"])), "open": np.ones(count, bool),
    }
    return {**s, "nodes": empty, "first": first, "count": count}


def _drawn(s: dict, tree: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The features of open nodes, one row each."""
    base = keyed(tree, place)
    order = keyed(base[:, None], np.arange(s["dim"])[None, :])
    return np.argsort(order, axis=1, kind="stable")[:, : s["features"]]


def _binned(s: dict, x: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(s["edges"])], axis=1)


def partial(s: dict, x: np.ndarray, y: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
    """What the rows add to a round: their values by feature first, then weights by open node, feature and bin."""
    if s["edges"] is None:
        order = np.sort(x, axis=0)
        if len(order) > 4 * BINS:
            order = order[np.linspace(0, len(order) - 1, 4 * BINS).round().astype(int)]
        return [order]
    n = s["nodes"]
    bins = _binned(s, x)
    opened = np.flatnonzero(n["open"])
    slot = np.full(len(n["open"]), -1)
    slot[opened] = np.arange(len(opened))
    drawn = _drawn(s, n["tree"][opened], n["place"][opened])
    found = [_cells(s, n, t, s["first"] + t, slot, drawn, bins, y, keys) for t in range(s["count"])]
    return [np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])]


def _cells(s: dict, n: dict, root: int, tree: int, slot: np.ndarray, drawn: np.ndarray, bins: np.ndarray, y: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, [weight, rows]) of the rows of a tree by open node, feature, bin and class; codes ascend."""
    k = s["classes"]
    w = weights(keys, tree, s["bootstrap"])
    rows = np.flatnonzero(w)
    at = np.full(len(rows), root)
    while True:
        f = n["feature"][at]
        inner = f >= 0
        if not inner.any():
            break
        right = bins[rows[inner], f[inner]] > n["bin"][at[inner]]
        at[inner] = n["left"][at[inner]] + right
    live = slot[at] >= 0
    rows, at = rows[live], slot[at[live]]
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros((0, 2))
    cell = (at[:, None] * s["features"] + np.arange(s["features"])) * (BINS + 1) + bins[rows[:, None], drawn[at]]
    code, same = np.unique((cell * k + y[rows, None]).ravel(), return_inverse=True)
    total = np.repeat(w[rows], s["features"])
    return code, np.stack([np.bincount(same, weights=total), np.bincount(same)], axis=1)


def _edges(values: np.ndarray) -> list[np.ndarray]:
    out = []
    for column in values.T:
        found = np.unique(column)
        if len(found) > BINS + 1:
            found = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1), method="inverted_cdf"))
        # Halfway, but below the upper value even where the two are neighbours as numbers.
        out.append(np.minimum((found[:-1] + found[1:]) / 2, np.nextafter(found[1:], -np.inf)))
    return out


def advance(s: dict, parts: list[list[np.ndarray]]) -> dict:
    """The next round's state from what all blocks sent, in the order of blocks."""
    s = {**s, "iterations": s["iterations"] + 1}
    if s["edges"] is None:
        return _new_lot({**s, "edges": _edges(np.concatenate([p[0] for p in parts]))})
    code, sums = _summed(parts)
    s = _grow(s, code, sums)
    if s["nodes"]["open"].any():
        return s
    s["grown"] = s["grown"] + _trees(s)
    if len(s["grown"]) < s["trees"]:
        return _new_lot(s)
    return {**s, "nodes": None, "done": True}


def _summed(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, same = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    values = np.concatenate([p[1] for p in parts])
    return code, np.stack([np.bincount(same, weights=v, minlength=len(code)) for v in values.T], axis=1)


def _splits(s: dict, tree: np.ndarray, at_place: np.ndarray, depth: np.ndarray, code: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """(open nodes, their class shares, those that are split, feature, bin) from the sums of some open nodes.

    ``tree``, ``at_place`` and ``depth`` are those of all open nodes.
    """
    k, m = s["classes"], s["features"]
    # One row per (node, feature, bin) with weights by class and the number of rows.
    cell, at = np.unique(code // k, return_inverse=True)
    by_class = np.zeros((len(cell), k))
    by_class[at, code % k] = sums[:, 0]
    rows = np.bincount(at, weights=sums[:, 1], minlength=len(cell))
    place = cell // (BINS + 1)
    start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    length = np.diff(np.append(start, len(cell)))

    def before(v: np.ndarray) -> np.ndarray:
        """Sums up to and with each bin, within its node and feature."""
        run = np.cumsum(v, axis=0)
        return run - np.repeat(run[start] - v[start], length, axis=0)

    left_class, left_rows = before(by_class), before(rows)
    total_class = np.repeat(np.add.reduceat(by_class, start), length, axis=0)
    total_rows = np.repeat(np.add.reduceat(rows, start), length)
    # Every node has all its rows under each of its features: the first one tells its totals.
    node_of = place[start] // m
    first = np.concatenate([[True], node_of[1:] != node_of[:-1]])
    slot = node_of[first]
    node_class, node_rows = total_class[start[first]], total_rows[start[first]]
    value = node_class / node_class.sum(axis=1, keepdims=True)
    right_class, right_rows = total_class - left_class, total_rows - left_rows
    lw, rw = left_class.sum(axis=1), right_class.sum(axis=1)
    # Less impurity is a larger sum of squares over the sides.
    with np.errstate(invalid="ignore", divide="ignore"):
        gain = (left_class**2).sum(axis=1) / lw + (right_class**2).sum(axis=1) / rw
    ok = (right_rows >= max(1, s["leaf"])) & (left_rows >= s["leaf"])
    gain = np.where(ok, gain, -np.inf)
    # The best of each node; ties to the feature drawn first, then to the lowest bin.
    node = place // m
    order = np.lexsort((cell, -gain, node))
    top = order[np.concatenate([[True], np.diff(node[order]) != 0])]
    pure = (node_class > 0).sum(axis=1) < 2
    can = np.isfinite(gain[top]) & ~pure & (node_rows >= s["split"])
    if s["max_depth"] is not None:
        can &= depth[slot] < s["max_depth"]
    top, chosen = top[can], slot[can]
    drawn = _drawn(s, tree[chosen], at_place[chosen])
    return slot, value, chosen, drawn[np.arange(len(chosen)), place[top] % m], cell[top] % (BINS + 1)


def _grow(s: dict, code: np.ndarray, sums: np.ndarray) -> dict:
    n = s["nodes"]
    opened = np.flatnonzero(n["open"])
    return {**s, "nodes": _grown(n, opened, _splits(s, n["tree"][opened], n["place"][opened], n["depth"][opened], code, sums))}


def _grown(n: dict, opened: np.ndarray, splits: tuple[np.ndarray, ...]) -> dict:
    """The nodes once the open ones have their shares, and the split ones two open nodes below them."""
    slot, value, chosen, feature, bin_ = splits
    n = {name: v.copy() for name, v in n.items()}
    n["open"][:] = False
    n["value"][opened[slot]] = value
    chosen = opened[chosen]
    if not len(chosen):
        return n
    n["feature"][chosen] = feature
    n["bin"][chosen] = bin_
    count = len(n["tree"])
    n["left"][chosen] = count + 2 * np.arange(len(chosen))

    def twice(v: np.ndarray) -> np.ndarray:
        return np.repeat(v[chosen], 2, axis=0)

    sides = np.tile(np.array([0, 1], np.uint64), len(chosen))
    with np.errstate(over="ignore"):
        places = np.concatenate([n["place"], spread(twice(n["place"]) * np.uint64(2) + sides)])
    added = 2 * len(chosen)
    return {
        "tree": np.concatenate([n["tree"], twice(n["tree"])]), "place": places, "depth": np.concatenate([n["depth"], twice(n["depth"]) + 1]),
        "feature": np.concatenate([n["feature"], np.full(added, -1)]), "bin": np.concatenate([n["bin"], np.zeros(added, np.int64)]),
        "left": np.concatenate([n["left"], np.full(added, -1)]), "value": np.concatenate([n["value"], np.zeros((added, n["value"].shape[1]))]),
        "open": np.concatenate([n["open"], np.ones(added, bool)]),
    }


# --- trees on their own, for rows in several blocks ------------------------------------

# Sums of a tree's level that are looked at together.
LEVEL_CELLS = 1 << 18


def held_bytes(s: dict) -> int:
    """About what the trees of a forest take at their largest."""
    nodes = 2 * s["rows"] if s["max_depth"] is None else min(2 * s["rows"], 2 ** (s["max_depth"] + 1))
    return s["trees"] * nodes * (8 * s["classes"] + 41)


def trees(s: dict) -> list[dict]:
    """The roots, a lot of one tree each."""
    return [_new_lot({**s, "lot": 1, "grown": [None] * t})["nodes"] for t in range(s["trees"])]


def shape(n: dict) -> dict:
    """What a row needs to find its open node in a tree, and an open node to draw its features."""
    opened = np.flatnonzero(n["open"])
    return {
        "feature": n["feature"].astype(np.int32), "bin": n["bin"].astype(np.int16), "left": n["left"].astype(np.int32),
        "opened": opened.astype(np.int32), "tree": n["tree"][opened], "place": n["place"][opened], "depth": n["depth"][opened],
    }


def chunks(s: dict, nodes: dict) -> int:
    cells = min(len(nodes["opened"]) * (BINS + 1) * s["classes"], s["rows"]) * s["features"]
    return max(1, -(-cells // LEVEL_CELLS))


def level(s: dict, shapes: dict[int, dict], x: np.ndarray, y: np.ndarray, keys: np.ndarray):
    """(tree, chunk of its open nodes, bytes of codes and sums) of the rows, for a level of each tree."""
    bins = _binned(s, x)
    for t, n in shapes.items():
        slot = np.full(len(n["feature"]), -1)
        slot[n["opened"]] = np.arange(len(n["opened"]))
        code, sums = _cells(s, n, 0, t, slot, _drawn(s, n["tree"], n["place"]), bins, y, keys)
        if not len(code):
            continue
        parts = chunks(s, n)
        of = code // (s["classes"] * (BINS + 1) * s["features"]) % parts
        for c in range(parts):
            mine = of == c
            if mine.any():
                yield t, c, _packed(code[mine], sums[mine])


def _packed(code: np.ndarray, sums: np.ndarray) -> tuple[int, list[np.ndarray]]:
    """Ascending codes as small differences, counts as small numbers."""
    least = lambda v: v.astype(np.min_scalar_type(int(v.max(initial=0))))
    return int(code[0]), [least(np.diff(code)), *(least(v.astype(np.int64)) for v in sums.T)]


def _unpacked(part: tuple[int, list[np.ndarray]]) -> list[np.ndarray]:
    first, (steps, *sums) = part
    return [np.concatenate([[first], first + np.cumsum(steps, dtype=np.int64)]), np.stack(sums, axis=1).astype(np.float64)]


def decided(s: dict, n: dict, parts: list) -> tuple[np.ndarray, ...]:
    """The splits among a chunk of a tree's open nodes, from what all blocks sent."""
    return _splits(s, n["tree"], n["place"], n["depth"], *_summed([_unpacked(p) for p in parts]))


def grown(n: dict, found: list[tuple[np.ndarray, ...]]) -> dict:
    """A tree a level deeper, from the splits of all chunks."""
    slot, value, chosen, feature, bin_ = (np.concatenate(v) for v in zip(*found))
    order = np.argsort(chosen)
    return _grown(n, np.flatnonzero(n["open"]), (slot, value, chosen[order], feature[order], bin_[order]))


def finished(s: dict, found: list[dict]) -> dict:
    """The state of a fit once all its trees are grown."""
    grown = [_trees({**s, "nodes": n, "first": t, "count": 1})[0] for t, n in enumerate(found)]
    return {**s, "grown": grown, "done": True}


def _trees(s: dict) -> list[dict]:
    """The trees of the lot: nodes of each in the order they were made, with split values for bins."""
    n, out = s["nodes"], []
    for t in range(s["first"], s["first"] + s["count"]):
        own = np.flatnonzero(n["tree"] == t)
        number = np.zeros(len(n["tree"]), np.int64)
        number[own] = np.arange(len(own))
        inner = n["feature"][own] >= 0
        at = [s["edges"][f][b] if f >= 0 else 0.0 for f, b in zip(n["feature"][own].tolist(), n["bin"][own].tolist())]
        left = np.where(inner, number[n["left"][own]], -1)
        out.append({"feature": n["feature"][own], "at": np.array(at), "left": left, "value": n["value"][own]})
    return out


def model(s: dict) -> list[dict]:
    return s["grown"]


def probabilities(trees: list[dict], x: np.ndarray) -> np.ndarray:
    """Mean class shares of the leaves a row falls into."""
    total = np.zeros((len(x), trees[0]["value"].shape[1]))
    for t in trees:
        at = np.zeros(len(x), np.int64)
        while True:
            f = t["feature"][at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                break
            at[inner] = t["left"][at[inner]] + (x[inner, f[inner]] > t["at"][at[inner]])
        total += t["value"][at]
    return total / len(trees)


def decide(trees: list[dict], x: np.ndarray) -> np.ndarray:
    """The class of the largest mean share, ties (up to rounding) to the first."""
    return np.argmax(np.round(probabilities(trees, x), 12), axis=1)
