"""Many fits in one plan: run keys, settings and cross-validation folds are columns.

The rows of a run are packed into blocks. A fit goes in rounds: every block adds up what its rows
say at the fit's present state, and the sums give the next state (see linear, forest, recurrent).
Where a run is a single block, nobody else is needed and all its rounds happen in one task; the runs
of a grid are spread over the tasks of one job. Fits over several blocks advance together, one job a
round, until all are done: a block stays where it is and is read once a round for all fits of its
run, what it adds up goes to the driver, which holds the states (parameters) of a bounded lot of
fits. Both ways take the same steps over the same blocks, and a block's rows are chosen and ordered
by key: a fit doesn't depend on partitions, executors or on other fits.

A fit that fails ends as a row with its error; the others go on.
"""

from __future__ import annotations

import pickle
import time
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odorframe.functions.draws import key_hash
from odorframe.operators import forest, linear, recurrent
from odorframe.session import cut_lineage, fresh_path, small_side

# Values of a block: what a task holds of a run at once (8 MB of doubles).
BLOCK_VALUES = 1 << 20
# Settings fitted by one task over one copy of a run's blocks.
LOT = 8
SEED = 42
# States and sums of the fits that advance together, in the driver's memory.
DRIVER_BYTES = 128 << 20
# Fitted models sent to every task that predicts; beyond it their blocks are shuffled to them.
SENT_BYTES = 32 << 20
# Fitted models sent to the shared folder at once.
WRITTEN_BYTES = 8 << 20
# Values of the rows of a recurrent fit that a task holds at once, in whole batches.
WINDOW_VALUES = 1 << 18


def _linear(model: str) -> SimpleNamespace:
    def begin(params: dict, facts: dict) -> dict:
        setting = linear.Setting.of(model, params)
        return {**linear.begin(setting, facts["dim"], facts["classes"]), "setting": setting, "n": facts["n"], "classes": facts["classes"]}

    def partial(s: dict, x, y, keys) -> list[np.ndarray]:
        return list(linear.sums(s["setting"], s["stage"], s["trial"], x, y, s["classes"]))

    def advance(s: dict, parts: list[list[np.ndarray]]) -> dict:
        fixed = {name: s[name] for name in ("setting", "n", "classes")}
        told, grad = (np.sum([p[i] for p in parts], axis=0) for i in (0, 1))
        return {**linear.advance(s["setting"], s, told, grad, s["n"], s["classes"]), **fixed}

    return SimpleNamespace(
        begin=begin, partial=partial, advance=advance, decide=linear.decide,
        sent=lambda s: {name: s[name] for name in ("setting", "stage", "trial", "classes")},
        model=lambda s: linear.coefficients(s["setting"], s, s["classes"]),
        report=lambda s: (s["spent"] + s["iterations"], linear.optimality(s["setting"], s)),
    )


def _others(module) -> SimpleNamespace:
    return SimpleNamespace(
        begin=module.begin, partial=module.partial, advance=module.advance, decide=module.decide, model=module.model, report=lambda s: (s["iterations"], 0.0)
    )


SOLVERS = {"RandomForest": _others(forest), "LinearSVC": _linear("LinearSVC"), "LogisticRegression": _linear("LogisticRegression"), "RNN": _others(recurrent)}


def forest_nodes(fits: DataFrame, run: list[str]) -> DataFrame:
    """``run..., fold, tree, node, feature, at, left, value`` of every node of fitted forests; a leaf has feature -1.

    Rows with a value of ``feature`` up to ``at`` go to node ``left``, the others to the next one.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                for t, tree in enumerate(pickle.loads(r.model)):
                    n = len(tree["feature"])
                    out = {c: getattr(r, c) for c in run} | {"fold": r.fold, "tree": t, "node": np.arange(n)}
                    out |= {"feature": tree["feature"], "at": tree["at"], "left": tree["left"], "value": list(tree["value"])}
                    yield pd.DataFrame(out).astype({"fold": "Int32"})

    good = fits.filter("model is not null").select(*run, "fold", "model")
    return good.mapInPandas(rows, _schema(fits, run, "fold int, tree int, node int, feature int, at double, left int, value array<double>"))


def linear_weights(fits: DataFrame, run: list[str]) -> DataFrame:
    """``run..., candidate, fold, label, weights``: the coefficients of linear fits, the intercept last."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                out = {c: getattr(r, c) for c in run} | {"candidate": r.candidate, "fold": r.fold, "label": list(r.classes), "weights": list(pickle.loads(r.model))}
                yield pd.DataFrame(out).astype({"candidate": "Int32", "fold": "Int32"})

    good = fits.filter("model is not null").select(*run, "candidate", "fold", "classes", "model")
    return good.mapInPandas(rows, _schema(fits, run, "candidate int, fold int, label string, weights array<double>"))


def register(name: str, solver) -> None:
    """Adds a model: an object with begin, partial, advance, decide, model and report, as SOLVERS has them.

    ``sent``, if there, tells what of a state ``partial`` needs.
    """
    SOLVERS[name] = solver


# --- blocks ---------------------------------------------------------------------------


def pack(rows: DataFrame, run: list[str], block_values: int = BLOCK_VALUES) -> DataFrame:
    """``run..., block, of_blocks, ids, y, keys, cv, x``, written: the rows of a run in blocks.

    ``rows``: ``run..., row_id, label, v`` and, for cross-validation, ``cv_fold``. A row's block and
    its key come from its id alone.
    """
    cv = "cv_fold" if "cv_fold" in rows.columns else F.lit(0)
    rows = rows.select(*run, F.col("row_id").cast("string").alias("row_id"), "label", "v", F.col(cv) if isinstance(cv, str) else cv.alias("cv_fold"))
    size = rows.groupBy(*run).agg(F.count("*").alias("__n"), F.max(F.size("v")).alias("__dim"))
    size = size.select(*run, F.greatest(F.lit(1), F.ceil(F.col("__n") * F.col("__dim") / block_values)).cast("int").alias("of_blocks"))
    word = lambda at: F.conv(F.substring(key_hash(SEED, "row", "row_id"), at, 8), 16, 10).cast("bigint")
    key = F.shiftleft(word(1), 32).bitwiseOR(word(9))
    dealt = rows.join(small_side(size, 1 + len(run)), run).withColumn("block", F.pmod(key, F.col("of_blocks")).cast("int"))
    row = F.struct("row_id", "label", "v", key.alias("key"), "cv_fold")
    packed = dealt.groupBy(*run, "block", "of_blocks").agg(F.sort_array(F.collect_list(row)).alias("r"))
    column = lambda name: F.transform("r", lambda s: s[name])
    return cut_lineage(
        packed.select(
            *run, "block", "of_blocks", column("row_id").alias("ids"), column("label").alias("y"), column("key").alias("keys"), column("cv_fold").alias("cv"),
            F.transform("r", lambda s: F.size(s["v"])).alias("sizes"), F.flatten(column("v")).alias("x"),
        )
    )


_BLOCK = ["block", "of_blocks", "ids", "y", "keys", "cv", "sizes", "x"]


class _Block:
    """The rows of a packed block that take part in a fit: all, or those outside the held-out fold."""

    def __init__(self, r, fold: int | None, inside: bool = False):
        sizes = np.asarray(r.sizes)
        self.dim = int(sizes[0]) if len(sizes) else 0
        self.even = bool((sizes == self.dim).all())
        cv = np.asarray(r.cv)
        use = np.ones(len(sizes), bool) if fold is None else (cv == fold) == inside
        self.labels = np.asarray(r.y, object)[use]
        self.ids = np.asarray(r.ids, object)[use]
        self.keys = np.asarray(r.keys, np.int64)[use].view(np.uint64)
        self.x = np.asarray(r.x, np.float64).reshape(len(sizes), -1)[use] if self.even else np.zeros((0, 0))

    def facts(self) -> dict:
        return {"n": len(self.labels), "dim": self.dim, "even": self.even, "labels": set(self.labels.tolist()), "numbers": bool(np.isfinite(self.x).all())}


def _begin(model: str, params: dict, facts: list[dict]) -> tuple[dict, list[str]]:
    """(first state, classes in sorted order), or ValueError where the rows don't allow a fit."""
    n = sum(f["n"] for f in facts)
    labels = set().union(*[f["labels"] for f in facts])
    if not n:
        raise ValueError("no training rows")
    if len({f["dim"] for f in facts if f["n"]}) > 1 or not all(f["even"] for f in facts):
        raise ValueError("rows of different lengths")
    if not all(f["numbers"] for f in facts):
        raise ValueError("a value is missing, infinite or not a number")
    if None in labels:
        raise ValueError("a label is missing")
    if len(labels) < 2:
        raise ValueError("one class only")
    dim = max(f["dim"] for f in facts)
    return SOLVERS[model].begin(params, {"n": n, "dim": dim, "classes": len(labels)}), sorted(labels)


# --- fits -----------------------------------------------------------------------------

_SETTING = "candidate int, fold int, params map<string,string>"
_FIT = "candidate int, fold int, params map<string,string>, classes array<string>, model binary, iterations int, optimality double, fit_seconds double, error string"


def _schema(like: DataFrame, run: list[str], rest: str) -> str:
    return ", ".join([f"{c} {like.schema[c].dataType.simpleString()}" for c in run] + [rest])


def _row(model: str, state: dict | None, classes: list[str], seconds: float, error: str | None) -> tuple:
    if state is None or error is not None:
        return None, None, 0, None, seconds, error
    iterations, optimality = SOLVERS[model].report(state)
    return classes, pickle.dumps(SOLVERS[model].model(state), 5), iterations, optimality, seconds, None


def _fit_alone(model: str, run: list[str]):
    """All rounds of the settings of a run whose rows are one block."""

    def one(r, setting) -> tuple:
        start, fold = time.perf_counter(), setting["fold"]
        params = dict(setting["params"] or {})
        try:
            block = _Block(r, fold)
            state, classes = _begin(model, params, [block.facts()])
            code = {c: i for i, c in enumerate(classes)}
            y = np.array([code[c] for c in block.labels.tolist()], np.int64)
            while not state["done"]:
                state = SOLVERS[model].advance(state, [SOLVERS[model].partial(state, block.x, y, block.keys)])
            out = _row(model, state, classes, time.perf_counter() - start, None)
        except Exception as problem:  # the outcome of this fit; the others go on
            out = _row(model, None, [], time.perf_counter() - start, f"{type(problem).__name__}: {problem}")
        return (*(getattr(r, c) for c in run), setting["candidate"], fold, params, *out)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                found = [one(r, setting) for setting in r.settings]
                yield pd.DataFrame(found, columns=[*run, *_names(_FIT)]).astype({"candidate": "Int32", "fold": "Int32"})

    return fit


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


_SHARED = "run string, block int, shared binary"
_USED = ["block", "y", "keys", "cv", "sizes", "x"]


def _run_key(r, run: list[str]) -> str:
    return repr(tuple(None if pd.isna(v := getattr(r, c)) else str(v) for c in run))


class _Shared:
    """A packed block that several fits look at."""

    def __init__(self, r):
        sizes = np.asarray(r.sizes)
        self.dim = int(sizes[0]) if len(sizes) else 0
        self.even = bool((sizes == self.dim).all())
        self.cv, self.keys = np.asarray(r.cv), np.asarray(r.keys, np.int64).view(np.uint64)
        self.place, self.labels = pd.factorize(np.asarray(r.y, object), use_na_sentinel=False)
        self.labels = [None if pd.isna(c) else c for c in self.labels]
        self.x = np.asarray(r.x, np.float64).reshape(len(sizes), -1) if self.even else None

    def used(self, fold: int | None) -> np.ndarray:
        return np.ones(len(self.cv), bool) if fold is None else self.cv != fold

    def facts(self, fold: int | None) -> dict:
        use = self.used(fold)
        labels = {self.labels[i] for i in np.unique(self.place[use])}
        return {"n": int(use.sum()), "dim": self.dim, "even": self.even, "labels": labels, "numbers": self.x is None or bool(np.isfinite(self.x[use]).all())}

    def rows(self, fold: int | None, classes: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(x, class numbers, keys) of the rows outside the fold."""
        use = self.used(fold)
        code = np.array([classes.index(c) if c in classes else -1 for c in self.labels], np.int64)
        return self.x[use], code[self.place[use]], self.keys[use]


def _over_blocks(blocks: DataFrame, run: list[str], sent, each, schema: str) -> DataFrame:
    """Rows that ``each(block, fit)`` yields for every block and every fit of its run; ``sent`` is {run key: [fit]} to the tasks."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                if asked := sent.value.get(_run_key(r, run)):
                    block = _Shared(r)
                    for f in asked:
                        yield from each(int(r.block), block, f)

    return blocks.select(*run, *_USED).mapInPandas(parts, schema)


def _by_run(going: list[dict], sent) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for f in going:
        out.setdefault(f["run"], []).append({"fit": f["fit"], "fold": f["fold"], **sent(f)})
    return out


def _share(run: list[str]):
    """``run, block, shared``: packed blocks as the tasks of a round look at them."""

    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                yield pd.DataFrame({"run": [_run_key(r, run)], "block": [int(r.block)], "shared": [pickle.dumps(_Shared(r), 5)]})

    return share


def _told(model: str, shared: RDD, going: list[dict], first: bool) -> dict[int, list]:
    """What the blocks add to the present round of each fit, in the order of blocks; at first, the facts about their rows.

    A round is a plain job: as queries, hundreds of rounds would leave their plans and figures in the driver.
    """
    sc = shared.context
    slim = getattr(SOLVERS[model], "sent", lambda s: s)
    sent = sc.broadcast(_by_run(going, lambda f: {} if first else {"state": slim(f["state"]), "classes": f["classes"]}))
    solver = SOLVERS[model]

    def parts(rows: Iterator) -> Iterator[tuple[int, int, bytes]]:
        for r in rows:
            if asked := sent.value.get(r["run"]):
                block = pickle.loads(r["shared"])
                for f in asked:
                    part = block.facts(f["fold"]) if first else solver.partial(f["state"], *block.rows(f["fold"], f["classes"]))
                    yield f["fit"], r["block"], pickle.dumps(part, 5)

    got: dict[int, list] = {f["fit"]: [] for f in going}
    for fit, number, part in shared.mapPartitions(parts).collect():
        got[fit].append((number, part))
    sent.destroy()
    return {fit: [pickle.loads(p) for _, p in sorted(parts)] for fit, parts in got.items()}


def _guarded(f: dict, step) -> None:
    """One step of a fit; an error is the outcome of this fit, the others go on."""
    try:
        step(f)
    except Exception as problem:
        f["state"], f["error"], f["done"] = None, f"{type(problem).__name__}: {problem}", True
    if f["done"]:
        f["seconds"] = time.time() - f["began"]


def _rounds(model: str, shared: RDD, run: list[str], lot: list[dict]) -> None:
    """All rounds of a lot of fits, one job each."""

    def advance(f: dict) -> None:
        f["state"] = SOLVERS[model].advance(f["state"], told[f["fit"]])
        f["done"] = f["state"]["done"]

    while going := [f for f in lot if not f["done"]]:
        told = _told(model, shared, going, False)
        for f in going:
            _guarded(f, advance)


def _epochs(model: str, blocks: DataFrame, run: list[str], lot: list[dict]) -> None:
    """All epochs of a lot of recurrent fits, one job each: rows sorted by batch pass by the fit's state."""
    sc = blocks.sparkSession.sparkContext
    while going := [f for f in lot if not f["done"]]:
        place = {f["fit"]: i for i, f in enumerate(going)}
        asked = sc.broadcast(_by_run(going, lambda f: {"classes": f["classes"], "rows": f["rows"], "dim": f["dim"], "batch": {c: f["state"][c] for c in ("epoch", "batches")}}))
        held = sc.broadcast({f["fit"]: f["state"] for f in going})

        def windows(number: int, block: _Shared, f: dict) -> Iterator[pd.DataFrame]:
            x, y, keys = block.rows(f["fold"], f["classes"])
            of = recurrent.batch_of(f["batch"], keys)
            small = x.astype(np.float32)
            x = small if (small == x).all() else x
            # Batches of a window: about WINDOW_VALUES values over all blocks.
            window = of // max(1, WINDOW_VALUES * f["batch"]["batches"] // max(1, f["rows"] * f["dim"]))
            order = np.argsort(window, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], np.diff(window[order]) != 0])) if len(order) else []
            cut = [order[a:b] for a, b in zip(starts, [*starts[1:], len(order)])]
            parts = [pickle.dumps((of[c], x[c], y[c]), 5) for c in cut]
            yield pd.DataFrame({"fit": f["fit"], "place": place[f["fit"]], "window": [int(window[c[0]]) for c in cut], "block": number, "part": parts})

        def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def taken(fit: int, state: dict, parts: list[bytes]) -> dict:
                of, x, y = (np.concatenate(v) for v in zip(*[pickle.loads(p) for p in parts]))
                return recurrent.take(state, of, x.astype(np.float64), y)

            def over(fit: int, state: dict, parts: list[bytes]) -> pd.DataFrame:
                state = recurrent.end(taken(fit, state, parts), held.value[fit]["epoch"])
                return pd.DataFrame({"fit": [fit], "state": [pickle.dumps(state, 5)]})

            now, state, parts = None, None, []
            for batch in batches:
                for r in batch.itertuples(index=False):
                    if now is None or now[0] != r.fit:
                        if now is not None:
                            yield over(now[0], state, parts)
                        now, state, parts = (r.fit, r.window), held.value[r.fit], []
                    elif now[1] != r.window:
                        now, state, parts = (r.fit, r.window), taken(r.fit, state, parts), []
                    parts.append(r.part)
            if now is not None:
                yield over(now[0], state, parts)

        rows = _over_blocks(blocks, run, asked, windows, "fit int, place int, window int, block int, part binary")
        rows = rows.repartitionById(len(going), "place").sortWithinPartitions("fit", "window", "block").drop("place", "block")
        got = {r["fit"]: r["state"] for r in rows.mapInPandas(steps, "fit int, state binary").collect()}

        def moved(f: dict) -> None:
            f["state"] = pickle.loads(got[f["fit"]])
            f["done"] = f["state"]["done"]

        for f in going:
            _guarded(f, moved)
        asked.destroy()
        held.destroy()


def _levels(model: str, blocks: DataFrame, run: list[str], lot: list[dict]) -> None:
    """All levels of a lot of forests, one job each; the sums of a level meet by tree."""
    sc = blocks.sparkSession.sparkContext
    fixed = {f["fit"]: {k: v for k, v in f["state"].items() if k not in ("grown", "nodes")} for f in lot}

    def spread(shapes: dict[int, dict]) -> dict:
        return _by_run([f for f in lot if not f["done"]], lambda f: {"classes": f["classes"], "trees": shapes.get(f["fit"], {})})

    def values(number: int, block: _Shared, f: dict) -> Iterator[pd.DataFrame]:
        part = forest.partial(fixed[f["fit"]], *block.rows(f["fold"], f["classes"]))
        yield pd.DataFrame({"fit": [f["fit"]], "part": [pickle.dumps(part[0], 5)]})

    def edges(parts: pd.DataFrame) -> pd.DataFrame:
        found = forest._edges(np.concatenate([pickle.loads(p) for p in parts["part"]]))
        return pd.DataFrame({"fit": parts["fit"].iloc[:1], "part": [pickle.dumps(found, 5)]})

    sent = sc.broadcast(spread({}))
    parts = _over_blocks(blocks, run, sent, values, "fit int, part binary")
    for r in parts.groupBy("fit").applyInPandas(edges, "fit int, part binary").collect():
        fixed[r["fit"]]["edges"] = pickle.loads(r["part"])
    sent.destroy()
    rules = sc.broadcast(fixed)
    trees = {f["fit"]: dict(enumerate(forest.trees(f["state"]))) for f in lot}

    def sums(number: int, block: _Shared, f: dict) -> Iterator[pd.DataFrame]:
        for t, c, part in forest.level(rules.value[f["fit"]], f["trees"], *block.rows(f["fold"], f["classes"])):
            yield pd.DataFrame({"fit": [f["fit"]], "tree": [t], "chunk": [c], "part": [pickle.dumps(part, 5)]})

    while shapes := {fit: open_ for fit, grown in trees.items() if (open_ := {t: forest.shape(n) for t, n in grown.items() if n["open"].any()})}:
        for f in lot:
            if not f["done"]:
                f["state"]["iterations"] += 1
            f["done"] = f["done"] or f["fit"] not in shapes
        sent, flat = sc.broadcast(spread(shapes)), sc.broadcast(shapes)

        def splits(parts: pd.DataFrame) -> pd.DataFrame:
            fit, tree = int(parts["fit"].iloc[0]), int(parts["tree"].iloc[0])
            found = forest.decided(rules.value[fit], flat.value[fit][tree], [pickle.loads(p) for p in parts["part"]])
            return pd.DataFrame({"fit": [fit], "tree": [tree], "part": [pickle.dumps(found, 5)]})

        got: dict = {}
        level = _over_blocks(blocks, run, sent, sums, "fit int, tree int, chunk int, part binary")
        for r in level.groupBy("fit", "tree", "chunk").applyInPandas(splits, "fit int, tree int, part binary").collect():
            got.setdefault((r["fit"], r["tree"]), []).append(pickle.loads(r["part"]))
        for fit, open_ in shapes.items():
            for t in open_:
                # A tree whose sample is empty stays a root.
                n = trees[fit][t]
                trees[fit][t] = forest.grown(n, got[(fit, t)]) if (fit, t) in got else {**n, "open": np.zeros(len(n["open"]), bool)}
        sent.destroy()
        flat.destroy()
    rules.destroy()
    for f in lot:
        f["state"] = forest.finished({**f["state"], "edges": fixed[f["fit"]]["edges"]}, [n for _, n in sorted(trees.pop(f["fit"]).items())])
        f["done"], f["seconds"] = True, time.time() - f["began"]


def _lots(model: str, going: list[dict]) -> Iterator[list[dict]]:
    """Fits whose states and sums fit into the driver together; at least one."""
    lot, held = [], 0
    for f in going:
        # A state grows by the steps it remembers; each block sends sums as large as its parameters.
        solver = SOLVERS[model]
        size = solver.held(f["state"]) if hasattr(solver, "held") else len(pickle.dumps(getattr(solver, "sent", lambda s: s)(f["state"]), 5)) * (24 + f["of_blocks"])
        if lot and held + size > DRIVER_BYTES:
            yield lot
            lot, held = [], 0
        lot, held = [*lot, f], held + size
    if lot:
        yield lot


ROUNDS = {"RandomForest": _levels, "RNN": _epochs}
SOLVERS["RandomForest"].held = forest.held_bytes


def _fit_spread(model: str, blocks: DataFrame, settings: DataFrame, run: list[str]) -> DataFrame:
    """Fits over runs of several blocks."""
    spark = blocks.sparkSession
    schema = _schema(blocks, run, _FIT)
    # One block a partition, kept: every round reads them from there.
    placed = blocks.repartitionByRange(blocks.count(), *run, "block")
    rounds = ROUNDS.get(model, _rounds)
    if rounds is _rounds:
        placed = shared = cut_lineage(placed.select(*run, *_USED).mapInPandas(_share(run), _SHARED)).rdd
    else:
        placed = cut_lineage(placed)
        shared = placed.select(*run, *_USED).mapInPandas(_share(run), _SHARED).rdd
    fits = [
        {"fit": i, "run": _run_key(r, run), "key": [r[c] for c in run], "candidate": r["candidate"], "fold": r["fold"], "params": r["params"], "of_blocks": r["of_blocks"],
         "classes": [], "state": None, "error": None, "done": False, "began": time.time(), "seconds": 0.0}
        for i, r in enumerate(settings.orderBy(*run, "candidate", "fold").collect())
    ]
    path = fresh_path(spark, "fits")

    def begin(f: dict) -> None:
        f["state"], f["classes"] = _begin(model, dict(f["params"] or {}), facts[f["fit"]])
        f["done"], f["rows"], f["dim"] = f["state"]["done"], sum(p["n"] for p in facts[f["fit"]]), max(p["dim"] for p in facts[f["fit"]])

    def write(ended: list[dict]) -> None:
        """Models leave the driver a few MB at a time."""
        rows, size = [], 0
        for f in ended:
            rows.append((*f["key"], f["candidate"], f["fold"], f["params"], *_row(model, f["state"], f["classes"], f["seconds"], f["error"])))
            f["state"], size = None, size + len(rows[-1][len(run) + 4] or b"")
            if size > WRITTEN_BYTES or f is ended[-1]:
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
                rows, size = [], 0

    facts = _told(model, shared, fits, True)
    for f in fits:
        _guarded(f, begin)
    write([f for f in fits if f["done"]])
    for lot in _lots(model, [f for f in fits if not f["done"]]):
        rounds(model, placed, run, lot)
        write(lot)
    return spark.read.schema(schema).parquet(path)


def fit(model: str, blocks: DataFrame, settings: DataFrame, run: list[str]) -> DataFrame:
    """``run..., candidate, fold, params, classes, model, iterations, optimality, fit_seconds, error``, written.

    ``settings``: ``run..., candidate, fold, params``; a fold leaves the rows of that cross-validation
    fold out, null trains on all. ``error`` tells why a fit has no model. ``fit_seconds`` are a fit's
    own in one task, or from its first to its last round. ``optimality`` is zero at the optimum of a
    linear fit.
    """
    spark = blocks.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    counted = settings.join(blocks.select(*run, "of_blocks").distinct(), run)
    counted = cut_lineage(counted.select(*run, "candidate", F.col("fold").cast("int").alias("fold"), "params", "of_blocks"))
    lot = F.pmod(F.xxhash64("candidate", "fold"), F.ceil(F.count("*").over(_by(run)) / LOT).cast("int"))
    lots = counted.filter("of_blocks = 1").withColumn("lot", lot).groupBy(*run, "lot").agg(F.collect_list(F.struct("candidate", "fold", "params")).alias("settings"))
    alone = blocks.filter("of_blocks = 1").join(small_side(lots, 1 + LOT * 8), run).repartition(tasks, *run, "lot")
    out = cut_lineage(alone.select(*run, *_BLOCK, "settings").mapInPandas(_fit_alone(model, run), _schema(blocks, run, _FIT)))
    spread = counted.filter("of_blocks > 1")
    if spread.isEmpty():
        return out
    return out.unionByName(_fit_spread(model, blocks.filter("of_blocks > 1"), spread, run))


def _by(run: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*run)


# --- predictions ----------------------------------------------------------------------

_PREDICTED = "candidate int, fold int, probe_id string, label string, prediction string, predict_seconds double"


def _predict(model: str, run: list[str]):
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                fold = None if pd.isna(r.fold) else int(r.fold)
                start = time.perf_counter()
                block = _Block(r, fold, inside=True)
                classes = np.asarray(r.classes, object)
                found = classes[SOLVERS[model].decide(pickle.loads(r.model), block.x)] if len(block.ids) else classes[:0]
                out = pd.DataFrame({c: getattr(r, c) for c in run} | {"candidate": r.candidate, "fold": r.fold, "probe_id": block.ids, "label": block.labels, "prediction": found})
                # A block's seconds stand in its first row.
                out["predict_seconds"] = 0.0
                if len(out):
                    out.loc[0, "predict_seconds"] = time.perf_counter() - start
                yield out[[*run, *_names(_PREDICTED)]].astype({"candidate": "Int32", "fold": "Int32"})

    return predict


def predict(model: str, fits: DataFrame, blocks: DataFrame, run: list[str]) -> DataFrame:
    """``run..., candidate, fold, probe_id, label, prediction, predict_seconds`` for the rows of ``blocks``.

    A fit with a fold predicts the rows of that fold, others all rows of their run. Fits without a
    model predict nothing.
    """
    good = fits.filter("model is not null").select(*run, "candidate", "fold", "classes", "model")
    # As many models as runs, however many rows: a few go to the blocks, which stay where they are.
    if (good.agg(F.sum(F.octet_length("model"))).first()[0] or 0) <= SENT_BYTES:
        good = F.broadcast(good)
    rows = blocks.join(good, run).select(*run, "candidate", "fold", "classes", "model", *_BLOCK)
    return rows.mapInPandas(_predict(model, run), _schema(blocks, run, _PREDICTED))
