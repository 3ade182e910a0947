"""Model-based generators: a distribution fitted per class, then sampled.

Fitting reads the sequences where they lie: each partition adds up its sufficient
statistics and only those are summed across the cluster. What reaches the driver are
the parameters, a few vectors per class; labels are fitted in batches so that they stay
small for any number of labels. Sampling is one row per new sequence with keyed draws.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odorframe.functions import draws
from odorframe.functions.arrays import bind
from odorframe.operators.augment import ID, LABEL, copies, register
from odorframe.session import BROADCAST_VALUES, cut_lineage

# Sizes, tolerances, priors and iteration limits of the fitted models.
MAX_COMPONENTS = 5
FIT_NOISE = 1e-4
VARIANCE_FLOOR = 1e-6
TOLERANCE = 1e-3
MAX_ITER = 100
MAX_STATES = 2
MIN_COVAR = 1e-2
PRIOR = 1.1
HMM_TOLERANCE = 1e-2
LATENT_DIMENSIONS = 16
LATENT_MIN_ROWS = 11
PARAMETER_VALUES = 5_000_000

Params = dict[str, dict[str, np.ndarray]]


def class_sizes(seqs: DataFrame, values_per_label: int) -> Iterator[dict[str, int]]:
    """Label sizes in batches whose parameters stay below a fixed number of values."""
    sizes = [(r[0], r[1]) for r in seqs.groupBy(LABEL).agg(F.count("*")).orderBy(LABEL).collect()]
    step = max(1, PARAMETER_VALUES // max(1, values_per_label))
    for s in range(0, len(sizes), step):
        yield dict(sizes[s : s + step])


def _shape(seqs: DataFrame) -> tuple[int, int]:
    """(channels, steps)."""
    return seqs.select(F.size("x"), F.size(F.col("x")[0])).first()


def _noisy(seqs: DataFrame, seed: int, steps: int) -> DataFrame:
    """``label, x`` plus tiny keyed noise, written once for the passes of the fit."""
    noise = lambda c, i: bind(
        draws.normals(steps, seed, "fitnoise", ID, i),
        lambda z: F.zip_with(c, z, lambda v, e: v + F.lit(FIT_NOISE) * e),
    )
    return cut_lineage(seqs.select(ID, LABEL, F.transform("x", noise).alias("x")))


def _sum_statistics(rows: DataFrame, fn: Callable[[str, pd.Series], np.ndarray]) -> dict[str, np.ndarray]:
    """``fn(label, x)`` gives a vector per label and batch; their sum per label."""

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, part in batch.groupby(LABEL, sort=False):
                s = fn(label, part["x"])
                total[label] = total[label] + s if label in total else s
        if total:
            yield pd.DataFrame({LABEL: list(total), "s": list(total.values())})

    partial = rows.select(LABEL, "x").mapInPandas(add_up, f"{LABEL} string, s array<double>")
    summed = partial.select(LABEL, F.posexplode("s").alias("i", "v")).groupBy(LABEL, "i").agg(F.sum("v").alias("v"))
    table = summed.toPandas().sort_values("i")
    return {label: part["v"].to_numpy() for label, part in table.groupby(LABEL, sort=False)}


def _stack(x: pd.Series) -> np.ndarray:
    """(rows, channels, steps)."""
    return np.array([np.stack(r) for r in x])


def _as_table(seqs: DataFrame, params: Params, fields: list[str]) -> DataFrame:
    """Parameters as one row per label, broadcast unless there are too many labels for it."""
    schema = T.StructType(
        [T.StructField(LABEL, T.StringType())]
        + [T.StructField(f, T.ArrayType(T.ArrayType(T.DoubleType()))) for f in fields]
    )
    rows = [(label, *[np.atleast_2d(p[f]).tolist() for f in fields]) for label, p in params.items()]
    table = seqs.sparkSession.createDataFrame(rows, schema)
    values = sum(np.size(p[f]) for p in params.values() for f in fields)
    return F.broadcast(table) if values <= BROADCAST_VALUES else table


def _new_rows(seqs: DataFrame, scale_factor: int, method: str, table: DataFrame, x: Column) -> DataFrame:
    """Originals, then the sampled copies; classes without parameters are not grown."""
    whole = copies(seqs.select(ID, LABEL, "x"), 1, method).withColumn("scale_factor", F.lit(scale_factor))
    slots = copies(seqs.select(ID, LABEL), scale_factor, method).filter(F.col("copy") > 0)
    made = slots.join(table, LABEL).withColumn("x", x)
    return whole.unionByName(made.select(*whole.columns))


def _pick(cumulative: Column, u: Column) -> Column:
    """Index of the first cumulative weight above ``u``."""
    return F.least(F.size(F.filter(cumulative, lambda w: w <= u)), F.size(cumulative) - 1)


# --- Gaussian mixture -----------------------------------------------------------------


def fit_gmm(seqs: DataFrame, seed: int = 42) -> tuple[Params, dict[str, list[float]]]:
    """Diagonal mixture per class by expectation-maximisation; also the log-likelihood path.

    min(max(1, n // 2), 5) components, started at the first rows in hash order.
    """
    channels, steps = _shape(seqs)
    dim = channels * steps
    rows = _noisy(seqs, seed, steps)
    params: Params = {}
    paths: dict[str, list[float]] = {}
    for sizes in class_sizes(seqs, 2 * dim * MAX_COMPONENTS):
        part = rows.filter(F.col(LABEL).isin(list(sizes)))
        state = _start_gmm(part, sizes, dim, seed)
        open_labels = set(state)
        for _ in range(MAX_ITER):
            live = {l: state[l] for l in open_labels}
            stats = _sum_statistics(part.filter(F.col(LABEL).isin(list(live))), _gmm_statistics(live, dim))
            for label, s in stats.items():
                k = len(live[label]["weight"])
                nk, s1, s2 = s[:k], s[k : k + k * dim].reshape(k, dim), s[k + k * dim : -1].reshape(k, dim)
                path = paths.setdefault(label, [])
                path.append(s[-1] / nk.sum())
                state[label] = _gmm_maximise(live[label], nk, s1, s2)
                if len(path) > 1 and abs(path[-1] - path[-2]) < TOLERANCE:
                    open_labels.discard(label)
            if not open_labels:
                break
        params.update(state)
    return params, paths


def _start_gmm(rows: DataFrame, sizes: dict[str, int], dim: int, seed: int) -> Params:
    moments = _sum_statistics(
        rows, lambda label, x: (lambda m: np.concatenate([[len(m)], m.sum(0), (m * m).sum(0)]))(_stack(x).reshape(len(x), -1))
    )
    ks = {label: min(max(1, n // 2), MAX_COMPONENTS) for label, n in sizes.items()}
    order = Window.partitionBy(LABEL).orderBy(draws.key_hash(seed, "component", ID), ID)
    firsts = (
        rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= MAX_COMPONENTS)
        .select(LABEL, "r", F.flatten("x").alias("v")).orderBy(LABEL, "r").collect()
    )
    out: Params = {}
    for label, k in ks.items():
        n, s1, s2 = moments[label][0], moments[label][1 : 1 + dim], moments[label][1 + dim :]
        var = np.maximum(s2 / n - (s1 / n) ** 2, VARIANCE_FLOOR)
        means = np.array([r["v"] for r in firsts if r[LABEL] == label][:k])
        out[label] = {"weight": np.full(k, 1.0 / k), "mean": means, "var": np.tile(var, (k, 1))}
    return out


def _gmm_statistics(params: Params, dim: int) -> Callable[[str, pd.Series], np.ndarray]:
    def fn(label: str, x: pd.Series) -> np.ndarray:
        m = _stack(x).reshape(len(x), -1)
        p = params[label]
        log = np.stack(
            [
                math.log(max(w, 1e-300))
                - 0.5 * (np.log(2 * math.pi * var).sum() + ((m - mean) ** 2 / var).sum(axis=1))
                for w, mean, var in zip(p["weight"], p["mean"], p["var"])
            ],
            axis=1,
        )
        top = log.max(axis=1, keepdims=True)
        total = top + np.log(np.exp(log - top).sum(axis=1, keepdims=True))
        r = np.exp(log - total)
        return np.concatenate([r.sum(0), (r.T @ m).ravel(), (r.T @ (m * m)).ravel(), [total.sum()]])

    return fn


def _gmm_maximise(old: dict[str, np.ndarray], nk: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> dict[str, np.ndarray]:
    """New parameters; a component that lost all rows keeps its place with no weight."""
    held = nk > 1e-10
    safe = np.where(held, nk, 1.0)[:, None]
    mean = np.where(held[:, None], s1 / safe, old["mean"])
    var = np.where(held[:, None], s2 / safe - mean**2, old["var"])
    return {"weight": nk / nk.sum(), "mean": mean, "var": np.maximum(var, 0.0) + VARIANCE_FLOOR}


def gmm(seqs: DataFrame, scale_factor: int = 2, seed: int = 42) -> DataFrame:
    """New sequences drawn from a diagonal Gaussian mixture per class."""
    channels, steps = _shape(seqs)
    params, _ = fit_gmm(seqs, seed)
    table = _as_table(
        seqs,
        {l: {"cum": np.cumsum(p["weight"]), "mean": p["mean"], "std": np.sqrt(p["var"])} for l, p in params.items()},
        ["cum", "mean", "std"],
    )
    comp = _pick(F.col("cum")[0], draws.uniform(draws.key_hash(seed, "gmm", ID, "copy")))

    def channel(i: Column) -> Column:
        z = draws.normals(steps, seed, "gmmz", ID, "copy", i)
        cut = lambda a: F.slice(F.get(F.col(a), comp), i * steps + 1, steps)
        ms = F.arrays_zip(cut("mean").alias("m"), cut("std").alias("s"))
        return F.zip_with(ms, z, lambda p, e: p["m"] + p["s"] * e)

    x = F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), channel)
    return _new_rows(seqs, scale_factor, "GMM", table, x)


# --- hidden Markov model --------------------------------------------------------------


def fit_hmm(seqs: DataFrame, seed: int = 42) -> tuple[Params, dict[str, list[float]]]:
    """Gaussian-emission hidden Markov model per class by Baum-Welch; also the log-likelihood path.

    max(1, min(2, n // 2)) states, diagonal covariances with a floor, and 1.1 pseudo-count
    priors on start and transition probabilities.
    """
    channels, steps = _shape(seqs)
    rows = _noisy(seqs, seed, steps)
    params: Params = {}
    paths: dict[str, list[float]] = {}
    for sizes in class_sizes(seqs, 4 * channels * MAX_STATES):
        part = rows.filter(F.col(LABEL).isin(list(sizes)))
        state = _start_hmm(part, sizes, channels)
        open_labels = set(state)
        for _ in range(MAX_ITER):
            live = {l: state[l] for l in open_labels}
            stats = _sum_statistics(part.filter(F.col(LABEL).isin(list(live))), _hmm_statistics(live))
            for label, s in stats.items():
                path = paths.setdefault(label, [])
                path.append(float(s[-1]))
                state[label] = _hmm_maximise(live[label], s, channels)
                if len(path) > 1 and path[-1] - path[-2] < HMM_TOLERANCE:
                    open_labels.discard(label)
            if not open_labels:
                break
        params.update(state)
    return params, paths


def _start_hmm(rows: DataFrame, sizes: dict[str, int], channels: int) -> Params:
    """States start half a standard deviation below and above the class mean."""

    def moments(label: str, x: pd.Series) -> np.ndarray:
        m = _stack(x)
        return np.concatenate([[m.shape[0] * m.shape[2]], m.sum(axis=(0, 2)), (m * m).sum(axis=(0, 2))])

    out: Params = {}
    for label, s in _sum_statistics(rows, moments).items():
        k = max(1, min(MAX_STATES, sizes[label] // 2))
        mean = s[1 : 1 + channels] / s[0]
        var = np.maximum(s[1 + channels :] / s[0] - mean**2, 0.0) + MIN_COVAR
        shift = np.linspace(-0.5, 0.5, k)[:, None] if k > 1 else np.zeros((1, 1))
        out[label] = {
            "start": np.full(k, 1.0 / k),
            "trans": np.full((k, k), 1.0 / k),
            "mean": mean + shift * np.sqrt(var),
            "var": np.tile(var, (k, 1)),
        }
    return out


def _hmm_statistics(params: Params) -> Callable[[str, pd.Series], np.ndarray]:
    """Scaled forward-backward for all sequences of a batch at once."""

    def fn(label: str, x: pd.Series) -> np.ndarray:
        p = params[label]
        m = np.transpose(_stack(x), (0, 2, 1))
        n, steps, _ = m.shape
        k = len(p["start"])
        log = np.stack(
            [-0.5 * (np.log(2 * math.pi * v).sum() + ((m - mu) ** 2 / v).sum(axis=2)) for mu, v in zip(p["mean"], p["var"])],
            axis=2,
        )
        top = log.max(axis=2, keepdims=True)
        emit = np.exp(log - top)
        alpha, scale, beta = np.empty((n, steps, k)), np.empty((n, steps)), np.ones((n, steps, k))
        for t in range(steps):
            a = (p["start"] if t == 0 else alpha[:, t - 1] @ p["trans"]) * emit[:, t]
            scale[:, t] = a.sum(axis=1)
            alpha[:, t] = a / scale[:, t, None]
        for t in range(steps - 2, -1, -1):
            beta[:, t] = (emit[:, t + 1] * beta[:, t + 1]) @ p["trans"].T / scale[:, t + 1, None]
        gamma = alpha * beta
        gamma /= gamma.sum(axis=2, keepdims=True)
        after = emit[:, 1:] * beta[:, 1:] / scale[:, 1:, None]
        trans = np.einsum("nti,ntj->ij", alpha[:, :-1], after) * p["trans"]
        return np.concatenate(
            [
                gamma[:, 0].sum(axis=0),
                trans.ravel(),
                gamma.sum(axis=(0, 1)),
                np.einsum("nts,ntf->sf", gamma, m).ravel(),
                np.einsum("nts,ntf->sf", gamma, m * m).ravel(),
                [(np.log(scale) + top[:, :, 0]).sum()],
            ]
        )

    return fn


def _hmm_maximise(old: dict[str, np.ndarray], s: np.ndarray, channels: int) -> dict[str, np.ndarray]:
    k = len(old["start"])
    cuts = np.cumsum([k, k * k, k, k * channels, k * channels])
    start, trans, post, obs, obs2, _ = np.split(s, cuts)
    start = np.maximum(start + PRIOR - 1.0, 0.0)
    trans = np.maximum(trans.reshape(k, k) + PRIOR - 1.0, 0.0)
    weight = np.maximum(post, 1e-10)[:, None]
    mean = obs.reshape(k, channels) / weight
    var = np.maximum(obs2.reshape(k, channels) / weight - mean**2, MIN_COVAR)
    return {
        "start": start / start.sum(),
        "trans": trans / trans.sum(axis=1, keepdims=True),
        "mean": mean,
        "var": var,
    }


def hmm(seqs: DataFrame, scale_factor: int = 2, seed: int = 42) -> DataFrame:
    """New sequences: a keyed walk over the states of the class, then keyed emissions."""
    channels, steps = _shape(seqs)
    params, _ = fit_hmm(seqs, seed)
    table = _as_table(
        seqs,
        {
            l: {
                "cum_start": np.cumsum(p["start"]),
                "cum_trans": np.cumsum(p["trans"], axis=1),
                "mean": p["mean"],
                "std": np.sqrt(p["var"]),
            }
            for l, p in params.items()
        },
        ["cum_start", "cum_trans", "mean", "std"],
    )
    hashes = F.transform(
        F.sequence(F.lit(0), F.lit((steps + 3) // 4 - 1)), lambda b: draws.key_hash(seed, "walk", ID, "copy", b)
    )
    us = F.slice(
        F.flatten(F.transform(hashes, lambda h: F.array(*[draws.uniform(h, j) for j in range(4)]))), 1, steps
    )

    def step(path: Column, u: Column) -> Column:
        cum = F.when(F.size(path) == 0, F.col("cum_start")[0]).otherwise(
            F.get(F.col("cum_trans"), F.try_element_at(path, F.lit(-1)))
        )
        return F.concat(path, F.array(_pick(cum, u)))

    walk = F.aggregate(us, F.array().cast("array<int>"), step)

    def emissions(path: Column) -> Column:
        def channel(i: Column) -> Column:
            z = draws.normals(steps, seed, "hmmz", ID, "copy", i)
            return F.zip_with(
                path, z, lambda s, e: F.get(F.get(F.col("mean"), s), i) + F.get(F.get(F.col("std"), s), i) * e
            )

        return F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), channel)

    return _new_rows(seqs, scale_factor, "HMM_GMM", table, bind(walk, emissions))


# --- latent Gaussian ------------------------------------------------------------------


def latent_gaussian(seqs: DataFrame, scale_factor: int = 2, seed: int = 42) -> DataFrame:
    """New sequences from up to 16 principal axes per class, each a Gaussian.

    Takes the place of a variational autoencoder of the same latent size. Classes with
    ten members or fewer are not grown.
    """
    channels, steps = _shape(seqs)
    dim = channels * steps
    rows = cut_lineage(seqs.select(LABEL, F.flatten("x").alias("v")).withColumn("features", array_to_vector("v")))
    params: Params = {}
    for sizes in class_sizes(seqs, (LATENT_DIMENSIONS + 2) * dim):
        for label, n in sizes.items():
            if n < LATENT_MIN_ROWS:
                continue
            part = rows.filter(F.col(LABEL) == label)
            model = PCA(k=min(LATENT_DIMENSIONS, n - 1, dim), inputCol="features", outputCol="z").fit(part)
            axes = model.pc.toArray()
            sums = _sum_statistics(
                part.select(LABEL, F.array("v").alias("x")),
                lambda _, x, axes=axes: _projection_moments(_stack(x)[:, 0], axes),
            )[label]
            mean = sums[1 : 1 + dim] / sums[0]
            centre = mean @ axes
            var = np.maximum(sums[1 + dim :] / sums[0] - centre**2, 0.0)
            params[label] = {"mean": mean, "axes": axes * np.sqrt(var)}
    table = _as_table(seqs, params, ["mean", "axes"])

    def values(z: Column) -> Column:
        flat = F.zip_with(
            F.col("mean")[0],
            F.col("axes"),
            lambda m, row: F.aggregate(F.zip_with(row, z, lambda a, e: a * F.coalesce(e, F.lit(0.0))), m, lambda s, v: s + F.coalesce(v, F.lit(0.0))),
        )
        return bind(
            flat,
            lambda f: F.transform(
                F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.slice(f, c * steps + 1, steps)
            ),
        )

    x = bind(draws.normals(LATENT_DIMENSIONS, seed, "latent", ID, "copy"), values)
    return _new_rows(seqs, scale_factor, "TimeVAE", table, x)


def _projection_moments(m: np.ndarray, axes: np.ndarray) -> np.ndarray:
    z = m @ axes
    return np.concatenate([[len(m)], m.sum(axis=0), (z * z).sum(axis=0)])


register("GMM", gmm)
register("HMM_GMM", hmm)
register("TimeVAE", latent_gaussian)
