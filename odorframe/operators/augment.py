"""Synthetic sequences from single sequences, and same-class mixing.

Contract of every generator: sequences in, ``synthetic`` out, with the originals as
copy 0 and ``scale_factor - 1`` augmented copies of each. Draws depend only on
(seed, method, measurement, copy, ...).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odorframe.functions import draws
from odorframe.functions.arrays import bind, double_array, lerp_channels, sample_linear, spline_basis
from odorframe.functions.ranking import number_rows
from odorframe.session import small_side

ID, LABEL = "measurement_id", "label"
XTYPE = "array<array<double>>"

# Default parameters of the generators.
JITTER_SIGMA = 0.03
SCALING_SIGMA = 0.1
WARP_SIGMA = 0.2
WARP_KNOTS = 4
SEGMENTS = 4
MIN_SEGMENT = 10
WINDOW_RATIO = 0.9
MIXUP_ALPHA = 0.2


def copies(seqs: DataFrame, scale_factor: int, method: str) -> DataFrame:
    """Each sequence ``scale_factor`` times, copy 0 being the original; one pass, no union."""
    return (
        seqs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(scale_factor - 1))))
        .withColumn("source_id", F.col(ID))
        .withColumn("method", F.lit(method))
        .withColumn("scale_factor", F.lit(scale_factor))
    )


def _augmented(seqs: DataFrame, scale_factor: int, method: str, x: Column) -> DataFrame:
    return copies(seqs, scale_factor, method).withColumn(
        "x", F.when(F.col("copy") == 0, F.col("x")).otherwise(x)
    )


def _per_channel(fn: Callable[[Column, Column], Column]) -> Column:
    return F.transform(F.col("x"), fn)


def steps_of(seqs: DataFrame, steps: int | None = None) -> int:
    """The number of steps that all channels of all sequences have (0 for an empty table).

    Raises where lengths differ, or differ from the ``steps`` asked for.
    """
    found = {n for r in seqs.select(F.array_distinct(F.transform("x", lambda c: F.size(c)))).distinct().limit(3).collect() for n in r[0]}
    if len(found) > 1 or (steps is not None and found - {steps}):
        raise ValueError(f"sequences of one length{f', {steps},' if steps else ''} are needed, not {sorted(found)}")
    return found.pop() if found else 0


def jitter(seqs: DataFrame, scale_factor: int = 2, seed: int = 42, sigma: float = JITTER_SIGMA) -> DataFrame:
    """Adds N(0, sigma) to every cell; one hash gives the noise of four steps."""

    def noisy(c: Column, i: Column) -> Column:
        return bind(
            _normals(c, seed, "jitter", i),
            lambda z: F.zip_with(c, z, lambda v, e: v + F.lit(sigma) * e),
        )

    return _augmented(seqs, scale_factor, "Jittering", _per_channel(noisy))


def _normals(c: Column, seed: int, purpose: str, i: Column) -> Column:
    """As many keyed normals as ``c`` has steps."""
    n = F.size(c)
    blocks = F.sequence(F.lit(0), F.ceil(n / 4).cast("int") - 1)
    hashes = F.transform(blocks, lambda b: draws.key_hash(seed, purpose, ID, "copy", i, b))
    polar = F.flatten(
        F.transform(
            hashes,
            lambda h: F.array(
                *[
                    F.struct(
                        F.sqrt(F.lit(-2.0) * F.log(draws.open_uniform(h, p))).alias("r"),
                        (F.lit(2.0 * math.pi) * draws.uniform(h, p + 1)).alias("a"),
                    )
                    for p in (0, 2)
                ]
            ),
        )
    )
    both = F.flatten(F.transform(polar, lambda p: F.array(p["r"] * F.cos(p["a"]), p["r"] * F.sin(p["a"]))))
    return F.slice(both, F.lit(1), n)


def scaling(seqs: DataFrame, scale_factor: int = 2, seed: int = 42, sigma: float = SCALING_SIGMA) -> DataFrame:
    """Multiplies each channel by one N(1, sigma) factor."""

    def scaled(c: Column, i: Column) -> Column:
        z = draws.normal(draws.key_hash(seed, "scaling", ID, "copy", i))
        return bind(F.lit(1.0) + F.lit(sigma) * z, lambda f: F.transform(c, lambda v: v * f))

    return _augmented(seqs, scale_factor, "Scaling", _per_channel(scaled))


def _knot_values(seed: int, purpose: str, knots: int, sigma: float, copy: Column, i: Column) -> Column:
    z = draws.normals(knots, seed, purpose, ID, copy, i)
    return F.transform(z, lambda v: F.lit(1.0) + F.lit(sigma) * v)


def magnitude_warping(
    seqs: DataFrame,
    scale_factor: int = 2,
    seed: int = 42,
    sigma: float = WARP_SIGMA,
    knot: int = WARP_KNOTS,
    steps: int | None = None,
) -> DataFrame:
    """Multiplies each channel by a smooth random curve around 1.

    The curve is a spline through ``knot + 2`` N(1, sigma) values, which is a fixed
    (steps x knots) matrix times the values.
    """
    steps = steps_of(seqs, steps)
    if steps < 2:
        return _augmented(seqs, scale_factor, "Magnitude_Warping", F.col("x"))
    basis = double_array(spline_basis(steps, knot + 2))

    def warped(c: Column, i: Column) -> Column:
        return bind(
            _knot_values(seed, "magnitude", knot + 2, sigma, F.col("copy"), i),
            lambda w: F.zip_with(
                c, basis, lambda v, b: v * sum((b[j] * w[j] for j in range(1, knot + 2)), b[0] * w[0])
            ),
        )

    return _augmented(seqs, scale_factor, "Magnitude_Warping", _per_channel(warped))


def time_warping(
    seqs: DataFrame,
    scale_factor: int = 2,
    seed: int = 42,
    sigma: float = WARP_SIGMA,
    knot: int = WARP_KNOTS,
    steps: int | None = None,
) -> DataFrame:
    """Stretches and squeezes time along a smooth random curve, per channel.

    A spline through knot position times N(1, sigma) is rescaled to end at the last
    step, clipped, and made non-decreasing by a running maximum; the channel is then
    read off the bent time axis by linear interpolation. The bracket search of that
    last step has no array function, so it runs as one vectorised Arrow function.
    """
    steps = steps_of(seqs, steps)
    if steps < 2:
        return _augmented(seqs, scale_factor, "Time_Warping", F.col("x"))
    basis = spline_basis(steps, knot + 2) * np.linspace(0.0, steps - 1.0, knot + 2)

    @F.pandas_udf(XTYPE)
    def bend(xs: pd.Series, knot_values: pd.Series) -> pd.Series:
        out = xs.copy()
        bent = np.flatnonzero(knot_values.notna().to_numpy())
        if len(bent) == 0:
            return out
        # All channels of the batch at once: (rows x channels, steps).
        x = np.array([np.stack(xs.iloc[i]) for i in bent])
        w = np.array([np.stack(knot_values.iloc[i]) for i in bent])
        rows, channels = x.shape[:2]
        curve = w.reshape(rows * channels, -1) @ basis.T
        curve = np.clip(curve * ((steps - 1) / curve[:, -1:]), 0.0, steps - 1.0)
        curve = np.maximum.accumulate(curve, axis=1)
        # The last place of each curve that is not beyond a step: one search over shifted curves.
        shift = np.arange(rows * channels)[:, None] * float(2 * steps)
        grid = np.arange(steps, dtype=float) + shift
        at = np.searchsorted((curve + shift).ravel(), grid.ravel(), side="right") - 1
        first = np.repeat(np.arange(rows * channels) * steps, steps)
        low = np.clip(at, first, first + steps - 1)
        high = np.minimum(low + 1, first + steps - 1)
        flat, y = curve.ravel(), x.reshape(rows * channels, steps).ravel()
        gap = flat[high] - flat[low]
        share = np.where(gap > 0, (np.tile(np.arange(steps, dtype=float), rows * channels) - flat[low]) / np.where(gap > 0, gap, 1.0), 0.0)
        made = (y[low] + np.clip(share, 0.0, 1.0) * (y[high] - y[low])).reshape(rows, channels, steps)
        for i, m in zip(bent, made):
            out.iat[i] = list(m)
        return out

    def with_knots(copy: Column) -> Column:
        values = _per_channel(lambda c, i: _knot_values(seed, "time", knot + 2, sigma, copy, i))
        return F.struct(copy.alias("copy"), F.when(copy > 0, values).alias("knots"))

    # The knot values ride along with the copy numbers, so the function below gets plain columns.
    every = F.transform(F.sequence(F.lit(0), F.lit(scale_factor - 1)), with_knots)
    return (
        seqs.withColumn("__k", F.explode(every))
        .withColumn("x", bend(F.col("x"), F.col("__k.knots")))
        .withColumn("copy", F.col("__k.copy"))
        .withColumn("source_id", F.col(ID))
        .withColumn("method", F.lit("Time_Warping"))
        .withColumn("scale_factor", F.lit(scale_factor))
        .drop("__k")
    )


def permutation(
    seqs: DataFrame,
    scale_factor: int = 2,
    seed: int = 42,
    segments: int = SEGMENTS,
    min_segment: int = MIN_SEGMENT,
    steps: int | None = None,
) -> DataFrame:
    """Cuts the sequence at random steps and shuffles the segments, all channels alike.

    Every cut pattern with segments of at least the minimum length (and a last one
    longer than it) is equally likely: distinct draws from the spare steps, sorted,
    then spread by the minimum. Too short sequences get equal segments.
    """
    steps = steps_of(seqs, steps)
    if steps // segments < 1:
        return _augmented(seqs, scale_factor, "Permutation", F.col("x"))
    least = min(min_segment, steps // segments)
    spare = steps - segments * least - 1
    if spare < 0:
        cuts = F.lit([int(c) for c in np.linspace(0, steps, segments + 1)])
    else:
        cuts = _distinct_cuts(seed, segments, least, spare, steps)
    order = F.transform(
        F.array_sort(
            F.transform(
                F.sequence(F.lit(0), F.lit(segments - 1)),
                lambda s: F.struct(
                    draws.key_hash(seed, "segment", ID, "copy", s).alias("h"), s.cast("int").alias("s")
                ),
            )
        ),
        lambda e: e["s"],
    )

    def shuffled(plan: Column) -> Column:
        return F.transform(
            F.col("x"),
            lambda c: F.flatten(
                F.transform(
                    plan["order"],
                    lambda s: F.slice(
                        c, F.get(plan["cuts"], s) + 1, F.get(plan["cuts"], s + 1) - F.get(plan["cuts"], s)
                    ),
                )
            ),
        )

    plan = F.struct(order.alias("order"), cuts.alias("cuts"))
    return _augmented(seqs, scale_factor, "Permutation", bind(plan, shuffled))


def _distinct_cuts(seed: int, segments: int, least: int, spare: int, steps: int) -> Column:
    """Segment borders 0..steps from ``segments - 1`` distinct keyed draws.

    Draw i picks the u-th of the numbers not taken yet: it moves up past each taken
    number, in ascending order, that is not larger.
    """
    n = spare + segments - 1
    draw = lambda i: draws.index(draws.key_hash(seed, "cut", ID, "copy", F.lit(i)), n - i).cast("int")
    taken = F.array(draw(0))
    for i in range(1, segments - 1):
        taken = bind(
            taken,
            _insert_draw(draw(i)),
        )
    inner = F.transform(taken, lambda v, i: (v - i + (i + 1) * least).cast("int"))
    return F.concat(F.array(F.lit(0)), inner, F.array(F.lit(steps)))


def _insert_draw(u: Column) -> Callable[[Column], Column]:
    def insert(taken: Column) -> Column:
        free = F.aggregate(taken, u, lambda acc, t: acc + (t <= acc).cast("int"))
        return F.array_sort(F.concat(taken, F.array(free)))

    return insert


def window_slicing(
    seqs: DataFrame, scale_factor: int = 2, seed: int = 42, ratio: float = WINDOW_RATIO, steps: int | None = None
) -> DataFrame:
    """A random window of ``ratio`` of the length, stretched back to full length."""
    steps = steps_of(seqs, steps)
    length = math.ceil(ratio * steps)
    if length >= steps:
        return _augmented(seqs, scale_factor, "Window_Slicing", F.col("x"))
    start = draws.index(draws.key_hash(seed, "window", ID, "copy"), steps - length).cast("int")
    at = np.linspace(0, length, steps)
    sliced = bind(start, lambda s: F.transform(F.col("x"), lambda c: sample_linear(c, at, length, s)))
    return _augmented(seqs, scale_factor, "Window_Slicing", sliced)


def class_ranks(keys: DataFrame, seed: int) -> DataFrame:
    """``measurement_id, label, rank``: members of a class numbered in hash order."""
    return number_rows(keys, draws.key_hash(seed, "rank", ID), tie=ID, partition=[LABEL])


def mixup(seqs: DataFrame, scale_factor: int = 2, seed: int = 42, alpha: float = MIXUP_ALPHA) -> DataFrame:
    """Each copy mixes its sequence with a random one of its class (possibly itself).

    The partner is a random rank of the class: an equi-join on (label, rank) over
    keys only, evenly spread however large the class is. A class of one is copied.
    """
    keys = seqs.select(ID, LABEL)
    ranks = class_ranks(keys, seed)
    sizes = small_side(keys.groupBy(LABEL).agg(F.count("*").alias("__n")), 2)
    base = copies(keys, scale_factor, "Mixup").filter(F.col("copy") > 0).join(sizes, LABEL)
    pick = draws.index(draws.key_hash(seed, "partner", ID, "copy"), F.col("__n")) + 1
    pairs = (
        base.withColumn("rank", pick)
        .join(ranks.select(LABEL, "rank", F.col(ID).alias("__partner")), [LABEL, "rank"])
        .withColumn("__lam", draws.beta_symmetric(alpha, seed, "lambda", ID, "copy"))
        .select(ID, "copy", "__partner", "__lam")
    )
    partner = seqs.select(F.col(ID).alias("__partner"), F.col("x").alias("__px"))
    mixed = pairs.join(partner, "__partner").join(seqs, ID)
    made = mixed.withColumn("x", lerp_channels(F.col("__px"), F.col("x"), F.col("__lam")))
    whole = copies(seqs, 1, "Mixup")
    tagged = made.withColumns(
        {"source_id": F.col(ID), "method": F.lit("Mixup"), "scale_factor": F.lit(scale_factor)}
    ).select(*whole.columns)
    return whole.withColumn("scale_factor", F.lit(scale_factor)).unionByName(tagged)


Generator = Callable[..., DataFrame]
_REGISTRY: dict[str, Generator] = {
    "Jittering": jitter,
    "Scaling": scaling,
    "Magnitude_Warping": magnitude_warping,
    "Time_Warping": time_warping,
    "Permutation": permutation,
    "Window_Slicing": window_slicing,
    "Mixup": mixup,
}


def register(name: str, generator: Generator) -> None:
    """Adds a generator: ``generator(seqs, scale_factor=, seed=, **params) -> synthetic``."""
    _REGISTRY[name] = generator


def generators() -> dict[str, Generator]:
    return dict(_REGISTRY)


def generate(seqs: DataFrame, method: str, scale_factor: int, seed: int = 42, **params) -> DataFrame:
    """Runs a registered generator."""
    return _REGISTRY[method](seqs, scale_factor=scale_factor, seed=seed, **params)


def eligibility(seqs: DataFrame, run: list[str], n_seeds: str, min_seeds: dict[str, int]) -> DataFrame:
    """Outcome per (run, method, label) before any work: ``ok`` or why the method is skipped.

    A method is gated by the seed size of the run, SMOTE and ADASYN also by the
    smallest class of the run.
    """
    sizes = seqs.groupBy(*run, n_seeds, LABEL).agg(F.count("*").alias("n"))
    smallest = sizes.groupBy(*run, n_seeds).agg(F.min("n").alias("smallest_class"))
    gates = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(k).alias("k")) for m, k in min_seeds.items()])
    return (
        sizes.join(smallest, [*run, n_seeds])
        .withColumn("__g", F.explode(gates))
        .withColumn("method", F.col("__g.method"))
        .withColumn(
            "outcome",
            F.when(F.col(n_seeds) < F.col("__g.k"), F.lit("seed size below gate"))
            .when(
                F.col("method").isin("SMOTE", "ADASYN") & (F.col("smallest_class") <= 1),
                F.lit("a class has one member"),
            )
            .otherwise(F.lit("ok")),
        )
        .drop("__g")
    )
