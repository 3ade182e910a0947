"""Array expressions on sequences: ``x`` is ARRAY<ARRAY<DOUBLE>>, channel-major."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def double_array(values) -> Column:
    """Literal ARRAY<DOUBLE> (or nested) from a small driver-side array."""
    return F.lit(np.asarray(values, dtype=float).tolist())


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once per row.

    A lambda body that mentions an outer expression computes it again for every
    element; a one-element transform turns it into a lambda variable first.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def flat_time_major(x: Column) -> Column:
    """(t, channel) order, the order of a row-major reshape of a (T, F) matrix."""

    def body(m: Column) -> Column:
        steps = F.sequence(F.lit(0), F.size(m[0]) - 1)
        return F.flatten(F.transform(steps, lambda t: F.transform(m, lambda c: F.get(c, t))))

    return bind(x, body)


def unflatten_time_major(v: Column, channels: int) -> Column:
    """Inverse of :func:`flat_time_major`."""

    def body(f: Column) -> Column:
        steps = F.sequence(F.lit(0), (F.size(f) / channels).cast("int") - 1)
        return F.transform(
            F.sequence(F.lit(0), F.lit(channels - 1)),
            lambda c: F.transform(steps, lambda t: F.get(f, t * channels + c)),
        )

    return bind(v, body)


def lerp_channels(a: Column, b: Column, w: Column) -> Column:
    """``a + w * (b - a)`` cell by cell."""
    return F.zip_with(a, b, lambda ca, cb: F.zip_with(ca, cb, lambda p, q: p + w * (q - p)))


def sample_linear(v: Column, positions: np.ndarray, length: int, start: Column) -> Column:
    """Linear interpolation of ``v[start : start+length]`` at fixed fractional positions.

    Positions past the last sample take the last sample.
    """
    lo = np.minimum(np.floor(positions).astype(int), length - 1)
    frac = np.where(lo >= length - 1, 0.0, positions - lo)
    hi = np.minimum(lo + 1, length - 1)
    plan = F.arrays_zip(
        F.lit(lo.tolist()).alias("lo"), F.lit(hi.tolist()).alias("hi"), double_array(frac).alias("w")
    )
    return F.transform(
        plan,
        lambda p: F.get(v, start + p["lo"]) + p["w"] * (F.get(v, start + p["hi"]) - F.get(v, start + p["lo"])),
    )


def spline_basis(steps: int, knots: int) -> np.ndarray:
    """(steps, knots) matrix B with ``curve = B @ knot_values``.

    Cubic spline with not-a-knot ends through ``knots`` evenly spaced points of
    0..steps-1, evaluated at every integer step. A spline with fixed knots is
    linear in the knot values, so column j is the spline through unit vector j.
    """
    if knots < 4:
        raise ValueError("a not-a-knot cubic spline needs at least 4 knots")
    h = (steps - 1) / (knots - 1)
    # Second derivatives m solve A m = R v on an even grid; the first and last rows
    # state that the third derivative is continuous at the second and last-but-one knot.
    a = np.zeros((knots, knots))
    r = np.zeros((knots, knots))
    a[0, :3] = a[-1, -3:] = (1.0, -2.0, 1.0)
    for i in range(1, knots - 1):
        a[i, i - 1 : i + 2] = (1.0, 4.0, 1.0)
        r[i, i - 1 : i + 2] = np.array((1.0, -2.0, 1.0)) * 6.0 / h**2
    m = np.linalg.solve(a, r)
    t = np.arange(steps, dtype=float)
    cell = np.clip(np.floor(t / h + 1e-12).astype(int), 0, knots - 2)
    u = t - cell * h
    eye = np.eye(knots)
    b = u / h
    quad_l = ((1 - b) ** 3 - (1 - b)) * h**2 / 6.0
    quad_r = (b**3 - b) * h**2 / 6.0
    return (
        (1 - b)[:, None] * eye[cell]
        + b[:, None] * eye[cell + 1]
        + quad_l[:, None] * m[cell]
        + quad_r[:, None] * m[cell + 1]
    )
