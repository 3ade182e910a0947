"""Random draws that depend only on their key.

Each draw hashes (seed, purpose, key...) with md5, so a row gets the same number
under any partitioning, on a task retry and in any engine that has md5. One hash
carries four 32-bit words: four uniforms, or four normals (two Box-Muller pairs).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = float(2**32)
# Tries of the rejection samplers.
JOHNK_TRIES = 64
GAMMA_TRIES = 16


def key_hash(seed: int, purpose: str, *key: Column | str) -> Column:
    """md5 hex of ``seed|purpose|key...``."""
    parts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in key]
    return F.md5(F.concat_ws("|", F.lit(f"{seed}|{purpose}"), *parts))


def word(h: Column, lane: int) -> Column:
    """The lane-th 32-bit word of the hash as a double (lane 0..3)."""
    return F.conv(F.substring(h, 8 * lane + 1, 8), 16, 10).cast("double")


def uniform(h: Column, lane: int = 0) -> Column:
    """Uniform in [0, 1)."""
    return word(h, lane) / F.lit(TWO32)


def open_uniform(h: Column, lane: int = 0) -> Column:
    """Uniform in (0, 1), safe under a logarithm."""
    return (word(h, lane) + F.lit(1.0)) / F.lit(TWO32 + 1.0)


def index(h: Column, n: Column | int, lane: int = 0) -> Column:
    """Integer in 0..n-1."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.floor(uniform(h, lane) * n).cast("bigint")


def normal(h: Column, lane: int = 0) -> Column:
    """Standard normal; lanes 0/1 and 2/3 are the two members of a Box-Muller pair."""
    base = 2 * (lane // 2)
    radius = F.sqrt(F.lit(-2.0) * F.log(open_uniform(h, base)))
    angle = F.lit(2.0 * math.pi) * uniform(h, base + 1)
    return radius * (F.cos(angle) if lane % 2 == 0 else F.sin(angle))


def normals(n: int, seed: int, purpose: str, *key: Column | str) -> Column:
    """ARRAY<DOUBLE> of n standard normals, one hash per four values.

    The nested transforms bind each hash and each polar pair once.
    """
    blocks = F.sequence(F.lit(0), F.lit((n + 3) // 4 - 1))
    hashes = F.transform(blocks, lambda b: key_hash(seed, purpose, *key, b))
    polar = F.flatten(
        F.transform(
            hashes,
            lambda h: F.array(
                *[
                    F.struct(
                        F.sqrt(F.lit(-2.0) * F.log(open_uniform(h, p))).alias("r"),
                        (F.lit(2.0 * math.pi) * uniform(h, p + 1)).alias("a"),
                    )
                    for p in (0, 2)
                ]
            ),
        )
    )
    both = F.flatten(F.transform(polar, lambda p: F.array(p["r"] * F.cos(p["a"]), p["r"] * F.sin(p["a"]))))
    return F.slice(both, 1, n)


def beta_symmetric(alpha: float, seed: int, purpose: str, *key: Column | str) -> Column:
    """Beta(alpha, alpha), alpha > 0.

    Up to 1 by Johnk's rejection, which accepts a keyed pair with probability 1/2 at least;
    above by two gamma draws. Both take the first accepted of so many tries that none is
    once in 1e19 draws; such a draw is 0.5, the mean.
    """
    if not alpha > 0:
        raise ValueError("alpha must be positive")
    if alpha > 1:
        a, b = (_gamma(alpha, seed, f"{purpose}|{side}", *key) for side in ("a", "b"))
        return F.coalesce(a / (a + b), F.lit(0.5))

    def accepted(start: int, stop: int) -> Column:
        hashes = F.transform(F.sequence(F.lit(start), F.lit(stop - 1)), lambda i: key_hash(seed, purpose, *key, i))
        pairs = F.transform(
            hashes,
            lambda h: F.struct(
                F.pow(open_uniform(h, 0), F.lit(1.0 / alpha)).alias("p"),
                F.pow(open_uniform(h, 1), F.lit(1.0 / alpha)).alias("q"),
            ),
        )
        # Both powers may underflow where alpha is tiny.
        first = F.get(F.filter(pairs, lambda s: (s["p"] + s["q"] <= 1.0) & (s["p"] + s["q"] > 0.0)), F.lit(0))
        return first["p"] / (first["p"] + first["q"])

    # The second lot is only drawn where the first eight fail.
    return F.coalesce(accepted(0, 8), accepted(8, JOHNK_TRIES), F.lit(0.5))


def _gamma(alpha: float, seed: int, purpose: str, *key: Column | str) -> Column:
    """Gamma(alpha) for alpha >= 1 by Marsaglia and Tsang; a try is accepted with probability 0.95 at least."""
    d = alpha - 1.0 / 3.0
    c = 1.0 / math.sqrt(9.0 * d)
    hashes = F.transform(F.sequence(F.lit(0), F.lit(GAMMA_TRIES - 1)), lambda i: key_hash(seed, purpose, *key, i))
    tries = F.transform(hashes, lambda h: F.struct(normal(h, 0).alias("x"), open_uniform(h, 2).alias("u")))
    cubes = F.transform(tries, lambda s: F.struct(s["x"].alias("x"), s["u"].alias("u"), F.pow(F.lit(1.0) + F.lit(c) * s["x"], F.lit(3.0)).alias("v")))
    ok = F.filter(
        cubes,
        lambda s: (s["v"] > 0) & (F.log(s["u"]) < F.lit(0.5) * s["x"] * s["x"] + F.lit(d) - F.lit(d) * s["v"] + F.lit(d) * F.log(s["v"])),
    )
    return F.lit(d) * F.get(ok, F.lit(0))["v"]
