"""Exact k-nearest-neighbour join.

Both sides are cut into tiles (some 32 a side, of 2048 rows to 32 MB) and every needed pair of tiles
meets in one task, which returns only the k nearest per probe row. No pair of rows is
ever emitted and no group is held whole, however many rows share one key.

On a large build side, pivots thin out the tile pairs without changing the result:
each build row belongs to the cell of its nearest pivot, and by the triangle
inequality a probe needs a cell only if the ring of the cell's pivot distances comes
within the probe's bound. The bound is the k-th smallest of
d(probe, pivot) + d(pivot, member) over the k innermost members of each cell, which
are k real rows at most that far away.

Manhattan distances have no matrix product to rank by: codes of a byte a coordinate give lower
bounds, and a sample of the build side tells every probe beforehand how far its k-th nearest row can
be. Where most cells are needed, rows are cut into tiles without cells; and rows that are joined with
themselves meet once per pair of tiles, for the probes of both.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odorframe.functions.draws import key_hash
from odorframe.session import BROADCAST_VALUES, cut_lineage, small_side

CELL_ROWS = 50_000
MAX_PIVOTS = 256
TILE_ROWS = 2048
# A side is cut into about this many tiles, as every row is sent once per opposite tile; a tile holds at most so many values.
TILES = 32
TILE_VALUES = 4_000_000
SUMMARY_VALUES = 2_000_000
# Rows that tell beforehand how far the nearest ones can be hold at most so many values.
SAMPLE_VALUES = 1 << 19
SLACK = 1e-9
# Rows of the build side whose distances to some probes are summed up within a core's cache.
STRIP = 8192
# Rows beyond the nearest ones, per probe, that may lie within rounding.
TOO_CLOSE = 256
# Manhattan distances to so many rows at least are ranked by codes of so many levels: four of them add up in a byte, so many in 15 bits.
CODED_ROWS = 1024
LEVELS = 64
CODED_DIM = 512
# Probes whose codes are compared at once, pairs of rows that a core's cache holds, pairs measured at once.
PROBES = 4096
PAIRS = 1 << 19
MEASURED = 512
# Rows held as possibly among the nearest before they are ranked and most of them dropped.
HELD = 1 << 20


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances between the rows of two small matrices, the Euclidean ones to about 1e-8."""
    if metric == "manhattan":
        return exact_distances(a, b, metric)
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0.0))


def exact_distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """The same from coordinate differences."""
    out = np.empty((len(a), len(b)))
    for i, row in enumerate(a):
        diff = b - row
        out[i] = np.abs(diff).sum(1) if metric == "manhattan" else np.sqrt((diff * diff).sum(1))
    return out


class RoughManhattan:
    """Manhattan distances to the rows of a matrix in single precision, and how far they may be off.

    Coordinates are taken from the rows' middle, so that a common offset costs no precision.
    """

    def __init__(self, bv: np.ndarray):
        self.middle = bv.mean(axis=0)
        self.columns = np.ascontiguousarray((bv - self.middle).T, dtype=np.float32)
        self.most = float(np.abs(self.columns).max(initial=0.0))

    def __call__(self, p: np.ndarray) -> tuple[np.ndarray, float]:
        p = (p - self.middle).astype(np.float32)
        dim, n = self.columns.shape
        out = np.zeros((len(p), n), np.float32)
        for c in range(0, n, STRIP):
            strip, total = self.columns[:, c : c + STRIP], np.zeros((len(p), min(STRIP, n - c)), np.float32)
            diff = np.empty_like(total)
            for j in range(dim):
                np.subtract(strip[j], p[:, j, None], out=diff)
                np.abs(diff, out=diff)
                total += diff
            out[:, c : c + STRIP] = total
        # Each coordinate is rounded twice, each difference and each of dim sums once.
        spread = max(self.most, float(np.abs(p).max(initial=0.0)))
        return out, (4 * dim + 2 * dim * dim) * 2.0**-24 * spread


class CodedManhattan:
    """Lower bounds of Manhattan distances to the rows of a matrix from one byte a coordinate.

    A coordinate is clipped to a grid of ``LEVELS`` equal steps, the same step in all columns. Clipping brings
    rows closer only, and the sum of a row's distances to its grid points is known, so
    distance >= step * |code - code'| summed - both rows' sums. Codes differ by a + b - 2 min(a, b), so the smaller
    codes are added up. Rows and shifted probes lie side by side: every sum is over whole arrays of bytes.
    """

    def __init__(self, bv: np.ndarray, scale: float):
        some = bv[:: max(1, len(bv) // 2048)]
        low, high = np.quantile(some, (0.005, 0.995), axis=0)
        self.step = max(float((high - low).max()) / LEVELS, SLACK * scale)
        self.low = (low + high - LEVELS * self.step) / 2
        self.slack = SLACK * scale
        self.n, strips = len(bv), -(-len(bv) // STRIP)
        self.strip = -(-len(bv) // (16 * strips)) * 16
        code, off = self.codes(bv)
        # A strip is even: two sums of bytes are taken apart from one word; and eight of its comparisons are looked at as one. What is added here is left out by its index.
        self.rows = np.zeros((bv.shape[1], strips * self.strip), np.uint8)
        self.rows[:, : self.n] = code.T
        self.total, self.off = code.sum(1, dtype=np.int64), off
        half = np.zeros(self.rows.shape[1], np.int16)
        half[: self.n] = self.asked(self.total, off, 0.0)
        self.half = np.stack([half[0::2], half[1::2]])
        self.shifts = max(1, PAIRS // self.strip)
        self.bytes = [np.empty(self.shifts * self.strip, np.uint8) for _ in range(2)]
        self.words = [np.empty(self.shifts * self.strip // 2, np.uint16) for _ in range(3)]
        self.bound, self.reached = np.empty(self.shifts * self.strip // 2, np.int16), np.empty(self.shifts * self.strip // 2, bool)

    def codes(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of some rows, and the sums of their distances to the grid."""
        out, off = np.empty(v.shape, np.uint8), np.empty(len(v))
        for s in range(0, len(v), MEASURED):
            x = np.clip(v[s : s + MEASURED], self.low, self.low + LEVELS * self.step)
            c = np.clip(np.floor((x - self.low) / self.step), 0, LEVELS - 1)
            out[s : s + MEASURED], off[s : s + MEASURED] = c, np.abs(x - (self.low + (c + 0.5) * self.step)).sum(1)
        return out, off

    def smaller(self, at: int, probes: np.ndarray, shift: int, shifts: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the smaller codes of row 2t, and of row 2t + 1, of a strip with the probe so many places on."""
        size, words = (shifts, self.strip), (shifts, self.strip // 2)
        least, added = (x[: shifts * self.strip].reshape(size) for x in self.bytes)
        both, odd, word = (x[: shifts * self.strip // 2].reshape(words) for x in self.words)
        both.fill(0)
        odd.fill(0)
        rows = self.rows[:, at : at + self.strip]
        shifted = as_strided(probes[:, shift:], (len(probes), *size), (probes.strides[0], 1, 1))
        pair = added.view("<u2")
        for first in range(0, len(probes), 4):
            np.minimum(rows[first], shifted[first], out=added)
            for j in range(first + 1, min(first + 4, len(probes))):
                np.minimum(rows[j], shifted[j], out=least)
                np.add(added, least, out=added)
            np.add(both, pair, out=both)
            np.right_shift(pair, 8, out=word)
            np.add(odd, word, out=odd)
        # both = even + 256 odd, but for whole multiples of 2^16; even is less.
        np.left_shift(odd, 8, out=word)
        np.subtract(both, word, out=both)
        return both, odd

    def hits(self, at: int, shift: int, sums: tuple, rows: np.ndarray, probes: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probe, row) wherever a sum reaches what row and probe ask for together."""
        out_p, out_b = [], []
        for odd, sum_of in enumerate(sums):
            for first in range(min(2, len(sum_of))):
                # Every other shift and every other row: what they need of the probes lies side by side.
                some, place = sum_of[first::2], shift + first + odd
                bound, reached = (x[: some.size].reshape(some.shape) for x in (self.bound, self.reached))
                np.add(as_strided(probes[place % 2, place // 2 :], some.shape, (2, 2)), rows[odd, at // 2 : (at + self.strip) // 2], out=bound)
                np.greater_equal(some.view(np.int16), bound, out=reached)
                eights = reached.reshape(-1, 8)
                word = np.flatnonzero(eights.view(np.uint64))
                i, j = np.nonzero(eights[word])
                s, t = np.divmod(word[i] * 8 + j, self.strip // 2)
                out_p.append(around[place + 2 * s + 2 * t])
                out_b.append(at + 2 * t + odd)
        p, b = np.concatenate(out_p), np.concatenate(out_b)
        real = b < self.n
        return p[real], b[real]

    def asked(self, total: np.ndarray, off: np.ndarray, cut: np.ndarray | float) -> np.ndarray:
        """What a row's half of a sum must reach: at most that far away."""
        return np.maximum(np.floor((total - (off + cut) / self.step) / 2), -20_000).astype(np.int16)

    def nearest(self, first: int, p: np.ndarray, bv: np.ndarray, found: Nearest, back: Nearest | None = None) -> bool:
        """Hands what may be among the nearest of some probes to ``found``, and of the rows to ``back``; False if too many rows are too close for codes."""
        m, strip = len(p), self.strip
        code, off = self.codes(p)
        total = code.sum(1, dtype=np.int64)
        around = np.arange(strip + m + m % 2) % m
        probes = np.ascontiguousarray(code.T[:, around])
        paired = lambda x: np.stack([x[0::2], x[1::2]])
        of_probes = lambda cut: paired(self.asked(total, off, cut)[around])
        cut = found.cut[first : first + m]
        known = np.isfinite(cut).all()
        wanted = of_probes(cut + self.slack) if known else None
        if back is not None:
            own = of_probes(0.0)
            wanted_back = np.zeros(self.rows.shape[1], np.int16)
            wanted_back[: self.n] = self.asked(self.total, self.off, back.cut + self.slack)
            wanted_back = paired(wanted_back)
        # Ranked again whenever twice as many rows are met, where nothing is known before: from the start.
        met, due, tried = 0, max(8 * found.want, self.n // 4 if known else 0), 0
        for at in range(0, self.rows.shape[1], strip):
            shift = 0
            while shift < m:
                shifts = min(m - shift, self.shifts)
                if wanted is None:
                    # Few pairs first, all measured: they give the first cut.
                    shifts = min(shifts, -(-8 * found.want * m // strip))
                    i = np.arange(at, min(at + strip, self.n))
                    found.measure(p, bv, np.concatenate([around[s + i - at] for s in range(shift, shift + shifts)]), np.tile(i, shifts), first)
                else:
                    sums = self.smaller(at, probes, shift, shifts)
                    r, c = self.hits(at, shift, sums, self.half, wanted, around)
                    found.measure(p, bv, r, c, first)
                    tried += len(r)
                    if back is not None:
                        r, c = self.hits(at, shift, sums, wanted_back, own, around)
                        back.measure(bv, p, c, r, 0, first)
                        tried += len(r)
                shift, met = shift + shifts, met + shifts * strip / m
                if tried > met * m / 32 + PAIRS:
                    return False
                if met >= due:
                    found.rank()
                    if np.isfinite(cut).all():
                        wanted = of_probes(cut + self.slack)
                    due = 2 * met
        found.rank()
        if back is not None:
            back.rank()
        return True


class Nearest:
    """The nearest rows so far of some probes: the want nearest set a probe's cut, the k nearest others are the result."""

    def __init__(self, pid: np.ndarray, bid: np.ndarray, k: int, want: int, skip_self: bool, cut: np.ndarray, slack: float):
        self.slack = slack
        self.pid, self.bid, self.k, self.want, self.skip_self, self.cut = pid, bid, k, want, skip_self, cut
        self.fresh, self.pairs, self.held, self.most = [], np.empty((2, 0, 0)), 0, HELD

    def measure(self, pv: np.ndarray, bv: np.ndarray, rows: np.ndarray, cols: np.ndarray, first: int = 0, first_col: int = 0) -> None:
        """Keeps what lies within the cut; ``pv`` begins with probe ``first``, ``bv`` with row ``first_col``."""
        if not self.pairs.size:
            self.pairs = np.empty((2, MEASURED, pv.shape[1]))
        for s in range(0, len(rows), MEASURED):
            r, c = rows[s : s + MEASURED], cols[s : s + MEASURED]
            diff, other = (x[: len(r)] for x in self.pairs)
            np.take(pv, r, axis=0, out=diff, mode="clip")
            np.take(bv, c, axis=0, out=other, mode="clip")
            np.subtract(diff, other, out=diff)
            d = np.abs(diff, out=diff).sum(1)
            near = d <= self.cut[first + r] + self.slack
            self.fresh.append((first + r[near], first_col + c[near], d[near]))
            self.held += np.count_nonzero(near)
        if self.held > self.most:
            self.rank()
            self.most = max(self.most, 2 * self.held)

    def rank(self) -> None:
        if not self.fresh:
            return
        r, c, d = (np.concatenate(x) for x in zip(*self.fresh))
        order = np.lexsort((c, self.bid[c], d, r))
        r, c, d = r[order], c[order], d[order]
        start = np.searchsorted(r, r)
        place = np.arange(len(r)) - start
        last = place == self.want - 1
        self.cut[r[last]] = np.minimum(self.cut[r[last]], d[last])
        self.other = self.pid[r] != self.bid[c] if self.skip_self else np.ones(len(r), bool)
        before = np.cumsum(self.other) - self.other
        result = self.other & (before - before[start] < self.k)
        keep = result | (place < self.want)
        self.fresh, self.other, self.held = [(r[keep], c[keep], d[keep])], result[keep], np.count_nonzero(keep)

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.rank()
        if not self.fresh:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        r, c, d = self.fresh[0]
        near = self.other & (d <= self.cut[r] + self.slack)
        return r[near], c[near], d[near]


def codable(rows: np.ndarray, scale: float) -> bool:
    return len(rows) >= CODED_ROWS and 0 < rows.shape[1] <= CODED_DIM and scale < 1e30


def within_of(within: np.ndarray | None, n: int, scale: float) -> np.ndarray:
    return np.full(n, np.inf) if within is None else within * (1 + SLACK) + SLACK * scale


def nearest_both_ways(av, aid, bv, bid, k: int, skip_self: bool, a_within, b_within) -> tuple[tuple, tuple]:
    """``nearest_in_tile`` of the first rows among the second and of the second among the first, Manhattan, for one pass over the pairs."""
    scale = 1.0 + np.abs(bv).max(initial=0.0) + np.abs(av).max(initial=0.0)
    if codable(bv, scale) and len(av) and np.isfinite(a_within).all() and np.isfinite(b_within).all():
        coded = CodedManhattan(bv, scale)
        there = Nearest(aid, bid, k, min(k + int(skip_self), len(bv)), skip_self, within_of(a_within, len(av), scale), coded.slack)
        back = Nearest(bid, aid, k, min(k + int(skip_self), len(av)), skip_self, within_of(b_within, len(bv), scale), coded.slack)
        block = min(PROBES, coded.strip // 64 * 64)
        if all(coded.nearest(s, av[s : s + block], bv, there, back) for s in range(0, len(av), block)):
            return there.result(), back.result()
    return (
        nearest_in_tile(av, aid, bv, bid, k, "manhattan", skip_self, a_within),
        nearest_in_tile(bv, bid, av, aid, k, "manhattan", skip_self, b_within),
    )


def nearest_in_tile(
    pv: np.ndarray, pid: np.ndarray, bv: np.ndarray, bid: np.ndarray, k: int, metric: str, skip_self: bool, within: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probe index, build index, distance) of the k nearest, ties by build id.

    A matrix product, codes of a byte, or sums in single precision, rank roughly; whatever may be within
    the k-th place is measured again exactly, so equal rows get equal distances. ``within``: rows
    farther from a probe than this may be left out.
    """
    out_p, out_b, out_d = [], [], []
    want = min(k + int(skip_self), len(bv))
    scale = 1.0 + np.abs(bv).max(initial=0.0) + np.abs(pv).max(initial=0.0)
    rough, coded, done = None, None, 0
    if metric == "manhattan" and codable(bv, scale):
        coded = CodedManhattan(bv, scale)
        block, within = min(PROBES, coded.strip // 64 * 64), within_of(within, len(pv), scale)
    for s in range(0, len(pv), 64):
        if coded is not None and s % block == 0:
            found = Nearest(pid[s : s + block], bid, k, want, skip_self, within[s : s + block], coded.slack)
            if coded.nearest(0, pv[s : s + block], bv, found):
                near = found.result()
                out_p.append(s + near[0])
                out_b.append(near[1])
                out_d.append(near[2])
                done = s + block
        if s < done:
            continue
        # Where single precision can't hold the numbers, sums are exact at once.
        if rough is None and metric == "manhattan" and bv.size and scale < 1e30:
            rough = RoughManhattan(bv)
        p = pv[s : s + 64]
        rows = None
        if rough is not None:
            d, off = rough(p)
            cut = np.partition(d, want - 1, axis=1)[:, want - 1].astype(np.float64)
            close = d <= (cut + 2 * off + SLACK * scale)[:, None]
            # Too many within rounding: these probes are measured exactly.
            if np.count_nonzero(close) <= len(p) * (want + TOO_CLOSE):
                rows, cols = np.nonzero(close)
        if rows is None:
            d = distances(p, bv, metric)
            cut = np.partition(d, want - 1, axis=1)[:, want - 1]
            margin = 1e-6 * scale if metric != "manhattan" else SLACK * scale
            rows, cols = np.nonzero(d <= cut[:, None] + margin)
        if skip_self:
            keep = pid[s + rows] != bid[cols]
            rows, cols = rows[keep], cols[keep]
        diff = p[rows] - bv[cols]
        exact = np.abs(diff).sum(1) if metric == "manhattan" else np.sqrt((diff * diff).sum(1))
        order = np.lexsort((bid[cols], exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        top = place < k
        out_p.append(s + rows[top])
        out_b.append(cols[top])
        out_d.append(exact[top])
    return np.concatenate(out_p), np.concatenate(out_b), np.concatenate(out_d)


def _group_key(df: DataFrame, within: list[str]) -> DataFrame:
    """One string key for the columns neighbours must share: JSON, so no two keys look alike and NULL is a key."""
    return df.withColumn("__g", F.to_json(F.struct(F.lit(0).alias("_"), *within), {"ignoreNullFields": "false"}))


def _pivots(build: DataFrame, n: int) -> np.ndarray:
    """n rows in hash order: a bounded matrix, the same on every run."""
    rows = build.orderBy(key_hash(0, "pivot", "__g", "build_id"), "build_id").limit(n).select("v").collect()
    return np.array([r[0] for r in rows], dtype=float)


def _with_cell(build: DataFrame, pivots: np.ndarray, metric: str) -> DataFrame:
    @F.pandas_udf("struct<cell: int, r: double>")
    def locate(v: pd.Series) -> pd.DataFrame:
        cells, radii = [], []
        m = np.stack(v) if len(v) else np.empty((0, pivots.shape[1]))
        for s in range(0, len(m), 512):
            d = exact_distances(m[s : s + 512], pivots, metric)
            c = d.argmin(axis=1)
            cells.append(c)
            radii.append(d[np.arange(len(c)), c])
        return pd.DataFrame(
            {"cell": np.concatenate(cells) if cells else [], "r": np.concatenate(radii) if radii else []}
        )

    return build.withColumn("__l", locate("v")).select(*build.columns, "__l.cell", "__l.r")


def _summary(celled: DataFrame, k: int) -> dict[str, tuple[np.ndarray, ...]]:
    """Per group: cell numbers, ring bounds and the k innermost radii of each cell.

    Its size, groups x pivots x k, was checked when the pivots were chosen.
    """
    ring = celled.groupBy("__g", "cell").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    w = Window.partitionBy("__g", "cell").orderBy("r")
    inner = (
        celled.select("__g", "cell", "r", F.row_number().over(w).alias("i"))
        .filter(F.col("i") <= k)
        .groupBy("__g", "cell")
        .agg(F.sort_array(F.collect_list("r")).alias("inner"))
    )
    per_group: dict[str, list] = {}
    for row in ring.join(inner, ["__g", "cell"]).collect():
        per_group.setdefault(row["__g"], []).append(row)
    out = {}
    for g, rows in per_group.items():
        pad = np.full((len(rows), k), np.inf)
        for i, r in enumerate(rows):
            pad[i, : len(r["inner"])] = r["inner"]
        out[g] = (
            np.array([r["cell"] for r in rows]),
            np.array([r["lo"] for r in rows]),
            np.array([r["hi"] for r in rows]),
            pad,
        )
    return out


def _sample(build: DataFrame, rows: int, dim: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Some rows of each group, chosen by their ids: at most SAMPLE_VALUES values, and few of the rows."""
    n = min(SAMPLE_VALUES // dim, rows // 16)
    chosen = build.withColumn("id", F.col("build_id").cast("string")).filter(F.pmod(F.xxhash64("__g", "build_id", F.lit("sample")), F.lit(rows).cast("bigint")) < n).limit(2 * n)
    groups: dict[str, list] = {}
    for r in chosen.select("__g", "id", "v").collect():
        groups.setdefault(r["__g"], []).append(r)
    return {g: (np.array([r["id"] for r in rs]).astype(str), np.array([r["v"] for r in rs], dtype=float)) for g, rs in groups.items()}


def _bound(probe: DataFrame, sample: dict, k: int, metric: str, skip_self: bool) -> DataFrame:
    """Adds ``bound``: how far the k-th nearest row of a sample is, so that none of the k nearest is farther."""
    sent = probe.sparkSession.sparkContext.broadcast(sample)

    @F.pandas_udf("double")
    def kth(g: pd.Series, pid: pd.Series, v: pd.Series) -> pd.Series:
        out, ids = np.full(len(g), np.inf), pid.to_numpy().astype(str)
        for key, at in g.groupby(g, sort=False).indices.items():
            if key not in sent.value:
                continue
            bid, bv = sent.value[key]
            p, _, d = nearest_in_tile(np.stack(v.iloc[at].to_list()), ids[at], bv, bid, k, metric, skip_self)
            last = np.arange(len(p)) - np.searchsorted(p, p) == k - 1
            out[at[p[last]]] = d[last]
        return pd.Series(out)

    return probe.withColumn("bound", kth("__g", F.col("probe_id").cast("string"), "v"))


def _route(probe: DataFrame, pivots: np.ndarray, summary: dict, k: int, metric: str) -> DataFrame:
    """Adds ``cells``: the cells that may hold one of the k nearest."""

    @F.pandas_udf("array<int>")
    def cells_of(g: pd.Series, v: pd.Series, known: pd.Series) -> pd.Series:
        out = []
        for key, vec, most in zip(g, v, known):
            if key not in summary:
                out.append(np.empty(0, dtype=np.int32))
                continue
            cells, lo, hi, inner = summary[key]
            d = exact_distances(np.asarray(vec)[None, :], pivots[cells], metric)[0]
            bounds = (d[:, None] + inner).ravel()
            bound = min(most, np.partition(bounds, k - 1)[k - 1] if len(bounds) >= k else np.inf)
            slack = SLACK * (1.0 + bound) if np.isfinite(bound) else 0.0
            near = (d - bound - slack <= hi) & (lo <= d + bound + slack)
            out.append(cells[near].astype(np.int32))
        return pd.Series(out)

    return probe.withColumn("cells", cells_of("__g", "v", "bound" if "bound" in probe.columns else F.lit(float("inf"))))


def _join_small(probe: DataFrame, build: DataFrame, k: int, within: list[str], metric: str, skip_self: bool, labels: list[str], id_type) -> DataFrame:
    """The join against a build side that was counted to fit into every task."""
    rows = build.toPandas()
    groups = {}
    for g, part in rows.groupby("__g", sort=False):
        ids = part["build_id"].to_numpy()
        groups[g] = (np.array(part["v"].to_list(), dtype=float), ids, ids.astype(str) if ids.dtype == object else ids, {c: part[c].to_numpy() for c in labels})
    sent = probe.sparkSession.sparkContext.broadcast(groups)
    schema = T.StructType(
        [
            *[probe.schema[c] for c in within],
            T.StructField("probe_id", probe.schema["probe_id"].dataType),
            T.StructField("ordinal", T.IntegerType()),
            T.StructField("build_id", id_type),
            T.StructField("distance", T.DoubleType()),
            *[build.schema[c] for c in labels],
        ]
    )

    def nearest(batches):
        for batch in batches:
            for g, part in batch.groupby("__g", sort=False):
                if g not in sent.value:
                    continue
                matrix, ids, ordered, extra = sent.value[g]
                pid = part["probe_id"].to_numpy()
                p, q, d = nearest_in_tile(
                    np.stack(part["v"].to_list()), pid.astype(str) if pid.dtype == object else pid, matrix, ordered, k, metric, skip_self
                )
                out = {c: part[c].to_numpy()[p] for c in within}
                out["probe_id"], out["ordinal"] = pid[p], np.arange(len(p)) - np.searchsorted(p, p) + 1
                out["build_id"], out["distance"] = ids[q], d
                yield pd.DataFrame(out | {c: v[q] for c, v in extra.items()})

    return probe.mapInPandas(nearest, schema)


def _join_same(rows: DataFrame, k: int, within: list[str], skip_self: bool, labels: list[str], tile_rows: int) -> DataFrame:
    """The Manhattan join of rows with themselves: a pair of tiles meets once, for the probes of both."""
    tiles = small_side(rows.groupBy("__g").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("__t")), 2)
    own = rows.join(tiles, "__g").withColumn("__own", F.pmod(F.xxhash64("probe_id"), F.col("__t").cast("bigint")).cast("int"))
    left = own.withColumn("tp", F.col("__own")).withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("__own"))))
    right = own.withColumn("tb", F.col("__own")).withColumn("tp", F.explode(F.sequence(F.col("__own"), F.col("__t") - 1)))
    key = ["__g", "tb", "tp"]
    left, right = left.drop("__own", "__t"), right.drop("__own", "__t")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    kind = rows.schema["probe_id"].dataType
    schema = T.StructType(
        [
            T.StructField("__g", T.StringType()),
            *[rows.schema[c] for c in within],
            T.StructField("probe_id", kind),
            T.StructField("build_id", kind),
            T.StructField("distance", T.DoubleType()),
            *[rows.schema[c] for c in labels],
        ]
    )

    def tile_pair(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        ids = [x["probe_id"].to_numpy() for x in (a, b)]
        if any(i.dtype == object for i in ids):
            ids = [i.astype(str) for i in ids]
        (av, bv), (a_within, b_within) = ([np.stack(x["v"].to_list()) for x in (a, b)], [x["bound"].to_numpy() for x in (a, b)])
        if key[1] == key[2]:
            found = [(a, b, nearest_in_tile(av, ids[0], bv, ids[1], k, "manhattan", skip_self, a_within))]
        else:
            there, back = nearest_both_ways(av, ids[0], bv, ids[1], k, skip_self, a_within, b_within)
            found = [(a, b, there), (b, a, back)]
        parts = []
        for one, other, (p, q, d) in found:
            out = {"__g": one["__g"].to_numpy()[p], "probe_id": one["probe_id"].to_numpy()[p], "build_id": other["probe_id"].to_numpy()[q], "distance": d}
            out |= {c: one[c].to_numpy()[p] for c in within} | {c: other[c].to_numpy()[q] for c in labels}
            parts.append(pd.DataFrame(out))
        return pd.concat(parts, ignore_index=True)

    return _places(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(tile_pair, schema), k)


def _places(partial: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("__g", "probe_id").orderBy("distance", "build_id")
    return partial.withColumn("ordinal", F.row_number().over(order)).filter(F.col("ordinal") <= k).drop("__g")


def tile_size(rows: int, dim: int) -> int:
    """Rows of a tile: grows with the build side, so that copies of rows don't, as far as a task can hold it."""
    return max(TILE_ROWS, min(math.ceil(rows / TILES), TILE_VALUES // dim))


def _same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames are the same rows by their plans, whatever the columns are called."""
    a, b = (x._jdf.queryExecution().optimizedPlan() for x in (a, b))
    return a.deterministic() and a.sameResult(b)


def knn_join(
    probe: DataFrame,
    build: DataFrame,
    k: int,
    within: list[str] = (),
    metric: str = "euclidean",
    skip_self: bool = False,
    tile_rows: int | None = None,
    pivots: int | None = None,
) -> DataFrame:
    """The k nearest build rows of every probe row.

    ``probe``: ``within..., probe_id, v``; ``build``: ``within..., build_id, v`` and
    optionally ``label``. Ids are of one type; neighbours share the ``within`` columns;
    ``skip_self`` leaves out the build row with the probe's own id. Returns
    ``within..., probe_id, ordinal (1..k), build_id, distance[, label]``, ties by build id.
    A build side of a few million values, by count, goes to every task and the probes stay where
    they are; beyond that, or with ``tile_rows`` or ``pivots`` given, tiles meet by shuffle.
    """
    if metric not in ("euclidean", "minkowski", "manhattan"):
        raise ValueError(f"unknown metric {metric!r}")
    metric = "manhattan" if metric == "manhattan" else "euclidean"
    labels = ["label"] if "label" in build.columns and "label" not in within else []
    same = lambda: _same_rows(probe.select(*within, "probe_id", "v"), build.select(*within, "build_id", "v"))
    keyed_probe = _group_key(probe, within).select(*within, "__g", "probe_id", "v")
    keyed_build = _group_key(build, within).select("__g", "build_id", "v", *labels)
    reach = k + int(skip_self)

    counted = pivots is None
    if counted:
        rows, groups, dim = keyed_build.agg(F.count("*"), F.approx_count_distinct("__g"), F.max(F.size("v"))).first()
        if tile_rows is None and rows * (dim or 1) <= BROADCAST_VALUES:
            return _join_small(keyed_probe, keyed_build, k, within, metric, skip_self, labels, build.schema["build_id"].dataType)
        pivots = min(MAX_PIVOTS, math.ceil(rows / CELL_ROWS), SUMMARY_VALUES // max(1, groups * (reach + 3)))
    if pivots > 1:
        centre = _pivots(keyed_build, pivots)
        celled = _with_cell(keyed_build, centre, metric)
        summary = _summary(celled.select("__g", "cell", "r"), reach)
        bounded, itself = counted and metric == "manhattan", False
        if bounded:
            itself = same()
            if itself:
                keyed_probe = _group_key(build, within).select(*within, "__g", F.col("build_id").alias("probe_id"), "v", *labels)
            keyed_probe = _bound(keyed_probe, _sample(keyed_build, rows, dim), k, metric, skip_self)
        routed = cut_lineage(_route(keyed_probe, centre, summary, reach, metric))
        sources = routed.withColumn("cell", F.explode("cells")).drop("cells")
        celled = celled.drop("r")
        if bounded:
            needed, probes = routed.agg(F.sum(F.size("cells")), F.count("*")).first()
            # Most cells are needed: there is no structure to go by, and tiles of all rows are fewer.
            if 2 * (needed or 0) > probes * pivots:
                sources = routed.drop("cells")
                if itself:
                    return _join_same(sources, k, within, skip_self, labels, tile_rows or tile_size(rows, dim))
                sources, celled = (x.withColumn("cell", F.lit(0)) for x in (sources, keyed_build))
        if itself:
            sources = sources.drop(*labels)
    else:
        celled = keyed_build.withColumn("cell", F.lit(0))
        sources = keyed_probe.withColumn("cell", F.lit(0))

    tile_rows = tile_rows or (tile_size(rows, dim or 1) if counted else TILE_ROWS)
    tiles_of = lambda n: F.ceil(F.col(n) / tile_rows).cast("int")
    tiles = (
        celled.groupBy("__g", "cell").agg(F.count("*").alias("__nb"))
        .join(sources.groupBy("__g", "cell").agg(F.count("*").alias("__np")), ["__g", "cell"])
        .select("__g", "cell", tiles_of("__nb").alias("__tb"), tiles_of("__np").alias("__tp"))
    )
    tiles = small_side(tiles, 4)
    slot = lambda c, n: F.pmod(F.xxhash64(c), F.col(n).cast("bigint")).cast("int")
    left = (
        sources.join(tiles, ["__g", "cell"])
        .withColumn("tp", slot("probe_id", "__tp"))
        .withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("__tb") - 1)))
        .drop("__tb", "__tp")
    )
    right = (
        celled.join(tiles, ["__g", "cell"])
        .withColumn("tb", slot("build_id", "__tb"))
        .withColumn("tp", F.explode(F.sequence(F.lit(0), F.col("__tp") - 1)))
        .drop("__tb", "__tp")
    )
    schema = T.StructType(
        [
            T.StructField("__g", T.StringType()),
            *[probe.schema[c] for c in within],
            T.StructField("probe_id", probe.schema["probe_id"].dataType),
            T.StructField("build_id", build.schema["build_id"].dataType),
            T.StructField("distance", T.DoubleType()),
            *[build.schema[c] for c in labels],
        ]
    )

    def tile_pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        pid, bid = a["probe_id"].to_numpy(), b["build_id"].to_numpy()
        if bid.dtype == object:
            pid, bid = pid.astype(str), bid.astype(str)
        p, q, d = nearest_in_tile(
            np.stack(a["v"].to_list()), pid, np.stack(b["v"].to_list()), bid, k, metric, skip_self, a["bound"].to_numpy() if "bound" in a else None
        )
        out = {
            "__g": a["__g"].to_numpy()[p],
            "probe_id": a["probe_id"].to_numpy()[p],
            "build_id": b["build_id"].to_numpy()[q],
            "distance": d,
        }
        for c in within:
            out[c] = a[c].to_numpy()[p]
        for c in labels:
            out[c] = b[c].to_numpy()[q]
        return pd.DataFrame(out)

    key = ["__g", "cell", "tb", "tp"]
    # Both sides may come from one table; fresh names keep their columns apart.
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    return _places(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(tile_pair, schema), k)
