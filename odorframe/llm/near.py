"""Near-duplicate documents: consistent weighted sampling over TF-IDF word shingles.

A shingle weighs (times in the text) x (1 + RARITY x ln((1+N)/(1+df)) / ln(1+N)): a rare shingle
counts a quarter more than one that every text has. The range is narrow on purpose, as the
shingles that copies share are less rare than those of an edit, the more so the larger their
group, and a group's size must not pull its members below the threshold. df comes from a count-min sketch of all documents, whose size is fixed. Improved
consistent weighted sampling draws, per sample, one shingle of a text with probability
proportional to its weight, alike in all texts; equal samples in all rows of a band make
candidates. Candidates are verified by exact weighted Jaccard similarity.

No bucket is expanded into all pairs. In a few rounds its rows are compared with one leader each,
and those that a link has joined to the leader's component are done with. What a bucket's
components then still leave apart is compared tile by tile inside tasks, which return links
only. In the end every pair of a bucket is joined through its component or was compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odorframe.llm import common
from odorframe.llm.components import components

WORDS = 5
SIMILARITY = 0.8
BANDS = 12
ROWS = 3
SLICE_BYTES = 1 << 20
# Bands whose leaders are compared in one round, members compared with a leader in one group, rows
# of a tile of a bucket.
BANDS_AT_ONCE = 4
GROUP = 512
TILE = 512
# Rows with samples that are sent to every executor at most.
BROADCAST_WIDE = 100_000
# Cells of each of the sketch's two rows: 8 MB in all, whatever the input.
CELLS = 1 << 20
# How much more a shingle of one text weighs than a shingle of all texts.
RARITY = 0.25
# Each of a shingle's three random numbers per sample is one of so many entries, picked by a part of its
# hash of its own: two shingles agree in all three once in 2**48.
ENTRIES = 1 << 16
SEED = 20_240

_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[:128] = [chr(i).isalnum() for i in range(128)]
_STEP = [np.uint64(x | 1) for x in np.random.default_rng(SEED).integers(1 << 62, 1 << 63, WORDS * 4, np.uint64).tolist()]


class Shingles:
    """Distinct shingles of each text of a slice, in text order: doc, hash, times; words per text."""

    def __init__(self, column: pa.Array, size: int):
        column = pc.utf8_lower(column.fill_null("") if column.null_count else column)
        data, offsets = common.utf8(column)
        n = self.n = len(column)
        starts, ends, doc = common.word_spans(data, offsets, _WORD_BYTE)
        words = common.span_hashes(data, starts, ends)
        self.n_words = np.bincount(doc, minlength=n)
        last = np.cumsum(self.n_words)
        first = last - self.n_words
        # One window per start of a full window; a shorter text is one window of all its words.
        at = np.flatnonzero(np.arange(len(words)) + size <= last[doc])
        short = first[(self.n_words > 0) & (self.n_words < size)]
        at = np.sort(np.concatenate([at, short]))
        h = np.zeros(len(at), np.uint64)
        for j in range(size):
            inside = at + j < last[doc[at]]
            h[inside] += words[at[inside] + j] * _STEP[j % len(_STEP)] + np.uint64(j + 1)
        h = common.mix(h)
        codes, _ = pd.factorize(common.mix(h ^ (doc[at].astype(np.uint64) * common.BASE)))
        self.times = np.bincount(codes) if len(codes) else np.zeros(0, np.int64)
        where = np.zeros(len(self.times), np.int64)
        where[codes[::-1]] = np.arange(len(codes))[::-1]
        self.doc, self.hash = doc[at][where], h[where]
        # Two sums over (word, place): equal word sequences, equal digests.
        place = (np.arange(len(words)) - first[doc]).astype(np.uint64) if len(words) else np.zeros(0, np.uint64)
        self.digest = [self._sum(common.mix(words * _STEP[i] + place), first, last) for i in (5, 6)]

    def _sum(self, values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=total[1:])
        return total[last] - total[first]

    def bounds(self) -> np.ndarray:
        return np.searchsorted(self.doc, np.arange(self.n + 1))


def _cells(h: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64(CELLS - 1)
    return [(h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)]


_FIRST = "kind int, row long, doc_id long, digest binary, n_words long, chunk int, cells binary"


def _first_pass(size: int):
    """Per document its digest (kind 0); per task its part of the sketch, by chunk (kind 1)."""

    def rows(kind, n, row=None, doc_id=None, digest=None, n_words=None, chunk=None, cells=None):
        columns = ([kind] * n, row, doc_id, digest, n_words, chunk, cells)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary())
        made = [pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays(made, [c.split()[0] for c in _FIRST.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((2, CELLS), np.int64)
        for part in common.slices(batches, "text", SLICE_BYTES, _DRAWS):
            s = Shingles(part.column("text"), size)
            for r, cells in enumerate(_cells(s.hash)):
                sketch[r] += np.bincount(cells, minlength=CELLS)
            pair = np.stack(s.digest, axis=1).astype("<u8")
            yield rows(
                0, s.n, part.column("row").to_pylist(), part.column("doc_id").to_pylist(),
                [pair[i].tobytes() for i in range(s.n)], s.n_words.tolist(),
            )
        for chunk, cells in common.cell_chunks(sketch.reshape(-1)):
            yield rows(1, 1, chunk=[chunk], cells=[cells])

    return run


def frequencies(first: DataFrame) -> Broadcast:
    """The sketch of document frequencies: (2, CELLS) counts, the same size for any input."""
    total = common.sum_cells(first.filter("kind = 1").select("chunk", "cells"), 2 * CELLS)
    sketch = np.minimum(total, 0xFFFFFFFF).astype(np.uint32).reshape(2, CELLS)
    return first.sparkSession.sparkContext.broadcast(sketch)


def weights(s: Shingles, sketch: np.ndarray, n_docs: int) -> np.ndarray:
    a, b = _cells(s.hash)
    df = np.minimum(np.minimum(sketch[0][a], sketch[1][b]), n_docs).astype(np.float64)
    whole = np.log1p(float(n_docs))
    # Rounded, so that equal shingles weigh the same wherever they stand in a batch.
    return s.times * (1.0 + RARITY * np.round((whole - np.log1p(df)) / whole, 4))


_DRAWS: dict[int, tuple[np.ndarray, ...]] = common.remembered()


def _draws(samples: int) -> tuple[np.ndarray, ...]:
    if samples not in _DRAWS:
        rng = np.random.default_rng(SEED)
        # Sample by sample, which takes no more memory than what is kept.
        r, inverse, log_c, beta = (np.empty((samples, ENTRIES), np.float32) for _ in range(4))
        for k in range(samples):
            drawn = rng.gamma(2.0, 1.0, ENTRIES)
            r[k], inverse[k] = drawn, 1.0 / drawn
        for k in range(samples):
            log_c[k] = np.log(rng.gamma(2.0, 1.0, ENTRIES))
        for k in range(samples):
            beta[k] = rng.random(ENTRIES)
        _DRAWS[samples] = r, inverse, log_c, beta
    return _DRAWS[samples]


def signatures(s: Shingles, w: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts that have shingles, samples by text): ln a of the drawn shingle, as bits."""
    bounds = s.bounds()
    have = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(have), samples), np.uint32)
    if len(have) == 0:
        return have, out
    log_w = (np.round(np.log(w) * 256) / 256).astype(np.float32)
    r, inverse, log_c, beta = _draws(samples)
    for k in range(samples):
        turn = np.uint64((k + 1) * int(common.BASE) % (1 << 64))
        h = common.mix(s.hash + turn)
        of_r, of_c, of_beta = ((h >> np.uint64(shift)).astype(np.uint16) for shift in (48, 32, 16))
        b = beta[k][of_beta]
        t = np.floor(log_w * inverse[k][of_r] + b)
        a = log_c[k][of_c] - r[k][of_r] * (t - b + np.float32(1))
        out[:, k] = np.minimum.reduceat(a, bounds[have]).view(np.uint32)
    return have, out


_SIGNED = "row long, keys array<long>, samples array<int>"


def _sign(size: int, bands: int, rows: int, sketch: Broadcast, n_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text", SLICE_BYTES, _DRAWS):
            s = Shingles(part.column("text"), size)
            have, drawn = signatures(s, weights(s, sketch.value, n_docs), bands * rows)
            keys = np.zeros((len(have), bands), np.uint64)
            for b in range(bands):
                for j in range(rows):
                    keys[:, b] = common.mix(keys[:, b] * common.BASE + drawn[:, b * rows + j].astype(np.uint64) + np.uint64(b + 1))
            ids = part.column("row").to_numpy(zero_copy_only=False)[have]
            flat = pa.array(keys.reshape(-1).view(np.int64))
            offsets = pa.array(np.arange(0, len(have) * bands + 1, bands, dtype=np.int32))
            places = pa.array(np.arange(0, len(have) * bands * rows + 1, bands * rows, dtype=np.int32))
            samples = pa.ListArray.from_arrays(places, pa.array(drawn.reshape(-1).view(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(offsets, flat), samples], ["row", "keys", "samples"])

    return run


def _vectors(size: int, sketch: Broadcast, n_docs: int):
    """Per document its shingles (high half of the hash, ascending) and their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text", SLICE_BYTES, _DRAWS):
            s = Shingles(part.column("text"), size)
            w, bounds = weights(s, sketch.value, n_docs).astype(np.float32), s.bounds()
            high = (s.hash >> np.uint64(32)).astype(np.uint32)
            out_h, out_w = [], []
            for a, b in zip(bounds[:-1], bounds[1:]):
                order = np.argsort(high[a:b])
                own, weight = high[a:b][order], w[a:b][order]
                # Shingles that share their half of the hash count as one.
                first = np.flatnonzero(np.diff(own, prepend=own[:1] + 1)) if len(own) else order
                out_h.append(own[first].astype("<u4").tobytes())
                out_w.append(np.add.reduceat(weight, first).astype("<f4").tobytes() if len(own) else b"")
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(out_h, pa.binary()), pa.array(out_w, pa.binary())], ["row", "hashes", "weights"]
            )

    return run


def weighted_jaccard(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    _, i, j = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
    low = float(np.minimum(w1[i], w2[j]).sum(dtype=np.float64))
    total = float(w1.sum(dtype=np.float64) + w2.sum(dtype=np.float64)) - low
    return low / total if total else 0.0


def _similar(h1: bytes, w1: bytes, h2: bytes, w2: bytes, similarity: float) -> bool:
    one, two = (np.frombuffer(x, "<f4") for x in (w1, w2))
    a, b = float(one.sum(dtype=np.float64)), float(two.sum(dtype=np.float64))
    # No pair of so different weights can be similar enough.
    if min(a, b) < similarity * max(a, b) * (1 - 1e-6):
        return False
    return weighted_jaccard(np.frombuffer(h1, "<u4"), one, np.frombuffer(h2, "<u4"), two) >= similarity


def _verify(similarity: float):
    def run(key: tuple, leader: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if not len(leader) or not len(members):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        h, w, lead = leader["hashes_"].iloc[0], leader["weights_"].iloc[0], int(leader["leader_"].iloc[0])
        keep = [int(r) for r, u, v in zip(members["row"], members["hashes"], members["weights"]) if _similar(h, w, u, v, similarity)]
        return pd.DataFrame({"a": [min(r, lead) for r in keep], "b": [max(r, lead) for r in keep]}, dtype="int64")

    return run


def _star_links(pairs: DataFrame, vectors: DataFrame, similarity: float) -> DataFrame:
    """The pairs (row, leader) that are similar enough, as links (a, b).

    Members travel once to their leader, in groups of about GROUP, to each of which the leader goes.
    """
    sizes = pairs.groupBy("leader").agg(F.ceil(F.count("*") / GROUP).cast("long").alias("parts"))
    dealt = pairs.join(sizes, "leader").select("leader", "row", F.pmod(F.xxhash64("row"), F.col("parts")).alias("part"))
    # Slim sides are broadcast where a count allows it, or all vectors would be shuffled to find a few.
    members = vectors.join(common.beside(dealt, "near-dealt"), "row").select("leader", "part", "row", "hashes", "weights")
    heads = sizes.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    heads = vectors.withColumnRenamed("row", "leader").join(common.beside(heads, "near-heads"), "leader").select(*[F.col(c).alias(f"{c}_") for c in ("leader", "part", "hashes", "weights")])
    return heads.groupBy("leader_", "part_").cogroup(members.groupBy("leader", "part")).applyInPandas(_verify(similarity), "a long, b long")


def _askable(i: int, band: int, rows: int, least: int, left: dict, right: dict) -> np.ndarray:
    """Which rows of the right tile row ``i`` of the left one is to be compared with, in this band.

    Those of another component that agree in enough samples. A pair that meets in several bands
    is looked at in the first; of two rows outside the largest component the smaller one asks.
    """
    ok = (right["component"] != left["component"][i]) & ~(right["rest"] & (right["row"] < left["row"][i]))
    at = np.flatnonzero(ok)
    same = right["samples"][at] == left["samples"][i]
    first = same.reshape(len(at), same.shape[1] // rows, rows).all(axis=2)[:, :band].any(axis=1)
    ok[at] = (same.sum(axis=1) >= least) & ~first
    return ok


def _columns(tile: pd.DataFrame) -> dict[str, np.ndarray]:
    tile = tile.rename(columns=lambda c: c.removesuffix("_"))
    return {c: np.array(tile[c].to_list()) for c in ("row", "component", "rest", "samples")}


def _tile_rows(rows: int, least: int):
    """The rows of two tiles that have someone to be compared with (no vectors needed)."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        seen: set[int] = set()
        if len(left) and len(right):
            one, two = _columns(left), _columns(right)
            for i in range(len(left)):
                ok = _askable(i, int(key[0]), rows, least, one, two)
                if ok.any():
                    seen.add(int(one["row"][i]))
                    seen.update(two["row"][ok].tolist())
        return pd.DataFrame({"band": int(key[0]), "key": int(key[1]), "row": sorted(seen)})

    return run


def _verify_tiles(rows: int, least: int, similarity: float):
    """Links between the rows of two tiles of a bucket that different components hold."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            one, two = _columns(left), _columns(right)
            h_l, w_l, h_r, w_r = left["hashes"].to_list(), left["weights"].to_list(), right["hashes_"].to_list(), right["weights_"].to_list()
            total = np.array([np.frombuffer(x, "<f4").sum(dtype=np.float64) for x in w_r])
            # All shingles of the right tile in one sorted list: a left row meets them all at once.
            owner = np.repeat(np.arange(len(right)), [len(x) // 4 for x in h_r])
            shingles, weights = np.frombuffer(b"".join(h_r), "<u4"), np.frombuffer(b"".join(w_r), "<f4")
            order = np.argsort(shingles, kind="stable")
            owner, shingles, weights = owner[order], shingles[order], weights[order]
            for i in range(len(left)):
                weight = np.frombuffer(w_l[i], "<f4")
                own = float(weight.sum(dtype=np.float64))
                ok = _askable(i, int(key[0]), rows, least, one, two)
                ok &= np.minimum(total, own) >= similarity * np.maximum(total, own) * (1 - 1e-6)
                if not ok.any():
                    continue
                h = np.frombuffer(h_l[i], "<u4")
                lo, hi = np.searchsorted(shingles, h, "left"), np.searchsorted(shingles, h, "right")
                n = hi - lo
                ends = np.cumsum(n)
                at = np.repeat(lo - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
                low = np.bincount(owner[at], weights=np.minimum(weights[at], np.repeat(weight, n)), minlength=len(right))
                close = ok & (low >= similarity * (total + own - low))
                found += [(min(int(one["row"][i]), r), max(int(one["row"][i]), r)) for r in two["row"][close].tolist()]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


_AT = ("band", "key", "row", "component", "samples")


def _tiled(at: DataFrame, vectors: DataFrame | None):
    """Pairs of tiles of each bucket of ``at`` that several components hold, as a co-group.

    Rows outside a bucket's largest component (left) meet all its rows (right).
    """
    sizes = at.groupBy("band", "key", "component").agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", "component")).alias("top")
    mixed = sizes.groupBy("band", "key").agg(best, F.count("*").alias("parts"), F.sum("n").alias("rows")).filter("parts > 1")
    tiles = lambda n: F.ceil(n / TILE).cast("long")
    mixed = mixed.select(
        "band", "key", F.col("top.component").alias("largest"), tiles(F.col("rows") - F.col("top.n")).alias("tl"), tiles(F.col("rows")).alias("tr")
    )
    full = at.join(mixed, ["band", "key"]).withColumn("rest", F.col("component") != F.col("largest"))
    if vectors is not None:
        # Rows here carry their samples, hence the lower bound.
        full = vectors.join(common.beside(full, "near-tiled", BROADCAST_WIDE), "row")
    columns = ["l", "r", *_AT, "rest"] + ([] if vectors is None else ["hashes", "weights"])
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = full.filter("rest").withColumn("l", F.pmod(F.xxhash64("row"), F.col("tl"))).withColumn("r", every("tr")).select(*columns)
    right = full.withColumn("r", F.pmod(F.xxhash64("row"), F.col("tr"))).withColumn("l", every("tl"))
    key = ["band", "key", "l", "r"]
    # Fresh names: both sides come from one table.
    right = right.select(*[F.col(c).alias(f"{c}_") for c in columns])
    return left.groupBy(*key).cogroup(right.groupBy(*[f"{c}_" for c in key]))


def _tile_links(at: DataFrame, vectors: DataFrame, rows: int, least: int, similarity: float) -> DataFrame:
    """Links inside buckets that several components hold: all pairs of rows of different ones.

    ``at``: band, key, row, component, samples. Pairs exist inside tasks only. Samples alone say
    which rows have someone to be compared with; only these bring their shingles.
    """
    busy = _tiled(at, None).applyInPandas(_tile_rows(rows, least), "band int, key long, row long").distinct()
    busy = common.written(busy, "near-busy")
    again = common.written(at.join(busy, ["band", "key", "row"], "left_semi"), "near-again")
    needed = common.written(again.select("row").distinct(), "near-needed")
    return _tiled(again, common.only(vectors, needed, "row")).applyInPandas(_verify_tiles(rows, least, similarity), "a long, b long").distinct()


def _relabelled(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` (row, component) after the links (a, b) between rows have joined components."""
    if links.isEmpty():
        return label
    one = label.select(F.col("row").alias("a"), F.col("component").alias("ca"))
    two = label.select(F.col("row").alias("b"), F.col("component").alias("cb"))
    joined = links.join(one, "a").join(two, "b").filter("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    new = components(joined).select(F.col("node").alias("component"), F.col("component").alias("__new"))
    out = label.join(new, "component", "left").select("row", F.coalesce("__new", "component").alias("component"))
    return common.written(out, "near-label")


def classes(
    docs: DataFrame, size: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, row: str | None = None
) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, class_id, class_size, kept.

    Words are the lower-case runs of letters, digits and bytes beyond ASCII; a text of fewer
    than ``size`` words is one shingle of all of them. class_id is the smallest doc_id of the
    class (null last) and kept marks its first row. Equal word sequences fall into one class
    before any comparing; texts without a word are classes of their own.
    """
    spark = docs.sparkSession
    source = docs.select((F.monotonically_increasing_id() if row is None else F.col(row)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = common.written(source.mapInArrow(_first_pass(size), _FIRST), "near-first")
    sketch = frequencies(first)
    known = first.filter("kind = 0").select("row", "doc_id", "digest", "n_words")
    n_docs = known.count()
    # Equal word sequences: one representative each.
    own = F.when(F.col("n_words") > 0, F.lit(None)).otherwise(F.col("row"))
    known = known.withColumn("own", own.cast("long"))
    copies = known.groupBy("digest", "own").agg(F.min("row").alias("rep"))
    member = common.written(known.join(copies, known.digest.eqNullSafe(copies.digest) & known.own.eqNullSafe(copies.own)).select("row", "doc_id", "rep"), "near-member")
    reps = member.filter("row = rep").select("row")
    signed = common.written(source.select("row", "text").mapInArrow(_sign(size, bands, rows, sketch, n_docs), _SIGNED), "near-signed")
    keys = signed.join(reps, "row", "left_semi").select("row", F.posexplode("keys").alias("band", "key"))
    keys = common.written(keys, "near-keys")
    # A leader per bucket, another one in each band.
    lead = F.min_by("row", F.xxhash64("row", "band")).alias("leader")
    buckets = keys.groupBy("band", "key").agg(lead, F.count("*").alias("n")).filter("n > 1")
    shared = common.written(keys.join(buckets.drop("n"), ["band", "key"]), "near-shared")
    some = common.written(shared.select("row").distinct(), "near-candidates")
    vectors = common.written(common.only(source.select("row", "text"), some, "row").mapInArrow(_vectors(size, sketch, n_docs), "row long, hashes binary, weights binary"), "near-vectors")
    samples = common.written(common.only(signed.select("row", "samples"), some, "row"), "near-samples")
    # Of so many samples a pair similar enough agrees in fewer than this once in thousands of pairs.
    total = bands * rows
    least = math.floor(total * similarity - 3.5 * math.sqrt(total * similarity * (1 - similarity)))
    leaders = samples.select(F.col("row").alias("leader"), F.col("samples").alias("theirs"))
    agree = F.aggregate(F.zip_with("samples", "theirs", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    # Rounds of some bands each; rows that a link has joined to the leader's component are done with.
    label = common.written(some.select("row", F.col("row").alias("component")), "near-label")
    for start in range(0, bands, BANDS_AT_ONCE):
        pairs = shared.filter((F.col("band") >= start) & (F.col("band") < start + BANDS_AT_ONCE)).select("row", "leader").filter("row <> leader").distinct()
        theirs = label.select(F.col("row").alias("leader"), F.col("component").alias("__c"))
        pairs = pairs.join(label, "row").join(theirs, "leader").filter(F.col("component") != F.col("__c")).select("row", "leader")
        pairs = pairs.join(samples, "row").join(leaders, "leader").filter(agree >= least).select("row", "leader")
        links = common.written(_star_links(common.written(pairs, "near-pairs"), vectors, similarity), "near-links")
        label = _relabelled(label, links)
    # Leaders have met all rows of their buckets; the others have not met each other.
    at = shared.filter("row <> leader").drop("leader").join(label, "row").join(samples, "row").select(*_AT)
    links = common.written(_tile_links(common.written(at, "near-at"), vectors, rows, least, similarity), "near-more")
    label = _relabelled(label, links)
    label = label.select(F.col("row").alias("node"), "component")
    # Classes of representatives, then of all rows.
    joined = member.join(label, member.rep == label.node, "left").select("row", "doc_id", F.coalesce("component", "rep").alias("class_row"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    whole = joined.groupBy("class_row").agg(F.min(order).alias("first"), F.count("*").alias("class_size"))
    return joined.join(whole, "class_row").select(
        "row", "doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("first.row") == F.col("row")).alias("kept")
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """One document of each class, with all columns of ``docs``."""
    row = common.fresh_name(docs, "row")
    numbered = common.written(docs.withColumn(row, F.monotonically_increasing_id()), "near-docs")
    kept = common.written(classes(numbered, row=row).filter("kept").select(F.col("row").alias(row)), "near-stay")
    return common.only(numbered, kept, row).drop(row)
