"""Quality rules: boosted trees over document statistics.

The statistics come from whole texts in one vectorised pass. The trees are grown on a bounded
labelled sample by histograms, with a monotone direction for chosen statistics, and flattened
into node arrays that score a batch level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odorframe.llm import common

SLICE_BYTES = 1 << 20
# Labelled rows that the trees see at most.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS = 60, 4, 0.15, 64
LEAST_ROWS, PENALTY = 8, 2.0
# A document is kept if its score (the probability of good quality) is at least this.
THRESHOLD = 0.35
LEAST_WORDS = 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Statistics that the trees see, and how the score may follow them: -1 never up, 0 either way.
STATISTICS = {
    "log_words": 0,
    "word_length": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": 0,
    "digit_share": 0,
    "punctuation_share": 0,
    "mark_share": 0,
    "bar_share": -1,
    "space_share": 0,
    "distinct_share": 0,
    "line_length": 0,
    "wide_share": 0,
}


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOLS = _table("#*$%&|<>")
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _table("0123456789")
_PUNCTUATION = _table(".,;:?\"'()-")
_MARK = _table("!")
_BAR = _table("|")


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS and STATISTICS of every text, in one pass over the bytes.

    Words are runs of anything but ASCII white space; a repeated word is one in a window of
    three words found twice or more in its text, the first time included; a repeated line is a
    line with a word that equals an earlier one.
    """
    data, offsets = common.utf8(column)
    n = len(offsets) - 1

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    starts, ends, doc = common.word_spans(data, offsets)
    words = common.span_hashes(data, starts, ends)
    n_words = np.bincount(doc, minlength=n)
    last = np.cumsum(n_words)
    salt = doc.astype(np.uint64) * common.BASE
    # Windows of three words.
    at = np.flatnonzero(np.arange(len(words)) + 3 <= last[doc]) if len(words) else np.zeros(0, np.int64)
    h = np.zeros(len(at), np.uint64)
    for j in range(3):
        h = common.mix(h + words[at + j])
    codes, found = pd.factorize(common.mix(h ^ salt[at]))
    again = at[np.bincount(codes, minlength=len(found))[codes] > 1] if len(at) else at
    repeated = np.zeros(len(words), bool)
    for j in range(3):
        repeated[again + j] = True
    # Lines.
    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))
    line_doc = np.searchsorted(offsets, line_starts, side="right") - 1
    line_ends -= (line_ends > line_starts) & (data[np.maximum(line_ends, 1) - 1] == 10) if len(data) else 0
    first_word = np.searchsorted(starts, line_starts)
    has_word = (first_word < len(starts)) & (np.append(starts, len(data))[first_word] < line_ends)
    line_hash = common.span_hashes(data, line_starts[has_word], line_ends[has_word])
    line_doc_w = line_doc[has_word]
    lines = np.bincount(line_doc_w, minlength=n)
    code_line, distinct = pd.factorize(common.mix(line_hash ^ (line_doc_w.astype(np.uint64) * common.BASE)))
    first_line = np.zeros(len(distinct), np.int64)
    first_line[code_line[::-1]] = np.arange(len(code_line))[::-1]
    n_dup = lines - np.bincount(line_doc_w[first_line], minlength=n)

    points = per_text((data & 0xC0) != 0x80)
    spaces = per_text(common.IS_SPACE[data])
    chars = points - spaces
    n_repeat = np.bincount(doc, weights=repeated, minlength=n).astype(np.int64)
    n_symbols = per_text(_SYMBOLS[data])
    code_word, distinct_words = pd.factorize(common.mix(words ^ salt))
    first = np.zeros(len(distinct_words), np.int64)
    first[code_word[::-1]] = np.arange(len(code_word))[::-1]
    own_words = np.bincount(doc[first], minlength=n)

    def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a / np.maximum(b, 1)

    return {
        "n_words": n_words,
        "word_chars": chars,
        "n_symbols": n_symbols,
        "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat,
        "log_words": np.log1p(n_words),
        "word_length": share(chars, n_words),
        "symbol_share": share(n_symbols, chars),
        "dup_line_share": share(n_dup, lines),
        "repeat_share": share(n_repeat, n_words),
        "upper_share": share(per_text(_UPPER[data]), chars),
        "digit_share": share(per_text(_DIGIT[data]), chars),
        "punctuation_share": share(per_text(_PUNCTUATION[data]), chars),
        "mark_share": share(per_text(_MARK[data]), chars),
        "bar_share": share(per_text(_BAR[data]), n_words),
        "space_share": share(spaces, points),
        "distinct_share": share(own_words, n_words),
        "line_length": share(points, lines),
        "wide_share": share(per_text(data >= 0xC0), chars),
    }


@dataclass
class Forest:
    """Complete binary trees side by side: node k of a tree has the children 2k+1 and 2k+2."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # go right if the statistic is above
    value: np.ndarray  # (trees, leaves)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            margin += v[node - inner]
        return 1 / (1 + np.exp(-margin))


def grow(x: np.ndarray, y: np.ndarray, direction: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Boosted trees for the log loss of ``y`` (0 or 1), monotone in the features of a direction.

    A split against a feature's direction isn't made; below a split on such a feature no leaf
    passes the middle of its two sides.
    """
    inner, leaves = 2**depth - 1, 2**depth
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    forest = Forest(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), float(np.log(mean / (1 - mean))))
    if len(y) == 0 or y.min() == y.max():
        return forest
    n_features = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(n_features)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin = np.full(len(y), forest.base)
    for tree in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        for k in range(inner):
            own = np.flatnonzero(node == k)
            low[2 * k + 1 : 2 * k + 3], high[2 * k + 1 : 2 * k + 3] = low[k], high[k]
            best = (1e-6, -1, 0, 0.0, 0.0)
            if len(own) >= 2 * LEAST_ROWS:
                for f in range(n_features):
                    m = len(edges[f]) + 1
                    b = binned[own, f]
                    n_left = np.cumsum(np.bincount(b, minlength=m))[:-1]
                    g_left = np.cumsum(np.bincount(b, weights=g[own], minlength=m))
                    h_left = np.cumsum(np.bincount(b, weights=h[own], minlength=m))
                    g_all, h_all = g_left[-1], h_left[-1]
                    g_left, h_left = g_left[:-1], h_left[:-1]
                    left = np.clip(g_left / (h_left + PENALTY), low[k], high[k])
                    right = np.clip((g_all - g_left) / (h_all - h_left + PENALTY), low[k], high[k])
                    gain = g_left**2 / (h_left + PENALTY) + (g_all - g_left) ** 2 / (h_all - h_left + PENALTY) - g_all**2 / (h_all + PENALTY)
                    ok = (n_left >= LEAST_ROWS) & (len(own) - n_left >= LEAST_ROWS) & ((right - left) * direction[f] >= 0)
                    if ok.any():
                        i = int(np.argmax(np.where(ok, gain, -np.inf)))
                        if gain[i] > best[0]:
                            best = (gain[i], f, i, left[i], right[i])
            _, f, i, left, right = best
            if f < 0:
                node[own] = 2 * k + 1
                continue
            forest.feature[tree, k], forest.threshold[tree, k] = f, edges[f][i]
            node[own] = 2 * k + 1 + (binned[own, f] > i)
            if direction[f]:
                middle = (left + right) / 2
                one, two = (2 * k + 1, 2 * k + 2) if direction[f] > 0 else (2 * k + 2, 2 * k + 1)
                high[one], low[two] = min(high[one], middle), max(low[two], middle)
        leaf = node - inner
        total_g, total_h = np.bincount(leaf, weights=g, minlength=leaves), np.bincount(leaf, weights=h, minlength=leaves)
        forest.value[tree] = rate * np.clip(total_g / (total_h + PENALTY), low[inner:], high[inner:])
        margin += forest.value[tree][leaf]
    return forest


def _matrix(s: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([s[k].astype(np.float64) for k in STATISTICS], axis=1)


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batches, "text", SLICE_BYTES):
        x = _matrix(statistics(part.column("text")))
        yield pa.RecordBatch.from_arrays([part.column("quality"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["quality", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Trees grown on at most ``sample`` labelled documents, those with the smallest hashed ids."""
    known = labels.filter("quality is not null").groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("quality"))
    known = common.beside(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "rule-labels")
    rows = docs.select("doc_id", "text").join(known, "doc_id").select("quality", "text").mapInArrow(_sample_rows, "quality int, x array<double>").limit(sample).collect()
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(STATISTICS))
    return grow(x, np.array([r["quality"] for r in rows], np.float64), np.array(list(STATISTICS.values())))


_RESULT = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double"


def _score(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text", SLICE_BYTES):
            s = statistics(part.column("text"))
            columns = [part.column("doc_id"), *(pa.array(s[c], pa.int64()) for c in COUNTS), pa.array(model.value.score(_matrix(s)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, "score"])

    return run


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, COUNTS, score, base_failed, kept.

    A null text has no words. base_failed: fewer than LEAST_WORDS words, or more than half of
    them repeated; such a document isn't kept, any other is if its score reaches ``threshold``.
    Of labels that repeat a doc_id the best wins. Without labels, or with labels of one kind,
    only the base rules decide, as every score is the share of good labels (one half without).
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(model), _RESULT)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
