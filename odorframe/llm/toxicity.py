"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed n-gram in a text. Its ratio, the log of how much more
often toxic texts have it, comes from all labelled training rows; a logistic regression on the
scaled features is fitted to a bounded sample of them. Ratios fit the texts they were counted on
too well, so scores are calibrated on margins of models that didn't see the text: each fold of the
training rows is judged by ratios and coefficients of the others. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odorframe.llm import common

ORDERS = (2, 3, 4, 6)
FEATURES = 1 << 20
# Labelled rows of each class that the regression sees at most (the ratios see all).
SAMPLE_PER_CLASS = 4000
# Features whose counts by class could be chance (likelihood ratio below this) carry no weight.
LEAST_EVIDENCE = 12.0
# Entries of the sample's matrix that are summed at once: bounds the driver's temporary arrays.
AT_ONCE = 1 << 20
SMOOTHING = 1.0
PENALTY = 1.0
STEPS = 300
THRESHOLD = 0.7
# Parts of the training rows, each judged by a model of the others for the calibration.
FOLDS = 3
# In the calibration the rarer class counts (ratio of the sizes) to this power more; 1: as much as the other one.
# This, the orders and the evidence were chosen on training rows alone (one fold fitted, another judged).
BALANCE = 1.0
SLICE_BYTES = 1 << 20


def held_out(column: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text leaves 1 divided by 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(3)) == 1, F.lit(False))


def features(column: pa.Array, orders: tuple[int, ...], used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every n-gram present, each pair once, by text; of ``used`` features only."""
    texts = pc.utf8_lower(column.fill_null("") if column.null_count else column).to_pylist()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(lengths)
    end = np.repeat(ends, lengths)
    keys = []
    for n in orders:
        if len(points) < n:
            continue
        h = np.full(len(points) - n + 1, n, np.uint64)
        for j in range(n):
            h *= common.BASE
            h += points[j : len(h) + j]
        feature = (common.mix(h) >> np.uint64(64 - (FEATURES.bit_length() - 1))).astype(np.int64)
        at = np.arange(len(h))
        inside = at + n <= end[: len(h)]
        if used is not None:
            inside &= used[feature]
        at = np.flatnonzero(inside)
        keys.append(np.searchsorted(ends, at, side="right") * FEATURES + feature[at])
    pairs = np.sort(pd.unique(np.concatenate(keys))) if keys else np.zeros(0, np.int64)
    return pairs // FEATURES, pairs % FEATURES


def _count(orders: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((FOLDS * 2, FEATURES), np.uint32)
        for part in common.slices(batches, "text", SLICE_BYTES):
            doc, feature = features(part.column("text"), orders)
            group = part.column("fold").to_numpy(zero_copy_only=False) * 2 + (part.column("toxic").to_numpy(zero_copy_only=False) > 0)
            for k in np.unique(group):
                counts[k] += np.bincount(feature[group[doc] == k], minlength=FEATURES).astype(np.uint32)
        rows = list(common.cell_chunks(counts.reshape(-1)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary()))], ["chunk", "cells"])

    return run


def _sample_rows(orders: tuple[int, ...], used: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text", SLICE_BYTES):
            doc, feature = features(part.column("text"), orders, used.value)
            cuts = np.searchsorted(doc, np.arange(part.num_rows + 1))
            bodies = [feature[a:b].astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([part.column("fold"), part.column("toxic"), pa.array(bodies, pa.binary())], ["fold", "toxic", "features"])

    return run


def fit(rows: list[np.ndarray], toxic: np.ndarray, ratio: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """(coefficient by feature, intercept) of a penalised logistic regression on ratio x presence."""
    used = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.int64)
    out = np.zeros(len(ratio))
    prior = float(np.average(toxic, weights=weight)) if len(toxic) else 0.0
    bias = float(np.log(max(prior, 1e-4) / max(1 - prior, 1e-4)))
    if len(used) == 0:
        return out, bias
    place = np.zeros(len(ratio), np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    column = np.empty(int(sizes.sum()), np.int32)
    ends = np.cumsum(sizes)
    for r, end in zip(rows, ends.tolist()):
        column[end - len(r) : end] = place[r]
    # Texts taken together, and the entries they have.
    lots = np.unique(np.searchsorted(ends, np.arange(0, len(column), AT_ONCE), side="right"))
    lots = list(zip(lots.tolist(), [*lots[1:].tolist(), len(rows)]))
    entry = np.concatenate([[0], ends])

    def by_text(value: np.ndarray) -> np.ndarray:
        parts = []
        for lo, hi in lots:
            doc = np.repeat(np.arange(hi - lo), sizes[lo:hi])
            parts.append(np.bincount(doc, weights=value[column[entry[lo] : entry[hi]]], minlength=hi - lo))
        return np.concatenate([np.zeros(lots[0][0]), *parts])

    def by_feature(value: np.ndarray) -> np.ndarray:
        total = np.zeros(len(used))
        for lo, hi in lots:
            total += np.bincount(column[entry[lo] : entry[hi]], weights=np.repeat(value[lo:hi], sizes[lo:hi]), minlength=len(used))
        return total

    value = ratio[used].astype(np.float64)
    # Start from naive Bayes shrunk, then accelerated gradient steps with per-feature scaling.
    w = np.zeros(len(used))
    scale = value**2 * by_feature(weight) * 0.25 + PENALTY
    velocity = np.zeros_like(w)
    bias_velocity, n = 0.0, weight.sum()
    for step in range(STEPS):
        margin = bias + by_text(value * w)
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - toxic)
        gradient = value * by_feature(error) + PENALTY * w
        velocity = 0.9 * velocity - 0.05 * gradient / scale
        bias_velocity = 0.9 * bias_velocity - 0.2 * error.sum() / n
        w += velocity
        bias += bias_velocity
    out[used] = w * ratio[used]
    return out, bias


def evidence(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Likelihood ratio (G) of each feature's presence by class against one rate for both."""
    if not sizes.all():
        return np.zeros(counts.shape[1])
    rate = counts.sum(axis=0) / sizes.sum()
    out = np.zeros(counts.shape[1])
    for k in (0, 1):
        for seen, expected in ((counts[k], rate * sizes[k]), (sizes[k] - counts[k], (1 - rate) * sizes[k])):
            out += 2 * seen * np.log(np.where(seen > 0, seen, 1) / np.where(seen > 0, expected, 1))
    return out


def ratios(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Log-count ratio of each feature by (class, feature) counts and class sizes; 0 without enough evidence."""
    p = [(counts[k].astype(np.float64) + SMOOTHING) / (sizes[k] + 2 * SMOOTHING) for k in (0, 1)]
    return np.where(evidence(counts, sizes) >= LEAST_EVIDENCE, np.log(p[1] / p[0]), 0.0)


def calibration(margin: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic curve from margins to classes, by damped Newton steps."""
    if not 0 < toxic.sum() < len(toxic):
        return 1.0, 0.0
    # Targets a little inside 0 and 1 keep the curve finite where the classes don't overlap.
    n = toxic.sum()
    target = np.where(toxic > 0, (n + 1) / (n + 2), 1 / (len(toxic) - n + 2))
    x = np.stack([margin, np.ones(len(margin))])

    def loss(at: np.ndarray) -> float:
        z = at @ x
        return float((weight * (np.logaddexp(0, z) - target * z)).sum())

    at = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -30, 30)))
        slope = (x * (weight * p * (1 - p))) @ x.T + 1e-9 * np.eye(2)
        step, now = np.linalg.solve(slope, x @ (weight * (p - target))), loss(at)
        while loss(at - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        at = at - step
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def train(docs: DataFrame, labels: DataFrame, orders: tuple[int, ...] = ORDERS, per_class: int = SAMPLE_PER_CLASS) -> tuple[np.ndarray, float]:
    """The calibrated model learned from the labelled rows that aren't held out."""
    spark = docs.sparkSession
    known = labels.filter(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = common.beside(known.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")), "toxic-labels")
    marked = docs.select("doc_id", "text").join(known, "doc_id")
    counts = common.sum_cells(marked.select("text", "fold", "toxic").mapInArrow(_count(orders), "chunk int, cells binary"), FOLDS * 2 * FEATURES)
    counts = counts.astype(np.uint32).reshape(FOLDS, 2, FEATURES)
    sizes = np.zeros((FOLDS, 2))
    for r in marked.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect():
        sizes[r["fold"], r["toxic"]] = r["n"]
    # One model without each fold, and the one of all.
    ratio = [ratios(counts.sum(axis=0) - counts[k], sizes.sum(axis=0) - sizes[k]) for k in range(FOLDS)]
    ratio.append(ratios(counts.sum(axis=0), sizes.sum(axis=0)))
    del counts
    send = spark.sparkContext.broadcast(np.any([r != 0 for r in ratio], axis=0))
    # A bounded sample of each class: the smallest hashes of the ids.
    some = [marked.select("doc_id", "toxic").filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    some = common.beside(some[0].unionByName(some[1]).select("doc_id").distinct(), "toxic-sample")
    sample = marked.join(some, "doc_id", "left_semi").select("text", "fold", "toxic").mapInArrow(_sample_rows(orders, send), "fold int, toxic int, features binary")
    # One part of the written sample at a time: the driver's JVM never holds all of it.
    sample = common.written(sample, "toxic-rows").toLocalIterator()
    fold, toxic, rows = [], [], []
    for r in sample:
        fold.append(r["fold"])
        toxic.append(r["toxic"])
        rows.append(np.frombuffer(r["features"], "<i4"))
    fold, toxic = np.array(fold, np.int64), np.array(toxic, np.float64)
    # Both classes count as often as they do among all training rows.
    share = sizes.sum(axis=0) / [max(1, int((toxic == k).sum())) for k in (0, 1)]
    weight = share[toxic.astype(np.int64)]
    weight = weight * len(weight) / weight.sum() if len(weight) else weight

    def fitted(own: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
        return fit([rows[i][ratio[rows[i]] != 0] for i in own.tolist()], toxic[own], ratio, weight[own])

    margin = np.zeros(len(rows))
    for k in range(FOLDS):
        coefficient, bias = fitted(np.flatnonzero(fold != k), ratio[k])
        for i in np.flatnonzero(fold == k).tolist():
            margin[i] = bias + coefficient[rows[i]].sum()
    of_class = sizes.sum(axis=0)
    more = (of_class[0] / of_class[1]) ** BALANCE if of_class.all() else 1.0
    slope, shift = calibration(margin, toxic, weight * np.where(toxic > 0, more, 1.0))
    coefficient, bias = fitted(np.arange(len(rows)), ratio[-1])
    return coefficient * slope, bias * slope + shift


def _score(orders: tuple[int, ...], model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coefficient, bias = model.value
        used = coefficient != 0
        for part in common.slices(batches, "text", SLICE_BYTES):
            doc, feature = features(part.column("text"), orders, used)
            margin = bias + np.bincount(doc, weights=coefficient[feature], minlength=part.num_rows)
            score = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, orders: tuple[int, ...] = ORDERS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Only text is an input of a score; a null text is empty, and an empty one has the score of a
    text without any feature. Of labels that repeat a doc_id a toxic one wins; null labels and
    held-out rows teach nothing. Without labels every score is near 0.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, orders))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(orders, model), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
