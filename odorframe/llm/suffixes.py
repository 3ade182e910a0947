"""Removal of repeated byte strings by a distributed merge sort of suffixes.

Every string of SPAN bytes holds a seed of SPAN/2 bytes whose hash is the smallest in it, so equal
strings hold equal seeds at equal offsets, and only suffixes that begin at such a seed are sorted.
Three steps, none of which moves or holds more than a share of the text:

1. Seeds met once in the corpus are dropped: their suffixes share no long prefix with any other.
2. Each slice of the text sorts what is left into runs, cut by seed into buckets and front-coded
   (length shared with the string before, then the rest). Equal strings of a run travel once.
3. A bucket's runs are merged by a loser tree that remembers how much each run's head shares with
   the last string put out, compares only behind that, and yields the common prefix lengths of
   neighbours. With the common lengths to the left of the seeds they give the repeated spans.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odorframe.llm import common

SPAN = 200
SLICE_BYTES = 2 << 20
# Text bytes whose seeds are hashed at once.
AT_ONCE = 1 << 18
# Text bytes per bucket.
BUCKET_BYTES = 2 << 20
# Row groups of the written slices: the Parquet reader holds up to one of them at once.
ROW_GROUP = 8 << 20
# A seed in more slices than this is split by a further SPAN/4 bytes on either side.
HOT_SLICES = 1024
# Groups of more strings than this are resolved column by column instead of pair by pair.
PAIRWISE = 100


def _slide(values: np.ndarray, width: int, pick: Callable) -> np.ndarray:
    """pick (minimum or maximum) over every ``width`` values in a row."""
    out, have = values, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[:-rest], out[rest:]) if rest else out


_POWERS: dict[str, np.ndarray] = common.remembered()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n + 1:
        _POWERS["up"] = common.powers(common.BASE, n + 1)
        _POWERS["back"] = common.powers(common.INVERSE, n + 1)
    return _POWERS["up"][:n], _POWERS["back"][:n]


def anchors(data: np.ndarray, offsets: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, seed hashes) of the seeds that are smallest in some span of a text."""
    parts, start = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))], 0
    while start < len(offsets) - 1:
        # Some texts at a time, which bounds what is held besides the result.
        stop = int(np.searchsorted(offsets, offsets[start] + AT_ONCE, side="right")) - 1
        stop = min(max(stop, start + 1), len(offsets) - 1)
        places, h = _anchors(data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start], span)
        parts.append((places + offsets[start], h))
        start = stop
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _anchors(data: np.ndarray, offsets: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    seed, n = span // 2, len(data)
    if n < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, back = _powers(n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=prefix[1:])
    h = common.mix((prefix[seed:] - prefix[:-seed]) * back[: n - seed + 1])
    end = np.repeat(offsets[1:], np.diff(offsets))
    place = np.arange(n)
    whole = place[: len(h)] + seed <= end[: len(h)]
    low = np.maximum((h >> np.uint64(32)).astype(np.uint32), np.uint32(1))
    low[~whole] = np.uint32(0xFFFFFFFF)
    width = span - seed + 1
    least = _slide(low, width, np.minimum)
    least[place[: len(least)] + span > end[: len(least)]] = 0
    # A seed is smallest in one of the spans around it if the largest minimum of those is its own.
    padded = np.zeros(len(least) + 2 * (width - 1), np.uint32)
    padded[width - 1 : width - 1 + len(least)] = least
    found = np.flatnonzero(whole & (_slide(padded, width, np.maximum)[: len(low)] == low))
    return found, h[found]


def _by_bucket(h: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    of = (h % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(of[part[0]]), part


_SEEDS = "bucket long, run long, hashes binary, twice binary"


def _unpacked(lengths, body: bytes) -> tuple[bytes, np.ndarray]:
    """(bytes of a slice, n+1 offsets of its texts)."""
    return zlib.decompress(body), np.concatenate([[0], np.cumsum(np.asarray(lengths, np.int64))])


def _send_seeds(span: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        common.forget(_POWERS)
        for batch in batches:
            for number, lengths, body in zip(*(batch.column(c) for c in ("run", "lengths", "body"))):
                raw, offsets = _unpacked(lengths.values.to_numpy(), body.as_py())
                _, h = anchors(np.frombuffer(raw, np.uint8), offsets, span)
                h, n = np.unique(h, return_counts=True)
                rows = [(b, number.as_py(), h[i].tobytes(), (n[i] > 1).tobytes()) for b, i in _by_bucket(h, buckets)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["bucket", "run", "hashes", "twice"])
        common.release()

    return run


def _live_seeds(hot_slices: int):
    """Per run the seeds that are met again, in the run or elsewhere, and which of them are hot."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(b, np.uint64) for b in group["hashes"]]
        codes, found = pd.factorize(np.concatenate(parts))
        runs = np.bincount(codes, minlength=len(found))
        twice = np.bincount(codes, weights=np.concatenate([np.frombuffer(b, bool) for b in group["twice"]]), minlength=len(found)) > 0
        live, hot = (runs > 1) | twice, runs > hot_slices
        out, at = [], 0
        for number, part in zip(group["run"], parts):
            c = codes[at : at + len(part)]
            at += len(part)
            keep = live[c]
            if keep.any():
                out.append((number, part[keep].tobytes(), hot[c][keep].tobytes()))
        return pd.DataFrame(out, columns=["run", "hashes", "hot"])

    return run


# Ids travel as text: numbers and nulls in one list would come back as doubles.
_TEXTS = "run long, ids array<string>, lengths array<int>, body binary"


def _send_texts(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, part in enumerate(common.slices(batches, "text", limit)):
            data, offsets = common.utf8(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(task << 32) + k], pa.int64()),
                    pa.array([part.column("doc_id").cast(pa.string()).to_pylist()], pa.list_(pa.string())),
                    pa.array([np.diff(offsets).tolist()], pa.list_(pa.int32())),
                    pa.array([zlib.compress(data.tobytes(), 1)], pa.binary()),
                ],
                ["run", "ids", "lengths", "body"],
            )

    return run


def shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of ``a`` and ``b``, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    low, high = known, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


Entry = tuple[bytes, bytes, list[int]]  # sorted string, the other side, places


def front_code(entries: list[Entry]) -> bytes:
    entries.sort(key=lambda e: e[:2])
    rows, last = [], b""
    for a, b, places in entries:
        n = shared(last, a, 0)
        rows.append((n, a[n:], b, places))
        last = a
    return zlib.compress(pickle.dumps(rows, 5), 1)


_RUNS = "bucket long, kind int, run long, body binary"


def _make_runs(span: int, buckets: int):
    seed, quarter = span // 2, span // 4

    def run(key: tuple, texts: pd.DataFrame, live: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(texts) and len(live):
            raw, offsets = _unpacked(texts["lengths"].iloc[0], texts["body"].iloc[0])
            data = np.frombuffer(raw, np.uint8)
            hashes = np.concatenate([np.frombuffer(b, np.uint64) for b in live["hashes"]])
            hot = np.concatenate([np.frombuffer(b, bool) for b in live["hot"]])
            order = np.argsort(hashes)
            hashes, hot = hashes[order], hot[order]
            place, h = anchors(data, offsets, span)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            ok = hashes[at] == h
            place, h, hot = place[ok], h[ok], hot[at[ok]]
            text = np.searchsorted(offsets, place, side="right")
            first, last = offsets[text - 1], offsets[text]
            made: dict[tuple[int, int], dict[tuple[bytes, bytes], list[int]]] = {}
            for x, s, lo, hi, split in zip(place.tolist(), h.tolist(), first.tolist(), last.tolist(), hot.tolist()):
                right, left = raw[x : min(x + span, hi)], raw[max(lo, x - seed) : x][::-1]
                if not split:
                    made.setdefault((s % buckets, 0), {}).setdefault((right, left), []).append(x)
                    continue
                # A span that holds the seed goes on for a quarter to its right or to its left.
                if len(right) >= seed + quarter:
                    b = zlib.crc32(right[: seed + quarter]) % buckets
                    made.setdefault((b, 1), {}).setdefault((right, left), []).append(x)
                if len(left) >= quarter:
                    back = right[:seed][::-1] + left
                    b = zlib.crc32(back[: seed + quarter]) % buckets
                    made.setdefault((b, 2), {}).setdefault((back, right[seed:]), []).append(x)
            for (b, kind), entries in made.items():
                out.append((b, kind, key[0], front_code([(a, o, p) for (a, o), p in entries.items()])))
        return pd.DataFrame(out, columns=["bucket", "kind", "run", "body"])

    return run


def merge(runs: list[list[tuple[int, bytes, bytes, list[int]]]]) -> Iterator[tuple[int, bytes, bytes, int, list[int]]]:
    """Merges front-coded sorted runs; yields (prefix shared with the last, string, other side, run, places).

    A loser tree: an inner node holds the run that lost there, and each run's head knows what it
    shares with the last string put out. Of two heads the one that shares more is the smaller;
    only if both share as much are they compared, from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads: list[bytes | None] = [r[0][1] if r else None for r in runs] + [None] * (size - len(runs))
    known, at, losers = [0] * size, [0] * size, [0] * size

    def play(i: int, j: int) -> tuple[int, int]:
        a, b = heads[i], heads[j]
        if b is None or a is None:
            return (i, j) if b is None else (j, i)
        if known[i] != known[j]:
            return (i, j) if known[i] > known[j] else (j, i)
        n = shared(a, b, known[i])
        if n == len(a) or (n < len(b) and a[n] < b[n]):
            known[j] = n
            return i, j
        known[i] = n
        return j, i

    winner = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winner[node], losers[node] = play(winner[2 * node], winner[2 * node + 1])
    top = winner[1]
    while heads[top] is not None:
        run, k = runs[top], at[top]
        string = heads[top]
        yield known[top], string, run[k][2], top, run[k][3]
        at[top] = k = k + 1
        if k < len(run):
            known[top] = run[k][0]
            heads[top] = string[: run[k][0]] + run[k][1]
        else:
            heads[top] = None
        node = (top + size) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def reaches(
    strings: list[bytes], common_prefix: list[int], others: list[bytes], times: list[int], span: int, pairwise: int = PAIRWISE
) -> list[tuple[int, int]]:
    """For sorted strings of one seed: how far (along, along the other side) each is repeated.

    ``common_prefix[i]`` is shared by strings i-1 and i. Two places repeat each other if what
    they share on both sides makes a span; (0, 0) where no such place exists.
    """
    m = len(strings)
    best = [[0, 0] for _ in range(m)]
    for i in range(m):
        if times[i] > 1 and len(strings[i]) + len(others[i]) >= span:
            best[i] = [len(strings[i]), len(others[i])]
    if m <= pairwise:
        for i in range(m - 1):
            along = span
            for j in range(i + 1, m):
                along = min(along, common_prefix[j])
                aside = shared(others[i], others[j], 0)
                if along + aside >= span:
                    for e in (best[i], best[j]):
                        e[0], e[1] = max(e[0], along), max(e[1], aside)
        return [(a, b) for a, b in best]
    along, aside = np.array(best).T.copy()
    n = np.array(times, np.float64)
    neighbour = np.array(common_prefix)
    neighbour[0] = 0
    long_a, long_b = np.array([len(s) for s in strings]), np.array([len(s) for s in others])
    order = sorted(range(m), key=others.__getitem__)
    beside = np.array([0] + [shared(others[order[k - 1]], others[order[k]], 0) for k in range(1, m)])
    for o in range(span // 2 + 1):
        ok = np.flatnonzero((long_a >= span - o) & (long_b >= o))
        if len(ok) < 2:
            continue
        class_b = np.zeros(m, np.int64)
        class_b[order] = np.cumsum(beside < o)
        codes, _ = pd.factorize(np.cumsum(neighbour < span - o)[ok] * (m + 1) + class_b[ok])
        again = ok[np.bincount(codes, weights=n[ok])[codes] > 1]
        along[again] = np.maximum(along[again], span - o)
        aside[again] = np.maximum(aside[again], o)
    return list(zip(along.tolist(), aside.tolist()))


def _resolve(span: int, pairwise: int):
    seed = span // 2

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        kind = int(key[1])
        least = seed if kind == 0 else seed + span // 4
        numbers = group["run"].tolist()
        spans: dict[int, list[int]] = {}

        def close(strings, prefixes, others, places) -> None:
            times = [sum(len(p) for _, p in ps) for ps in places]
            for (a, b), ps in zip(reaches(strings, prefixes, others, times, span, pairwise), places):
                if a + b < span:
                    continue
                for r, xs in ps:
                    to = spans.setdefault(r, [])
                    for x in xs:
                        to += (x - b, x + a) if kind < 2 else (x + seed - a, x + seed + b)

        held: tuple[list, list, list, list] = ([], [], [], [])
        for n, string, other, r, places in merge([pickle.loads(zlib.decompress(b)) for b in group["body"]]):
            if n < least and held[0]:
                close(*held)
                held = ([], [], [], [])
            strings, prefixes, others, at = held
            # Strings equal on both sides are one string with more places.
            if not strings or n != len(string) or n != len(strings[-1]):
                same: dict[bytes, int] = {}
            if other in same:
                at[same[other]].append((r, places))
                continue
            same[other] = len(strings)
            strings.append(string)
            prefixes.append(n)
            others.append(other)
            at.append([(r, places)])
        if held[0]:
            close(*held)
        rows = [(numbers[r], np.array(v, "<i4").tobytes()) for r, v in spans.items()]
        return pd.DataFrame(rows, columns=["run", "spans"])

    return run


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept "


def _remove(as_text: bool):
    def run(key: tuple, texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ids, lengths, body in zip(texts["ids"], texts["lengths"], texts["body"]):
            raw, offsets = _unpacked(lengths, body)
            data = np.frombuffer(raw, np.uint8)
            depth = np.zeros(len(data) + 1, np.int32)
            for b in found["spans"]:
                pairs = np.frombuffer(b, "<i4")
                np.add.at(depth, pairs[0::2], 1)
                np.add.at(depth, pairs[1::2], -1)
            np.cumsum(depth, out=depth)
            gone = depth[:-1] > 0
            del depth
            starts = gone.copy()
            starts[1:] &= ~gone[:-1]
            inner = offsets[offsets < len(data)]
            starts[inner] = gone[inner]
            # Text by text, which holds no numbers for all bytes of the slice.
            for doc_id, a, b in zip(ids, offsets[:-1].tolist(), offsets[1:].tolist()):
                own = data[a:b][~gone[a:b]].tobytes()
                n_removed, n_spans = b - a - len(own), int(np.count_nonzero(starts[a:b]))
                out.append((None if doc_id is None else int(doc_id), b - a, n_removed, n_spans, own.decode("utf-8", "ignore") if as_text else own))
        made = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
        made = made.assign(doc_id=pd.array([r[0] for r in out], dtype="Int64"))
        common.release()
        return made

    return run


def remove_repeats(
    docs: DataFrame,
    span: int = SPAN,
    slice_bytes: int = SLICE_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
    hot_slices: int = HOT_SLICES,
    pairwise: int = PAIRWISE,
    as_text: bool = False,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay).

    A byte goes if a string of ``span`` bytes that covers it also starts anywhere else, in this
    text or another one; with ``as_text`` what is left of a cut character goes too. n_spans counts the maximal runs of such bytes. Matches never cross
    documents. A null text is empty; texts shorter than ``span`` bytes stay whole. Rows that
    repeat a doc_id are documents of their own. Slices of the texts are written once and every
    later step reads those.
    """
    if span < 8 or span % 4:
        raise ValueError("span must be a multiple of 4, 8 at least")
    buckets = common.blocks_for(docs, bucket_bytes)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Slices are cut at Arrow batches, whose borders differ from scan to scan: numbered and written once.
    texts = common.written(source.mapInArrow(_send_texts(slice_bytes), _TEXTS), "suffix-texts", ROW_GROUP)
    seeds = texts.select("run", "lengths", "body").mapInArrow(_send_seeds(span, buckets), _SEEDS)
    live = common.written(seeds.groupBy("bucket").applyInPandas(_live_seeds(hot_slices), "run long, hashes binary, hot binary"), "suffix-seeds")
    runs = texts.groupBy("run").cogroup(live.groupBy("run")).applyInPandas(_make_runs(span, buckets), _RUNS)
    spans = runs.groupBy("bucket", "kind").applyInPandas(_resolve(span, pairwise), "run long, spans binary")
    spans = common.written(spans, "suffix-spans")
    return texts.groupBy("run").cogroup(spans.groupBy("run")).applyInPandas(_remove(as_text), _RESULT + ("string" if as_text else "binary"))


def trimmed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with all their columns, texts without repeated strings and n_chars (if any) anew."""
    row = common.fresh_name(docs, "row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    kept = remove_repeats(numbered.select(F.col(row).alias("doc_id"), "text"), as_text=True)
    texts = kept.select(F.col("doc_id").alias(row), F.col("kept").alias("text"))
    out = numbered.drop("text").join(texts, row)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
