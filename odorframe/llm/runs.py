"""Periodic runs of words, by recursive frequency splitting and a scan of lags.

A run is a stretch of consecutive words with smallest period q, at least max(LEAST, TIMES * q) words
long, that no neighbouring word extends. Each of its words stands in it TIMES times or more. So a
word that is rarer than that within a segment is in no run of the segment and splits it; counting
again within the parts splits further, until nothing changes. Most text is gone by then.

What is left is scanned lag by lag. A run of period q makes max(LEAST, TIMES * q) - q neighbouring
words equal to the word q further on, so it is enough to look at one place in so many: over all lags
that is n log n places, not n * n. Only a place that agrees is extended to its whole stretch.

Documents are independent of each other: nothing is shuffled, and a task holds some documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odorframe.llm import common, twins

LEAST = 6
TIMES = 4
# Text bytes whose words are held at once; a longer text is held alone.
SLICE_BYTES = 1 << 20


def segments(codes: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Places of the words that may be in runs, as stretches of neighbours within a document."""
    place, segment = np.arange(len(codes)), doc.astype(np.int64)
    width = int(codes.max(initial=0)) + 1
    while len(place):
        same, found = pd.factorize(segment * width + codes[place])
        often = np.bincount(same, minlength=len(found))[same] >= TIMES
        stays, old = place[often], segment[often]
        first = np.ones(len(stays), bool)
        first[1:] = (np.diff(stays) != 1) | (np.diff(old) != 0)
        number = np.cumsum(first) - 1
        long = np.bincount(number, minlength=1)[number] >= LEAST
        changed = len(stays) < len(place) or not long.all()
        place, segment = stays[long], number[long]
        if not changed:
            break
    return np.split(place, np.flatnonzero(np.diff(segment)) + 1) if len(place) else []


def _stretch(cells: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The longest [start, end) around ``at`` whose cells all equal the cell ``lag`` further on."""
    start, end, step = at, at + 1, 64
    while True:
        step = min(step, len(cells) - end - lag)
        differ = np.flatnonzero(cells[end : end + step] != cells[end + lag : end + lag + step])
        if len(differ):
            end += int(differ[0])
            break
        end, step = end + step, step * 2
    step = 64
    while start:
        low = max(0, start - step)
        differ = np.flatnonzero(cells[low:start] != cells[low + lag : start + lag])
        if len(differ):
            start = low + int(differ[-1]) + 1
            break
        start, step = low, step * 2
    return start, end


def runs_of(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """(start, length, period) of every run as rows, by start, then period; places count over all texts."""
    parts = sorted(segments(codes, doc), key=len, reverse=True)
    if not parts:
        return np.zeros((0, 3), np.int64)
    longest = len(parts[0])
    # The segments in a row, longest first. What stands between and behind them equals nothing.
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes + 1)
    cells = -1 - np.arange(int(ends[-1]) + 2 * longest + 64, dtype=np.int64)
    places = np.zeros(len(cells), np.int64)
    for end, part in zip(ends.tolist(), parts):
        cells[end - 1 - len(part) : end - 1] = codes[part]
        places[end - 1 - len(part) : end - 1] = part
    found: list[tuple[int, int, int]] = []
    known: set[tuple[int, int]] = set()
    # The run last found that covers a cell, and the periods and lengths of the runs.
    cover = np.full(len(cells), -1)
    periods, lengths = np.zeros(64, np.int64), np.zeros(64, np.int64)
    for lag in range(1, longest // TIMES + 1):
        least = max(LEAST, TIMES * lag)
        fit = int(np.searchsorted(-sizes, -least, side="right"))
        if not fit:
            break
        step = least - lag
        probe = np.arange(0, int(ends[fit - 1]), step)
        hits = probe[cells[probe] == cells[probe + lag]]
        if not len(hits):
            continue
        # A multiple of the period of a run that holds both words: the stretch is that run.
        at = cover[hits]
        inside = (at >= 0) & (at == cover[hits + lag])
        inside &= (lag % np.maximum(periods[at], 1) == 0) & (lengths[at] >= periods[at] + lag)
        hits = hits[~inside]
        # Four neighbours at least agree as well.
        agreed = np.ones(len(hits), np.int64)
        for way in (1, -1):
            on = np.ones(len(hits), bool)
            for k in range(1, LEAST - 1):
                on &= cells[hits + way * k] == cells[hits + way * k + lag]
                agreed += on
        behind = -1
        for hit in hits[agreed >= LEAST - 1].tolist():
            if hit < behind:
                continue
            start, behind = _stretch(cells, hit, lag)
            # The same words with a smaller period were found with that one.
            if behind - start < step or (start, behind + lag) in known:
                continue
            known.add((start, behind + lag))
            if len(found) == len(periods):
                periods, lengths = np.resize(periods, 2 * len(found)), np.resize(lengths, 2 * len(found))
            periods[len(found)], lengths[len(found)] = lag, behind + lag - start
            cover[start : behind + lag] = len(found)
            found.append((int(places[start]), behind + lag - start, lag))
    out = np.array(found, np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


_FOUND = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batches, "text", SLICE_BYTES):
        data, offsets = common.utf8(part.column("text"))
        raw = data.tobytes()
        # bytes.split() cuts at the six ASCII white-space bytes and at nothing else.
        texts = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        n_words = np.array([len(t) for t in texts], np.int64)
        first = np.concatenate([[0], np.cumsum(n_words)])
        words = np.empty(int(first[-1]), object)
        words[:] = [w for t in texts for w in t]
        found = runs_of(pd.factorize(words)[0], np.repeat(np.arange(len(texts)), n_words))
        owner = np.searchsorted(first, found[:, 0], side="right") - 1
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, found[:, 0] + found[:, 2], 1)
        np.add.at(depth, found[:, 0] + found[:, 1], -1)
        stays = np.cumsum(depth[:-1]) == 0
        cut = set(owner.tolist())
        kept = [b" ".join(words[first[i] : first[i + 1]][stays[first[i] : first[i + 1]]] if i in cut else t) for i, t in enumerate(texts)]
        runs = pa.StructArray.from_arrays(
            [pa.array(found[:, 0] - first[owner]), pa.array(found[:, 1]), pa.array(found[:, 2])], ["start", "length", "period"]
        )
        upto = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
        columns = [part.column("row"), part.column("doc_id"), pa.array(n_words), pa.ListArray.from_arrays(pa.array(upto), runs), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, n_words, runs, collapsed.

    Words are what stands between ASCII white space, numbered from 0. ``runs`` has (start, length,
    period) by start, then period. ``collapsed`` is the words that are in no run, or among the first
    ``period`` words of every run they are in, joined by one space, as UTF-8 bytes. A null, empty or
    blank text has no words: no runs, nothing collapsed. Rows that repeat a doc_id or a text are
    documents of their own; an empty table gives an empty one.
    """
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(_find, "row long, doc_id long, " + _FOUND)


def repeated(text: Column, doc_id: Column) -> Column:
    """``text`` with its tail made periodic for one doc_id in ten: known cases for the scan.

    With h = crc32 of the decimal doc_id and g = h div 10, where 10 divides h every word i >= a
    becomes word a + (i - a) mod p: a = g mod n, p = 1 + (n - a) div (3 + g mod 8).
    """
    full = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(full, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    n = F.size(words)
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    made = F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(made, " ")).otherwise(full)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: first start, then smallest period) and two digests."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    told = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    out = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    length, period = F.col("best.length"), -F.col("best.period")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


SQL = f"""
WITH {twins.CRC_TABLE},
d0 AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {twins.crc_sql('CAST(doc_id AS VARCHAR)')} AS h FROM documents, t),
d1 AS (SELECT *, len(w) AS n, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM d0),
d2 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM d1),
d AS (SELECT r, doc_id, n, list_transform(range(n), lambda i: w[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END]) AS w FROM d2),
wd AS (SELECT r, n, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM d),
often AS (SELECT * FROM wd QUALIFY count(*) OVER (PARTITION BY r, x) >= 4),
eq AS (SELECT a.r, b.i - a.i AS q, a.i FROM often a JOIN often b ON a.r = b.r AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
st AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM eq),
sp AS (SELECT r, min(i) AS start, count(*) + q AS length, q AS period FROM st GROUP BY r, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
rn AS (SELECT r, start, length, min(period) AS period FROM sp GROUP BY ALL),
best AS (SELECT * FROM rn QUALIFY row_number() OVER (PARTITION BY r ORDER BY length DESC, start, period) = 1),
told AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said FROM rn GROUP BY r),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS said FROM wd
  WHERE NOT EXISTS (SELECT 1 FROM rn WHERE rn.r = wd.r AND wd.i >= rn.start + rn.period AND wd.i < rn.start + rn.length) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
  1000 * best.length // best.period AS exponent_milli, sha256(coalesce(told.said, '')) AS runs_sha256, sha256(coalesce(kept.said, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""
