"""Benchmark decontamination by winnowing.

Of every WINDOW words in a row, the smallest hash of GRAM neighbouring words is kept, with its
place, in documents and items alike. Whatever stands before and behind, equal windows keep equal
hashes, so any shared passage of WINDOW words or more has a fingerprint in common. Three steps:

1. Documents send their fingerprints; those that no item has are dropped by a semi-join.
2. Hits are extended: every window of the document that holds the place of a hit goes, as text, to
   the table of the items' windows. Only equal words match, and a longer shared passage is the union
   of its windows.
3. A document's windows give the words that are hit, its distinct windows the items.

Items of fewer than WINDOW words are one window each, with the hash of all their words; documents
send hashes of that many words only where such items exist.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odorframe.llm import common, twins
from odorframe.llm.suffixes import _slide

WINDOW = 10
GRAM = 5
SLICE_BYTES = 1 << 20
# Fingerprints (8 bytes each) of the items that are sent to every task; beyond it Spark joins by shuffle.
MOST_SENT = 1_000_000
# Bytes of windows of the items that joins may broadcast.
MOST_BYTES = 32 << 20

# Bytes of words once A-Z are lower-cased: digits, letters and all of other scripts.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Words:
    """The words of some texts: their bytes, places, hashes and texts."""

    def __init__(self, column: pa.Array):
        data, offsets = common.utf8(column)
        self.data = LOWER[data]
        self.starts, self.ends, text = common.word_spans(self.data, offsets, WORD_BYTE)
        # Of each text: its first word and the one behind its last.
        self.first = np.searchsorted(text, np.arange(len(offsets)))
        self.hashes = common.span_hashes(self.data, self.starts, self.ends)
        self.stop = self.first[text + 1]

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; meaningless where they leave the text."""
        count = max(0, len(self.hashes) - n + 1)
        h = np.full(count, n, np.uint64)
        for k in range(n):
            h = h * common.BASE + self.hashes[k : k + count]
        return common.mix(h)

    def whole(self, n: int, count: int) -> np.ndarray:
        """Whether the n words from each of the first ``count`` words on are in one text."""
        return np.arange(count) + n <= self.stop[:count]

    def anchors(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, place) of the grams that are smallest in some window, and each window's smallest hash."""
        h = self.grams(gram)
        width = window - gram + 1
        if len(h) < width:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        # 0 stands for "in no whole window" below.
        h = np.maximum(h, np.uint64(1))
        least = _slide(h, width, np.minimum)
        least = np.where(self.whole(window, len(least)), least, np.uint64(0))
        around = np.zeros(len(least) + 2 * (width - 1), np.uint64)
        around[width - 1 : width - 1 + len(least)] = least
        # The largest minimum of the windows around a gram is its own hash if it is smallest in one.
        at = np.flatnonzero(_any_equal(around, h, width))
        return h[at], at, least

    @functools.cached_property
    def texts(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist())]

    def joined(self, starts: np.ndarray, length: int) -> list[bytes]:
        return [b" ".join(self.texts[s : s + length]) for s in starts.tolist()]


def _any_equal(around: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    """Whether one of the ``width`` windows that hold a gram has the gram's hash as its smallest."""
    out = np.zeros(len(h), bool)
    for k in range(width):
        out |= around[k : k + len(h)] == h
    return out


_PRINTS = "row long, doc_id long, head boolean, h long, at long, length int"


def _fingerprints(window: int, gram: int, short: list[int], known: Broadcast | None):
    """A head row per document with its number of words, and a row per fingerprint (of ``known`` ones, if given)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text", SLICE_BYTES):
            words = Words(part.column("text"))
            rows = part.column("row").to_numpy()
            found = [(*words.anchors(window, gram)[:2], window)]
            for n in short:
                h = words.grams(n)
                at = np.flatnonzero(words.whole(n, len(h)))
                found.append((h[at], at, n))
            out = [(rows, np.ones(len(rows), bool), np.zeros(len(rows), np.uint64), np.diff(words.first), np.zeros(len(rows), np.int32))]
            for h, at, n in found:
                if known is not None:
                    where = np.searchsorted(known.value, h)
                    mine = known.value[np.minimum(where, len(known.value) - 1)] == h if len(known.value) else np.zeros(len(h), bool)
                    h, at = h[mine], at[mine]
                text = np.searchsorted(words.first, at, side="right") - 1
                out.append((rows[text], np.zeros(len(h), bool), h, at - words.first[text], np.full(len(h), n, np.int32)))
            made = [np.concatenate(c) for c in zip(*out)]
            made[2] = made[2].view(np.int64)
            ids = pa.concat_arrays([part.column("doc_id"), pa.nulls(len(made[0]) - len(rows), pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array(made[0]), ids, *map(pa.array, made[1:])], ["row", "doc_id", "head", "h", "at", "length"])

    return run


_WINDOWS = "h long, length int, window binary"


def _item_windows(window: int, gram: int):
    """Every distinct window of an item with its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text", SLICE_BYTES):
            words = Words(part.column("text"))
            count = np.diff(words.first)
            least = words.anchors(window, gram)[2]
            at = np.flatnonzero(least)
            made = [(at, least[at], window)]
            for n in range(1, window):
                at = words.first[:-1][count == n]
                made.append((at, words.grams(n)[at], n))
            for at, h, n in made:
                item = np.searchsorted(words.first, at, side="right") - 1
                columns = [part.column("item").take(pa.array(item)), pa.array(h.view(np.int64)), pa.array(np.full(len(at), n, np.int32)), pa.array(words.joined(at, n), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["item", "h", "length", "window"])

    return run


_TEXTS = "row long, at long, length int, window binary"


def _extend(gram: int):
    """The windows of a document around the places of its hits, as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text", SLICE_BYTES):
            words = Words(part.column("text"))
            for i, (row, hits) in enumerate(zip(part.column("row").to_pylist(), part.column("hits").to_pylist())):
                first, last = int(words.first[i]), int(words.first[i + 1])
                places: dict[int, set[int]] = {}
                for hit in hits:
                    n, at = hit["length"], hit["at"]
                    # A long window holds the gram; a short one is the gram.
                    low = at - (n - gram) if hit["long"] else at
                    places.setdefault(n, set()).update(range(max(0, low), min(at, last - first - n) + 1))
                for n, some in places.items():
                    at = np.array(sorted(some), np.int64)
                    columns = [pa.array(np.full(len(at), row)), pa.array(at), pa.array(np.full(len(at), n, np.int32)), pa.array(words.joined(at + first, n), pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "at", "length", "window"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, most_sent: int = MOST_SENT, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, n_words, n_hit, items (sorted as strings).

    Words are runs of ASCII digits, ASCII letters (lower-cased) and characters beyond ASCII. A word is
    hit if it is in ``window`` words in a row that an item has too, or in all the words of an item that
    has fewer; ``items`` are the ids of those items. Null and empty texts have no words; an item
    without words matches nothing; rows of the benchmark with the same id are one item, those without
    an id are the item ''. Rows that repeat a doc_id are documents of their own.
    """
    if not 1 <= gram <= window:
        raise ValueError("a gram is at most as long as a window")
    spark = docs.sparkSession
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    windows = common.written(items.mapInArrow(_item_windows(window, gram), "item string, " + _WINDOWS).distinct(), "leak-windows")
    short = [r[0] for r in windows.filter(F.col("length") < window).select("length").distinct().collect()]
    prints = common.written(windows.select("h").distinct(), "leak-prints")
    sent = prints.count() <= most_sent
    known = None
    if sent:
        known = spark.sparkContext.broadcast(np.sort(prints.toArrow().column("h").to_numpy().view(np.uint64)))
    marks = numbered.mapInArrow(_fingerprints(window, gram, sorted(short), known), _PRINTS)
    if not sent:
        marks = marks.filter("head").unionByName(marks.filter(~F.col("head")).join(prints, "h", "left_semi").select(*marks.columns))
    marks = common.written(marks, "leak-marks")
    hits = marks.filter(~F.col("head")).groupBy("row").agg(F.collect_list(F.struct("at", "length", (F.col("length") == window).alias("long"))).alias("hits"))
    hits = common.written(hits, "leak-hits")
    near = numbered.select("row", "text").join(hits, "row").mapInArrow(_extend(gram), _TEXTS)
    # A window's number stands for its text from here on.
    size, n = windows.agg(F.sum(F.octet_length("window") + 32), F.count("*")).first()
    small = (size or 0) <= most_bytes

    def beside(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    named = common.written(windows.select("window", "length").distinct().select("window", "length", F.monotonically_increasing_id().alias("w")), "leak-names")
    found = common.written(near.join(beside(named), ["window", "length"]).select("row", "at", "length", "w"), "leak-found")
    spans = F.array_sort(F.collect_list(F.struct("at", (F.col("at") + F.col("length")).alias("end"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    union = F.aggregate(
        "spans", start, lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["end"], x["at"]))).alias("n"), F.greatest(s["end"], x["end"]).alias("end")), lambda s: s["n"]
    )
    hit = found.groupBy("row").agg(spans.alias("spans")).select("row", union.alias("n_hit"))
    owners = common.written(windows.join(beside(named), ["window", "length"]).select("w", "item"), "leak-owners")
    met = found.select("row", "w").distinct().join(beside(owners), "w").select("row", "item").distinct()
    met = met.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    told = marks.filter("head").select("row", "doc_id", F.col("at").alias("n_words")).join(hit.join(met, "row"), "row", "left")
    return told.select("row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{twins.UPPER}', '{twins.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
  SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT r, n, i, item FROM dw JOIN bw USING (n, win)),
wh AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN wh USING (r) LEFT JOIN it USING (r)
"""
