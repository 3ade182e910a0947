"""Spelling variants: words one edit apart, found by products of letter-count blocks.

1. The words of all texts are counted, some texts at a time and then by word.
2. The letters are dealt into four sets of about equal weight. One inserted, deleted or replaced
   letter changes the counts of two sets at most, so two words one edit apart agree in the letters
   of some pair of sets. Each word goes to a block for each of the six pairs, keyed by its letters
   of that pair in sorted order: no two similar words miss each other, and few others meet.
3. Within a block, words stand by length. The product of the count matrices of a length with its
   own and the next one gives all squared distances; two at most are left to be compared letter by
   letter. A pair that meets in several blocks is taken in the first of them.

Blocks of more than TILE words are cut into tiles that meet pairwise, so no task holds a block.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odorframe.llm import common, twins

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
RUN = re.compile("[a-zÀ-ÿ]+")
SETS = 4
PAIRS = list(combinations(range(SETS), 2))
LEAST_LETTERS, LEAST_TIMES = 6, 5
# A form stands at least so many times as often as its variant.
TIMES_MORE = 5
# Text bytes counted at once, and distinct words counted before they are sent on.
SLICE_BYTES = 1 << 20
HELD_WORDS = 200_000
# Words of a block (or tile) that meet in one task, and of a bucket of blocks.
TILE = 8192
BUCKET_WORDS = 60_000
# Rows and columns of a distance matrix.
ROWS, COLUMNS = 256, 1024
# Longer words are compared one by one.
LONGEST = 64


def _count(drop_every: int, least: int):
    """Words of ``least`` letters at least with their counts; see :func:`count_words`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for part in common.slices(batches, "text", SLICE_BYTES):
            data, offsets = common.utf8(part.column("text"))
            raw = data.tobytes().lower()  # of bytes: A-Z only
            for doc_id, a, b in zip(part.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(RUN.findall(raw[a:b].decode("utf-8", "replace"))).items():
                    if drop_every and len(word) >= least:
                        h = zlib.crc32(word.encode(), head)
                        if h % drop_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                    if len(word) >= least:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield sent()
        yield sent()
        common.release()

    return run


def count_words(docs: DataFrame, drop_every: int = 0, least: int = LEAST_LETTERS) -> DataFrame:
    """(word, n) of every run of letters (Latin, A-Z lower-cased) of ``least`` letters at least.

    With ``drop_every``, a run loses the letter h mod its length where h, the crc32 of
    ``<doc_id>:<run>``, is a multiple of it: known misspellings.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(_count(drop_every, least), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_sets(words: DataFrame) -> list[str]:
    """The letters in sets of about equal weight: in turn, to and fro, by how many words have them."""
    sums = words.agg(*[F.sum(F.contains("word", F.lit(c)).cast("long")).alias(f"l{i}") for i, c in enumerate(LETTERS)]).first()
    order = sorted(range(len(LETTERS)), key=lambda i: (-(sums[i] or 0), i))
    turn = [*range(SETS), *reversed(range(SETS))]
    return ["".join(LETTERS[i] for k, i in enumerate(order) if turn[k % len(turn)] == s) for s in range(SETS)]


def _key(pair: int, sets: list[str]) -> Column:
    others = "".join(s for i, s in enumerate(sets) if i not in PAIRS[pair])
    own = F.array_join(F.array_sort(F.split(F.translate("word", others, ""), "")), "")
    return F.struct(F.lit(pair).alias("pair"), F.xxhash64(F.lit(pair), own).alias("key"))


def _counts(words: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    letter = np.where(points < 0xC0, points - ord("a"), points - 0xC0 + 26)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(row * len(LETTERS) + letter, minlength=len(words) * len(LETTERS)).reshape(len(words), -1)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each pair of words, as long or the second a letter longer, differs by exactly one edit."""
    size = np.array([len(w) for w in a])
    longer = np.array([len(w) for w in b]) > size
    out = np.zeros(len(a), bool)
    for i in np.flatnonzero(size > LONGEST).tolist():
        x, y = a[i], b[i]
        at = next((k for k in range(len(x)) if x[k] != y[k]), len(x))
        out[i] = x[at:] == y[at + 1 :] if longer[i] else at < len(x) and x[at + 1 :] == y[at + 1 :]
    short = np.flatnonzero(size <= LONGEST)
    if len(short):
        wide = LONGEST + 2

        def matrix(words: np.ndarray) -> np.ndarray:
            return np.frombuffer("".join(w.ljust(wide, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(-1, wide)

        x, y, n = matrix(a[short]), matrix(b[short]), size[short]
        same = x == y
        # Letters alike from the front, and from the back when y is moved by its extra letter.
        front = np.minimum(np.argmin(np.concatenate([same, np.zeros((len(short), 1), bool)], axis=1), axis=1), n)
        moved = (x[:, :-1] == y[:, 1:]) | (np.arange(wide - 1) >= n[:, None])
        back = n - np.where(moved.all(axis=1), 0, wide - 1 - np.argmin(moved[:, ::-1], axis=1))
        out[short] = np.where(longer[short], front + back >= n, (~same).sum(axis=1) == 1)
    return out


_NEAR = "word string, n long, other string, other_n long"


def _meet(sets: list[str]):
    of = np.zeros(len(LETTERS), np.int64)
    for s, letters in enumerate(sets):
        of[[LETTERS.index(c) for c in letters]] = s
    first = np.array([p[0] for p in PAIRS]), np.array([p[1] for p in PAIRS])

    def near(words: np.ndarray, counts: np.ndarray, block: np.ndarray, pair: np.ndarray, tile: np.ndarray, cross: np.ndarray) -> Iterator[np.ndarray]:
        """Pairs (place, place) of words at distance two at most; rows stand by block, then length."""
        size = counts.sum(axis=1)
        used = counts.any(axis=0)
        # Single precision holds counts of words of up to 2048 letters exactly.
        exact = np.float32 if size.max() <= 2048 else np.float64
        matrix, group = counts[:, used].astype(exact), of[used]
        norm = (matrix * matrix).sum(axis=1)
        n = len(words)
        for low in range(0, n, ROWS):
            high = min(n, low + ROWS)
            # Up to the last word of the last row's block that is a letter longer at most.
            end = high + int(np.searchsorted(block[high:], block[high - 1], side="right"))
            stop = high + int(np.searchsorted(size[high:end], size[high - 1] + 1, side="right"))
            for left in range(low, stop, COLUMNS):
                right = min(stop, left + COLUMNS)
                d = norm[low:high, None] + norm[None, left:right] - 2 * (matrix[low:high] @ matrix[left:right].T)
                i, j = np.nonzero((d > 0) & (d <= 2))
                i, j = i + low, j + left
                ok = (j > i) & (block[i] == block[j]) & (size[j] - size[i] <= 1) & (~cross[i] | (tile[i] != tile[j]))
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                # Only in the first pair of sets whose letters both words share.
                differ = matrix[i] != matrix[j]
                changed = np.stack([differ[:, group == s].any(axis=1) for s in range(SETS)], axis=1)
                shared = ~(changed[:, first[0]] | changed[:, first[1]])
                ok = np.argmax(shared, axis=1) == pair[i]
                i, j = i[ok], j[ok]
                ok = one_edit(words[i], words[j])
                yield np.stack([i[ok], j[ok]])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(size=group["word"].str.len()).sort_values(["key", "left", "right", "size", "word"], ignore_index=True)
        head = group[["key", "left", "right"]].to_numpy()
        start = np.ones(len(group), bool)
        start[1:] = (head[1:] != head[:-1]).any(axis=1)
        block = np.cumsum(start)
        alone = np.bincount(block)[block] < 2
        group, block = group[~alone], block[~alone]
        if not len(group):
            return pd.DataFrame({"word": [], "n": [], "other": [], "other_n": []})
        words, n = group["word"].to_numpy(object), group["n"].to_numpy()
        found = list(near(words, _counts(words.tolist()), block, group["pair"].to_numpy(), group["tile"].to_numpy(), (group["left"] != group["right"]).to_numpy()))
        i, j = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        a, b = np.concatenate([i, j]), np.concatenate([j, i])
        return pd.DataFrame({"word": words[a], "n": n[a], "other": words[b], "other_n": n[b]})

    return run


def near_words(words: DataFrame, tile: int = TILE, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """(word, n, other, other_n): all ordered pairs of the written ``words`` (word, n) one edit apart."""
    sets = letter_sets(words)
    rows = words.select("word", "n", F.explode(F.array(*[_key(p, sets) for p in range(len(PAIRS))])).alias("at")).select("word", "n", "at.*")
    large = rows.groupBy("pair", "key").agg(F.count("*").alias("size")).filter(F.col("size") > tile)
    large = common.beside(large.select("key", F.ceil(F.col("size") / tile).cast("int").alias("tiles")), "spelling-blocks")
    placed = rows.join(large, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("tile")).alias("left"), F.greatest(t, F.col("tile")).alias("right")))
    dealt = placed.select("word", "n", "pair", "key", "tile", F.explode(meets).alias("m")).select("word", "n", "pair", "key", "tile", "m.*")
    buckets = max(1, -(-words.count() * len(PAIRS) // bucket_words))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("key", "left", "right"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandas(_meet(sets), _NEAR)


def variants(docs: DataFrame, drop_every: int = 0, least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES, times_more: int = TIMES_MORE, tile: int = TILE) -> DataFrame:
    """One row per word that is long and frequent enough: word, n, n_near, form, form_n, root.

    ``n_near`` counts the words one edit away. ``form`` is the most frequent of them (ties: the first
    in code-point order) if it stands ``times_more`` times as often; ``root`` is where following
    forms ends. Null and empty texts have no words; repeated rows count each time; an empty table
    gives an empty one.
    """
    words = common.written(count_words(docs, drop_every, least_letters).filter(F.col("n") >= least_times), "spelling-words")
    near = near_words(words, tile)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("form"))).alias("best"))
    told = words.join(best, "word", "left")
    taken = F.col("best").isNotNull() & (-F.col("best.n") >= times_more * F.col("n"))
    told = common.written(
        told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best.form")).alias("form"), F.when(taken, -F.col("best.n")).alias("form_n")),
        "spelling-forms",
    )
    roots = _roots(told)
    return told.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def _roots(told: DataFrame) -> DataFrame:
    """(word, root) of the words with a form. Each round doubles the steps made; counts grow by each step, so rounds are few."""
    links = common.written(told.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-links")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = common.written(step, "spelling-links")
        links = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return links


SQL = f"""
WITH RECURSIVE {twins.CRC_TABLE},
rn AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{twins.UPPER}', '{twins.LOWER}'), '[a-zÀ-ÿ]+')) AS w FROM documents),
oc AS (SELECT doc_id, w, count(*) AS n FROM rn GROUP BY ALL),
hs AS (SELECT w, n, {twins.crc_sql("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)")} AS h FROM oc, t),
md AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hs),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM md GROUP BY word HAVING length(word) >= 6 AND sum(n) >= 5),
cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
pr AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT cut.word, v.word FROM cut JOIN v ON cut.rest = v.word UNION SELECT v.word, cut.word FROM cut JOIN v ON cut.rest = v.word),
nr AS (SELECT pr.word, other, v.n AS other_n, count(*) OVER (PARTITION BY pr.word) AS n_near FROM pr JOIN v ON v.word = other
  QUALIFY row_number() OVER (PARTITION BY pr.word ORDER BY v.n DESC, other) = 1),
fm AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM v LEFT JOIN nr ON v.word = nr.word),
rt AS (SELECT word, word AS root FROM fm UNION ALL SELECT rt.word, fm.form FROM rt JOIN fm ON fm.word = rt.root WHERE fm.form IS NOT NULL)
SELECT fm.word, fm.n, fm.n_near, fm.form, fm.form_n, rt.root FROM fm JOIN rt ON rt.word = fm.word JOIN fm e ON e.word = rt.root WHERE e.form IS NULL
"""
