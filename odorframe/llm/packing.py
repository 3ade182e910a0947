"""Packing token sequences into fixed windows by minimum bin slack.

Every task packs the documents of its own partition: nothing is shuffled, memory is bounded by
the pool, and at most one window per partition is left short. A document gives whole windows as
long as it fills them; what remains goes to a pool counted by length. A window takes the longest
remainder and then the multiset of remainders that fills it best: a bitset holds the reachable
sums, length by length, and the counts are found by going back through the bitsets.
"""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from odorframe.llm import common

CAPACITY = 4096
END = 2
VOCABULARY = "word_bpe_49k.json"
# Remainders waiting in a task at most; windows are filled down to half of it.
POOL = 2048
# A window short of more than this many tokens gets the front of another remainder.
TOLERANCE = 16
SLICE_BYTES = 2 << 20
# Words (and parts of words) whose ids a worker remembers, give or take a slice's.
CACHE_WORDS = 600_000
# New ones are encoded by so many as one text, between them a sign with an id of its own.
GROUP = 4096
MARK = "\x01"
# Words for which lower case and Unicode normal form are the same everywhere (special tokens
# aside), and their parts.
PLAIN = regex.compile("[!-~À-ÖØ-öø-ÿ]+")
SPECIAL = "<|"
# Bytes of a plain word, an apostrophe aside (which may begin a part within a run of signs), and their kinds: letter, digit, sign.
LETTER, DIGIT, SIGN = 1, 2, 3
KIND = np.zeros(256, np.uint8)
KIND[33:127] = SIGN
KIND[[*range(48, 58)]] = DIGIT
KIND[[*range(65, 91), *range(97, 123), 0xC3]] = LETTER
KIND[ord("'")] = 0
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

Piece = tuple[int, int, int, np.ndarray]  # doc_id, start, doc_tokens, ids


class Table:
    """Strings and their ids, in flat arrays."""

    def __init__(self):
        self.index: dict[bytes | str, int] = {}
        self.first = self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def add(self, keys: list, count: np.ndarray, flat: np.ndarray) -> None:
        at = len(self.index)
        self.index.update(zip(keys, range(at, at + len(keys))))
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, flat])

    def places(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.index.get, keys, repeat(-1)), np.int64, len(keys))

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all places in a row, number of ids of each)."""
        count = self.count[places]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.first[places] - ends + count, count) + np.arange(total)], count


class WordIds:
    """Ids of texts by way of their words between ASCII white space.

    For a vocabulary that drops white space, lowers case and splits at letters, digits and other
    signs (as ``word_bpe_49k`` does) a text's ids are its words' ids in a row, and a word of plain
    Latin characters has those of its parts. These are cut from the bytes of many texts at once; each
    distinct part is encoded once per worker. Other words are encoded whole, or cut one by one.
    """

    def __init__(self, path: str):
        # A task has one core: threads of the library would take those of other tasks.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.words, self.parts = Table(), Table()
        # Ids that end a part, if the vocabulary tells them apart.
        suffix, vocabulary = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True

    def _encode(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, ids) of strings without white space or MARK: many as one text, marks between."""
        groups = [f" {MARK} ".join(strings[i : i + GROUP]) + f" {MARK}" for i in range(0, len(strings), GROUP)]
        counts, flats = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for e in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False):
            ids = np.array(e.ids, np.uint32)
            marks = np.flatnonzero(ids == self.mark)
            counts.append(np.diff(marks, prepend=-1) - 1)
            flats.append(np.delete(ids, marks))
        return np.concatenate(counts), np.concatenate(flats)

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of parts of plain words, lower-cased: their ids tell where one ends."""
        groups = [parts[i : i + GROUP] for i in range(0, len(parts), GROUP)]
        counts, flats = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.last[ids])
            count = np.diff(ends, prepend=-1)
            if len(ends) != len(group) or count.sum() != len(ids):
                count, ids = self._encode(group)
            counts.append(count)
            flats.append(ids)
        return np.concatenate(counts), np.concatenate(flats)

    def _learn_parts(self, parts: list[str]) -> None:
        if len(self.parts.index) > CACHE_WORDS:
            self.parts = Table()
        new = list(set(parts).difference(self.parts.index, [MARK]))
        if MARK not in self.parts.index:
            self.parts.add([MARK], np.array([1]), np.array([self.mark], np.uint32))
        if new:
            self.parts.add(new, *self._encode(new))

    def _learn(self, words: list[bytes]) -> None:
        plain, whole, odd = [], [], []
        for t in [w.decode() for w in words]:
            (odd if MARK in t else plain if PLAIN.fullmatch(t) and SPECIAL not in t else whole).append(t)
        # The parts of all plain words in one go, a mark behind each word.
        parts = PARTS.findall((f" {MARK} ".join(plain) + f" {MARK}").lower()) if plain else []
        self._learn_parts(parts)
        places = self.parts.places(parts)
        flat, count = self.parts.ids(places)
        ends = np.concatenate([[0], np.cumsum(count)])
        behind = np.flatnonzero(places == self.parts.index[MARK]) if plain else np.zeros(0, np.int64)
        # A mark has one id, left out here.
        self.words.add([t.encode() for t in plain], np.diff(ends[behind], prepend=-1) - 1, np.delete(flat, ends[behind]))
        self.words.add([t.encode() for t in whole], *self._encode(whole))
        for t in odd:
            ids = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
            self.words.add([t.encode()], np.array([len(ids)]), ids)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of a row of texts (bytes and offsets)."""
        data, starts, ends, doc, cut = units(data, offsets)
        codes, distinct = pd.factorize(common.span_hashes(data, starts, ends))
        first = np.zeros(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        if len(self.words.index) > CACHE_WORDS:
            self.words = Table()
        places = self.words.places(words)
        new = np.flatnonzero(places < 0)
        if len(new):
            at, is_part = len(self.words.index), cut[first[new]]
            parts, others = new[is_part], new[~is_part]
            keys = [words[i] for i in parts.tolist()]
            self.words.add(keys, *self._encode_parts([k.decode() for k in keys]))
            places[parts] = at + np.arange(len(parts))
            if len(others):
                keys = [words[i] for i in others.tolist()]
                self._learn(keys)
                places[others] = self.words.places(keys)
        ids, count = self.words.ids(places[codes])
        by_text = np.bincount(doc, weights=count, minlength=len(offsets) - 1).astype(np.int64)
        return np.split(ids, np.cumsum(by_text)[:-1])


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, text, whether a part) of the parts of plain words and of all other words, in text order.

    Plain words are lower-cased in these bytes. A part is a run of letters, a digit or a run of signs.
    """
    starts, ends, doc = common.word_spans(data, offsets)
    if not len(starts):
        return data, starts, ends, doc, np.zeros(0, bool)
    kind = KIND[data]
    after = np.flatnonzero(data == 0xC3) + 1
    after = after[after < len(data)]
    # The second byte of a letter from U+00C0 to U+00FF; the signs among them are not plain.
    kind[after] = np.where((data[after] == 0x97) | (data[after] == 0xB7), 0, LETTER)
    kind[np.flatnonzero((data[:-1] == ord(SPECIAL[0])) & (data[1:] == ord(SPECIAL[1])))] = 0
    odd = np.flatnonzero((kind == 0) & ~common.IS_SPACE[data])
    plain = np.ones(len(starts), bool)
    plain[np.searchsorted(starts, odd, side="right") - 1] = False
    capital = (data >= 65) & (data <= 90)
    capital[after] = (data[after] >= 0x80) & (data[after] <= 0x9E)
    begin = np.zeros(len(data), bool)
    begin[1:] = kind[1:] != kind[:-1]
    begin |= kind == DIGIT
    begin &= ~common.IS_SPACE[data]
    if len(odd):
        step = np.zeros(len(data) + 1, np.int8)
        step[starts[~plain]] += 1
        step[ends[~plain]] -= 1
        outside = np.cumsum(step[:-1], dtype=np.int8) == 0
        begin &= outside
        capital &= outside
    begin[starts] = True
    first = np.flatnonzero(begin)
    word = np.searchsorted(starts, first, side="right") - 1
    last = np.minimum(np.append(first[1:], len(data)), ends[word])
    return data + capital * np.uint8(32), first, last, doc[word], plain[word]


_WORKER: dict[str, WordIds] = common.remembered()


def worker_ids(path: str) -> WordIds:
    if path not in _WORKER:
        _WORKER[path] = WordIds(path)
    return _WORKER[path]


def best_fill(lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset {length: count} with the largest length in it that leaves the least slack.

    ``lengths``: the lengths with a positive count, ascending, none over ``capacity``.
    """
    top = lengths[-1]
    room = capacity - top
    mask = (1 << (room + 1)) - 1
    reach, layers = 1, []
    for i in range(bisect_left(lengths, room + 1) - 1, -1, -1):
        length = lengths[i]
        most = min(counts[length] - (length == top), room // length)
        if most <= 0:
            continue
        layers.append((length, reach))
        step = 1
        while most > 0:
            n = min(step, most)
            reach |= (reach << (length * n)) & mask
            most -= n
            step *= 2
        if reach >> room & 1:
            break
    left = reach.bit_length() - 1
    picked = {top: 1}
    for length, before in reversed(layers):
        n = 0
        while not before >> left & 1:
            left -= length
            n += 1
        if n:
            picked[length] = picked.get(length, 0) + n
    return picked


class Pool:
    """Remainders by length, and the windows filled from them."""

    def __init__(self, capacity: int, tolerance: int):
        self.capacity, self.tolerance = capacity, tolerance
        self.lengths: list[int] = []
        self.pieces: dict[int, list[Piece]] = defaultdict(list)
        self.size = 0

    def add(self, piece: Piece) -> None:
        n = len(piece[3])
        if not self.pieces[n]:
            insort(self.lengths, n)
        self.pieces[n].append(piece)
        self.size += 1

    def take(self, length: int) -> Piece:
        piece = self.pieces[length].pop()
        if not self.pieces[length]:
            del self.lengths[bisect_left(self.lengths, length)]
        self.size -= 1
        return piece

    def window(self) -> list[Piece]:
        counts = {n: len(self.pieces[n]) for n in self.lengths}
        picked = best_fill(self.lengths, counts, self.capacity)
        out = [self.take(n) for n in sorted(picked, reverse=True) for _ in range(picked[n])]
        slack = self.capacity - sum(n * k for n, k in picked.items())
        if slack > self.tolerance and self.size:
            # No remainder fits any more: the shortest one is cut.
            doc_id, start, total, ids = self.take(self.lengths[0])
            out.append((doc_id, start, total, ids[:slack]))
            self.add((doc_id, start + slack, total, ids[slack:]))
        return out


def _windows(documents: Iterator[tuple[int, np.ndarray]], capacity: int, pool_size: int, tolerance: int) -> Iterator[list[Piece]]:
    pool = Pool(capacity, tolerance)
    for doc_id, ids in documents:
        whole = len(ids) // capacity * capacity
        for start in range(0, whole, capacity):
            yield [(doc_id, start, len(ids), ids[start : start + capacity])]
        if whole < len(ids):
            pool.add((doc_id, whole, len(ids), ids[whole:].copy()))
        if pool.size >= pool_size:
            while pool.size > pool_size // 2:
                yield pool.window()
    while pool.size:
        yield pool.window()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def _pack(encoder: Callable[[], WordIds], capacity: int, end: int, pool_size: int, tolerance: int):
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        words = encoder()
        for part in common.slices(batches, "text", SLICE_BYTES, _WORKER):
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), words.encode(*common.utf8(part.column("text")))):
                yield doc_id, np.append(ids, np.uint32(end))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        rows, held = [], 0
        for window in _windows(documents(batches), capacity, pool_size, tolerance):
            offset = 0
            for doc_id, start, total, ids in window:
                rows.append((doc_id, start, len(ids), ids.astype("<u4").tobytes(), total, sequence, offset))
                offset += len(ids)
            sequence += 1
            held += offset
            if held >= 1 << 20:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    return run


def pack(
    docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END, pool_size: int = POOL, tolerance: int = TOLERANCE
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit words. A document is its
    text's ids and ``end``; a null or empty text is ``end`` alone. Rows that repeat a doc_id or a
    text are documents of their own. ``vocabulary`` is a tokenizer file that every executor has
    (default: ``word_bpe_49k.json`` of the installed vocabularies); strings of special tokens in
    a text are encoded as that file says.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")

    def encoder() -> WordIds:
        return worker_ids(vocabulary or public_tokenizers.path(VOCABULARY))

    return docs.select("doc_id", "text").mapInArrow(_pack(encoder, capacity, end, pool_size, tolerance), SCHEMA)
