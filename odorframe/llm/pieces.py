"""SentencePiece encoding and decoding over a lattice.

A task takes some texts at a time and their distinct words. The substrings of all these words are
looked up at once, character by character, in the pieces laid out as a trie; each piece found is an
edge of a word's lattice. Edges are folded by the place they start at, again for all words at once,
into the best path to every place, and the texts look their words' ids up. Nothing is shuffled,
and what a task holds is bounded by the bytes of the texts it takes at a time.

The path is the one of the highest sum of piece scores (ties: the one whose last piece is
longest). A file whose pieces were made by merging (BPE) has ranks for scores, so the path needn't
be the one that replaying the merges gives; decoding gives the text back either way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odorframe.llm import common

MODEL = "piece_bpe_32k.model"
SPACE = "\u2581"
# A word: a space mark and what follows up to the next one. Longer runs without a space are cut
# here, which bounds a lattice; the path is the best within each part.
LONGEST_WORD = 512
WORD = f"{SPACE}?[^{SPACE}]{{1,{LONGEST_WORD}}}|{SPACE}"
# What a byte of a character without a piece costs below the lowest score of a piece.
BYTE_PENALTY = 10.0
# Text bytes whose words are encoded at once.
BLOCK_BYTES = 2 << 20


@dataclass
class Model:
    """The pieces of a model file: texts and scores by id, ids of the 256 bytes."""

    pieces: list[str]
    scores: list[float]
    plain: list[bool]
    bytes_: list[int]

    @classmethod
    def load(cls, path: str | None = None) -> Model:
        sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        of_byte = {sp.id_to_piece(i): i for i in range(n) if sp.is_byte(i)}
        if len(of_byte) != 256:
            raise ValueError("the model needs a piece for each byte")
        return cls([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], [not s for s in special], [of_byte[f"<0x{b:02X}>"] for b in range(256)])

    @property
    def lowest(self) -> float:
        return min(s for s, ok in zip(self.scores, self.plain) if ok and s > -1e6)


class Lattice:
    """The pieces as a trie in arrays: a node and a code point lead to the next node, which may end a piece."""

    def __init__(self, model: Model):
        next_: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for i, (piece, ok) in enumerate(zip(model.pieces, model.plain)):
            if ok:
                node = 0
                for c in map(ord, piece):
                    node = next_.setdefault((node, c), len(next_) + 1)
                ends[node] = i
        keys = np.array([node << 21 | c for node, c in next_], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.array(list(next_.values()), np.int64)[order]
        self.ends = np.full(len(next_) + 1, -1, np.int32)
        self.ends[list(ends)] = list(ends.values())
        self.scores = np.array(model.scores, np.float64)
        self.worst = model.lowest - BYTE_PENALTY
        self.bytes_ = np.array(model.bytes_, np.uint32)

    def edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, id) of all pieces in words of ``codes``, ``left`` of them up to a word's end.

        A character without a piece is one edge of all its bytes, with -1 for the id.
        """
        at, node, n, out = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0, []
        while len(at):
            key = node << 21 | codes[at + n]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[k] == key
            n += 1
            node = self.child[k]
            ids = np.where(known, self.ends[node], np.int32(-1))
            found = ids >= 0 if n > 1 else slice(None)
            out.append((at[found], ids[found], n))
            on = known & (left[at] > n)
            at, node = at[on], node[on]
        length = np.repeat([n for _, _, n in out], [len(a) for a, _, _ in out])
        return np.concatenate([a for a, _, _ in out]), length, np.concatenate([i for _, i, _ in out])

    def best_paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the best path of each word in a row, how many each has)."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        inner = np.arange(len(codes)) - first[word]
        at, length, ids = self.edges(codes, size[word] - inner)
        wide = np.array([1, 2, 3, 4])[np.searchsorted([0x80, 0x800, 0x10000], codes, side="right")]
        own = np.where(ids >= 0, self.scores[ids], self.worst * wide[at])
        # A word has one place more than characters. Edges come by start: an earlier start is only
        # beaten by a better path, and those of one start end at different places.
        order = np.argsort(inner[at].astype(np.uint16), kind="stable")
        cuts = np.cumsum(np.bincount(inner[at], minlength=1))
        start, length, ids, own = (at + word[at])[order], length[order], ids[order], own[order]
        best = np.full(len(codes) + len(words), -np.inf)
        by = np.zeros(len(best), np.int64)
        origin = first + np.arange(len(words))
        best[origin] = 0.0
        for lo, hi in zip([0, *cuts[:-1].tolist()], cuts.tolist()):
            total, end = best[start[lo:hi]] + own[lo:hi], start[lo:hi] + length[lo:hi]
            better = total > best[end]
            best[end[better]] = total[better]
            by[end[better]] = lo + np.flatnonzero(better)
        # All words go back from their ends at once, an edge at a time.
        steps, who, place = [], np.arange(len(words)), origin + size
        while len(who):
            edge = by[place]
            steps.append((who, edge))
            place = start[edge]
            on = place > origin[who]
            who, place = who[on], place[on]
        n = np.bincount(np.concatenate([w for w, _ in steps]), minlength=len(words)) if steps else np.zeros(0, np.int64)
        last = np.cumsum(n) - 1
        path = np.zeros(int(n.sum()), np.int64)
        for k, (who, edge) in enumerate(steps):
            path[last[who] - k] = edge
        # Characters without a piece become their bytes.
        strange = ids[path] < 0
        char = start[path] - np.repeat(np.arange(len(words)), n)
        times = np.where(strange, wide[char], 1)
        flat = np.repeat(ids[path], times).astype(np.uint32)
        body = "".join(map(chr, codes[char[strange]].tolist())).encode()
        flat[np.repeat(strange, times)] = self.bytes_[np.frombuffer(body, np.uint8)]
        return flat, np.bincount(np.repeat(np.arange(len(words)), n), weights=times, minlength=len(words)).astype(np.int64)


_ENCODED = "row long, doc_id long, n_ids long, ids binary"


def _encode(lattice: Broadcast, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = re.compile(WORD)
        for part in common.slices(batches, "text", limit):
            index: dict[str, int] = {}
            codes = []
            for text in part.column("text").to_pylist():
                marked = SPACE + text.replace(" ", SPACE) if text else ""
                codes.append(np.array([index.setdefault(w, len(index)) for w in split.findall(marked)], np.int64))
            flat, count = lattice.value.best_paths(list(index))
            first = np.cumsum(count) - count
            sizes, bodies = [], []
            for own in codes:
                n = count[own]
                ends = np.cumsum(n)
                total = int(ends[-1]) if len(ends) else 0
                sizes.append(total)
                bodies.append(flat[np.repeat(first[own] - ends + n, n) + np.arange(total)].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(bodies, pa.binary())], ["row", "doc_id", "n_ids", "ids"])

    return run


def encode(docs: DataFrame, model: Model | None = None, row: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, n_ids, ids (little-endian unsigned 32-bit words).

    As SentencePiece does without further normalising: a space mark in front, one for each
    space; a null or empty text has no ids. Characters without a piece become their bytes. Rows that
    repeat are encoded each; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Lattice(model or Model.load()))
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    source = docs.select(number.cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(_encode(shared, block_bytes), _ENCODED)


def _decode(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, first, count = model.value
        for batch in batches:
            texts = []
            for ids in batch.column("ids").to_pylist():
                ids = np.frombuffer(ids or b"", "<u4").astype(np.int64)
                n = count[ids]
                ends = np.cumsum(n)
                total = int(ends[-1]) if len(ends) else 0
                text = flat[np.repeat(first[ids] - ends + n, n) + np.arange(total)].tobytes().decode("utf-8", "replace")
                # The mark in front isn't part of the text.
                texts.append(text.replace(SPACE, " ").removeprefix(" "))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("n_ids"), batch.column("ids"), pa.array(texts, pa.string())], ["row", "doc_id", "n_ids", "ids", "text"])

    return run


def decode(encoded: DataFrame, model: Model | None = None) -> DataFrame:
    """``encoded`` (row, doc_id, n_ids, ids) with the text that the ids stand for.

    Null ids are none. Control pieces stand for nothing; a space mark of the text itself comes
    back as a space, as in SentencePiece.
    """
    model = model or Model.load()
    of_byte = {i: bytes([b]) for b, i in enumerate(model.bytes_)}
    bodies = [of_byte.get(i, p.encode() if ok else b"") for i, (p, ok) in enumerate(zip(model.pieces, model.plain))]
    count = np.array([len(b) for b in bodies])
    send = (np.frombuffer(b"".join(bodies), np.uint8), np.cumsum(count) - count, count)
    shared = encoded.sparkSession.sparkContext.broadcast(send)
    columns = encoded.select("row", "doc_id", "n_ids", "ids")
    return columns.mapInArrow(_decode(shared), _ENCODED + ", text string")
