"""Shared helpers: the shared folder, written intermediates, Arrow text buffers, 64-bit mixing.

Nulls everywhere in this subpackage: a null text is an empty text. Operators pick the columns
they need by name, so extra columns never clash with their own.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The six ASCII white-space bytes: space, tab, newline, vertical tab, form feed, return.
SPACES = r"[\x20\x09-\x0D]"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; sets one only where the session has none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), f"llm-{uuid.uuid4().hex}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and outlives executors.

    ``row_group`` bounds the bytes of a row group where rows are large.
    """
    path = new_path(df.sparkSession, name)
    (df.write if row_group is None else df.write.option("parquet.block.size", row_group)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Keys (8 bytes each) sent to every executor at most; beyond it joins shuffle.
BROADCAST_KEYS = 2_000_000


def only(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in the written table ``keys``.

    The keys are broadcast where a count allows it; beyond that Spark joins by shuffle.
    """
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, "left_semi")


def beside(df: DataFrame, name: str, most: int = BROADCAST_KEYS) -> DataFrame:
    """``df`` written, and broadcast to joins if a count of its rows allows it."""
    out = written(df, name)
    return F.broadcast(out) if out.count() <= most else out


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    name, i = f"__{stem}", 0
    while name in taken:
        i += 1
        name = f"__{stem}{i}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks_for(docs: DataFrame, target_bytes: int) -> int:
    """How many blocks of about ``target_bytes`` of text the table makes (one aggregate scan)."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-int(total) // target_bytes))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in a row, n+1 offsets) of an Arrow string column, without a copy.

    Null texts are empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


# What workers remember from task to task, by operator: a worker lives on and serves other operators next.
_REMEMBERED: list[dict] = []


def remembered() -> dict:
    """A dictionary that lasts until a task of another operator begins in the worker."""
    _REMEMBERED.append({})
    return _REMEMBERED[-1]


def forget(but: dict | None = None) -> None:
    """Drops what other operators left in this worker, all but one's own."""
    for kept in _REMEMBERED:
        if kept is not but and kept:
            kept.clear()


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int, keep: dict | None = None) -> Iterator[pa.RecordBatch]:
    """Cuts record batches into runs of rows of at most ``limit`` text bytes (one row at least).

    A task begins with it: what the worker remembers of other operators goes, ``keep`` stays.
    """
    forget(keep)
    release()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        offsets = utf8(batch.column(text))[1]
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
    release()


def numbered_slices(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(number, rows) of slices of a task: a row's number comes from the text bytes before it.

    Hence numbers are alike in every scan of the same files, whichever other columns it reads and
    wherever its batches end; a slice may come in several parts, one per batch.
    """
    task, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        offsets = utf8(batch.column(text))[1]
        number = (before + offsets[:-1]) // limit
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [batch.num_rows]]).tolist()
        for start, stop in zip(cuts, cuts[1:]):
            if stop > start:
                yield (task << 32) + int(number[start]), batch.slice(start, stop - start)
        before += int(offsets[-1])
    release()


def release() -> None:
    """Gives memory that is free again back to the system: a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte span [start, end): equal spans, equal hashes.

    Differences of one prefix polynomial modulo 2**64, shifted back to the span's own
    origin by the inverse of the (odd) base, then mixed.
    """
    n = len(data)
    terms = (data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(terms, out=prefix[1:])
    back = powers(INVERSE, n + 1)
    return mix((prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of the runs of word bytes, never across texts.

    Word bytes are those marked in ``word_byte``, by default all but white space.
    """
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    solid = ~IS_SPACE[data] if word_byte is None else word_byte[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def sums_by(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n)


# Count arrays of a fixed size, summed over all tasks: pieces of CHUNK cells travel compressed.
CHUNK = 1 << 16


def cell_chunks(cells: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(number, bytes) of the pieces of a task's counts that aren't all zero."""
    for k in range(-(-len(cells) // CHUNK)):
        part = cells[k * CHUNK : (k + 1) * CHUNK]
        if part.any():
            yield k, zlib.compress(part.astype("<u8").tobytes(), 1)


def _unpack(cells: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(cells), "<u8")


def _add_chunks(group: pd.DataFrame) -> pd.DataFrame:
    total = _unpack(group["cells"].iloc[0]).copy()
    for cells in group["cells"].iloc[1:]:
        total += _unpack(cells)
    return pd.DataFrame({"chunk": group["chunk"].iloc[:1], "cells": [zlib.compress(total.tobytes(), 1)]})


def sum_cells(parts: DataFrame, size: int) -> np.ndarray:
    """The sums of all tasks' counts; ``parts`` has chunk and cells. ``size`` is fixed by the caller."""
    salted = parts.select("chunk", "cells", F.pmod(F.xxhash64("cells"), F.lit(64)).alias("salt"))
    # Two steps, so that a group stays small however many tasks there were.
    some = salted.groupBy("chunk", "salt").applyInPandas(_add_chunks, "chunk int, cells binary")
    whole = some.groupBy("chunk").applyInPandas(_add_chunks, "chunk int, cells binary")
    out = np.zeros(size, np.uint64)
    for r in whole.collect():
        part = _unpack(r["cells"])
        out[r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(part)] = part
    return out
