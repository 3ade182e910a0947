"""Quality classifier: interpolated modified Kneser-Ney character model of trusted text.

The model has one entry per n-gram of the whole trusted text; nothing of it passes through the
driver but 4 counts of counts per order and the single characters. An n-gram is two numbers: its
last two characters, and those before. n-grams are dealt to shards by the two characters before the
last one, so a shard holds, for orders 3 and up, an n-gram's own entry, its context's and those of all
its tails. The second order is dealt along, by context.

Documents are scored by blocks. A block sends its distinct n-grams to the shards in sorted, packed
pieces; a shard answers a piece by its log probabilities in the same order. Shuffled rows are pieces,
one per block and shard, not n-grams.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odorframe.llm import common

ORDER = 5
# Text bytes of one block: bounds a task's memory and the size of a co-group.
BLOCK_BYTES = 4 << 20
# Text bytes per shard of the model.
SHARD_BYTES = 32 << 20
# A context's last character is dealt to so many shards, by the character before it.
SPREAD = 16
# Characters whose n-grams are hashed at once.
AT_ONCE = 1 << 19
# Share of trusted texts (in 1/16) kept from the model to set the thresholds.
HELD_OUT = 4
# A document is rejected above this quantile of its language's held-out perplexities, times MARGIN.
QUANTILE = 0.99
MARGIN = 1.25
# Languages with fewer held-out texts use the thresholds over all languages.
LEAST_TEXTS = 30
# A text is judged as if so many more characters had its language's median perplexity.
PRIOR_CHARS = 20
PAD = "\x02"
# Bits of a character.
BITS = 21
CHAR = np.uint64((1 << BITS) - 1)
U = np.uint64


def _few_grams(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code of the n-gram ending at each character; hash, head and last two characters of the distinct ones)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    pad = PAD * (order - 1)
    joined = pad + pad.join(texts) + pad
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points) - order + 1
    h = np.zeros(n, np.uint64)
    for j in range(order):
        h *= common.BASE
        h += points[j : j + n]
    ends = np.cumsum(lengths)
    own = np.ones(n, bool)
    for j in range(order - 1):
        # windows that end inside the padding behind a text
        own[ends + np.arange(len(texts)) * (order - 1) + j] = False
    where = np.flatnonzero(own)
    codes, found = pd.factorize(common.mix(h[where]))
    first = np.zeros(len(found), np.int64)
    first[codes[::-1]] = where[::-1]
    head, last = np.zeros(len(found), np.uint64), np.zeros(len(found), np.uint64)
    for j in range(order):
        into = head if j < order - 2 else last
        into <<= U(BITS)
        into |= points[first + j]
    return codes.astype(np.int32), found, head, last


class Grams:
    """The distinct n-grams of some texts, by shard, then head, then last two characters."""

    def __init__(self, texts: list[str], order: int, shards: int):
        self.offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=self.offsets[1:])
        parts, start = [], 0
        while start < len(texts):
            # Some texts at a time, which bounds what is held besides the result.
            stop = int(np.searchsorted(self.offsets, self.offsets[start] + AT_ONCE, side="right")) - 1
            stop = min(max(stop, start + 1), len(texts))
            parts.append(_few_grams(texts[start:stop], order))
            start = stop
        if not parts:
            parts = [(np.zeros(0, np.int32), *[np.zeros(0, np.uint64)] * 3)]
        same, found = pd.factorize(np.concatenate([p[1] for p in parts]))
        first = np.zeros(len(found), np.int64)
        first[same[::-1]] = np.arange(len(same))[::-1]
        head, last = (np.concatenate([p[i] for p in parts])[first] for i in (2, 3))
        shard = shard_of(head, last, shards)
        order_ = np.lexsort((last, head, shard))
        place = np.empty(len(order_), np.int32)
        place[order_] = np.arange(len(order_))
        bounds = np.cumsum([0] + [len(p[1]) for p in parts])
        # The number, in that order, of the n-gram that ends at each character.
        self.codes = np.concatenate([place[same[b : b + len(p[1])]][p[0]] for p, b in zip(parts, bounds)])
        self.head, self.last, self.shard = head[order_], last[order_], shard[order_]

    def by_shard(self) -> Iterator[tuple[int, slice]]:
        cuts = np.flatnonzero(np.diff(self.shard)) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(self.shard)]):
            if stop > start:
                yield int(self.shard[start]), slice(start, stop)


def shard_of(head: np.ndarray, last: np.ndarray, shards: int) -> np.ndarray:
    part = common.mix((head & CHAR) + U(1)) % U(SPREAD)
    return _dealt(last >> U(BITS), part, shards)


def _dealt(context: np.ndarray, part: np.ndarray, shards: int) -> np.ndarray:
    return (common.mix(context * U(SPREAD) + part + U(1)) % U(shards)).astype(np.int64)


def packed(values: np.ndarray) -> bytes:
    """Numbers of 8 bytes, byte by byte, compressed."""
    return zlib.compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(body: bytes, kind=np.uint64) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(kind)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


_PIECE = "shard long, head binary, last binary, n binary"


def _count_grams(order: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text", BLOCK_BYTES):
            g = Grams(_texts(part), order, shards)
            n = np.bincount(g.codes, minlength=len(g.head))
            rows = [(k, packed(g.head[at]), packed(g.last[at]), packed(n[at].astype(np.int64))) for k, at in g.by_shard()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), *[pa.binary()] * 3))], ["shard", "head", "last", "n"])
            del g, n, rows
            common.release()

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Blocks of a task by number. Scans of the same columns of the same files cut and number them alike."""
    task = TaskContext.get().partitionId()
    for k, part in enumerate(common.slices(batches, "text", BLOCK_BYTES)):
        yield (task << 32) + k, part
        common.release()


_ASKED = "block long, shard long, head binary, last binary"


def _ask(order: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part in _numbered(batches):
            g = Grams(_texts(part), order, shards)
            rows = [(block, k, packed(g.head[at]), packed(g.last[at])) for k, at in g.by_shard()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["block", "shard", "head", "last"])
            del g, rows

    return run


_BLOCK = "block long, ids array<long>, lengths array<int>, body binary"


def _block_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, part in _numbered(batches):
        data, offsets = common.utf8(part.column("text"))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([block], pa.int64()),
                pa.array([part.column("row").to_pylist()], pa.list_(pa.int64())),
                pa.array([np.diff(offsets).astype(np.int32).tolist()], pa.list_(pa.int32())),
                pa.array([zlib.compress(data.tobytes(), 1)], pa.binary()),
            ],
            ["block", "ids", "lengths", "body"],
        )


def _score_block(order: int, shards: int):
    def run(key: tuple, texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ids, lengths, body in zip(texts["ids"], texts["lengths"], texts["body"]):
            raw, ends = zlib.decompress(body), np.cumsum(lengths)
            g = Grams([raw[e - n : e].decode("utf-8", "replace") for e, n in zip(ends.tolist(), lengths)], order, shards)
            logs = b"".join(answers.sort_values("shard")["logs"])
            if len(logs) != 4 * len(g.head):
                raise RuntimeError("a block changed between two scans; give a table that reads alike each time")
            sums = np.zeros(len(g.codes) + 1)
            np.cumsum(np.frombuffer(logs, np.float32).astype(np.float64)[g.codes], out=sums[1:])
            out.append(pd.DataFrame({"row": ids, "n_scored": np.diff(g.offsets), "log_p": sums[g.offsets[1:]] - sums[g.offsets[:-1]]}))
        return pd.concat(out) if out else pd.DataFrame({"row": [], "n_scored": [], "log_p": []})

    return run


def _tail(head: np.ndarray, k: int) -> np.ndarray:
    """The head of the last k characters."""
    return head & U((1 << (BITS * (k - 2))) - 1)


def _summed(head: np.ndarray, last: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((last, head))
    head, last = head[order], last[order]
    first = np.ones(len(head), bool)
    first[1:] = (head[1:] != head[:-1]) | (last[1:] != last[:-1])
    start = np.flatnonzero(first)
    return head[start], last[start], np.add.reduceat(n[order], start) if len(start) else n[:0]


_LEVEL = "shard long, k int, head binary, last binary, n binary, n1 long, n2 long, n3 long, n4 long"


def _levels(order: int):
    """The counts of a shard: plain ones of the highest order, of each lower one the distinct left neighbours."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        head, last, n = _summed(*(np.concatenate([unpacked(b, t) for b in group[c]]) for c, t in (("head", np.uint64), ("last", np.uint64), ("n", np.int64))))
        out = []
        for k in range(order, 1, -1):
            if k < order:
                head, last, n = _summed(_tail(head, k), last, np.ones(len(head), np.int64))
            of = [int((n == i).sum()) for i in (1, 2, 3, 4)]
            out.append((int(group["shard"].iloc[0]), k, packed(head), packed(last), packed(n), *of))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _LEVEL.split(", ")])

    return run


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for last, n in zip(batch["last"], batch["n"]):
            yield pd.DataFrame({"last": unpacked(last).astype(np.int64), "n": unpacked(n, np.int64)})


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """What counts of 1, 2 and more give away, by Chen and Goodman, from the counts of counts."""
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    d = [i - (i + 1) * y * b / a if a else i * 0.5 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [min(max(x, 0.1), i - 0.1) for i, x in enumerate(d, 1)]


def _cut(d: list[float]):
    return F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])


def _of_counts(level: DataFrame) -> list[int]:
    found = level.agg(*[F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    return [x or 0 for x in found]


class Table:
    """Values by number pairs, looked up by 64-bit hash."""

    def __init__(self, head: np.ndarray, last: np.ndarray, values: np.ndarray):
        h = self.hash(head, last)
        order = np.argsort(h)
        self.h, self.values = h[order], values[order]

    @staticmethod
    def hash(head: np.ndarray, last: np.ndarray) -> np.ndarray:
        return common.mix(common.mix(head + U(1)) + last * common.BASE)

    def get(self, head: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value or 0, whether there is one)."""
        if not len(self.h):
            return np.zeros(len(head)), np.zeros(len(head), bool)
        h = self.hash(head, last)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        found = self.h[at] == h
        return np.where(found, self.values[at], 0.0), found


def _answer(order: int, cuts: dict[int, list[float]], chars: tuple[np.ndarray, np.ndarray], share: float):
    """Log probabilities of the pieces asked of a shard, in the pieces' order."""

    def run(key: tuple, asked: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        levels = []
        for k in range(3, order + 1):
            own = model[model["k"] == k]
            head, last, n = (np.concatenate([unpacked(b, t) for b in own[c]] or [np.zeros(0, t)]) for c, t in (("head", np.uint64), ("last", np.uint64), ("n", np.int64)))
            cut = np.array([0.0, *cuts[k]])[np.minimum(n, 3)] if k in cuts else np.zeros(len(n))
            codes, _ = pd.factorize(Table.hash(head, last >> U(BITS)))
            total, freed = (np.bincount(codes, weights=w, minlength=1) for w in (n, cut))
            _, first = np.unique(codes, return_index=True)
            levels.append((k, Table(head, last, (n - cut) / total[codes]), Table(head[first], last[first] >> U(BITS), (freed / np.maximum(total, 1))[codes[first]])))
        # Order 2, dealt by context: the pairs there are, and what a context leaves for others.
        two = model[model["k"] == 2].drop_duplicates("context")
        context = two["context"].to_numpy(np.int64).astype(np.uint64)
        size = [len(w) for w in two["chars"]]
        flat = np.concatenate([np.asarray(w, np.int64) for w in two["chars"]] or [np.zeros(0, np.int64)]).astype(np.uint64)
        shares = np.concatenate([np.asarray(p, np.float64) for p in two["shares"]] or [np.zeros(0)])
        none = np.zeros(len(flat), np.uint64)
        pairs = Table(none, (np.repeat(context, size) << U(BITS)) | flat, shares)
        left = Table(none[:0].repeat(0) if not len(context) else np.zeros(len(context), np.uint64), context, two["gamma"].to_numpy(np.float64))
        out = []
        for block, head_, last_ in zip(asked["block"], asked["head"], asked["last"]):
            head, last = unpacked(head_), unpacked(last_)
            zero = np.zeros(len(head), np.uint64)
            at = np.minimum(np.searchsorted(chars[0], last & CHAR), max(0, len(chars[0]) - 1))
            one = np.where(chars[0][at] == (last & CHAR), chars[1][at], share) if len(chars[0]) else np.full(len(head), share)
            p2, known = pairs.get(zero, last)
            gamma, seen = left.get(zero, last >> U(BITS))
            p = np.where(known, p2, np.where(seen, gamma, 1.0) * one)
            for k, alpha, gammas in levels:
                tail = _tail(head, k)
                gamma, seen = gammas.get(tail, last >> U(BITS))
                p = alpha.get(tail, last)[0] + np.where(seen, gamma, 1.0) * p
            out.append((block, key[0], np.log(p).astype(np.float32).tobytes()))
        return pd.DataFrame(out, columns=["block", "shard", "logs"])

    return run


def model_of(trusted: DataFrame, order: int, shards: int) -> tuple[DataFrame, dict[int, list[float]], tuple[np.ndarray, np.ndarray], float]:
    """(entries by shard, discounts by order, single characters and their probabilities, that of an unseen one)."""
    spark = trusted.sparkSession
    pieces = trusted.select("text").mapInArrow(_count_grams(order, shards), _PIECE)
    levels = common.written(pieces.groupBy("shard").applyInPandas(_levels(order), _LEVEL), "kn-levels")
    of = levels.filter("k > 2").groupBy("k").agg(*[F.sum(f"n{i}") for i in (1, 2, 3, 4)]).collect()
    cuts = {r[0]: discounts(*r[1:]) for r in of}
    pairs = levels.filter("k = 2").select("last", "n").mapInPandas(_pairs, "last long, n long").groupBy("last").agg(F.sum("n").alias("n"))
    pairs = common.written(pairs.select("n", F.shiftright("last", BITS).alias("context"), F.col("last").bitwiseAND(F.lit(int(CHAR))).alias("char")), "kn-pairs")
    singles = common.written(pairs.groupBy("char").agg(F.count("*").alias("n")), "kn-chars")
    d1, d2 = discounts(*_of_counts(singles)), discounts(*_of_counts(pairs))
    # As many rows as there are characters: 1.1 million at most.
    found = singles.select("char", "n", _cut(d1).alias("cut")).toPandas().sort_values("char")
    total = max(1, int(found["n"].sum()))
    share = float(found["cut"].sum()) / total / (len(found) + 1) if len(found) else 1.0
    chars = found["char"].to_numpy(np.int64).astype(np.uint64), ((found["n"] - found["cut"]) / total + share).to_numpy(np.float64)
    one = F.broadcast(spark.createDataFrame(pd.DataFrame({"char": chars[0].astype(np.int64), "one": chars[1]}), "char long, one double"))
    two = pairs.withColumn("cut", _cut(d2)).join(one, "char")
    two = two.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("freed"), F.array_sort(F.collect_list(F.struct("char", "n", "cut", "one"))).alias("row"))
    gamma = F.col("freed") / F.col("total")
    shares = F.transform("row", lambda r: (r["n"] - r["cut"]) / F.col("total") + F.col("freed") / F.col("total") * r["one"])
    two = two.select(F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"), "context", gamma.alias("gamma"), F.transform("row", lambda r: r["char"]).alias("chars"), shares.alias("shares"))
    two = two.mapInPandas(_deal(shards), "shard long, k int, context long, gamma double, chars array<long>, shares array<double>").dropDuplicates(["shard", "context"])
    entries = levels.filter("k > 2").select("shard", "k", "head", "last", "n").unionByName(two, allowMissingColumns=True)
    return entries, cuts, chars, share


def _deal(shards: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shard = _dealt(batch["context"].to_numpy(np.int64).astype(np.uint64), batch["part"].to_numpy(np.int64).astype(np.uint64), shards)
            yield batch.assign(shard=shard, k=2)[["shard", "k", "context", "gamma", "chars", "shares"]]

    return run


def score(docs: DataFrame, trusted: DataFrame, order: int = ORDER, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """row, n_scored, perplexity (per character; null for an empty text) under the model of ``trusted``.

    ``docs`` (row, text) must read alike each time it is read, as a table of files does. Orders 3 to 5.
    """
    if not 3 <= order <= 5:
        raise ValueError("an n-gram of order 3 to 5 fits two numbers")
    source = docs.select("row", "text")
    shards = common.blocks_for(source, shard_bytes)
    entries, cuts, chars, share = model_of(trusted, order, shards)
    asked = source.mapInArrow(_ask(order, shards), _ASKED)
    answers = asked.groupBy("shard").cogroup(entries.groupBy("shard")).applyInPandas(_answer(order, cuts, chars, share), "block long, shard long, logs binary")
    texts = source.mapInArrow(_block_texts, _BLOCK)
    sums = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_score_block(order, shards), "row long, n_scored long, log_p double")
    return sums.select("row", "n_scored", F.when(F.col("n_scored") > 0, F.exp(-F.col("log_p") / F.col("n_scored"))).alias("perplexity"))


def held_out(column: str = "doc_id"):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(16)) < HELD_OUT


def classify(
    docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, margin: float = MARGIN, row: str | None = None
) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, n_scored, perplexity, adjusted, threshold, kept.

    Trusted text is every document labelled quality 1; 4 in 16 of them stay out of the model
    and set, per language, the highest perplexity accepted. What is compared is the adjusted
    perplexity, drawn to the language's median by PRIOR_CHARS characters, as a few characters
    say little. Languages (null is one) with under LEAST_TEXTS of those use the threshold over
    all languages. Empty and null texts have no perplexity and are not kept. With no trusted text
    at all nothing can be judged: every text is kept. ``docs`` must read alike each time it is
    read (a table of files does); ``row`` names a column that numbers its rows, if it has one.
    """
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    numbered = docs.select(number.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("lang", F.lit("")).alias("lang"))
    good = common.written(labels.filter("quality = 1").select("doc_id").distinct(), "kn-trusted")
    # Without a count Spark would shuffle every text to find the trusted ones.
    trusted = common.only(numbered.select("doc_id", "text"), good, "doc_id")
    scored = score(numbered.select("row", "text"), trusted.filter(~held_out()), order)
    rows = common.written(scored.join(numbered.drop("text"), "row"), "kn-rows")
    marked = common.only(rows, good, "doc_id").filter(held_out()).filter("n_scored > 0")
    marked = common.written(marked.withColumn("loss", F.log("perplexity")), "kn-held-out")

    def cut(of: DataFrame, column: str, share: float, name: str) -> tuple[DataFrame, float | None]:
        at = F.percentile_approx(column, share, 10_000)
        own = of.groupBy("lang").agg(F.count("*").alias("n"), at.alias(name)).filter(F.col("n") >= LEAST_TEXTS)
        return common.beside(own.select("lang", name), "kn-by-lang"), of.agg(at).first()[0]

    def shrunk(df: DataFrame) -> DataFrame:
        typical = F.coalesce("median", F.lit(middle_all).cast("double"))
        loss = (F.col("loss") * F.col("n_scored") + typical * PRIOR_CHARS) / (F.col("n_scored") + PRIOR_CHARS)
        return df.join(medians, "lang", "left").withColumn("adjusted", F.exp(F.coalesce(loss, "loss")))

    medians, middle_all = cut(marked, "loss", 0.5, "median")
    tops, top_all = cut(shrunk(marked), "adjusted", quantile, "top")
    judged = shrunk(rows.withColumn("loss", F.log("perplexity"))).join(tops, "lang", "left")
    judged = judged.withColumn("threshold", F.coalesce("top", F.lit(top_all).cast("double")) * margin)
    kept = (F.col("n_scored") > 0) & (F.col("threshold").isNull() | (F.col("adjusted") <= F.col("threshold")))
    return judged.select("row", "doc_id", "n_scored", "perplexity", "adjusted", "threshold", kept.alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those rejected, with all their columns."""
    row = common.fresh_name(docs, "row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    kept = common.written(classify(numbered, labels, row=row).filter("kept").select(F.col("row").alias(row)), "kn-kept")
    return common.only(numbered, kept, row).drop(row)
