"""Periodic runs against a scan of every lag and place."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from odorframe.llm import runs

COLUMNS = "doc_id long, text string"


def brute_runs(words):
    """Every maximal stretch of smallest period q, straight from the definition."""
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            smaller = any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                found.add((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, found):
    gone = {k for start, length, period in found for k in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone).encode()


def mixed(seed):
    """Text of runs, broken runs and loose words over few or many words."""
    r = random.Random(seed)
    out = []
    for _ in range(r.randint(1, 8)):
        unit = [r.choice("abcdefgh"[: r.randint(1, 8)]) for _ in range(r.randint(1, 7))]
        out += (unit * r.randint(1, 9))[: r.randint(1, 60)]
        out += [r.choice("abxyz") for _ in range(r.randint(0, 5))]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_equals_brute_force(seed):
    texts = [mixed(seed * 1000 + k) for k in range(120)]
    codes = np.array([ord(w) for t in texts for w in t])
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    got = runs.runs_of(codes, doc).tolist()
    want, at = [], 0
    for t in texts:
        want += [[start + at, length, period] for start, length, period in brute_runs(t)]
        at += len(t)
    assert got == want


def test_long_segments_and_one_word_over_and_over():
    r = random.Random(5)
    unit = [r.randint(0, 40) for _ in range(700)]
    words = unit * 5 + [50] * 5000 + [r.randint(0, 40) for _ in range(3000)] + [1, 2] * 400
    assert runs.runs_of(np.array(words), np.zeros(len(words), int)).tolist() == [list(x) for x in brute_long(words)]


def brute_long(words):
    """The definition with numpy, for texts too long for the plain version."""
    w, found = np.array(words), {}
    for q in range(1, len(w) // 4 + 1):
        same = np.concatenate([[False], w[:-q] == w[q:], [False]])
        edges = np.flatnonzero(np.diff(same.astype(int)))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e - s + q >= max(6, 4 * q):
                found.setdefault((s, e - s + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_table_of_awkward_texts(spark):
    texts = {
        1: None, 2: "", 3: " \n\t ", 4: "a a a a a", 5: "a a a a a a", 6: "a b " * 4, 7: "a b " * 3 + "a", 8: "x " + "a b c\n" * 5 + "y",
        9: "é   " * 6, 10: " ".join(mixed(77)), 11: "z " * 50_000, 12: "A a " * 4,
    }
    rows = [(i, t, "clash", "clash") for i, t in texts.items()] + [(None, "q " * 7, "", ""), (2**60 + 1, "b " * 6, "", ""), (4, "a a a a a a a", "", "")]
    docs = spark.createDataFrame(rows, COLUMNS + ", row string, runs string").repartition(3)
    got = {(r["doc_id"], r["n_words"]): r for r in runs.periodic_runs(docs).collect()}
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        words = (text or "").encode().split()
        r = got[(doc_id, len(words))]
        want = brute_runs(words) if len(words) < 1000 else [(0, len(words), 1)]
        assert [tuple(x) for x in r["runs"]] == want
        assert bytes(r["collapsed"]) == brute_collapsed([w.decode() for w in words], want)


def test_empty_table(spark):
    assert runs.digests(runs.periodic_runs(spark.createDataFrame([], COLUMNS))).collect() == []


def test_repeated_follows_its_rule(spark):
    import zlib

    rows = [(i, " ".join(f"w{k}" for k in range(i % 37))) for i in range(300)] + [(None, "a b"), (9, None)]
    made = spark.createDataFrame(rows, COLUMNS).select("doc_id", "text", runs.repeated(F.col("text"), F.col("doc_id")).alias("made")).collect()
    changed = 0
    for doc_id, text, out in made:
        words = (text or "").split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += 1
        assert out.split() == words
    assert changed > 10


def test_ties_of_the_longest_run(spark):
    found = runs.digests(runs.periodic_runs(spark.createDataFrame([(3, "a a a a a a x b b b b b b"), (5, "c d e")], COLUMNS))).orderBy("doc_id").collect()
    assert (found[0]["n_runs"], found[0]["start"], found[0]["length"], found[0]["period"], found[0]["exponent_milli"]) == (2, 0, 6, 1, 6000)
    assert found[1]["n_runs"] == 0 and found[1]["start"] is None and found[1]["exponent_milli"] is None
