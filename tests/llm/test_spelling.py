"""Spelling variants against all pairs of words, edited letter by letter."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from odorframe.llm import spelling

COLUMNS = "doc_id long, text string"


def edits(a, b):
    """Whether exactly one letter is inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, every=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: sorted((x for x in words if edits(w, x)), key=lambda x: (-words[x], x)) for w in words}
    form = {w: x[0] if x and words[x[0]] >= 5 * words[w] else None for w, x in near.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, n, len(near[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items()}


def texts(seed, n_docs=60):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdeéñz") for _ in range(r.randint(5, 9))) for _ in range(25)]

    def typo(w):
        at = r.randrange(len(w) + 1)
        return r.choice([w[:at] + r.choice("abcz") + w[at:], w[:at] + w[at + 1 :], w[:at] + r.choice("abcz") + w[at + 1 :]])

    words = base + [typo(w) for w in base for _ in range(4)]
    words += [typo(w) for w in words[25:60]]
    weights = [40] * 25 + [6] * (len(words) - 25)
    return [(i if i % 9 else None, " ".join(w.upper() if r.random() < 0.2 else w for w in r.choices(words, weights, k=r.randint(0, 80)))) for i in range(n_docs)]


def found(df):
    return {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


@pytest.mark.parametrize(("seed", "tile", "every"), [(1, 8192, 199), (2, 3, 7), (3, 40, 3)])
def test_variants_equal_all_pairs(spark, seed, tile, every):
    rows = texts(seed)
    docs = spark.createDataFrame(rows, COLUMNS).repartition(4)
    want = brute(rows, every)
    assert found(spelling.variants(docs, drop_every=every, tile=tile)) == want
    assert any(f is not None for _, _, _, f, _, _ in want) and any(k > 1 for _, _, k, _, _, _ in want)


def test_chains_of_forms_end_at_the_root(spark):
    rows = [(i, t) for i, t in enumerate(["aaaaaab " * 5, "aaaaabb " * 25, "aaaabbb " * 125, "aaabbbb " * 625, "aabbbbb " * 3125, "ababab " * 5])]
    got = {r["word"]: r["root"] for r in spelling.variants(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert set(got.values()) == {"aabbbbb", "ababab"}


def test_awkward_words(spark):
    long_ = "z" * 3000
    rows = [(1, None), (2, ""), (3, "×÷×÷×÷ " * 5 + "straße STRASSE " * 6), (4, (long_ + " ") * 5), (5, (long_[:-1] + "y ") * 5 + (long_ + "z ") * 25), (5, "ÀÀÀÀÀÀ àààààà " * 5)]
    docs = spark.createDataFrame([(*r, "c", "c") for r in rows], COLUMNS + ", word string, n string")
    assert found(spelling.variants(docs)) == brute(rows, 10**12)
    assert spelling.variants(spark.createDataFrame([], COLUMNS)).collect() == []


def test_one_edit_letter_by_letter():
    r = random.Random(3)
    a, b = [], []
    for _ in range(4000):
        n = r.choice([1, 2, 5, 8, 63, 64, 65, 66])
        x = "".join(r.choice("ab") for _ in range(n))
        at = r.randrange(n)
        y = r.choice([x[:at] + r.choice("ab") + x[at:], x[:at] + r.choice("ab") + x[at + 1 :], "".join(r.choice("ab") for _ in range(n + r.randint(0, 1)))])
        a.append(x)
        b.append(y)
    got = spelling.one_edit(np.array(a, object), np.array(b, object))
    assert got.tolist() == [edits(x, y) for x, y in zip(a, b)]


def test_every_pair_comes_once(spark):
    rows = texts(4)
    words = spelling.count_words(spark.createDataFrame(rows, COLUMNS), 0).filter("n >= 5").cache()
    got = [(r["word"], r["other"]) for r in spelling.near_words(words, tile=5).collect()]
    assert len(got) == len(set(got)) and {(b, a) for a, b in got} == set(got)
