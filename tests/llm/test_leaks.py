"""Decontamination against a plain search for every window."""

import random
import re

import numpy as np
import pytest

from odorframe.llm import leaks

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (items_ := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= items_
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def made(seed, letters="abcdef"):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, 2)))
    items = [(i % 25 if i % 7 else None, " ".join(word() for _ in range(r.choice([0, 1, 3, 9, 10, 11, 30])))) for i in range(40)]
    docs = []
    for i in range(80):
        text = [word() for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            src = r.choice(items)[1].split()
            low = r.randint(0, max(0, len(src) - 1))
            at = r.randint(0, len(text))
            text[at:at] = src[low : low + r.randint(8, 14)]
        joined = r.choice([" ", ", ", "\n", "  "]).join(text)
        docs.append((i if i % 11 else None, joined.upper() if r.random() < 0.3 else joined))
    return docs, items


def found(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in df.collect()), key=str)


@pytest.mark.parametrize(("seed", "letters", "sent", "size"), [(1, "abcdef", 10**6, 32 << 20), (2, "ab", 10**6, 0), (3, "abcdefgh", 0, 0)])
def test_equals_plain_search(spark, tmp_path, seed, letters, sent, size):
    docs, items = made(seed, letters)
    path = str(tmp_path / "docs")
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(path)
    got = found(leaks.find_leaks(spark.read.parquet(path), spark.createDataFrame(items, ITEMS), most_sent=sent, most_bytes=size))
    assert got == brute(docs, items)
    assert any(h for _, _, h, _ in got)


def test_awkward_tables(spark, tmp_path):
    ten = "one two three four five six seven eight nine ten"
    docs = [(1, None), (2, ""), (3, "  ,.!"), (4, ten), (5, ten.replace(" ", "-").upper()), (6, ten[:-4]), (None, ten), (2**60 + 1, "x " + ten + " y"), (4, ten), (7, "é日本 語1"), (8, "a " * 30_000), (9, "KK Ünï")]
    items = [(1, ten), (1, ten), (2, None), (3, "..."), (10, "日本 語1 ok"), (11, "é日本 語1"), (12, "a " * 25), (None, "ünï"), (13, "kK Ünï")]
    path = str(tmp_path / "docs")
    spark.createDataFrame([(*d, "c", "c", "c") for d in docs], DOCS + ", row string, h string, item_id string").write.parquet(path)
    table = spark.createDataFrame([(*i, "c") for i in items], ITEMS + ", item string")
    assert found(leaks.find_leaks(spark.read.parquet(path), table)) == brute(docs, items)
    none = spark.createDataFrame([], ITEMS)
    assert found(leaks.find_leaks(spark.read.parquet(path), none)) == brute(docs, [])
    assert leaks.find_leaks(spark.createDataFrame([], DOCS), table).collect() == []


def test_windows_share_the_smallest_hash():
    """The guarantee of winnowing: a window keeps the same hash whatever stands around it."""
    import pyarrow as pa

    r = random.Random(1)
    passage = " ".join(str(r.randint(0, 99)) for _ in range(10))
    kept = []
    for _ in range(50):
        around = [" ".join(str(r.randint(0, 99)) for _ in range(r.randint(0, 30))) for _ in range(2)]
        h, at, _ = leaks.Words(pa.array([f"{around[0]} {passage} {around[1]}"])).anchors(10, 5)
        low = len(around[0].split())
        kept.append({int(x) for x, a in zip(h, at) if low <= a <= low + 5})
    assert set.intersection(*kept)
    with pytest.raises(ValueError):
        leaks.find_leaks(None, None, window=4, gram=5)
    assert np.all(leaks.LOWER[65:91] == np.arange(97, 123))
