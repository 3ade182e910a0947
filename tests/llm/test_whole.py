"""Whole results where an operator once did less: batch borders, several tiles, many features."""

import random

import numpy as np
import pytest

from odorframe.llm import near, perplexity, suffixes, toxicity


def prose(r, n):
    return " ".join("".join(r.choice("abdeilmnorst") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture
def small_batches(spark):
    """Arrow batches end by bytes, counting every column of a scan."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, "20000")
    yield
    spark.conf.unset(name)


def stored(spark, tmp_path, rows, schema):
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def test_repeats_found_whatever_the_batches(spark, tmp_path, small_batches):
    r = random.Random(11)
    passages = [prose(r, 60)[:260] for _ in range(150)]
    # Every passage stands in two texts, far apart.
    texts = [prose(r, 10) + p + prose(r, 10) for p in passages + passages[::-1]]
    docs = stored(spark, tmp_path, list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["n_removed"] for x in suffixes.remove_repeats(docs, slice_bytes=1 << 20).collect()}
    assert all(got[i] >= 260 for i in range(len(texts)))


def test_scores_whatever_the_batches(spark, tmp_path, small_batches):
    r = random.Random(12)
    texts = [prose(r, 40) for _ in range(400)]
    docs = stored(spark, tmp_path, list(enumerate(texts)), "row long, text string")
    trusted = docs.filter("row < 50")
    got = {x["row"]: x["perplexity"] for x in perplexity.score(docs, trusted).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    want = {x["row"]: x["perplexity"] for x in perplexity.score(docs, trusted).collect()}
    assert got.keys() == want.keys() == set(range(400))
    assert np.allclose([got[i] for i in want], list(want.values()))


def test_bucket_of_unlinked_rows_over_several_tiles(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(near, "TILE", 2)
    r = random.Random(13)
    base = prose(r, 120)
    rows = [(i, base + " " + prose(r, 40)) for i in range(16)]
    docs = stored(spark, tmp_path, rows, "doc_id long, text string")
    got = near.classes(docs).collect()
    assert sorted(x["class_id"] for x in got) == list(range(16))


def test_every_feature_with_evidence_counts(spark, tmp_path):
    r = random.Random(14)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 400)]
    said = ["".join(r.choice(letters) for _ in range(6000)) for _ in range(2)]
    docs = stored(spark, tmp_path, [(i, said[i % 2][: 6000 - 1000 * min(i // 2 % 5, 3)]) for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    coefficient, _ = toxicity.train(docs, labels)
    # The first 3,000 characters of a class have some 6,000 n-grams, in all its texts; the next 1,000
    # have 2,000 in about three of five texts, the next 1,000 in two of five, the last in one of five.
    assert np.count_nonzero(coefficient) > 15_000


def test_fit_by_lots_is_the_same(monkeypatch):
    r = np.random.default_rng(15)
    rows = [np.sort(r.choice(500, n, replace=False)).astype("<i4") for n in r.integers(0, 60, 80)]
    toxic, ratio, weight = r.integers(0, 2, 80).astype(float), r.normal(size=500), np.ones(80)
    whole = toxicity.fit(rows, toxic, ratio, weight)
    monkeypatch.setattr(toxicity, "AT_ONCE", 50)
    lots = toxicity.fit(rows, toxic, ratio, weight)
    assert np.allclose(whole[0], lots[0]) and np.isclose(whole[1], lots[1])


def test_default_model_sees_four_characters_back(spark, tmp_path):
    # What ends a text is told by its first character alone, four places before.
    texts = ["1xyz1", "2xyz2"] * 40 + ["1xyz2"]
    docs = stored(spark, tmp_path, list(enumerate(texts)), "row long, text string")
    got = {x["row"]: x["perplexity"] for x in perplexity.score(docs, docs.filter("row < 80")).collect()}
    assert got[80] > 1.3 * got[0]
