"""Every dealt operator and every stage on awkward tables: one defined result per row."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from odorframe.llm import common, exact, licences, lines, near, packing, perplexity, pieces, rules, runs, suffixes, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use themselves.
CLASHING = ["row", "digest", "keep", "block", "gram", "label", "n", "kept", "component", "ids", "body", "chunk", "__row", "w", "run", "key"]


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abdeilmnorst") for _ in range(r.randint(2, 8))) for _ in range(n))


def awkward_rows():
    same = words(1, 120)
    texts = [
        None, "", "   \n\t ", "\n\n\n", "x", "...", same, same, same.upper(), same + ".", "é" * 300, "日本語" * 50, "a▁b", "😀 " * 40,
        "word " * 400, "\n".join([words(2, 12)] * 30), words(3, 30_000), "z" * 20_000, "line\r\nline\r\n", "<|endoftext|> <s> \x00 \x02 #",
        words(4, 60) + "\n" + words(5, 60), words(5, 60) + "\n" + words(4, 60),
    ]
    rows = [(i, t, ["en", "fr", None][i % 3], None if i % 4 == 0 else f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(None, same, "en", "s", 1), (None, None, None, None, None), (7, "another text of row seven", "en", "s", 25), rows[6]]
    return rows


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("awkward") / "docs")
    docs = spark.createDataFrame(awkward_rows(), COLUMNS).repartition(3)
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit("clash"))
    docs.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("nothing") / "docs")
    spark.createDataFrame([], COLUMNS).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, int(i % 5 == 0)) for i in range(22)] + [(None, 1, 1), (3, None, None), (999, 1, 0), (4, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


PER_ROW = {
    "licences": lambda d, _: licences.scan(d),
    "pieces": lambda d, _: pieces.decode(pieces.encode(d)),
    "lines": lambda d, _: lines.deduplicate(d),
    "near": lambda d, _: near.classes(d),
    "toxicity": toxicity.classify,
    "rules": rules.judge,
    "exact": lambda d, _: exact.deduplicate(d),
    "suffixes": lambda d, _: suffixes.remove_repeats(d),
    "perplexity": perplexity.classify,
    "runs": lambda d, _: runs.periodic_runs(d),
}


def test_large_ids_beside_nulls(spark, tmp_path):
    ids = [None, 2**60 + 1, 2**60 + 3, -(2**60) - 1, None, 5]
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, "some words of text here") for i in ids], "doc_id long, text string").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    for name in ("pieces", "suffixes", "runs"):
        assert sorted((r[0] for r in PER_ROW[name](docs, None).select("doc_id").collect()), key=str) == sorted(ids, key=str)


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_one_row_per_document(awkward, labels, name):
    out = PER_ROW[name](awkward, labels).select("doc_id").collect()
    assert sorted(str(r[0]) for r in out) == sorted(str(r[0]) for r in awkward_rows())


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_empty_table(nothing, labels, name):
    assert PER_ROW[name](nothing, labels).count() == 0


@pytest.mark.parametrize("name", ["toxicity", "rules", "perplexity"])
def test_without_labels(awkward, no_labels, name):
    out = PER_ROW[name](awkward, no_labels).collect()
    assert len(out) == len(awkward_rows())
    if name == "toxicity":
        assert all(r["score"] < 0.7 for r in out)
    if name == "perplexity":
        assert {r["kept"] for r in out if r["n_scored"]} == {True}


def test_packing_awkward(awkward, nothing):
    out = packing.pack(awkward).collect()
    assert {r["doc_id"] for r in out} == {r[0] for r in awkward_rows()}
    assert packing.pack(nothing).count() == 0


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, awkward, nothing, tmp_path, labels, stage, empty):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = nothing if empty else awkward
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
    n = common.written(out, "stage").count()
    assert (n == 0) == empty


def test_exact_values_of_awkward_rows(awkward, labels):
    by = {}
    for r in exact.deduplicate(awkward).collect():
        by.setdefault(r["keep_id"], []).append(r)
    # All texts without a visible byte are one group: longest first, then the smallest id.
    assert sorted(str(r["doc_id"]) for r in by[2]) == ["0", "1", "2", "3", "None"]
    # The same text four times over: row 6 twice, row 7, a null id.
    assert sorted(str(r["doc_id"]) for r in by[6]) == ["6", "6", "7", "None"]
    assert [sum(r["kept"] for r in g) for g in by.values()] == [1] * len(by)


def test_near_values_of_awkward_rows(awkward):
    found = {}
    for r in near.classes(awkward).collect():
        found.setdefault(r["class_id"], []).append(r)
    # Case and punctuation make no difference; texts without a word stay alone.
    assert sorted(str(r["doc_id"]) for r in found[6]) == ["6", "6", "7", "8", "9", "None"]
    assert all(len(found[i]) == 1 for i in (0, 1, 2, 3, 5))
    assert [sum(r["kept"] for r in g) for g in found.values()] == [len(g) if i is None else 1 for i, g in found.items()]
