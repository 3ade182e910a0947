"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from odorframe.llm import exact, leaks, licences, lines, near, packing, perplexity, pieces, rules, runs, spelling, suffixes, toxicity
from odorframe.llm.common import table


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the bytes of repeated 200-byte strings."""
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under the model of all trusted text, and the verdict."""
    return perplexity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document and the notices in it."""
    return licences.scan(table(spark, sf_dir, "documents")).drop("row")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, and the digest of the text decoded from them."""
    found = pieces.decode(pieces.encode(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("decoded_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without repeated multi-line chunks."""
    found = lines.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "n_chunks_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in windows of 4096 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near.classes(table(spark, sf_dir, "documents")).drop("row")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and the quality verdict of every document."""
    found = rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *rules.COUNTS, "base_failed", "kept", "score")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of every document: the row that stays, the group's size, the digest."""
    verdicts = exact.deduplicate(table(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of words of every document, a tenth of them made periodic first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return runs.digests(runs.periodic_runs(docs.withColumn("text", runs.repeated(F.col("text"), F.col("doc_id")))))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of all documents with its near words, its form and its root; one run in 199 is misspelt first."""
    return spelling.variants(table(spark, sf_dir, "documents"), drop_every=199).select("word", "form", "root", "n", "n_near", "form_n")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document that stand in a window of a benchmark item, and the items."""
    found = leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_license_scan": op1_license_scan,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_line_dedup": op3_line_dedup,
    "op4_packing": op4_packing,
    "op5_near_dedup": op5_near_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_quality_rules": op7_quality_rules,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_decontamination": op13_decontamination,
}

SQL: dict[str, str] = {
    "op1_license_scan": licences.oracle_sql(), "op3_line_dedup": lines.SQL, "op8_exact_dedup": OP8_SQL,
    "op11_periodic_runs": runs.SQL, "op12_spelling_variants": spelling.SQL, "op13_decontamination": leaks.SQL,
}
