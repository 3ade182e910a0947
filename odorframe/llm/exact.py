"""Exact deduplication with streaming state that never expires.

Texts are equal when identical after deleting every white-space byte. A streaming aggregation
keeps, per digest, the stable identifier and the content locator of the row that stays and the
number of rows, in RocksDB state on the executors' disks with its log in the shared folder. The
state is then read as a table. Rows whose digest was hit are compared by their full bytes.
DataFrame and SQL functions only.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from odorframe.llm import common

# Deleted before comparing: the ASCII white-space bytes.
WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # A store would otherwise claim megabytes of disk for logs before it holds a row.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: str = "text") -> Column:
    out = F.coalesce(F.col(text), F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sha256(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


SLIM = ("row", "doc_id", "digest", "n_code_points", "locator")


def _slim(row: str | None, digest) -> list[Column]:
    return [
        F.monotonically_increasing_id() if row is None else F.col(row),
        F.col("doc_id").cast("long"),
        digest(normalised()),
        F.length(F.coalesce("text", F.lit(""))).cast("long"),
        F.input_file_name(),
    ]


def arrivals(docs: DataFrame, row: str | None = None, digest=sha256) -> DataFrame:
    """One slim row per document: row, doc_id, digest, n_code_points, locator.

    ``row`` (a column of ``docs``, or else its place in the scan) tells rows apart that repeat a
    doc_id; ``locator`` names the file that holds the text (empty if there is none).
    """
    return docs.select(*[c.alias(n) for c, n in zip(_slim(row, digest), SLIM)])


def _best() -> Column:
    return F.max(F.struct("n_code_points", (-F.col("doc_id")).alias("minus_id"), (-F.col("row")).alias("minus_row"), "locator"))


def keep_state(spark: SparkSession, path: str, checkpoint: str, files_per_batch: int | None = None) -> DataFrame:
    """Feeds the arrivals under ``path`` to the keyed state and returns the state as a table.

    A later call with the same checkpoint takes only files that are new, and judges them against
    everything seen before. Columns: digest, keep (n_code_points, minus_id, minus_row, locator), n.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    seen = reader.parquet(path).groupBy("digest").agg(_best().alias("keep"), F.count("*").alias("n"))
    with _settings(spark, _STATE):
        query = seen.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
    key, value = state.schema["key"].dataType.names, state.schema["value"].dataType.names
    keep, n = value[-2:]
    return state.select(F.col(f"key.{key[0]}").alias("digest"), F.col(f"value.`{keep}`").alias("keep"), F.col(f"value.`{n}`").alias("n"))


def _verdicts(rows: DataFrame, keys: list[str], groups: DataFrame) -> DataFrame:
    return rows.join(groups, keys).select(
        "row",
        "doc_id",
        "digest",
        (-F.col("keep.minus_id")).alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == -F.col("keep.minus_row")).alias("kept"),
        F.col("keep.locator").alias("keep_locator"),
    )


def deduplicate(docs: DataFrame, row: str | None = None, digest=sha256) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, digest, keep_id, group_size, kept, keep_locator.

    Of equal texts the row with the most code points before normalising stays, then the smallest
    doc_id (a null one last), then the first row among rows that repeat both. Null is an empty
    text; all empty texts are equal. Different bytes under one digest are different texts.
    """
    spark = docs.sparkSession
    path = common.new_path(spark, "arrivals")
    arrivals(docs, row, digest).write.parquet(path)
    rows = spark.read.parquet(path)
    state = common.written(keep_state(spark, path, common.new_path(spark, "dedup-state")), "dedup-kept")
    hits = common.written(state.filter("n > 1").select("digest"), "dedup-hits")
    # Grouping by the whole normalised text is the byte comparison; copies meet map-side first.
    bodies = common.only(docs.select(normalised().alias("body")).withColumn("digest", digest(F.col("body"))), hits, "digest")
    texts = bodies.groupBy("digest", "body").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("texts"))
    mixed = common.written(texts.filter("texts > 1").select("digest"), "dedup-mixed")
    if mixed.isEmpty():
        return _verdicts(rows, ["digest"], state)
    # Different texts share a digest: these few groups are keyed by their bytes.
    full = docs.select(*[c.alias(n) for c, n in zip(_slim(row, digest), SLIM)], normalised().alias("body"))
    again = common.written(full.join(mixed, "digest", "left_semi"), "dedup-again")
    split = again.groupBy("digest", "body").agg(_best().alias("keep"), F.count("*").alias("n"))
    plain = _verdicts(rows.join(mixed, "digest", "left_anti"), ["digest"], state)
    return plain.unionByName(_verdicts(again, ["digest", "body"], split))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    row = common.fresh_name(docs, "row")
    numbered = common.written(docs.withColumn(row, F.monotonically_increasing_id()), "dedup-docs")
    kept = common.written(deduplicate(numbered, row).filter("kept").select(F.col("row").alias(row)), "dedup-stay")
    return common.only(numbered, kept, row).drop(row)
