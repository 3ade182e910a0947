"""Reading and writing combined tables and the results ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odorframe.session import cut_lineage, small_side
from odorframe.sources.raw import source_path

# Ledger columns and types, file suffix and the folder name left out of a merge.
LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("Dataset", T.StringType()),
        T.StructField("Fold", T.IntegerType()),
        T.StructField("SeedsPerLabel", T.IntegerType()),
        T.StructField("SeedFoldSelection", T.IntegerType()),
        T.StructField("ScaleFactor", T.IntegerType()),
        T.StructField("Model", T.StringType()),
        T.StructField("Method", T.StringType()),
        T.StructField("Accuracy", T.DoubleType()),
        T.StructField("F1_Score", T.DoubleType()),
        T.StructField("Hyperparameters", T.StringType()),
        T.StructField("ExecutionTime_Sec", T.DoubleType()),
    ]
)
RUN_PARTITIONS = ["Dataset", "Fold", "SeedsPerLabel"]
RESULT_SUFFIX = "_results.csv"
OLD_FOLDER = "Old result"


def write_combined(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A combined table; CSV with header, or Parquet."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))


def _by_run(rows: DataFrame) -> DataFrame:
    """Rows of one run folder together, so it gets few files; AQE splits the large ones."""
    typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LEDGER_SCHEMA.fields])
    return typed.hint("rebalance", *RUN_PARTITIONS)


def append_results(rows: DataFrame, path: str) -> None:
    """Adds finished runs in one commit, partitioned like they are read.

    A failed task or job leaves no partial rows: files appear only when the write commits.
    """
    _by_run(rows).write.mode("append").partitionBy(*RUN_PARTITIONS).parquet(path)


def replace_runs(rows: DataFrame, path: str) -> None:
    """Writes the partitions found in ``rows`` anew and leaves all others alone, so a rerun does not add twice."""
    (
        _by_run(rows)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*RUN_PARTITIONS)
        .parquet(path)
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The partitioned ledger; filters on dataset, fold and seed size prune folders."""
    return spark.read.schema(LEDGER_SCHEMA).parquet(path).select(*LEDGER_SCHEMA.names)


def save_table(rows: DataFrame, path: str) -> None:
    """The whole results table as CSV with header."""
    rows.write.mode("overwrite").options(header=True, escape='"').csv(path)


def _result_lines(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(``path, line`` of all result tables below ``root`` but the headers, ``path, line`` of the headers, written).

    Other files are left out by name before they are read. Lines of a split come in order, so the first
    line of a file is the one with the smallest row number among those of its first split.
    """
    path = F.col("_metadata.file_path")
    lines = (
        spark.read.option("recursiveFileLookup", True).text(root)
        # Paths are percent-encoded here; they are decoded in the headers only.
        .filter(path.rlike(r"_results\.csv(/part-[^/]*)?$") & ~path.contains(OLD_FOLDER) & ~path.contains(OLD_FOLDER.replace(" ", "%20")))
        .filter(F.col("value") != "")
        .select(path.alias("path"), F.col("_metadata.file_block_start").alias("at"), F.col("value").alias("line"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    firsts = lines.groupBy("path").agg(F.min(F.struct("at", "row")).alias("__f"))
    firsts = small_side(firsts.select("path", F.col("__f.row").alias("__row")), 10)
    marked = lines.join(firsts, "path")
    headers = cut_lineage(marked.filter(F.col("row") == F.col("__row")).select("path", "line"))
    return marked.filter(F.col("row") != F.col("__row")).select("path", "line"), headers


def result_headers(spark: SparkSession, root: str) -> DataFrame:
    """``file, columns, known``: the header of every result table and how many ledger columns it names.

    A table that names none gives rows without a value; this is where to see which ones.
    """
    _, first = _result_lines(spark, root)
    return _split(first, "line", _width(first)).select(
        source_path("path").alias("file"), F.col("c").alias("columns"), F.size(F.array_intersect("c", F.lit(LEDGER_SCHEMA.names))).alias("known")
    )


def _width(headers: DataFrame) -> int:
    """Fields of the widest header, at most."""
    commas = F.length("line") - F.length(F.replace(F.col("line"), F.lit(","), F.lit("")))
    return int(headers.agg(F.max(commas)).first()[0] or 0) + 1


def _split(lines: DataFrame, column: str, width: int) -> DataFrame:
    """Adds ``c``: the fields of a CSV line, as many as the widest header has."""
    wide = ", ".join(f"c{i} STRING" for i in range(width))
    fields = lines.withColumn("__f", F.from_csv(column, F.lit(wide), {"escape": '"'}))
    trimmed = [F.trim(F.col(f"__f.c{i}")) for i in range(width)]
    return fields.withColumn("c", F.array(*trimmed)).drop("__f")


def merge_results(spark: SparkSession, root: str) -> DataFrame:
    """All result tables below ``root`` as one ledger.

    Takes files, or folders written by Spark, whose name ends in ``_results.csv``, not
    below a folder named ``Old result``. Each file's first line is its header, in any order, of
    any width, quoted or not: it decides which field is which column. Other columns are left out
    and missing ones come out NULL.
    """
    lines, first = _result_lines(spark, root)
    width = _width(first)
    headers = _split(first, "line", width).select("path", F.col("c").alias("h"))
    rows = _split(lines, "line", width).join(small_side(headers, 2 * width + 10), "path")
    return rows.select(
        *[
            F.get(F.col("c"), F.nullif(F.array_position(F.col("h"), f.name), F.lit(0)).cast("int") - 1)
            .cast(f.dataType)
            .alias(f.name)
            for f in LEDGER_SCHEMA.fields
        ]
    )
