"""Folders of raw measurement files to one labelled points table.

Layout: ``root/<label>/<file>``, one file per measurement. Lines are read by the text
source, so a large file is split like any other input; the row number inside a file is
the row number inside its split plus the rows of the earlier splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odorframe.functions.draws import key_hash
from odorframe.functions.ranking import number_rows
from odorframe.schema import INDICATOR, LABEL, MEASUREMENT, TIME, DatasetProfile, normalise_time
from odorframe.session import cut_lineage, small_side

# Cell texts that a CSV reader takes as missing.
MISSING = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


def glob_path(root: str, levels: int) -> str:
    return root.rstrip("/") + "/*" * (levels + 1)


def source_path(col: str = "_metadata.file_path") -> Column:
    """Decoded path; paths arrive percent-encoded, where a plus is a plus."""
    return F.url_decode(F.replace(F.col(col), F.lit("+"), F.lit("%2B")))


def relative_path(path: Column, levels: int) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, -(levels + 1), levels + 1), "/")


def with_names(df: DataFrame) -> DataFrame:
    """Label and base name from the relative path ``file``."""
    parts = F.split("file", "/")
    return df.withColumn(LABEL, F.get(parts, F.lit(0))).withColumn("name", F.element_at(parts, -1))


def name_problem(profile: DatasetProfile) -> Column:
    """Why a file name is not read; NULL where it is."""
    hidden = F.lit(False)
    for prefix in profile.hidden:
        hidden = hidden | F.col("name").startswith(prefix)
    known = F.lit(False)
    for suffix in profile.suffixes:
        known = known | F.col("name").endswith(suffix)
    return F.when(hidden, F.lit("hidden name")).when(~known, F.lit("suffix"))


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Reads begun inside list their files in a few tasks per core; by itself Spark takes one per path, up to 10,000."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def list_files(spark: SparkSession, root: str, levels: int = 1) -> DataFrame:
    """``file, Label, name`` of every file; no content is read.

    Names starting with ``.`` or ``_`` and files of zero bytes are already left out by
    Spark's file sources.
    """
    with few_listing_tasks(spark):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(glob_path(root, levels))
    return with_names(found.select(relative_path(source_path("path"), levels).alias("file")))


def scan_lines(spark: SparkSession, root: str, profile: DatasetProfile, levels: int = 1) -> DataFrame:
    """Non-blank lines ``file, Label, name, line, pos`` of the files the name filter lets through, written.

    Every file is opened once, however often its lines are read again.
    """
    with few_listing_tasks(spark):
        text = spark.read.option("recursiveFileLookup", True).text(glob_path(root, levels))
    text = text.select(
        relative_path(source_path(), levels).alias("file"),
        F.col("_metadata.file_block_start").alias("__split"),
        F.col("value").alias("line"),
    ).filter(F.col("line") != "")
    # A split is read by one task from front to back, so this id orders its lines without a gap.
    text = with_names(text).filter(name_problem(profile).isNull()).withColumn("__at", F.monotonically_increasing_id())
    text = cut_lineage(text)
    before = Window.partitionBy("file").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    splits = text.groupBy("file", "__split").agg(F.count("*").alias("__n"), F.min("__at").alias("__first")).select(
        "file", "__split", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift")
    )
    return (
        text.join(small_side(splits, 4), ["file", "__split"])
        .withColumn("pos", (F.col("__at") + F.col("__shift")).cast("bigint"))
        .drop("__split", "__at", "__shift")
    )


def _cells(profile: DatasetProfile) -> Column:
    return F.transform(F.split("line", profile.sep, -1), lambda c: F.trim(c))


def _missing(cell: Column) -> Column:
    return cell.isin(*MISSING)


def check_files(lines: DataFrame, profile: DatasetProfile) -> DataFrame:
    """One row per file: ``file, Label, kept`` (column positions) and ``reason`` (NULL = accepted)."""
    n = len(profile.sensors)
    cells = lines.select("file", LABEL, "pos", _cells(profile).alias("c"))
    first = F.min(F.struct("pos", "c"))
    per_file = cells.groupBy("file", LABEL).agg(
        first["c"].alias("head"), F.max(F.size("c")).alias("widest"), F.count("*").alias("n_lines")
    )
    if profile.header:
        places = F.transform(F.lit(list(profile.sensors)), lambda s: F.array_position(F.col("head"), s).cast("int") - 1)
        checked = per_file.withColumn("kept", places).withColumn(
            "reason", F.when(F.exists("kept", lambda p: p < 0), F.lit("missing column"))
        )
        ragged = F.col("widest") > F.size("head")
        reason = F.coalesce(F.when(ragged, F.lit("ragged lines")), F.col("reason"))
        return checked.select("file", LABEL, "kept", reason.alias("reason"))
    if profile.drop_empty_cols:
        filled = (
            cells.select("file", F.posexplode("c").alias("place", "cell"))
            .filter(~_missing(F.col("cell")))
            .groupBy("file", "place").agg(F.lit(1).alias("one"))
            .groupBy("file").agg(F.array_sort(F.collect_list("place")).alias("usable"))
        )
        per_file = per_file.join(filled, "file", "left").withColumn(
            "usable", F.coalesce("usable", F.array().cast("array<int>"))
        )
    else:
        per_file = per_file.withColumn("usable", F.sequence(F.lit(0), F.size("head") - 1))
    width = F.size("usable")
    reason = F.when(F.col("widest") > F.size("head"), F.lit("ragged lines")).when(
        width < n, F.lit("too few columns")
    )
    if profile.width == "exact":
        reason = reason.when(width != n, F.lit("wrong width"))
    return per_file.select("file", LABEL, F.slice("usable", 1, n).alias("kept"), reason.alias("reason"))


def number_files(accepted: DataFrame) -> DataFrame:
    """Adds ``Measurement_Number`` 1..n over the accepted files, by label and path hash."""
    return number_rows(
        accepted, key_hash(0, "file", "file"), tie="file", prefix=[LABEL], name=MEASUREMENT
    )


def with_indicator(df: DataFrame) -> DataFrame:
    """Adds ``Label_Indicator``: 0, 1, ... over the sorted labels."""
    labels = df.select(LABEL).distinct()
    codes = labels.withColumn(INDICATOR, (F.dense_rank().over(Window.orderBy(LABEL)) - 1).cast("int"))
    return df.join(small_side(codes, 10), LABEL)


def read_labelled_raw(spark: SparkSession, root: str, profile: DatasetProfile, levels: int = 1) -> DataFrame:
    """Combined table of one dataset whose time is the row number times the interval.

    ``Measurement_Number, Time, <sensors>, Label[, Label_Indicator]``. Cells that are
    not numbers become NULL. With a header, sensors are found by name in each file.
    """
    lines = scan_lines(spark, root, profile, levels)
    accepted = check_files(lines, profile).filter(F.col("reason").isNull()).select("file", LABEL, "kept")
    files = small_side(number_files(cut_lineage(accepted)), len(profile.sensors) + 20)
    start = 1 if profile.header else 0
    rows = lines.filter(F.col("pos") >= start).drop(LABEL).join(files, "file")
    cells = _cells(profile)
    sensors = [
        _number(F.get(F.col("__c"), F.get(F.col("kept"), F.lit(i)))).alias(s)
        for i, s in enumerate(profile.sensors)
    ]
    time = ((F.col("pos") - start) * F.lit(float(profile.interval or 1.0))).alias(TIME)
    out = rows.withColumn("__c", cells).select(MEASUREMENT, time, *sensors, LABEL)
    return with_indicator(out).select(*out.columns, INDICATOR) if profile.indicator else out


def _number(cell: Column) -> Column:
    return F.when(~_missing(cell), cell.try_cast("double"))


def rejects(spark: SparkSession, root: str, profile: DatasetProfile, levels: int = 1) -> DataFrame:
    """``file, Label, reason`` of every file that is not part of the combined table."""
    files = list_files(spark, root, levels)
    checked = check_files(scan_lines(spark, root, profile, levels), profile).select("file", "reason")
    read = checked.withColumn("__read", F.lit(True))
    reason = F.coalesce(
        name_problem(profile), F.col("reason"), F.when(F.col("__read").isNull(), F.lit("no lines"))
    )
    return (
        files.join(read, "file", "left")
        .select("file", LABEL, reason.alias("reason"))
        .filter(F.col("reason").isNotNull())
    )


def read_labelled_csv(
    spark: SparkSession, root: str, schema: T.StructType, profile: DatasetProfile, levels: int = 1
) -> DataFrame:
    """Combined table of files that carry a header and their own time column.

    No row number is needed, so rows are scanned once and never shuffled; only the
    file names are numbered. A file with another header order fails loudly.
    """
    reader = spark.read.schema(schema).options(header=True, sep=profile.sep, enforceSchema=False, recursiveFileLookup=True)
    with few_listing_tasks(spark):
        scanned = reader.csv(glob_path(root, levels)).withColumn("file", relative_path(source_path(), levels))
    files = list_files(spark, root, levels).filter(name_problem(profile).isNull()).select("file", LABEL)
    out = scanned.join(small_side(number_files(files), 20), "file").select(MEASUREMENT, *schema.names, LABEL)
    out = normalise_time(out)
    return with_indicator(out) if profile.indicator else out


def combine(tables: dict[str, DataFrame]) -> DataFrame:
    """All datasets in one table, columns matched by name, with a ``dataset`` column."""
    out = None
    for name, df in tables.items():
        df = df.withColumn("dataset", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def summary(combined: DataFrame, measurement: str = MEASUREMENT, label: str = LABEL) -> DataFrame:
    """Labels, measurements, rows, and floor averages per label and per measurement.

    Counted in two steps, so a measurement with most of the rows combines map-side.
    """
    per = combined.groupBy(measurement).agg(F.count("*").alias("n"))
    totals = per.agg(F.count("*").alias("measurements"), F.sum("n").alias("rows"))
    labels = combined.agg(F.count_distinct(label).alias("labels"))
    floor = lambda a, b: F.coalesce(F.floor(F.col(a) / F.nullif(F.col(b), F.lit(0))), F.lit(0)).cast("bigint")
    return (
        totals.withColumn("labels", labels.scalar())
        .withColumn("measurements_per_label", floor("measurements", "labels"))
        .withColumn("rows_per_measurement", floor("rows", "measurements"))
    )


def with_sensors(profile: DatasetProfile, sensors: tuple[str, ...]) -> DatasetProfile:
    """The same file format with another sensor list."""
    return replace(profile, sensors=sensors)
