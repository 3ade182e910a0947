"""Queries that write the given tables as files and read them back."""

from __future__ import annotations

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import tables as tb
from odorframe.plans import ledger
from odorframe.schema import PROFILES, Catalog, DatasetProfile, feature_columns
from odorframe.session import fresh_path
from odorframe.sources import ledger_io, raw

Q = {}
SQL = {}

HEADERLESS = DatasetProfile("headerless", "", header=False, sensors=("value", "k"), interval=0.05, indicator=True)
TABS = DatasetProfile("tabs", "", sep="\t", header=False, sensors=("value", "k"), drop_empty_cols=True, interval=1.0)
EXACT = DatasetProfile("exact", "", sep="\t", header=False, sensors=("value", "k"), width="exact", interval=1.0)
NAMED = DatasetProfile("named", "", sensors=("k", "value"), interval=1.0)


def _labelled(spark, sf):
    """Events with the label of their user's first event, as ``kind=<label>/user=<id>`` folders."""
    pts = tb.points(spark, sf)
    first = pts.groupBy("measurement_id").agg(F.min(F.struct("time", "seq", "label"))["label"].alias("kind"))
    return pts.drop("label").join(first, "measurement_id").withColumnRenamed("measurement_id", "user")


def _escaped(value: str | None) -> str:
    """A value as part of a folder name, as a partitioned write of Spark spells it."""
    if not isinstance(value, str) or not value:
        return "__HIVE_DEFAULT_PARTITION__"
    return "".join(f"%{ord(c):02X}" if c < " " or c in "\"#%'*/:=?\\\x7f{[]^" else c for c in value)


def _write_lines(df, line, path, suffix="txt", header=None):
    """One text file per measurement, lines in time order, after the header if there is one.

    Tasks create the files themselves where Arrow knows the file system: a partitioned write of Spark
    took some 0.1 s of a core per file on a local one. A file gets its name when it is complete.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    rows = df.select("kind", "user", F.lit(1).alias("place"), "time", "seq", line.alias("line"))
    if header is not None:
        heads = df.select("kind", "user").distinct().withColumn("place", F.lit(0)).withColumn("line", F.lit(header))
        rows = rows.unionByName(heads, allowMissingColumns=True)
    rows = (
        rows.repartition(tasks, "kind", "user")
        .sortWithinPartitions("kind", "user", "place", "time", "seq")
        .select("kind", "user", "line")
    )
    try:
        arrow_fs.FileSystem.from_uri(path)
    except (ValueError, NotImplementedError, OSError):
        rows.write.partitionBy("kind", "user").text(path)
        return

    def write(batches):
        system, root = arrow_fs.FileSystem.from_uri(path)
        now = out = None
        files = 0

        def close():
            if out is not None:
                out.close()
                system.move(f"{root}/{now}/.part", f"{root}/{now}/part.{suffix}")

        for batch in batches:
            for (kind, user), part in batch.groupby(["kind", "user"], sort=False, dropna=False):
                folder = f"kind={_escaped(kind)}/user={user}"
                if folder != now:
                    close()
                    system.create_dir(f"{root}/{folder}", recursive=True)
                    now, out, files = folder, system.open_output_stream(f"{root}/{folder}/.part"), files + 1
                out.write("".join(f"{text or ''}\n" for text in part["line"]).encode())
        close()
        yield pd.DataFrame({"files": [files]})

    rows.mapInPandas(write, "files long").agg(F.sum("files")).collect()


_LAB = f"""WITH {tb.points_sql()},
fst AS (SELECT id, arg_min(label, (time, seq)) AS kind FROM pts GROUP BY 1),
lab AS (SELECT pts.id AS usr, 'kind=' || kind AS folder, time, seq, value, k, kind || '' AS kind,
  row_number() OVER (PARTITION BY pts.id ORDER BY time, seq) - 1 AS pos FROM pts JOIN fst USING (id))"""

def headerless(spark, sf):
    path = fresh_path(spark, "headerless")
    narrow = F.col("user") % 10 == 0
    _write_lines(
        _labelled(spark, sf), F.when(narrow, F.col("value").cast("string")).otherwise(F.concat_ws(",", "value", "k", "seq")), path
    )
    return raw.read_labelled_raw(spark, path, HEADERLESS, levels=2).withColumn("Time", tb.r6("Time")).drop("Measurement_Number")


Q["raw_headerless"] = headerless
SQL["raw_headerless"] = f"""{_LAB} SELECT round(pos * 0.05::DOUBLE, 6) + 0 AS "Time", value, k, folder AS "Label",
  CAST(dense_rank() OVER (ORDER BY folder) - 1 AS INTEGER) AS "Label_Indicator" FROM lab WHERE usr % 10 <> 0"""


def rejected(spark, sf):
    path = fresh_path(spark, "rejects")
    kind = F.col("user") % 10
    line = (
        F.when(kind == 0, F.col("value").cast("string"))
        .when((kind == 1) & (F.col("seq") % 2 == 0), F.concat_ws(",", "value", "k", "seq", "seq"))
        .otherwise(F.concat_ws(",", "value", "k", "seq"))
    )
    _write_lines(_labelled(spark, sf), line, path)
    out = raw.rejects(spark, path, HEADERLESS, levels=2)
    return out.withColumn("file", F.array_join(F.slice(F.split("file", "/"), 1, 2), "/"))


Q["raw_rejects"] = rejected
SQL["raw_rejects"] = f"""{_LAB} SELECT folder || '/user=' || usr AS file, folder AS "Label",
  CASE WHEN usr % 10 = 0 THEN 'too few columns' ELSE 'ragged lines' END AS reason
FROM lab GROUP BY usr, folder HAVING usr % 10 = 0 OR (usr % 10 = 1 AND arg_min(seq, pos) % 2 = 1 AND min(seq % 2) = 0)"""


def tabs(spark, sf):
    """Column 0 is empty throughout for odd users and filled for even ones."""
    path = fresh_path(spark, "tabs")
    lead = F.when(F.col("user") % 2 == 1, F.lit("")).otherwise(F.col("seq").cast("string"))
    _write_lines(_labelled(spark, sf), F.concat_ws("\t", lead, F.col("value"), F.col("k")), path)
    return raw.read_labelled_raw(spark, path, TABS, levels=2).drop("Measurement_Number")


Q["raw_drop_empty_columns"] = tabs
SQL["raw_drop_empty_columns"] = f"""{_LAB} SELECT CAST(pos AS DOUBLE) AS "Time", folder AS "Label",
  CASE WHEN usr % 2 = 1 THEN value ELSE CAST(seq AS DOUBLE) END AS value, CASE WHEN usr % 2 = 1 THEN k ELSE value END AS k FROM lab"""


def exact(spark, sf):
    path = fresh_path(spark, "exact")
    two, three = F.concat_ws("\t", "value", "k"), F.concat_ws("\t", "value", "k", "seq")
    _write_lines(_labelled(spark, sf), F.when(F.col("user") % 3 == 0, three).otherwise(two), path)
    return raw.read_labelled_raw(spark, path, EXACT, levels=2).drop("Measurement_Number")


Q["raw_exact_width"] = exact
SQL["raw_exact_width"] = f"""{_LAB} SELECT CAST(pos AS DOUBLE) AS "Time", folder AS "Label", value, k FROM lab WHERE usr % 3 <> 0"""


def named(spark, sf):
    """A header line per file, columns in two different orders; time is the row number."""
    path = fresh_path(spark, "named")
    df = _labelled(spark, sf)
    flip = F.col("user") % 2 == 0
    body = F.when(flip, F.concat_ws(",", "value", "k")).otherwise(F.concat_ws(",", "k", "value"))
    head = df.groupBy("kind", "user").agg(F.lit(-1).cast("bigint").alias("time"), F.lit(-1).cast("bigint").alias("seq"))
    rows = df.select("kind", "user", "time", "seq", body.alias("l")).unionByName(
        head.withColumn("l", F.when(flip, F.lit("value,k")).otherwise(F.lit("k,value")))
    )
    _write_lines(rows, F.col("l"), path)
    return raw.read_labelled_raw(spark, path, NAMED, levels=2).drop("Measurement_Number")


Q["raw_named_columns"] = named
SQL["raw_named_columns"] = f"""{_LAB} SELECT CAST(pos AS DOUBLE) AS "Time", folder AS "Label", value, k FROM lab"""


def with_header(spark, sf):
    """Files with a header and their own time column; every file is one measurement."""
    path = fresh_path(spark, "csv")
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("time", "value", "k")]
    _write_lines(_labelled(spark, sf), F.concat_ws(",", *cells), path, "csv", "Time [us],value,k")
    schema = T.StructType(
        [T.StructField("Time [us]", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("k", T.DoubleType())]
    )
    return raw.read_labelled_csv(spark, path, schema, PROFILES["Plant_oil"], levels=2)


Q["raw_csv_header"] = lambda s, sf: with_header(s, sf).drop("Measurement_Number")
SQL["raw_csv_header"] = f"""{_LAB} SELECT time AS "Time", value, k, folder AS "Label" FROM lab"""


def numbering(spark, sf):
    """Numbers are consecutive, and follow the label order."""
    per = with_header(spark, sf).groupBy("Measurement_Number", "Label").agg(F.count("*").alias("n"))
    return per.groupBy("Label").agg(
        F.min("Measurement_Number").alias("first"),
        F.max("Measurement_Number").alias("last"),
        F.count("*").alias("files"),
        F.sum("n").alias("rows"),
    )


Q["measurement_numbers"] = numbering
SQL["measurement_numbers"] = f"""{_LAB},
c AS (SELECT folder, count(DISTINCT usr) AS files, count(*) AS "rows" FROM lab GROUP BY 1),
s AS (SELECT *, CAST(sum(files) OVER (ORDER BY folder) AS BIGINT) AS last FROM c)
SELECT folder AS "Label", last - files + 1 AS first, last, files, "rows" FROM s"""


def number_by_path(spark, sf):
    """Measurement numbers over distinct (label, user) names."""
    names = _labelled(spark, sf).select(
        F.col("kind").alias("Label"), F.concat("kind", F.lit("/"), "user").alias("file")
    ).distinct()
    return raw.number_files(names)


Q["file_numbering"] = number_by_path
SQL["file_numbering"] = f"""{_LAB} SELECT kind AS "Label", file, row_number() OVER (ORDER BY kind, md5('0|file|' || file)) AS "Measurement_Number"
FROM (SELECT DISTINCT kind, kind || '/' || usr AS file FROM lab)"""


def indicator(spark, sf):
    pts = tb.points(spark, sf).select(F.col("label").alias("Label"))
    return raw.with_indicator(pts).groupBy("Label", "Label_Indicator").agg(F.count("*").alias("n"))


Q["label_indicator"] = indicator
SQL["label_indicator"] = f"""WITH {tb.points_sql()} SELECT label AS "Label", CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS "Label_Indicator",
  count(*) AS n FROM pts GROUP BY 1"""


def combined(spark, sf):
    """Two datasets, one of them with one sensor only, in one table."""
    pts = tb.points(spark, sf)
    a = pts.select("measurement_id", "label", "value", "k")
    return raw.combine({"both": a, "single": a.drop("k")})


Q["combined_union"] = combined
SQL["combined_union"] = f"""WITH {tb.points_sql()} SELECT id AS measurement_id, label, value, k, 'both' AS dataset FROM pts
UNION ALL SELECT id, label, value, NULL, 'single' FROM pts"""

Q["dataset_summary"] = lambda s, sf: raw.summary(tb.points(s, sf), "measurement_id", "label")
SQL["dataset_summary"] = f"""WITH {tb.points_sql()}, c AS (SELECT count(DISTINCT id) AS measurements, count(*) AS "rows", count(DISTINCT label) AS labels FROM pts)
SELECT *, measurements // labels AS measurements_per_label, "rows" // measurements AS rows_per_measurement FROM c"""


def load_by_name(spark, sf):
    """Written as the combined CSV of a named dataset, loaded by name, averaged per feature."""
    root = fresh_path(spark, "catalog")
    pts = tb.points(spark, sf).select(
        F.col("measurement_id").alias("Measurement_Number"), F.col("time").alias("Time [us]"), "value", "k",
        F.col("label").alias("Label"), F.lit(1).alias("Label_Indicator"),
    )
    ledger_io.write_combined(pts, f"{root}/{PROFILES['Brewed_vinegar'].table}")
    df = Catalog(root).load(spark, "Brewed_vinegar", pts.schema)
    means = [F.struct(F.lit(f).alias("feature"), F.avg(f).alias("mean")) for f in feature_columns(df)]
    return df.agg(F.array(*means).alias("m"), F.min("Time").alias("t0")).select("t0", F.inline("m")).withColumn("mean", tb.r6("mean"))


Q["load_by_name"] = load_by_name
SQL["load_by_name"] = f"""WITH {tb.points_sql()} SELECT min(time) AS t0, 'value' AS feature, round(avg(value), 6) + 0 AS mean FROM pts
UNION ALL SELECT min(time), 'k', round(avg(k), 6) + 0 FROM pts"""


def combined_written(spark, sf):
    path = fresh_path(spark, "combined")
    pts = tb.points(spark, sf)
    ledger_io.write_combined(pts, path)
    return spark.read.schema(pts.schema).option("header", True).csv(path)


Q["combined_csv"] = combined_written
SQL["combined_csv"] = f"""WITH {tb.points_sql()} SELECT id AS measurement_id, time, seq, label, value, k FROM pts"""


def appended(spark, sf):
    """Two batches appended to one ledger and read back."""
    path = fresh_path(spark, "ledger")
    led = tb.ledger(spark, sf)
    ledger_io.append_results(ledger.baselines(led), path)
    ledger_io.append_results(ledger.generated(led), path)
    return ledger_io.read_ledger(spark, path)


Q["ledger_append"] = appended
SQL["ledger_append"] = f"WITH {tb.LEDGER_SQL} SELECT * FROM led"


def replaced(spark, sf):
    """The runs of two folds written again with another accuracy; all others stay."""
    path = fresh_path(spark, "ledger")
    led = tb.ledger(spark, sf)
    ledger_io.append_results(led, path)
    ledger_io.replace_runs(led.filter(F.col("Fold") <= 2).withColumn("Accuracy", F.lit(0.5)), path)
    return ledger_io.read_ledger(spark, path)


Q["ledger_replace_runs"] = replaced
SQL["ledger_replace_runs"] = f"""WITH {tb.LEDGER_SQL} SELECT * REPLACE (CASE WHEN "Fold" <= 2 THEN 0.5 ELSE "Accuracy" END AS "Accuracy") FROM led"""


def saved(spark, sf):
    path = fresh_path(spark, "saved")
    led = tb.ledger(spark, sf)
    ledger_io.save_table(led, path)
    return spark.read.schema(led.schema).options(header=True, escape='"').csv(path)


Q["results_table_csv"] = saved
SQL["results_table_csv"] = SQL["ledger_append"]


def merged(spark, sf):
    """Current and old result tables in nested folders, one of them out of use."""
    root = fresh_path(spark, "results")
    led = tb.ledger(spark, sf).withColumn("Hyperparameters", F.concat(F.lit("{'id': '"), "Hyperparameters", F.lit("', 'k': 5}")))
    even = F.col("Fold") % 2 == 0
    ledger_io.save_table(led.filter(even), f"{root}/a/new_results.csv")
    ledger_io.save_table(led.filter(~even).drop("SeedFoldSelection"), f"{root}/b/c/older_results.csv")
    ledger_io.save_table(led.filter(even), f"{root}/Old result/x_results.csv")
    ledger_io.save_table(led.filter(even), f"{root}/b/notes.csv")
    return ledger_io.merge_results(spark, root)


Q["merge_result_files"] = merged
SQL["merge_result_files"] = f"""WITH {tb.LEDGER_SQL} SELECT * REPLACE ('{{''id'': ''' || "Hyperparameters" || ''', ''k'': 5}}' AS "Hyperparameters",
  CASE WHEN "Fold" % 2 = 0 THEN "SeedFoldSelection" END AS "SeedFoldSelection") FROM led"""


def merged_odd(spark, sf):
    """Result tables whose first column is another one, with quoted headers, and wider than a ledger."""
    root = fresh_path(spark, "results")
    led = tb.ledger(spark, sf)
    part = lambda i: led.filter(F.col("Fold") % 3 == i)
    ledger_io.save_table(part(0).select(*reversed(led.columns)), f"{root}/back_results.csv")
    part(1).write.options(header=True, escape='"', quoteAll=True).csv(f"{root}/quoted_results.csv")
    wide = part(2).select(F.lit("n, 1").alias("Note"), F.lit(1).alias("Host"), *led.columns)
    wide.write.options(header=True, escape='"').csv(f"{root}/deep/wide_results.csv")
    return ledger_io.merge_results(spark, root)


Q["merge_odd_headers"] = merged_odd
SQL["merge_odd_headers"] = SQL["ledger_append"]


def headers(spark, sf):
    """How many ledger columns each result table names; all files of a table have its header."""
    root = fresh_path(spark, "results")
    led = tb.ledger(spark, sf)
    ledger_io.save_table(led, f"{root}/whole_results.csv")
    ledger_io.save_table(led.select("Dataset", F.lit(0).alias("Other")), f"{root}/one_results.csv")
    ledger_io.save_table(led.select(F.lit(0).alias("Other")), f"{root}/none_results.csv")
    found = ledger_io.result_headers(spark, root)
    return found.select(F.regexp_extract("file", "([a-z]+)_results", 1).alias("name"), F.size(F.filter("columns", lambda c: c.isNotNull())).alias("columns"), "known").distinct()


Q["result_headers"] = headers
SQL["result_headers"] = """SELECT n AS name, CAST(c AS INTEGER) AS columns, CAST(k AS INTEGER) AS known
FROM (VALUES ('whole', 11, 11), ('one', 2, 1), ('none', 1, 0)) v(n, c, k) WHERE EXISTS (SELECT 1 FROM lineitem)"""
