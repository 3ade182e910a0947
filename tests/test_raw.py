import pytest

from odorframe.schema import ID_COLUMNS, PROFILES, Catalog, feature_columns, normalise_time
from odorframe.sources import ledger_io, raw
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELS = ("A", "B b", "C+c")


def write(root, make, suffix=".txt"):
    for label in LABELS:
        (root / label).mkdir(parents=True)
        for f in range(4):
            (root / label / f"m_{f}{suffix}").write_text("".join(make(label, f, r) for r in range(12)))


def value(f, r, c):
    return 100 * f + r + c / 10


def test_headerless(spark, tmp_path):
    p = PROFILES["Brewed_vinegar"]
    write(tmp_path, lambda l, f, r: ",".join(str(value(f, r, c)) for c in range(9)) + "\n", ".csv")
    (tmp_path / "A" / ".hidden.csv").write_text("1,2\n")
    (tmp_path / "A" / "narrow.csv").write_text("1,2,3\n4,5,6\n")
    (tmp_path / "A" / "notes.md").write_text("x\n")
    (tmp_path / "A" / "empty.csv").write_text("\n")
    (tmp_path / "B b" / "cell.csv").write_text("1,2,3,4,5,6,7,oops\n1,2,3,4,5,6,7,\n")
    got = raw.read_labelled_raw(spark, str(tmp_path), p)
    assert got.columns == ["Measurement_Number", "Time", *p.sensors, "Label", "Label_Indicator"]
    rows = got.collect()
    assert len(rows) == 12 * 12 + 2
    assert {r["Measurement_Number"] for r in rows} == set(range(1, 14))
    assert {(r["Label"], r["Label_Indicator"]) for r in rows} == {("A", 0), ("B b", 1), ("C+c", 2)}
    one = sorted((r for r in rows if r["Measurement_Number"] == 1), key=lambda r: r["Time"])
    assert [round(r["Time"], 2) for r in one] == [round(0.05 * i, 2) for i in range(12)]
    assert [r["MQ5"] - one[0]["MQ5"] for r in one] == pytest.approx(list(range(12)))
    assert sum(r["MQ5"] is None for r in rows) == 2
    why = {r["file"]: r["reason"] for r in raw.rejects(spark, str(tmp_path), p).collect()}
    assert why == {"A/narrow.csv": "too few columns", "A/notes.md": "suffix", "A/empty.csv": "no lines"}


def test_empty_columns_are_dropped(spark, tmp_path):
    p = PROFILES["Coffee"]
    write(tmp_path, lambda l, f, r: "\t".join([str(r), "", *[str(value(f, r, c)) for c in range(8)], ""]) + "\r\n")
    (tmp_path / "A" / "~$lock.txt").write_text("1\n")
    rows = raw.read_labelled_raw(spark, str(tmp_path), p).collect()
    assert len(rows) == 144
    assert all(r["SP-12A"] == r["Time"] for r in rows)  # the first filled column
    assert {r["reason"] for r in raw.rejects(spark, str(tmp_path), p).collect()} == {"hidden name"}


def test_exact_width(spark, tmp_path):
    p = PROFILES["Wine_spoilage"]
    write(tmp_path, lambda l, f, r: "\t".join(str(value(f, r, c)) for c in range(8 if f else 9)) + "\n")
    rows = raw.read_labelled_raw(spark, str(tmp_path), p).collect()
    assert len(rows) == 3 * 3 * 12
    assert {r["reason"] for r in raw.rejects(spark, str(tmp_path), p).collect()} == {"wrong width"}


def test_header_with_row_number_time(spark, tmp_path):
    p = raw.with_sensors(PROFILES["Chinese_wine"], ("s1", "s2"))
    flip = lambda f: "s2,s1\n" if f % 2 else "s1,s2\n"
    write(tmp_path, lambda l, f, r: flip(f) if r == 0 else (f"{r + 0.5},{r}\n" if f % 2 else f"{r},{r + 0.5}\n"))
    (tmp_path / "A" / "other.csv").write_text("s1,s3\n1,2\n")
    rows = raw.read_labelled_raw(spark, str(tmp_path), p).collect()
    assert len(rows) == 3 * 4 * 11
    assert all(r["s1"] == r["Time"] + 1 and r["s2"] == r["Time"] + 1.5 for r in rows)
    assert {r["reason"] for r in raw.rejects(spark, str(tmp_path), p).collect()} == {"missing column"}


def test_header_with_own_time(spark, tmp_path):
    p = PROFILES["Plant_oil"]
    write(tmp_path, lambda l, f, r: "Time [s],TGS2620,TGS2602\n" if r == 0 else f"{r},{value(f, r, 0)},{value(f, r, 1)}\n")
    schema = T.StructType(
        [T.StructField("Time [s]", T.IntegerType()), T.StructField("TGS2620", T.DoubleType()), T.StructField("TGS2602", T.DoubleType())]
    )
    df = raw.read_labelled_csv(spark, str(tmp_path), schema, p)
    assert df.columns == ["Measurement_Number", "Time", "TGS2620", "TGS2602", "Label"]
    assert feature_columns(df) == ["TGS2620", "TGS2602"]
    s = raw.summary(df).first()
    assert (s["labels"], s["measurements"], s["rows"], s["measurements_per_label"], s["rows_per_measurement"]) == (3, 12, 132, 4, 11)
    assert {r["Label"] for r in df.select("Label").distinct().collect()} == set(LABELS)
    assert "Exchange" not in spark.read.schema(schema).csv(str(tmp_path / "A"))._jdf.queryExecution().executedPlan().toString()


def test_a_file_larger_than_a_split_keeps_its_row_order(spark, tmp_path):
    p = raw.with_sensors(PROFILES["Wine_spoilage"], ("a", "b"))
    (tmp_path / "A").mkdir()
    (tmp_path / "A" / "big.txt").write_text("".join(f"{i}\t{-i}\n" for i in range(5000)))
    (tmp_path / "A" / "small.txt").write_text("0\t0\n1\t-1\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert raw.scan_lines(spark, str(tmp_path), p).select("file").count() == 5002
        rows = raw.read_labelled_raw(spark, str(tmp_path), p).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128MB")
    assert len(rows) == 5002
    assert all(r["a"] == r["Time"] and r["b"] == -r["Time"] for r in rows)


def test_time_column_rules(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "`Measurement_Number` int, `Time [s]` double, Label string")
    assert normalise_time(df).columns == ["Measurement_Number", "Time", "Label"]
    with pytest.raises(ValueError):
        normalise_time(df.withColumn("Time", F.lit(1)))
    with_code = df.withColumn("Label_Indicator", F.lit(1)).withColumn("s", F.lit(1.0))
    assert feature_columns(normalise_time(with_code)) == ["s"]
    assert feature_columns(normalise_time(with_code), exclude=ID_COLUMNS) == ["Label_Indicator", "s"]


def test_catalog(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, 3.0, "x")], "Measurement_Number int, `Time [s]` double, s double, Label string")
    ledger_io.write_combined(df, str(tmp_path / PROFILES["Coffee"].table))
    assert Catalog(str(tmp_path)).load(spark, "Coffee").columns == ["Measurement_Number", "Time", "s", "Label"]
    with pytest.raises(KeyError):
        Catalog(str(tmp_path)).load(spark, "Tea")


def test_merge_of_plain_files(spark, tmp_path):
    (tmp_path / "new").mkdir()
    (tmp_path / "Old result").mkdir()
    head = ",".join(ledger_io.LEDGER_SCHEMA.names)
    (tmp_path / "new" / "X_S5_results.csv").write_text(
        head + "\n" + 'X,1,5,2,1,KNN,Baseline,0.5,0.4,"{\'a\': 1, \'b\': ""q""}",1.5\n'
    )
    (tmp_path / "Y_results.csv").write_text(
        head.replace("SeedFoldSelection,", "") + "\nY,1,5,1,KNN,Baseline,0.5,0.4,p,1.5\n"
    )
    (tmp_path / "Old result" / "Z_results.csv").write_text(head + "\nZ,1,5,2,1,KNN,Baseline,0.5,0.4,p,1.5\n")
    rows = {r["Dataset"]: r for r in ledger_io.merge_results(spark, str(tmp_path)).collect()}
    assert set(rows) == {"X", "Y"}
    assert rows["X"]["Hyperparameters"] == "{'a': 1, 'b': \"q\"}" and rows["X"]["SeedFoldSelection"] == 2
    assert rows["Y"]["SeedFoldSelection"] is None and rows["Y"]["ExecutionTime_Sec"] == 1.5


def test_arriving_files_are_added_once(spark, tmp_path):
    from odorframe.streaming.arrivals import append_to, arriving_csv

    schema = T.StructType([T.StructField("Time [s]", T.IntegerType()), T.StructField("s", T.DoubleType())])
    root, out, state = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "state")
    make = lambda l, f, r: "Time [s],s\n" if r == 0 else f"{r},{value(f, r, 0)}\n"
    write(root, make)
    run = lambda: append_to(arriving_csv(spark, str(root), schema, PROFILES["Plant_oil"]), out, state).awaitTermination()
    run()
    run()
    assert spark.read.parquet(out).count() == 3 * 4 * 11
    (root / "A" / "late.txt").write_text("Time [s],s\n1,2.5\n")
    (root / "A" / "~$late.txt").write_text("Time [s],s\n1,2.5\n")
    run()
    got = spark.read.parquet(out)
    assert got.count() == 3 * 4 * 11 + 1
    assert {r["Label"] for r in got.select("Label").distinct().collect()} == set(LABELS)
    assert set(got.columns) == {"file", "Time", "s", "Label"}


def test_lines_are_scanned_once(spark, tmp_path):
    p = raw.with_sensors(PROFILES["Coffee"], ("a", "b"))
    (tmp_path / "A").mkdir()
    (tmp_path / "A" / "one.txt").write_text("0\t0\n\n1\t-1\n")
    (tmp_path / "A" / "two.txt").write_text("5\t5\n")
    lines = raw.scan_lines(spark, str(tmp_path), p)
    assert sorted((r["name"], r["pos"]) for r in lines.collect()) == [("one.txt", 0), ("one.txt", 1), ("two.txt", 0)]
    plan = raw.read_labelled_raw(spark, str(tmp_path), p)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "Window" not in plan
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_written_files_are_those_of_a_partitioned_write(spark, tmp_path, scheme):
    from checks import files

    rows = [("a/b=c %", 1, 2, 1, "late"), ("a/b=c %", 1, 1, 9, "early"), (None, 2, 1, 1, "é"), ("", 3, 1, 1, None), ("x", 1, 1, 1, "other")]
    df = spark.createDataFrame(rows, "kind string, user bigint, time bigint, seq bigint, line string")
    spark.createDataFrame(rows, df.schema).select("kind", "user", "line").write.partitionBy("kind", "user").text(str(tmp_path / "spark"))
    files._write_lines(df, F.col("line"), scheme + str(tmp_path / "own"), "csv", "head")
    folders = lambda root: {str(f.parent.relative_to(root)) for f in root.rglob("part*")}
    assert folders(tmp_path / "own") == folders(tmp_path / "spark")
    texts = sorted(f.read_text() for f in (tmp_path / "own").rglob("part*"))
    assert texts == ["head\n\n", "head\nearly\nlate\n", "head\nother\n", "head\né\n"]
    assert not [f for f in (tmp_path / "own").rglob("*") if f.name.startswith(".")]


def test_a_merge_reads_no_other_files(spark, tmp_path):
    """A damaged file beside the result tables, or below the old folder, is not opened."""
    (tmp_path / "Old result").mkdir()
    (tmp_path / "a%20b").mkdir()
    head = ",".join(ledger_io.LEDGER_SCHEMA.names)
    (tmp_path / "notes.gz").write_bytes(b"no archive")
    (tmp_path / "Old result" / "old_results.csv").mkdir()
    (tmp_path / "Old result" / "old_results.csv" / "part-0.gz").write_bytes(b"no archive")
    (tmp_path / "a%20b" / "X_results.csv").write_text("\n" + head + "\nX,1,5,2,1,KNN,Baseline,0.5,0.4,p,1.5\n")
    rows = ledger_io.merge_results(spark, str(tmp_path)).collect()
    assert [(r["Dataset"], r["ExecutionTime_Sec"]) for r in rows] == [("X", 1.5)]
    found = ledger_io.result_headers(spark, str(tmp_path)).collect()
    assert [(r["file"].endswith("/a%20b/X_results.csv"), r["known"]) for r in found] == [(True, 11)]
