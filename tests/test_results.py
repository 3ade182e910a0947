"""Result tables: no task writes or reads a whole one."""

import glob

from checks import files
from odorframe.session import fresh_path


def test_headers_of_tables_in_several_files(spark, tmp_path, monkeypatch):
    orders = spark.range(40).selectExpr("id AS o_orderkey", "'1-URGENT' AS o_orderpriority")
    lines = "id AS l_orderkey, id AS l_partkey, id AS l_suppkey, 1 AS l_linenumber, 1.0D AS l_quantity, 0.1D AS l_discount, 0.1D AS l_tax"
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(0, 40, 1, 4).selectExpr(*lines.split(", ")).write.parquet(f"{tmp_path}/lineitem.parquet")
    root = fresh_path(spark, "headers")
    monkeypatch.setattr(files, "fresh_path", lambda *_: root)
    was = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    try:
        found = sorted(tuple(r) for r in files.headers(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", was)
    assert found == [("none", 1, 0), ("one", 2, 1), ("whole", 11, 11)]
    assert len(glob.glob(root.removeprefix("file:") + "/whole_results.csv/part-*")) > 1
