"""What the finding queries share: the code view, different lines, and findings that lie by file."""

from __future__ import annotations

import re

import duckdb
from pyspark.sql import functions as F

from codesift.functions.text import different_lines, explode_lines
from codesift.operators.findings import resolve_overlaps, summary
from codesift.sources import files as sources
from codesift.sources.corpus import files, files_sql


def plan(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def test_code_view_of_odd_tables(spark, tmp_path):
    """Orders twice, without lines or without a key, and a key over many batches, in one shuffle."""
    orders = [(1, 5), (1, 6), (2, 7), (None, 3), (4, 8), (26, 1)]
    items = [(1, 2, 10, 3), (1, 1, 11, 4), (1, 1, 11, 2), (3, 1, 1, 1), (None, 1, 1, 1), (4, 1, 58, 44)] + [(26, n, n * 3, 1) for n in range(1, 300)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        view = files(spark, str(tmp_path))
        shuffles = len(re.findall("Exchange hashpartitioning", plan(view)))
        got = sorted(tuple(r) for r in view.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == sorted(con.execute(f"with {files_sql()} select file_id, path, content from files").fetchall()) and len(got) == 4
    assert shuffles == 1


def test_different_lines(spark):
    df = spark.createDataFrame([("a\n\nb\r\na",), ("",), (None,), ("b\n",), ("é\n𝒳",)], "content string")
    assert sorted(r.line for r in different_lines(df).collect()) == ["", "a", "b", "b\r", "é", "𝒳"]
    assert different_lines(df.limit(0)).count() == 0
    assert "size(split" not in plan(explode_lines(df.withColumn("path", F.lit("p"))))


def test_findings_lie_by_file(spark):
    rows = [("a", 1, "high", "xss", "m"), ("a", 1, "low", "xss", "m"), ("a", 2, "high", "auth", "m"), ("b", 1, None, "xss", "m"), (None, 1, "low", "xss", "m")]
    found = spark.createDataFrame(rows, "path string, line_no int, severity string, category string, message string")
    found = found.withColumns({"scanner": F.lit("security"), "scanner_ord": F.lit(0), "pattern_ord": F.lit(0), "col": F.lit(1), "rule_id": F.lit("r")})
    total = summary(resolve_overlaps(found))
    assert len(re.findall("Exchange hashpartitioning", plan(total))) == 2
    assert {(r.dimension, r.value): (r.n, r.files) for r in total.collect()} == {
        ("total", "all"): (4, 2), ("severity", "high"): (2, 1), ("severity", "low"): (1, 0), ("severity", "all"): (1, 1),
        ("scanner", "security"): (4, 2), ("category", "xss"): (3, 2), ("category", "auth"): (1, 1),
    }


def test_extensions(spark):
    want = {"a/b.JS": ".js", "a.b/c": "", ".js": "", "x/.js": "", "a\\.js": "", "..": ".", "a.": ".", "q.tar.GZ": ".gz", "a.b\n": ".b\n", "": ""}
    df = spark.createDataFrame([(p,) for p in want], "path string")
    assert {r.path: r.e for r in df.select("path", sources.extension(F.col("path")).alias("e")).collect()} == want
