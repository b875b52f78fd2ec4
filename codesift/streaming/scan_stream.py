"""Scanning files as they arrive: the batch operators on a stream, duplicates dropped by fingerprint."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.detectors import Pattern
from codesift.functions.text import explode_lines, fingerprint
from codesift.operators.match import RULE_COLUMNS, matches, rules_of, with_file_flags


def read_stream(spark: SparkSession, folder: str, schema: str = "path string, content string, seen timestamp") -> DataFrame:
    """Files as rows of Parquet that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def scan_stream(files: DataFrame, patterns: Sequence[Pattern], within: str = "1 hour") -> DataFrame:
    """Findings of a stream of files (path, content, seen): a line that was reported within the time is not reported again.

    State holds fingerprints only, and the watermark lets them go.
    """
    seen = files.withWatermark("seen", within)
    lines = explode_lines(with_file_flags(seen.select("path", "content", "seen"), patterns))
    table = files.sparkSession.createDataFrame(rules_of(patterns), RULE_COLUMNS)
    found = matches(lines, patterns, keep=("seen",)).join(F.broadcast(table), "pattern_ord")
    found = found.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("path"), F.col("line")))
    return found.dropDuplicatesWithinWatermark(["fingerprint"]).select("path", "line_no", "col", "rule_id", "severity", "fingerprint", "seen")


def severity_counts(found: DataFrame, window: str = "10 minutes") -> DataFrame:
    return found.groupBy(F.window("seen", window), "severity").agg(F.count(F.lit(1)).alias("n"))
