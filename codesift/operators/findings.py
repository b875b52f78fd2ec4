"""From matches to findings: snippets, fingerprints, duplicates, overlaps, order and summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codesift.functions.text import fingerprint, severity_rank, snippet

#: The order in which findings arise; every choice of a first one follows it.
ORDINALS = ("path", "scanner_ord", "pattern_ord", "line_no", "col")


#: Lines before and after a finding that its snippet shows.
AROUND = 3


def findings(files: DataFrame, matched: DataFrame, scanner: str = "security", scanner_ord: int = 0) -> DataFrame:
    """Matches (path, line_no, col, pattern_ord, rule columns) with snippet, fingerprint, id and extent.

    Matches that carry a snippet need no join; others meet the content of their file.
    """
    rows = matched
    if "snippet" not in matched.columns:
        rows = matched.join(files.select("path", "content"), "path").withColumn("snippet", snippet(F.col("content"), F.col("line_no"), AROUND)).drop("content")
    rows = rows.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("path"), F.col("snippet")))
    return rows.select(
        "*",
        F.lit(scanner).alias("scanner"),
        F.lit(scanner_ord).alias("scanner_ord"),
        F.concat(F.lit(f"{scanner}-"), "fingerprint").alias("id"),
        F.col("line_no").alias("end_line"),
        F.col("col").alias("end_col"),
        F.greatest(F.lit(1), F.col("line_no") - AROUND).alias("snippet_line"),
    )


def first_of_fingerprint(found: DataFrame) -> DataFrame:
    """Of findings with one fingerprint the first stays.  A fingerprint is made of its path too, so equal ones lie in one file."""
    order = Window.partitionBy("path", "fingerprint").orderBy(*ORDINALS)
    # Dealt out before the window, as else Spark sorts all rows before the shuffle too, which drops next to none; by file, as overlaps
    # and summaries are, so that one shuffle serves all, and none is made where findings lie by file already.
    return found.repartition("path").withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def resolve_overlaps(found: DataFrame) -> DataFrame:
    """Of security findings on one line and category the best stays: not from a rule file, severe, long message, first."""
    keys = ("path", "line_no", "category", "scanner")
    # Paths begin alike, so rows are sorted by a hash of the keys first; files stay whole for what counts by file.
    best = Window.partitionBy(F.xxhash64(*keys), *keys).orderBy(F.col("rule_id").startswith("security/"), severity_rank(F.col("severity")), F.length("message").desc(), *ORDINALS)
    # One pass: two branches would run the scan twice.
    return found.repartition("path").withColumn("_nth", F.row_number().over(best)).where("scanner <> 'security' or _nth = 1 and scanner is not null").drop("_nth")


def of_severity(found: DataFrame, severities: Sequence[str]) -> DataFrame:
    """Security findings of the listed severities, and all others; an empty list keeps all."""
    return found.where((F.col("scanner") != "security") | F.col("severity").isin(*severities)) if severities else found


def ordered(found: DataFrame) -> DataFrame:
    """By severity, then file in the order of a dictionary, then as they arose."""
    return found.orderBy(severity_rank(F.col("severity")), F.collate("path", "UNICODE"), *ORDINALS)


def summary(found: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """dimension, value, n and files: all findings, by severity, scanner, category, and distinct files, in one pass.

    ``scanned`` adds a row ``scanned`` with the number of files that were looked at, readable or not.
    """
    sizes = found.groupBy("path", "severity", "scanner", "category").agg(F.count(F.lit(1)).alias("n"))
    total = F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value"))
    each = [F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("severity", "scanner", "category")]
    # Each file once: findings that lie by file are counted without a shuffle but for these few rows.
    by_file = sizes.select("path", "n", F.inline(F.array(total, *each))).groupBy("path", "dimension", "value").agg(F.sum("n").alias("n"))
    rows = by_file.groupBy("dimension", "value").agg(F.sum("n").alias("n"), F.count("path").alias("files"))
    rows = rows.select("dimension", F.coalesce("value", F.lit("all")).alias("value"), "n", "files")
    if scanned is None:
        return rows
    n = F.count(F.lit(1))
    return rows.unionByName(scanned.agg(F.lit("scanned").alias("dimension"), F.lit("all").alias("value"), n.alias("n"), n.alias("files")))


def exit_code(found: DataFrame) -> DataFrame:
    """One row: 1 if any finding is critical or high, else 0."""
    return found.agg(F.coalesce(F.max(F.when(F.col("severity").isin("critical", "high"), 1).otherwise(0)), F.lit(0)).alias("exit_code"))
