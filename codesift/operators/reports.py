"""Report rows: CSV, SARIF, HTML filters, and the budget of a validator."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyarrow.fs import FileSelector, FileType
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codesift.functions.text import severity_rank
from codesift.operators.findings import ORDINALS, ordered, summary
from codesift.session import written
from codesift.sources.jsonlist import RANGE, read_list
from codesift.sources.onefile import write_one
from codesift.sources.tree import opened, readable_by_tree

#: The columns of a CSV report.
CSV_HEADER = ("ID", "Rule", "Scanner", "Severity", "Confidence", "Category", "File", "Line", "Title", "Message")


def csv_field(value: Column) -> Column:
    """Quoted if it holds a comma, a quote or a line end."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike("[\",\\r\\n]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(*values: Column) -> Column:
    return F.concat_ws(",", *map(csv_field, values))


def csv_report(found: DataFrame) -> DataFrame:
    """One text column, ready for ``write.text``; header, byte-order mark and CRLF belong to the file writer."""
    columns = ("id", "rule_id", "scanner", "severity", "confidence", "category", "path", "line_no", "message", "message")
    return found.select(csv_line(*(F.col(c) for c in columns)).alias("value"))


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def sarif_rules(found: DataFrame) -> DataFrame:
    """rule_id, rule_index in the order of first sight, and the number of results.  Rules are few: their order is one small window."""
    seen = found.groupBy("rule_id").agg(F.min(F.struct("path", "pattern_ord", "line_no", "col")).alias("seen"), F.count(F.lit(1)).alias("results"))
    return seen.select("rule_id", (F.row_number().over(Window.orderBy("seen")) - 1).cast("long").alias("rule_index"), "results")


def sarif_results(found: DataFrame, in_order: bool = False) -> DataFrame:
    """A JSON result for each finding, with the index of its rule, and for a taint flow its way from source to sink; in the order of a report if asked."""
    place = F.struct(F.struct(F.struct(F.translate("path", "\\", "/").alias("uri")).alias("artifactLocation"), F.struct(F.col("line_no").alias("startLine"), F.col("col").alias("startColumn")).alias("region")).alias("physicalLocation"))
    spot = lambda line, text: F.struct(F.struct(F.struct(F.struct(F.translate("path", "\\", "/").alias("uri")).alias("artifactLocation"), F.struct(line.cast("int").alias("startLine")).alias("region")).alias("physicalLocation"), F.struct(text.alias("text")).alias("message")).alias("location"))
    flow = []
    if "source_line" in found.columns:
        steps = F.array(spot(F.col("source_line"), F.lit("source")), spot(F.col("line_no"), F.col("message")))
        flow = [F.when(F.col("source_line").isNotNull(), F.array(F.struct(F.array(F.struct(steps.alias("locations"))).alias("threadFlows")))).alias("codeFlows")]
    # Rules of advisories may be many: Spark broadcasts their table if it is small enough.
    joined = found.join(sarif_rules(found).drop("results"), "rule_id")
    if in_order:
        joined = ordered(joined)
    return joined.select(F.to_json(F.struct(*flow, F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), sarif_level(F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("fingerprint").alias("primary")).alias("fingerprints"))).alias("value"))


def sarif_descriptors(found: DataFrame) -> DataFrame:
    """A JSON object for each rule, in the order of their indexes: id, level, text, category and weaknesses as its first finding has them."""
    first = F.min_by(F.struct("severity", "message", "category", "cwe"), F.struct("path", "pattern_ord", "line_no", "col", "fingerprint")).alias("first")
    rows = sarif_rules(found).join(found.groupBy("rule_id").agg(first), "rule_id").orderBy("rule_index")
    told = F.struct(F.col("first.category").alias("category"), F.when(F.col("first.cwe") != "", F.array("first.cwe")).alias("cwe"))
    return rows.select(F.to_json(F.struct(F.col("rule_id").alias("id"), F.struct(F.col("first.message").alias("text")).alias("shortDescription"), F.struct(sarif_level(F.col("first.severity")).alias("level")).alias("defaultConfiguration"), told.alias("properties"))).alias("value"))


def sarif_taxa(found: DataFrame) -> DataFrame:
    """Each weakness with its results and rules."""
    return found.where("cwe <> ''").groupBy("cwe").agg(F.count(F.lit(1)).alias("results"), F.countDistinct("rule_id").alias("rules"))


def sarif(found: DataFrame, version: str = "1") -> DataFrame:
    """One row: a SARIF 2.1.0 log.  For logs that one file holds; ``sarif_results`` is the table of a large scan."""
    rules = sarif_rules(found).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rule_index", "rule_id"))), lambda r: F.struct(r["rule_id"].alias("id")))).alias("rules"))
    taxa = sarif_taxa(found).agg(F.to_json(F.transform(F.array_sort(F.collect_list("cwe")), lambda c: F.struct(c.alias("id")))).alias("taxa"))
    results = sarif_results(found).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("value")), ","), F.lit("]")).alias("results"))
    one = F.lit(1).alias("one")
    parts = rules.select("*", one).join(taxa.select("*", one), "one").join(results.select("*", one), "one")
    driver = F.concat(F.lit('{"name":"codesift","version":"' + version + '","rules":'), "rules", F.lit("}"))
    return parts.select(F.concat(F.lit('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":'), driver, F.lit('},"taxonomies":[{"name":"CWE","taxa":'), "taxa", F.lit('}],"results":'), "results", F.lit("}]}")).alias("value"))


def json_report(found: DataFrame) -> DataFrame:
    """A JSON object for each finding, a line each."""
    return found.select(F.to_json(F.struct(*found.columns)).alias("value"))


#: What ``read_report`` reads of a report; other fields are left.
REPORT = "findings array<struct<id:string,rule_id:string,scanner:string,severity:string,confidence:string,category:string,path:string,line_no:int,col:int,message:string,cwe:string,snippet:string,fingerprint:string>>"


def _of_lines(values: DataFrame) -> DataFrame:
    """A finding for each JSON object in ``value``; what is none, or names no rule, is left out."""
    one = REPORT[len("findings array<struct<") : -2].replace(":", " ")
    return values.select(F.from_json("value", one).alias("f")).where("f.rule_id is not null").select("f.*")


def read_report(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """The findings of JSON reports that hold them as a list, or one a line.

    A report in one file is read by many tasks, ``size`` bytes each, in either
    form; so is a folder that Spark wrote.  In other folders each file is a row.
    """
    if readable_by_tree(path):
        system, inner = opened(path)
        if system.get_file_info(inner).type == FileType.File:
            listed = read_list(spark, path, "findings", size)
            if listed is not None or not path.lower().endswith(".gz"):
                return _of_lines(spark.read.text(path) if listed is None else listed)
            # Of other gzip files the text is not known before they are read from the begin.
            return _of_texts(spark, path)
        names = [f.base_name for f in system.get_file_info(FileSelector(inner)) if not f.base_name.startswith((".", "_"))]
        if names and all(n.startswith("part-") for n in names):
            return _of_lines(spark.read.text(path))
    return _of_texts(spark, path)


def _of_texts(spark: SparkSession, path: str) -> DataFrame:
    """The findings of files that are a row each."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", REPORT)["findings"].alias("fs"), "value")
    whole = rows.where("fs is not null").select(F.explode("fs").alias("f")).select("f.*")
    return whole.unionByName(_of_lines(rows.where("fs is null").select(F.explode(F.split("value", "\n")).alias("value")).where("value <> ''")))


def console_rows(found: DataFrame) -> DataFrame:
    """path, line_no, severity, rule_id and text, in the order of a terminal report: by file, then severity, then line."""
    text = F.format_string("%s:%d  %s  %s  %s", "path", "line_no", F.rpad(F.col("severity"), 8, " "), "rule_id", "message")
    return found.select("path", "line_no", "severity", "rule_id", text.alias("text")).orderBy("path", severity_rank(F.col("severity")), "line_no", "rule_id")


def bars(totals: DataFrame, width: int = 40) -> DataFrame:
    """The rows of a summary with a bar of at most ``width`` signs, in proportion to the total."""
    total = F.max(F.when(F.col("dimension") == "total", F.col("n"))).over(Window.partitionBy())
    return totals.withColumn("bar", F.repeat(F.lit("#"), F.ceil(F.lit(width) * F.col("n") / F.greatest(total, "n", F.lit(1))).cast("int")))


#: Report formats, by name: findings to a column ``value``.
FORMATS = {"json": json_report, "csv": csv_report, "sarif": sarif, "console": lambda found: console_rows(found).select(F.col("text").alias("value"))}


def write_report(found: DataFrame, path: str, kind: str) -> None:
    """A folder of text files; a CSV report has its header in the first."""
    rows = FORMATS[kind](found)
    if kind == "csv":
        header = found.sparkSession.createDataFrame([(",".join(CSV_HEADER),)], "value string")
        rows = header.unionByName(rows)
    rows.write.text(path)


def write_file(found: DataFrame, path: str, kind: str, totals: DataFrame | None = None, about: dict | None = None, overwrite: bool = False) -> None:
    """A report as one file that many tasks write, findings in the order of a report.

    json: an object with ``about`` (version, target, settings), the summary
    and the findings, one a line; csv: with a byte-order mark and CRLF; sarif: a
    2.1.0 log with rules, weaknesses and results; console: lines.  No task and
    no row holds the report.  ``found`` is read several times for sarif: pass a
    written table.
    """
    about = {"version": "1", "tool": "codesift"} | (about or {})
    text = lambda value: json.dumps(value, ensure_ascii=False, sort_keys=True)
    if kind == "csv":
        write_one([csv_report(ordered(found))], path, ["\ufeff" + ",".join(CSV_HEADER) + "\r\n", ""], terminator="\r\n", overwrite=overwrite)
    elif kind == "console":
        write_one([FORMATS[kind](found)], path, ["", ""], terminator="\n", overwrite=overwrite)
    elif kind == "sarif":
        driver = text({"name": about["tool"], "version": about["version"]})[:-1]
        head = '{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":' + driver + ',"rules":[\n'
        taxa = sarif_taxa(found).orderBy("cwe").select(F.to_json(F.struct(F.col("cwe").alias("id"), F.col("cwe").alias("name"))).alias("value"))
        layout = [head, '\n]}},"taxonomies":[{"name":"CWE","taxa":[\n', '\n]}],"results":[\n', "\n]}]}\n"]
        write_one([sarif_descriptors(found), taxa, sarif_results(found, in_order=True)], path, layout, separator=",\n", overwrite=overwrite)
    elif kind == "json":
        # A few rows, worked out before, so that their shuffles are gone when the findings are put in order; files stay whole, as the count of each would shuffle twice else.
        by_file = found.select("path", "severity", "scanner", "category").repartition("path")
        totals = written(summary(by_file) if totals is None else totals, "summary").orderBy("dimension", "value")
        # As texts, which take less of a shuffle than rows of as many columns.
        listed = ordered(found.select("severity", *ORDINALS, F.to_json(F.struct(*found.columns)).alias("value")))
        layout = [text(about)[:-1] + ',"summary":[\n', '\n],"findings":[\n', "\n]}\n"]
        write_one([json_report(totals), listed], path, layout, separator=",\n", overwrite=overwrite)
    else:
        raise ValueError(f"no report format {kind}")


def is_file(path: str) -> bool:
    """Whether a report's path names a file: it ends in a format's extension, or that and .gz."""
    return path.lower().removesuffix(".gz").endswith((".json", ".sarif", ".csv", ".txt"))


def convert_report(spark: SparkSession, source: str, target: str, kind: str) -> None:
    """A JSON report in another format."""
    found = read_report(spark, source).select("*", F.lit(0).alias("scanner_ord"), F.lit(0).alias("pattern_ord"))
    if is_file(target):
        write_file(written(found, "report"), target, kind)
    else:
        write_report(found, target, kind)


def ranked_in_file(found: DataFrame) -> DataFrame:
    """The place of a finding's severity among those of its file, from 1."""
    return found.withColumn("file_rank", F.dense_rank().over(Window.partitionBy("path").orderBy(severity_rank(F.col("severity")))).cast("long"))


#: What a search looks at.
SEARCHED = ("message", "rule_id", "path", "category", "cwe", "snippet")


def filtered(found: DataFrame, severities: Sequence[str] = (), scanners: Sequence[str] = (), categories: Sequence[str] = (), search: str = "", searched: Sequence[str] = SEARCHED) -> DataFrame:
    """Three facets, and a text that any of the searched columns holds in any letter case."""
    for column, values in (("severity", severities), ("scanner", scanners), ("category", categories)):
        if values:
            found = found.where(F.col(column).isin(*values))
    if search:
        found = found.where(reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lit(search.lower())) for c in searched if c in found.columns)))
    return found


def budget(found: DataFrame, n: int) -> DataFrame:
    """checked: whether a finding is among the first ``n`` of its file, which a validator sees."""
    order = Window.partitionBy("path").orderBy(*ORDINALS[1:])
    return found.withColumn("checked", F.row_number().over(order) <= n)


def duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60000, F.format_string("%.2fs", ms / 1000)).otherwise(F.format_string("%dm %ds", F.floor(ms / 60000), F.floor(ms % 60000 / 1000)))
