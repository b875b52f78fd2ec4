"""The scan: files to findings, through routing, detectors, duplicates, overlaps, order and summary."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.config import Config
from codesift.detectors.api import API
from codesift.detectors.auth import AUTH
from codesift.detectors.crypto import CRYPTO
from codesift.detectors.file_ops import FILE_OPS
from codesift.detectors.injection import INJECTION
from codesift.detectors.secrets import SECRETS
from codesift.detectors.xss import XSS
from codesift.functions.lexer import harmless
from codesift.functions.text import different_lines, explode_lines, severity_rank
from codesift.operators import dependencies, flow, quality, taint
from codesift.operators.findings import AROUND, ORDINALS, exit_code, findings, first_of_fingerprint, of_severity, ordered, resolve_overlaps, summary
from codesift.operators.many import detect_many
from codesift.operators.match import detect
from codesift.session import written
from codesift.sources.files import by_path, dealt, discover, ignore_lines, read_files, route
from codesift.sources.rules import read_rules, rule_patterns
from codesift.sources.tree import read_tree, readable_by_tree

HAND_WRITTEN = (*INJECTION, *XSS, *AUTH, *CRYPTO, *FILE_OPS, *API, *SECRETS)
RULE_PATTERNS, RULE_LANGUAGES = rule_patterns(read_rules())


#: Categories whose matches are text by nature: they stand in literals and count there.
TEXTUAL = ("secrets",)
#: Patterns beyond which lines walk an automaton instead of trying each; results are the same.
MANY = 500


def security_findings(routed: DataFrame, patterns=RULE_PATTERNS, languages: Sequence[tuple[str, ...]] = RULE_LANGUAGES, contexts: bool = False, by_file: bool = False) -> DataFrame:
    """Findings of the hand-written detectors and of the rules that run on a file's language, before duplicates go.

    One pass over the files: language and snippet travel with the lines.
    ``contexts`` drops matches in text that does nothing (``functions.lexer``).
    ``by_file`` deals the files out by path first, so that duplicates and overlaps are settled where the findings lie:
    a shuffle of texts, which are shorter than their findings with snippets.
    """
    source = routed.where("to_security")
    files = dealt(source) if by_file else source
    every = (*HAND_WRITTEN, *patterns)
    along = ()
    if contexts:
        files, along = files.withColumn("_harmless", harmless(F.col("language"), F.col("content"))), ("_harmless",)
    if len(every) > MANY:
        found = detect_many(files, every, ("language",), AROUND, along)
    else:
        found = detect(files, every, ("language",), AROUND, along, source)
    table = files.sparkSession.createDataFrame([(len(HAND_WRITTEN) + k, list(x)) for k, x in enumerate(languages)], "pattern_ord int, runs_on array<string>")
    found = found.join(F.broadcast(table), "pattern_ord", "left")
    found = found.where(F.col("runs_on").isNull() | F.array_contains("runs_on", "*") | F.array_contains("runs_on", F.col("language"))).drop("runs_on", "language")
    if contexts:
        idle = F.exists("_harmless", lambda s: (s["begin"] <= F.col("col")) & (F.col("col") < s["end"]))
        found = found.where(F.col("category").isin(*TEXTUAL) | ~idle).drop("_harmless")
    return findings(files, found)


def quality_findings(routed: DataFrame, config: Config = Config()) -> DataFrame:
    """path, line_no, rule_id, severity, category and message of all quality operators."""
    source = routed.where("to_quality")
    return _quality_findings(dealt(source), source, config)


def _quality_findings(files: DataFrame, source: DataFrame, config: Config) -> DataFrame:
    """Of files dealt out by path: lines never leave the task of their file.  ``source``: the files as they lie, whose different lines are measured."""
    lines = explode_lines(files)
    different = different_lines(source)
    t = config.thresholds

    def named(df: DataFrame, rule: str, category: str, message: str, severity: str | None = None, line: str = "line_no") -> DataFrame:
        return df.select("path", F.col(line).cast("int").alias("line_no") if line else F.lit(1).alias("line_no"), F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity") if severity else F.col("severity"), F.lit(category).alias("category"), F.lit(message).alias("message"))

    functions = quality.complexity_findings(quality.functions(lines, different), t.complexity, t.function_lines)
    parts = [
        # Rows that came through Python have to be told again that they lie by file; few functions are too long.
        by_path(functions.select("path", "line_no", "rule_id", "severity", F.lit("complexity").alias("category"), F.concat(F.lit("function "), "name").alias("message"))),
        named(quality.deep_nesting(lines, t.nesting), "QUA-CMPLX-003", "complexity", "deep nesting"),
        named(quality.long_files(files, t.file_lines), "QUA-SMELL-001", "code-smell", "long file", line=""),
        named(quality.unused_imports(lines), "QUA-SMELL-002", "code-smell", "unused import", "low"),
        named(quality.magic_numbers(lines), "QUA-SMELL-003", "code-smell", "magic number", "low"),
        named(quality.console_statements(lines), "QUA-SMELL-004", "code-smell", "console statement", "low"),
        named(quality.todo_tags(lines), "QUA-SMELL-005", "code-smell", "task tag"),
        named(quality.empty_catches(lines), "QUA-SMELL-006", "code-smell", "empty catch", "medium"),
        named(quality.duplicate_findings(quality.blocks(lines, different=different)), "QUA-DUP-001", "duplication", "duplicate block", line="a_start"),
        quality.metric_findings(quality.metrics(lines), t.comment_ratio).select("path", F.lit(1).alias("line_no"), "rule_id", F.lit("low").alias("severity"), F.lit("metrics").alias("category"), "message"),
    ]
    return reduce(DataFrame.unionByName, (p.withColumn("pattern_ord", F.lit(k)) for k, p in enumerate(parts)))


def quality_scanner(routed: DataFrame, config: Config = Config()) -> DataFrame:
    """The quality findings with the columns of the security findings."""
    source = routed.where("to_quality")
    files = dealt(source)
    found = _quality_findings(files, source, config).select("*", F.lit(1).alias("col"), F.lit("high").alias("confidence"))
    return findings(files, found, "quality", 1)


def cve_scanner(routed: DataFrame, advisories: DataFrame) -> DataFrame:
    """Findings of advisories that apply to the manifests' dependencies."""
    deps = dependencies.dependencies(routed.where("to_cve").select("path", "content"))
    # Written, so that the shuffles of manifests and intervals are gone when the findings are made.
    matched = written(dependencies.match_advisories(deps, advisories), "matches")
    found = dependencies.cve_findings(matched, advisories)
    return found.select(
        "path", "line_no", "rule_id", "severity", "fingerprint", "id",
        F.lit(1).alias("col"), F.lit(0).alias("pattern_ord"), F.lit("high").alias("confidence"), F.lit("cve").alias("category"), F.col("title").alias("message"),
        F.concat_ws(" ", "name", "version").alias("hit"), F.lit("cve").alias("scanner"), F.lit(2).alias("scanner_ord"), F.array("reference").alias("references"),
    )


def taint_scanner(routed: DataFrame) -> DataFrame:
    """Findings of taint flows, part of the security scanner in a deep scan."""
    files = routed.where("to_security")
    found = taint.taint_findings(flow.structure_flows(files.select("path", "language", "content")))
    message = F.concat(F.lit("data from "), "source", F.lit(" (line "), F.col("source_line"), F.lit(") reaches "), "sink")
    found = found.select("path", "line_no", "rule_id", "severity", "category", "confidence", "cwe", message.alias("message"), F.lit(1).alias("col"), F.lit(1_000_000).alias("pattern_ord"), F.col("sink").alias("hit"), "source_line")
    return findings(files, found)


@dataclass(frozen=True)
class Scan:
    """The tables of a scan; of a folder, the files have been read into a table, else nothing has run yet.

    files: what is scanned; unreadable: path and size of files left out as they
    are not UTF-8; findings: in order; summary; exit_code: one row.
    """

    files: DataFrame
    unreadable: DataFrame
    findings: DataFrame
    summary: DataFrame
    exit_code: DataFrame


#: A further scanner: routed files to rows with the columns of the security findings.
Scanner = Callable[[DataFrame], DataFrame]


def scan(spark: SparkSession, source: str | DataFrame, config: Config = Config(), scanners: Sequence[Scanner] = (), advisories: DataFrame | None = None) -> Scan:
    """Scans a folder, or a table with path and content, with the scanners that the configuration turns on.

    advisories: rows of ``operators.dependencies.ADVISORY``, which the cve
    scanner needs.  A file that cannot be read takes part in nothing and fails
    nothing; it counts as scanned.
    """
    root = source if isinstance(source, str) else ""
    ignore = [*(ignore_lines(spark, root) if root else ()), *config.exclude]
    # Stores that only Spark's readers know are read by them, without names that begin with an underscore.
    files = source if not root else read_tree(spark, root, ignore) if readable_by_tree(root) else read_files(spark, root)
    if "readable" not in files.columns:
        files = files.withColumn("readable", F.col("content").isNotNull())
    chosen = route(discover(files, ignore, config.languages, config.include, root))
    if root:
        # Listed and opened once; all scanners read this table, each the columns it needs.
        chosen = written(chosen, "files")
    routed = chosen.where(F.col("readable") & (F.length("content") > 0))
    parts = []
    if config.security:
        patterns, languages = rule_patterns(read_rules(config.rules_path))
        parts.append(of_severity(security_findings(routed, patterns, languages, contexts=True, by_file=True), config.severities))
        if config.deep:
            parts.append(of_severity(taint_scanner(routed), config.severities))
    if config.quality:
        parts.append(quality_scanner(routed, config))
    if config.cve:
        if advisories is None:
            raise ValueError("the cve scanner needs advisories")
        parts.append(cve_scanner(routed, advisories))
    parts += [extra(routed) for extra in scanners]
    if not parts:
        raise ValueError("no scanner is on")
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    final = resolve_overlaps(first_of_fingerprint(found))
    return Scan(chosen, chosen.where(~F.col("readable")).select("path", *(["size"] if "size" in chosen.columns else [])), ordered(final), summary(final, chosen), exit_code(final))


def envelope(result: Scan, target: str, config: Config = Config(), version: str = "1") -> DataFrame:
    """One row: version, tool, target, config, summary and findings as nested values.

    For reports that one file holds; large scans write ``findings`` as a table.
    """
    totals = result.summary.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws(":", "dimension", "value"), "n")))).alias("summary"))
    listed = result.findings.withColumn("rank", severity_rank(F.col("severity")))
    every = listed.agg(F.array_sort(F.collect_list(F.struct("rank", *ORDINALS, *(c for c in listed.columns if c not in ("rank", *ORDINALS))))).alias("findings"))
    settings = F.lit(json.dumps(asdict(config), sort_keys=True))
    return totals.withColumn("one", F.lit(1)).join(every.withColumn("one", F.lit(1)), "one").select(F.lit(version).alias("version"), F.lit("codesift").alias("tool"), F.lit(target).alias("target"), settings.alias("config"), "summary", "findings")
