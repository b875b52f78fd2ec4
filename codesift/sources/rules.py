"""Rules as tables: reading rule files, validation, filters, and conversion of another rule format."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.detectors import Pattern
from codesift.detectors import crypto, file_ops, secrets, xss, api
from codesift.detectors.rules import RULES

SEVERITIES, CONFIDENCES = ("critical", "high", "medium", "low"), ("high", "medium", "low")
#: Categories of the security and quality scanners, and those whose rules the security scanner runs.
SECURITY = ("injection", "xss", "auth", "crypto", "file-ops", "secrets")
QUALITY = ("complexity", "code-smell", "duplication", "metrics", "naming")
RUN_BY_SECURITY = (*SECURITY, "api-security")

SCHEMA = (
    "id string, name string, description string, category string, subcategory string, severity string, confidence string, cwe array<string>, owasp array<string>, languages array<string>, "
    "patterns array<struct<pattern:string,message:string,regex:string,regexFlags:string>>, tags array<string>, references array<string>, enabled boolean"
)


def validated(rules: Iterable[dict]) -> list[dict]:
    """The rules with defaults; ValueError names the first that is not valid, and so rejects its whole file."""
    out = []
    for r in rules:
        for key in ("id", "name", "category", "severity"):
            if not isinstance(r.get(key), str) or not r[key]:
                raise ValueError(f"rule {r.get('id')!r}: {key} is missing")
        if r["severity"] not in SEVERITIES or r.get("confidence", "medium") not in CONFIDENCES:
            raise ValueError(f"rule {r['id']!r}: unknown severity or confidence")
        patterns = r.get("patterns")
        if not isinstance(patterns, list) or any(not (p.get("regex") or p.get("pattern")) for p in patterns):
            raise ValueError(f"rule {r['id']!r}: a pattern needs pattern or regex")
        defaults = {"description": "", "subcategory": None, "confidence": "medium", "cwe": [], "owasp": [], "languages": ["*"], "tags": [], "references": [], "enabled": True}
        keep = {k: r.get(k, v) for k, v in defaults.items()} | {k: r[k] for k in ("id", "name", "category", "severity")}
        keep["patterns"] = [{k: p.get(k) for k in ("pattern", "message", "regex", "regexFlags")} for p in patterns]
        out.append(keep)
    return out


def read_rules(path: str | None = None) -> list[dict]:
    """The built-in rules, then those of a rule file or of one folder of them; of equal ids the last wins, in the first's place."""
    found = {r["id"]: r for r in validated(RULES)}
    if path:
        p = Path(path)
        if not p.exists():
            raise FileNotFoundError(path)
        for f in sorted(x for x in (p.iterdir() if p.is_dir() else [p]) if x.suffix in (".yml", ".yaml")):
            loaded = yaml.safe_load(f.read_text()) or {}
            try:
                found |= {r["id"]: r for r in validated(loaded.get("rules", []))}
            except ValueError:
                continue
    return list(found.values())


def rules_table(spark: SparkSession, rules: Sequence[dict]) -> DataFrame:
    names = [c.split(" ")[0] for c in re.split(r", (?![^<]*>)", SCHEMA)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rules], SCHEMA)


def id_regex(pattern: str) -> str:
    """A rule-id pattern: ``*``, an id, ``prefix/*``, or an expression in which ``*`` is any text and ``?`` any character."""
    if pattern == "*":
        return "^.*$"
    if not re.search(r"[*?]", pattern):
        return "^" + re.escape(pattern) + "$"
    if pattern.endswith("/*"):
        return "^" + re.escape(pattern[:-1]) + ".*$"
    return "^" + pattern.replace("*", ".*").replace("?", ".") + "$"


def selected(rules: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), id_col: str = "id") -> DataFrame:
    """Rows whose id fits any include pattern (all, if there are none or one is ``*``) and no exclude pattern."""
    for patterns, keep in ((include if "*" not in include else (), True), (exclude, False)):
        if patterns:
            fits = F.col(id_col).rlike("|".join(map(id_regex, patterns)))
            rules = rules.where(fits if keep else ~fits)
    return rules


def for_language(files: DataFrame, rules: DataFrame) -> DataFrame:
    """path and id of each enabled rule that runs on a file: by its language, or by the wildcard.

    The languages are exploded, so both branches are hash joins.
    """
    each = rules.where(F.coalesce("enabled", F.lit(True))).select("id", F.explode("languages").alias("language")).distinct()
    wild = each.where("language = '*'").select("id")
    own = files.select("path", "language").join(F.broadcast(each.where("language <> '*'")), "language").select("path", "id")
    listed = [r.id for r in wild.orderBy("id").collect()]  # rule ids: a configuration, not data
    all_files = files.select("path", F.explode(F.array(*map(F.lit, listed))).alias("id")) if listed else None
    return (own.unionByName(all_files) if all_files is not None else own).distinct()


def by_id(rules: DataFrame, rule_id: str) -> DataFrame:
    return rules.where(F.col("id") == rule_id)


def categories(rules: DataFrame) -> DataFrame:
    """category, scanner and rules (how many there are) of every category, those without rules too."""
    spark = rules.sparkSession
    known = spark.createDataFrame([(c, "security") for c in RUN_BY_SECURITY] + [(c, "quality") for c in QUALITY] + [("cve", "cve")], "category string, scanner string")
    return known.join(rules.groupBy("category").agg(F.count(F.lit(1)).alias("rules")), "category", "left").na.fill(0, ["rules"])


def for_scanner(rules: DataFrame, scanner: str) -> DataFrame:
    return rules.where(F.col("category").isin(*(SECURITY if scanner == "security" else QUALITY)))


def listed(rules: DataFrame, category: str | None = None, severity: str | None = None, language: str | None = None, scanner: str | None = None) -> DataFrame:
    """The rows of a rule listing."""
    if category:
        rules = rules.where(F.col("category") == category)
    if severity:
        rules = rules.where(F.col("severity") == severity)
    if language:
        rules = rules.where(F.array_contains("languages", language) | F.array_contains("languages", "*"))
    if scanner:
        security = F.col("category").isin(*SECURITY)
        rules = rules.where(security if scanner == "security" else ~security)
    return rules.select("id", "name", "category", "severity", "confidence", "enabled")


def suppressions(rule: dict) -> dict:
    """What the matcher skips for a rule, by its id and category."""
    out: dict = {}
    if rule["category"] == "secrets" or "secret" in rule["id"] or "password" in rule["id"]:
        out = dict(secrets.ANYWHERE)
        if "secret" in rule["id"] or "password" in rule["id"]:
            out["skip_path"] = secrets.TESTS
    if rule["id"] in ("security/xss-innerhtml", "insecure-innerhtml"):
        out = dict(xss.HTML)
    if rule["id"] in ("security/weak-crypto", "SEC-CRYPTO-003"):
        out = {"skip_line": crypto.HARMLESS}
    if rule["id"] == "security/path-traversal":
        out = dict(file_ops.SKIP)
    if rule["id"] in ("security/xxe", "SEC-XXE-001"):
        out = dict(api.HARDENED)
    if rule["id"] in ("security/ssrf", "SEC-SRF-001", "SEC-SRF-002"):
        out = dict(api.CHECKED)
    return out


def rule_patterns(rules: Iterable[dict]) -> tuple[tuple[Pattern, ...], tuple[tuple[str, ...], ...]]:
    """The patterns of enabled rules that the security scanner runs, and the languages of each.

    Expressions that do not compile are left out, as is ``.*``, which fits every line.
    """
    patterns, languages = [], []
    for r in rules:
        if not r.get("enabled", True) or r["category"] not in RUN_BY_SECURITY:
            continue
        for p in r["patterns"]:
            regex = p.get("regex") or p["pattern"]
            try:
                groups = re.compile(regex).groups
            except re.error:
                continue
            if regex == ".*":
                continue
            if groups:
                regex = re.sub(r"(?<!\\)\((?!\?)", "(?:", regex)
            patterns.append(Pattern(r["id"], regex, p.get("message") or r["name"], r["severity"], r["confidence"], r["category"], r.get("subcategory") or "", (r["cwe"] or [""])[0], **suppressions(r)))
            languages.append(tuple(r["languages"]))
    return tuple(patterns), tuple(languages)


#: Severities of the other format, and categories by parts of an id, the first that fits.
CONVERTED_SEVERITY = {"ERROR": "high", "WARNING": "medium", "INFO": "low"}
CONVERTED_CATEGORY = (("sql", "injection"), ("injection", "injection"), ("xss", "xss"), ("auth", "auth"), ("jwt", "auth"), ("crypto", "crypto"), ("hash", "crypto"), ("secret", "secrets"), ("password", "secrets"), ("path", "file-ops"), ("file", "file-ops"))


def convert(rule: dict) -> dict:
    """A rule of the pattern-list format (id, severity, message, metadata, pattern, pattern-regex, patterns, pattern-either)."""
    meta = rule.get("metadata", {})
    found: list[dict] = []

    def take(node: dict) -> None:
        if "pattern" in node:
            found.append({"pattern": node["pattern"], "message": rule.get("message", "")})
        if "pattern-regex" in node:
            found.append({"regex": node["pattern-regex"], "message": rule.get("message", "")})

    take(rule)
    for key in ("patterns", "pattern-either"):
        for node in rule.get(key, []):
            take(node)
    as_list = lambda v: v if isinstance(v, list) else [v] if v else []
    return {
        "id": rule["id"],
        "name": rule["id"].rsplit(".", 1)[-1].replace("-", " "),
        "description": rule.get("message", ""),
        "severity": CONVERTED_SEVERITY.get(rule.get("severity", ""), "medium"),
        "category": next((c for part, c in CONVERTED_CATEGORY if part in rule["id"].lower()), "security"),
        "cwe": [m[0] for v in as_list(meta.get("cwe")) if (m := re.search(r"CWE-\d+", str(v)))],
        "owasp": [m[0] for v in as_list(meta.get("owasp")) if (m := re.search(r"A\d{2}:\d{4}", str(v)))],
        "languages": rule.get("languages") or ["*"],
        "patterns": found or [{"regex": ".*", "message": rule.get("message", "")}],
    }


def convert_file(path: str) -> list[dict]:
    """The rules of a file in the other format, converted and checked; those that are not valid are left out."""
    loaded = yaml.safe_load(Path(path).read_text()) or {}
    out = []
    for r in loaded.get("rules", []):
        try:
            out += validated([convert(r)])
        except (KeyError, ValueError):
            continue
    return out


def by_language(rules: DataFrame) -> DataFrame:
    """One row for each language and rule id, ready for ``write.partitionBy("language")``."""
    return rules.select(F.explode("languages").alias("language"), *[c for c in rules.columns if c != "languages"]).dropDuplicates(["language", "id"])
