"""Queries of the file sources and the line operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.detectors import COMMENT, DEFINITION
from codesift.functions.text import entropy, explode_lines, fingerprint, positions, snippet
from codesift.operators.match import not_comment, not_definition
from codesift.queries.sql import any_rx, match_sql, rx
from codesift.sources import files as src
from codesift.sources.corpus import files, files_sql, quoted
from codesift.sources.rules import for_language, id_regex, read_rules, rules_table, selected

QUERIES, ORACLE_SQL = {}, {}
IGNORE = ("vendor/", "*.min.js", "!f11*.min.js", "tests/**/f2*")
WORD = r"\b(?:req|user)\w*"
INCLUDE, EXCLUDE = ("security/*",), ("security/xss-*", "security/weak-auth")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def case_sql(column: str, table: dict[str, str]) -> str:
    return f"CASE {column} {' '.join(f'WHEN {quoted(k)} THEN {quoted(v)}' for k, v in table.items())} END"


def listed(values) -> str:
    return ", ".join(map(quoted, values))


NAME_SQL = "regexp_extract(path, '([^/\\\\]*)$', 1)"
EXT_SQL = "lower(regexp_extract(path, '[^/\\\\](\\.[^./\\\\]*)$', 1))"
ROLES_SQL = f"""{NAME_SQL} IN ({listed(src.DEPENDENCY_FILES)}) AS is_dependency_file, {NAME_SQL} IN ({listed(src.LOCK_FILES)}) AS is_lock_file,
    {rx('path', src.VENDOR_FOLDER)} OR {rx(NAME_SQL, src.VENDOR_FILE)} AS is_vendor_file, {rx(NAME_SQL, src.MINIFIED)} AS is_minified,
    {rx('path', src.TEST_FOLDER)} OR {rx(NAME_SQL, src.TEST_FILE)} AS is_test_file"""
LANGUAGE_SQL = case_sql(EXT_SQL, src.EXTENSION_LANGUAGE)


@query(f"WITH {files_sql()} SELECT path, {LANGUAGE_SQL} AS language, {ROLES_SQL} FROM files")
def scan_files_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.classify(files(spark, sf_dir)).select("path", "language", "is_dependency_file", "is_lock_file", "is_vendor_file", "is_minified", "is_test_file")


def _ignore_sql() -> str:
    out = "false"
    for expression, back in src.ignore_rules(IGNORE):
        out = f"CASE WHEN {rx('path', expression)} THEN {'false' if back else 'true'} ELSE {out} END"
    return out


@query(f"WITH {files_sql()} SELECT path FROM files WHERE NOT ({_ignore_sql()})")
def scan_ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where(~src.ignored(F.col("path"), IGNORE)).select("path")


@query(f"WITH {files_sql()}, roles AS (SELECT path, {LANGUAGE_SQL} AS language, {ROLES_SQL} FROM files) SELECT path, language, is_dependency_file AS to_cve, NOT is_lock_file AND NOT is_vendor_file AND NOT is_minified AS to_security, true AS to_quality FROM roles WHERE language IS NOT NULL")
def route_scanners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.route(src.discover(files(spark, sf_dir))).select("path", "language", "to_cve", "to_security", "to_quality")


@query("WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line_no, md5(unnest(ls)) AS line_md5 FROM s")
def lines_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return explode_lines(docs, "text").select("doc_id", F.col("line_no").cast("long"), F.md5("line").alias("line_md5"))


@query(f"WITH {files_sql()}, m AS ({match_sql('lines', WORD, '(?i)')}) SELECT path, line_no::BIGINT AS line_no, col::BIGINT AS col, hit FROM m")
def match_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = explode_lines(files(spark, sf_dir).select("path", "content"))
    rows = lines.select("path", "line_no", F.explode(positions(F.col("line"), WORD, "(?i)")).alias("m"))
    return rows.select("path", F.col("line_no").cast("long"), F.col("m.col").cast("long").alias("col"), F.col("m.hit").alias("hit"))


@query(f"WITH {files_sql()} SELECT path, line_no::BIGINT AS line_no FROM lines WHERE NOT {rx('line', COMMENT)}")
def match_comment_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_lines(files(spark, sf_dir).select("path", "content")).where(not_comment(F.col("line"))).select("path", F.col("line_no").cast("long"))


@query(f"WITH {files_sql()} SELECT path, line_no::BIGINT AS line_no FROM lines WHERE NOT {any_rx('line', DEFINITION)}")
def match_definition_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_lines(files(spark, sf_dir).select("path", "content")).where(not_definition(F.col("line"))).select("path", F.col("line_no").cast("long"))


SNIPPET_SQL = "array_to_string(string_split(content, chr(10))[greatest(line_no - 3, 1):line_no + 3], chr(10))"
TRIM_SQL = "regexp_replace({}, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')"
PRINT_SQL = f"substr(sha256('R::' || path || '::' || {TRIM_SQL.format(SNIPPET_SQL)}), 1, 16)"


@query(f"WITH {files_sql()} SELECT path, line_no::BIGINT AS line_no, md5({SNIPPET_SQL}) AS snippet_md5, {PRINT_SQL} AS fingerprint FROM lines WHERE line LIKE '%eval%' OR line LIKE '%secret%'")
def snippet_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select("path", "content")
    lines = explode_lines(rows.select("path", "content", F.col("content").alias("whole"))).where(F.col("line").contains("eval") | F.col("line").contains("secret"))
    code = snippet(F.col("whole"), F.col("line_no"))
    return lines.select("path", F.col("line_no").cast("long"), F.md5(code).alias("snippet_md5"), fingerprint(F.lit("R"), F.col("path"), code).alias("fingerprint"))


def _rules_sql() -> str:
    rows = ", ".join(f"({quoted(r['id'])}, {quoted(x)})" for r in read_rules() for x in r["languages"])
    return f"rules AS (SELECT * FROM (VALUES {rows}) t(id, lang))"


@query(f"WITH {files_sql()}, {_rules_sql()}, typed AS (SELECT path, {LANGUAGE_SQL} AS language FROM files) SELECT DISTINCT path, id FROM typed JOIN rules ON lang = language OR lang = '*' WHERE language IS NOT NULL")
def rules_for_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return for_language(src.discover(files(spark, sf_dir)), rules_table(spark, read_rules()))


@query(f"WITH {files_sql()}, {_rules_sql()}, typed AS (SELECT path, {LANGUAGE_SQL} AS language FROM files) SELECT id, count(*) AS files FROM (SELECT DISTINCT path, id FROM typed JOIN rules ON lang = language OR lang = '*' WHERE language IS NOT NULL) WHERE {any_rx('id', [id_regex(p) for p in INCLUDE])} AND NOT {any_rx('id', [id_regex(p) for p in EXCLUDE])} GROUP BY id")
def rules_include_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = selected(rules_table(spark, read_rules()), INCLUDE, EXCLUDE)
    return for_language(src.discover(files(spark, sf_dir)), rules).groupBy("id").agg(F.count(F.lit(1)).alias("files"))


TOKEN = r"\btoken\s*=\s*[\"']?([0-9A-Za-z]{20,})"


@query(f"WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, sha256(unnest(regexp_extract_all(line, {quoted(TOKEN)}, 1))) AS secret_sha256 FROM s WHERE {rx('line', TOKEN)}")
def secrets_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where(F.col("text").contains("token"))
    lines = explode_lines(docs, "text").where(F.col("line").rlike(TOKEN))
    return lines.select("doc_id", F.explode(F.regexp_extract_all("line", F.lit(TOKEN), F.lit(1))).alias("t")).select("doc_id", F.sha2("t", 256).alias("secret_sha256"))


LONG = r"[0-9A-Za-z]{24,}"


@query(f"WITH t AS (SELECT DISTINCT token FROM (SELECT unnest(regexp_extract_all(text, {quoted(LONG)})) AS token FROM documents)), c AS (SELECT token, unnest(string_split(token, '')) AS ch FROM t), n AS (SELECT token, ch, count(*) / length(token)::DOUBLE AS p FROM c WHERE ch <> '' GROUP BY token, ch) SELECT token, round(-sum(p * log2(p)), 6) AS bits FROM n GROUP BY token")
def entropy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").where(F.col("text").rlike(LONG))
    tokens = docs.select(F.explode(F.regexp_extract_all("text", F.lit(LONG), F.lit(0))).alias("token")).distinct()
    return tokens.select("token", F.round(entropy(F.col("token")), 6).alias("bits"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS host, len(regexp_extract_all(html, '(?s)<!--.*?-->'))::BIGINT AS comments, len(regexp_extract_all(html, '(?i)<script\\b'))::BIGINT AS scripts FROM pages")
def pages_url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select(
        "page_id",
        F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"),
        F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"),
        F.regexp_count("html", F.lit("(?s)<!--.*?-->")).cast("long").alias("comments"),
        F.regexp_count("html", F.lit(r"(?i)<script\b")).cast("long").alias("scripts"),
    )


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type")
def events_props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.from_json("props", "k long").alias("p"))
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("total"))
