"""Queries of the finding operators: rule patterns, duplicates, overlaps, order, summary, reports, evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.functions import lexer
from codesift.operators import evaluate, reports
from codesift.operators.findings import first_of_fingerprint, resolve_overlaps, summary
from codesift.plans.scan import HAND_WRITTEN, RULE_LANGUAGES, RULE_PATTERNS, security_findings
from codesift.queries.files import LANGUAGE_SQL, ROLES_SQL, SNIPPET_SQL, TRIM_SQL
from codesift.queries.sql import detect_sql
from codesift.session import drop_at_exit, held, shared_folder, written
from codesift.sources import files as src
from codesift.sources.corpus import files, quoted

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def findings_sql() -> str:
    """``all_found``: the findings of every pattern that runs on a file, with fingerprint and ordinals."""
    patterns = (*HAND_WRITTEN, *RULE_PATTERNS)
    own = " ".join(f"WHEN {len(HAND_WRITTEN) + k} THEN [{', '.join(map(quoted, langs))}]" for k, langs in enumerate(RULE_LANGUAGES))
    routed = f"routed AS (SELECT path AS p2, {LANGUAGE_SQL} AS language, {ROLES_SQL} FROM files)"
    return f"""{detect_sql(patterns)}, {routed},
        all_found AS (SELECT path, line_no, col, pattern_ord, rule_id, severity, category, message, hit, 'security' AS scanner, 0 AS scanner_ord,
            substr(sha256(rule_id || '::' || path || '::' || {TRIM_SQL.format(SNIPPET_SQL)}), 1, 16) AS fingerprint,
            CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS rank
            FROM found JOIN routed ON path = p2
            WHERE language IS NOT NULL AND NOT is_lock_file AND NOT is_vendor_file AND NOT is_minified
            AND (pattern_ord < {len(HAND_WRITTEN)} OR list_contains(CASE pattern_ord {own} ELSE [] END, language) OR list_contains(CASE pattern_ord {own} ELSE [] END, '*'))),
        firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY path, scanner_ord, pattern_ord, line_no, col) AS nth FROM all_found) WHERE nth = 1),
        best AS (SELECT * FROM (SELECT * EXCLUDE nth, row_number() OVER (PARTITION BY path, line_no, category ORDER BY starts_with(rule_id, 'security/'), rank, length(message) DESC, path, scanner_ord, pattern_ord, line_no, col) AS nth FROM firsts) WHERE nth = 1)"""


BASE = f"WITH {findings_sql()}"
TAKE = "path, line_no::BIGINT AS line_no, col::BIGINT AS col, rule_id, severity"


def _take(found: DataFrame) -> DataFrame:
    return found.select("path", F.col("line_no").cast("long"), F.col("col").cast("long").alias("col"), "rule_id", "severity")


def _all(spark: SparkSession, sf_dir: str, by_file: bool = True) -> DataFrame:
    return security_findings(_routed(spark, sf_dir), by_file=by_file)


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the security scanner; written, as the scan reads them twice: for its different lines and for all."""
    return written(src.route(src.discover(files(spark, sf_dir))).where("to_security").select("path", "language", "content", "to_security"), "files")


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_overlaps(first_of_fingerprint(_all(spark, sf_dir)))


@query(f"{BASE} SELECT {TAKE}, hit FROM all_found WHERE pattern_ord >= {len(HAND_WRITTEN)}")
def detect_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir, by_file=False).where(F.col("pattern_ord") >= len(HAND_WRITTEN)).select("path", F.col("line_no").cast("long"), F.col("col").cast("long").alias("col"), "rule_id", "severity", "hit")


@query(f"{BASE} SELECT {TAKE}, fingerprint FROM firsts")
def dedup_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = first_of_fingerprint(_all(spark, sf_dir))
    return found.select("path", F.col("line_no").cast("long"), F.col("col").cast("long").alias("col"), "rule_id", "severity", "fingerprint")


@query(f"{BASE} SELECT {TAKE} FROM best")
def dedup_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _take(_best(spark, sf_dir))


@query(f"{BASE} SELECT {TAKE}, dense_rank() OVER (PARTITION BY path ORDER BY rank)::BIGINT AS file_rank FROM best")
def sort_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.ranked_in_file(_best(spark, sf_dir)).select("path", F.col("line_no").cast("long"), F.col("col").cast("long").alias("col"), "rule_id", "severity", "file_rank")


@query(f"""{BASE} SELECT 'total' AS dimension, 'all' AS value, count(*) AS n, count(DISTINCT path) AS files FROM best
    UNION ALL SELECT 'severity', severity, count(*), count(DISTINCT path) FROM best GROUP BY severity
    UNION ALL SELECT 'scanner', scanner, count(*), count(DISTINCT path) FROM best GROUP BY scanner
    UNION ALL SELECT 'category', category, count(*), count(DISTINCT path) FROM best GROUP BY category""")
def summary_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(_best(spark, sf_dir))


@query(f"""{BASE} SELECT {TAKE}, 'security-' || fingerprint || ',' || rule_id || ',security,' || severity || ',' ||
    CASE WHEN regexp_matches(message, '[",\\r\\n]') THEN '"' || replace(message, '"', '""') || '"' ELSE message END AS csv FROM best""")
def report_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _best(spark, sf_dir)
    return found.select("path", F.col("line_no").cast("long"), F.col("col").cast("long").alias("col"), "rule_id", "severity", reports.csv_line(*(F.col(c) for c in ("id", "rule_id", "scanner", "severity", "message"))).alias("csv"))


@query(f"{BASE} SELECT {TAKE}, message, 'security-' || fingerprint AS id FROM best")
def report_one_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings as one JSON file that many tasks wrote and many tasks read."""
    path = f"{shared_folder(spark)}/codesift/report-{uuid.uuid4().hex}.json.gz"
    with held(_best(spark, sf_dir), "findings") as found:
        reports.write_file(found, path, "json")
    drop_at_exit(spark, path)
    return reports.read_report(spark, path).select("path", F.col("line_no").cast("long"), F.col("col").cast("long").alias("col"), "rule_id", "severity", "message", "id")


@query(f"""{BASE}, f AS (SELECT rule_id, min({{'path': path, 'p': pattern_ord, 'l': line_no, 'c': col}}) AS seen, count(*) AS results FROM best GROUP BY rule_id)
    SELECT rule_id, (row_number() OVER (ORDER BY seen) - 1)::BIGINT AS rule_index, results FROM f""")
def sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sarif_rules(_best(spark, sf_dir))


@query(f"{BASE} SELECT rule_id, count(*) AS n FROM best WHERE severity IN ('critical', 'high') AND (contains(lower(message), 'sql') OR contains(lower(rule_id), 'sql') OR contains(lower(path), 'sql') OR contains(lower(category), 'sql')) GROUP BY rule_id")
def html_filter_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.filtered(_best(spark, sf_dir), severities=("critical", "high"), search="sql", searched=("message", "rule_id", "path", "category")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"{BASE}, n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY scanner_ord, pattern_ord, line_no, col) AS k FROM all_found) SELECT {TAKE}, k <= 2 AS checked FROM n WHERE NOT (k <= 2 AND ascii(right(fingerprint, 1)) % 5 = 0)")
def ai_budget_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first findings of each file get a verdict, here by a rule on the fingerprint; the rest pass."""
    judged = reports.budget(_all(spark, sf_dir), 2).withColumn("valid", ~F.col("checked") | (F.ascii(F.right("fingerprint", F.lit(1))) % 5 != 0))
    return judged.where("valid").select("path", F.col("line_no").cast("long"), F.col("col").cast("long").alias("col"), "rule_id", "severity", "checked")


# Expected rows: the planted evals, MD5 hashes and literal comparisons, where the code view puts them.
EXPECTED_SQL = """expected AS (SELECT path AS e_path, line_no AS e_line, CASE WHEN contains(line, 'eval(req') THEN 'injection' WHEN contains(line, 'createHash(''md5''') THEN 'crypto' ELSE 'auth' END AS e_category
    FROM lines WHERE contains(line, 'eval(req') OR contains(line, 'createHash(''md5''') OR contains(line, 'hunter2secret'))"""


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codesift.functions.text import explode_lines

    line = F.col("line")
    category = F.when(line.contains("eval(req"), "injection").when(line.contains("createHash('md5'"), "crypto").when(line.contains("hunter2secret"), "auth")
    lines = explode_lines(files(spark, sf_dir).select("path", "content"))
    return lines.select("path", F.col("line_no").alias("line"), category.alias("category")).where("category is not null")


@query(f"""{BASE}, {EXPECTED_SQL}, hit AS (SELECT e_path, e_line, e_category, bool_or(line_no = e_line) AS found FROM expected LEFT JOIN best ON path = e_path AND category = e_category AND line_no = e_line GROUP BY ALL)
    SELECT e_category AS category, count(*) AS expected, count(*) FILTER (found) AS tp, round(count(*) FILTER (found) / count(*), 6) AS recall FROM hit GROUP BY e_category""")
def evaluate_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.recall_by(evaluate.exact_matches(_expected(spark, sf_dir), _best(spark, sf_dir)), "category")


@query(f"""{BASE}, {EXPECTED_SQL} SELECT category, count(*) AS false_positives FROM best
    WHERE NOT EXISTS (SELECT 1 FROM expected WHERE e_path = path AND e_category = category) GROUP BY category""")
def evaluate_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.false_positives(_expected(spark, sf_dir), _best(spark, sf_dir)).groupBy("category").agg(F.count(F.lit(1)).alias("false_positives"))


@query(f"""{BASE}, {EXPECTED_SQL}, e AS (SELECT *, {LANGUAGE_SQL} AS language FROM (SELECT e_path AS path, e_line, e_category FROM expected)),
    hit AS (SELECT e.path, e_line, e_category, e.language, coalesce(bool_or(abs(line_no - e_line) <= 5), false) AS found FROM e LEFT JOIN best b ON b.path = e.path AND b.category = e_category GROUP BY ALL)
    SELECT coalesce(language, 'other') AS language, count(*) AS expected, count(*) FILTER (found) AS tp, round(count(*) FILTER (found) / count(*), 6) AS recall FROM hit GROUP BY 1""")
def evaluate_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall by language, with the lines of tolerance that a finding may be off."""
    expected = _expected(spark, sf_dir).withColumn("language", F.coalesce(src.language(F.col("path")), F.lit("other")))
    return evaluate.recall_by(evaluate.near_matches(expected, _best(spark, sf_dir)), "language")


def spans_sql() -> str:
    """``harmless``: path, and begin and end offsets (from 0) of the spans of the scanned files in which a match does nothing."""
    family = "CASE language " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in lexer.FAMILY.items()) + " ELSE 'c' END"
    cuts = []
    for name, parts in lexer.FAMILIES.items():
        kind = "CASE " + " ".join(f"WHEN regexp_full_match(piece, {quoted(f'(?m)(?:{e})')}) THEN {quoted(k)}" for k, e in parts) + " END"
        master = quoted("(?m)" + "|".join(f"(?:{e})" for _, e in parts))
        cuts.append(f"SELECT *, {kind} AS kind FROM (SELECT path, language, unnest(ps) AS piece, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT path, language, regexp_extract_all(content, {master}, 0) AS ps FROM coded WHERE {family} = {quoted(name)}))")
    signs = lexer.OPEN_ENDED.replace("'", "''")
    return f"""coded AS (SELECT path, language, content FROM files JOIN routed ON path = p2 WHERE language IS NOT NULL),
        cut AS ({' UNION ALL '.join(cuts)}),
        placed AS (SELECT *, sum(length(piece)) OVER prior + 0 AS before, kind NOT IN ('space', 'newline', 'comment') AS solid,
            CASE WHEN kind = 'sign' AND piece IN ('(', '[') THEN 1 WHEN kind = 'sign' AND piece IN (')', ']') THEN -1 ELSE 0 END AS opens, rtrim(piece, chr(10) || chr(9) || ' ') AS bare
            FROM cut WINDOW prior AS (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        told AS (SELECT *, coalesce(sum(opens) OVER prior, 0) AS depth, coalesce(last_value(CASE WHEN solid THEN right(bare, 1) END IGNORE NULLS) OVER prior, '') AS last_sign,
            coalesce(max(CASE WHEN kind = 'newline' THEN i END) OVER prior, 0) >= coalesce(max(CASE WHEN solid THEN i END) OVER prior, 0) AS fresh,
            CASE WHEN lead(kind, 1) OVER o = 'space' THEN lead(kind, 2) OVER o ELSE lead(kind, 1) OVER o END AS next_kind, CASE WHEN lead(kind, 1) OVER o = 'space' THEN lead(piece, 2) OVER o ELSE lead(piece, 1) OVER o END AS next_piece
            FROM placed WINDOW prior AS (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), o AS (PARTITION BY path ORDER BY i)),
        harmless AS (SELECT path AS h_path, coalesce(before, 0) + CASE WHEN kind = 'regex' THEN strpos(piece, '/') - 1 ELSE 0 END AS b, coalesce(before, 0) + length(piece) AS e FROM told
            WHERE kind IN ('import', 'type', 'regex', 'comment') OR kind = 'template' AND NOT contains(piece, '${{')
            OR kind = 'string' AND depth <= 0 AND (next_kind IS NULL OR next_kind IN ('newline', 'comment') OR next_piece[1] = ';')
               AND (last_sign = '' OR contains(';{{}}', last_sign) OR last_sign = ':' AND language = 'python' OR fresh AND NOT contains('{signs}', last_sign)))"""


@query(f"""{BASE}, {spans_sql()}, begins AS (SELECT path AS b_path, line_no AS b_line, coalesce(sum(length(line) + 1) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b_at FROM lines)
    SELECT {TAKE} FROM all_found JOIN begins ON path = b_path AND line_no = b_line
    WHERE category = 'secrets' OR NOT EXISTS (SELECT 1 FROM harmless WHERE h_path = path AND b <= b_at + col - 1 AND b_at + col - 1 < e)""")
def match_context_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings that stand in code, not in text that does nothing."""
    return _take(security_findings(_routed(spark, sf_dir), contexts=True))


def evaluate_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.greedy(_expected(spark, sf_dir), _best(spark, sf_dir))


QUERIES["evaluate_greedy"] = evaluate_greedy
