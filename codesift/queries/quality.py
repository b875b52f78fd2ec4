"""Queries of the quality, semantic, context and taint operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.functions.text import explode_lines
from codesift.operators import flow, quality, semantic, taint
from codesift.queries.files import LANGUAGE_SQL, TRIM_SQL
from codesift.queries.sql import any_rx, rx
from codesift.sources.corpus import files, files_sql, quoted
from codesift.sources.files import classify

QUERIES, ORACLE_SQL = {}, {}
LONG_FILE, DUP_MIN = 12, 20


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_lines(classify(files(spark, sf_dir)).select("path", "language", "content"))


def count_sql(expression: str, column: str = "line") -> str:
    return f"len(regexp_extract_all({column}, {quoted(expression)}))"


CODE = TRIM_SQL.format("line")
COMMENT_STARTS = " OR ".join(f"starts_with({CODE}, '{m}')" for m in ("//", "#", "*"))


def nesting_sql() -> str:
    return f"""WITH {files_sql()}, marked AS (SELECT path, line_no, line, contains({CODE}, '*/') AS closes,
          CASE WHEN contains({CODE}, '*/') THEN 0 WHEN contains({CODE}, '/*') THEN 1 END AS mark, {COMMENT_STARTS} AS comment FROM lines),
        state AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING), 0) AS inside FROM marked),
        own AS (SELECT *, CASE WHEN NOT closes AND inside = 0 AND NOT comment THEN {count_sql(chr(92) + '{')} ELSE 0 END AS o, CASE WHEN NOT closes AND inside = 0 AND NOT comment THEN {count_sql(chr(92) + '}')} ELSE 0 END AS c FROM state),
        total AS (SELECT *, sum(o - c) OVER w AS t FROM own WINDOW w AS (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
        clamped AS (SELECT *, t - least(0, min(t) OVER w) AS d FROM total WINDOW w AS (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
        before AS (SELECT *, coalesce(lag(d) OVER (PARTITION BY path ORDER BY line_no), 0) + o AS depth FROM clamped)"""


@query(f"{nesting_sql()} SELECT path, line_no::BIGINT AS line_no, depth::BIGINT AS depth FROM before WHERE NOT closes")
def nesting_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.nesting(_lines(spark, sf_dir)).select("path", F.col("line_no").cast("long"), "depth")


@query(f"""{nesting_sql().replace('WITH', 'WITH RECURSIVE', 1)},
    deep AS MATERIALIZED (SELECT path, line_no, depth FROM before WHERE NOT closes AND depth > {quality.MAX_NESTING} AND (contains(line, '{{') OR {rx(CODE, r'^(?:if|for|while|switch|try)\b')})),
    kept AS (SELECT path, min(line_no) AS line_no FROM deep GROUP BY path
             UNION ALL SELECT kept.path, min(deep.line_no) FROM kept JOIN deep ON deep.path = kept.path AND deep.line_no > kept.line_no + 5 GROUP BY kept.path)
    SELECT path, line_no::BIGINT AS line_no, depth::BIGINT AS depth, CASE WHEN depth > {quality.MAX_NESTING + 2} THEN 'high' ELSE 'medium' END AS severity FROM kept JOIN deep USING (path, line_no)""")
def deep_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.deep_nesting(_lines(spark, sf_dir)).withColumn("line_no", F.col("line_no").cast("long"))


def count_all(column: str, *expressions: str) -> str:
    """How often the expressions match; ``x(?!=)`` as the matches of x less those of x and an equals sign."""
    parts = []
    for e in expressions:
        bare, look, _ = e.partition("(?!=)")
        parts.append(count_sql(bare, column) + (f" - {count_sql(bare + '=', column)}" if look else ""))
    return " + ".join(parts)


def functions_sql() -> str:
    """``fns``: path, name, start_line, end_line, complexity and line_count."""
    shaped = " OR ".join(rx("code", e) for e in quality.FUNCTIONS)
    names = ", ".join(f"nullif(regexp_extract(e.code, {quoted(quality.NAME)}, {g}), '')" for g in (1, 2, 3, 4))
    return f"""{files_sql()},
        c AS (SELECT path, line_no, line, {CODE} AS code, {count_sql('{', 'line')} AS opens, {count_sql('}', 'line')} AS closes, {count_all('line', *quality.DECISIONS)} AS points,
              CASE WHEN {CODE} = '' THEN -1 ELSE length(line) - length(regexp_replace(line, '^\\s+', '')) END AS indent FROM lines),
        r AS (SELECT *, sum(opens) OVER w AS opened, sum(opens - closes) OVER w AS depth, sum(points) OVER w AS decided, count(*) OVER (PARTITION BY path) AS n FROM c WINDOW w AS (PARTITION BY path ORDER BY line_no)),
        f AS (SELECT *, opened - opens AS bo, depth - opens + closes AS bd, least(line_no + {quality.SPAN + 1}, n) AS last FROM r WHERE NOT ({COMMENT_STARTS}) AND ({shaped})),
        g AS (SELECT f.path, f.line_no, min(CASE WHEN l.line_no <= f.last AND l.opened > f.bo AND l.depth <= f.bd THEN l.line_no END) AS closing, max(CASE WHEN l.line_no = f.last THEN l.opened END) AS last_opened,
              min(CASE WHEN l.line_no > f.line_no AND l.indent >= 0 AND l.indent <= f.indent THEN l.line_no END) AS outdent FROM f JOIN r l ON l.path = f.path AND l.line_no >= f.line_no GROUP BY f.path, f.line_no),
        h AS (SELECT g.path, g.line_no, max(l.line_no) AS inner_end FROM g JOIN r l ON l.path = g.path AND l.line_no > g.line_no AND l.indent >= 0 AND (g.outdent IS NULL OR l.line_no < g.outdent) GROUP BY g.path, g.line_no),
        e AS (SELECT f.*, CASE WHEN starts_with(code, 'def ') AND NOT last_opened > bo THEN coalesce(inner_end, f.line_no) ELSE coalesce(closing, CASE WHEN n > f.line_no + {quality.SPAN} THEN f.line_no + {quality.SPAN + 1} END, f.line_no) END AS end_line
              FROM f JOIN g USING (path, line_no) LEFT JOIN h USING (path, line_no)),
        fns AS (SELECT e.path, coalesce({names}, 'anonymous') AS name, e.line_no AS start_line, e.end_line, (1 + r.decided - e.decided + e.points)::BIGINT AS complexity, e.end_line - e.line_no + 1 AS line_count
              FROM e JOIN r ON r.path = e.path AND r.line_no = e.end_line)"""


@query(f"WITH {functions_sql()} SELECT path, name, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, complexity, line_count::BIGINT AS line_count FROM fns")
def function_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.functions(_lines(spark, sf_dir)).select("path", "name", *(F.col(c).cast("long") for c in ("start_line", "end_line", "complexity", "line_count")))


@query(f"""WITH {functions_sql()}
    SELECT path, start_line::BIGINT AS line_no, 'QUA-CMPLX-001' AS rule_id, CASE WHEN complexity > 8 THEN 'high' ELSE 'medium' END AS severity, name FROM fns WHERE complexity > 4
    UNION ALL SELECT path, start_line::BIGINT, 'QUA-CMPLX-002', CASE WHEN line_count > 16 THEN 'high' ELSE 'medium' END, name FROM fns WHERE line_count > 8""")
def complexity_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.complexity_findings(quality.functions(_lines(spark, sf_dir)), 4, 8).withColumn("line_no", F.col("line_no").cast("long"))


@query(f"WITH n AS (SELECT 'doc/' || doc_id AS path, len(string_split(text, chr(10)))::BIGINT AS n_lines FROM documents) SELECT path, n_lines, CASE WHEN n_lines > {2 * LONG_FILE} THEN 'high' ELSE 'medium' END AS severity FROM n WHERE n_lines > {LONG_FILE}")
def long_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    return quality.long_files(docs, LONG_FILE)


def imported_sql(pattern: str, when: str = "true", drop: str = "''") -> str:
    """The names that group 1 of a pattern lists on a line, less their old names; an empty list where it does not match."""
    listed = f"list_transform(string_split(regexp_extract(line, {quoted(pattern)}, 1), ','), lambda x: trim(regexp_split_to_array(trim(x), '\\s+as\\s+')[-1]))"
    return f"CASE WHEN {rx('line', pattern)} AND {when} THEN list_filter({listed}, lambda x: x NOT IN ({drop})) ELSE [] END"


@query(f"""WITH {files_sql()},
    i AS (SELECT path, line_no, unnest(list_concat(list_concat({imported_sql(r'import\s+\{([^}]+)\}\s+from\s+', drop="'', 'type'")}, {imported_sql(r'import\s+(\w+)\s+from\s+', "NOT contains(line, '{')")}),
          list_concat({imported_sql(r'from\s+\S+\s+import\s+(.+)')}, {imported_sql(r'^import\s+(\w+)', "NOT contains(line, 'from')")}))) AS name
          FROM lines WHERE {rx('line', r'\b(?:import|from)\b')} AND NOT {rx('line', r'import\s+type\b')}),
    words AS (SELECT DISTINCT path, unnest(regexp_extract_all(line, '\\w+')) AS name FROM lines WHERE NOT {rx('line', quality.IMPORT_LINE)})
    SELECT path, line_no::BIGINT AS line_no, name FROM i WHERE NOT EXISTS (SELECT 1 FROM words WHERE words.path = i.path AND words.name = i.name)""")
def unused_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.unused_imports(_lines(spark, sf_dir)).withColumn("line_no", F.col("line_no").cast("long"))


def _numbers_sql() -> str:
    # The character before a number is part of its gap, as there is no look-behind.
    wrapped = quoted(r"([\s\S]*?(?:^|\W))(-?\d+\.?\d*\b)")
    plain = " AND ".join(f"NOT {rx('line', e)}" for e in (r"^\s*(?:import|from|require)\b", r"^\s*(?:const|final|static)\s+\w+\s*[:=]", r"^\s*(?:export\s+)?(?:const|enum)\b", r"\[\s*\d+\s*\]"))
    even = " AND ".join(f"(length(before) - length(replace(before, {quoted(q)}, ''))) % 2 = 0" for q in ("'", '"', "`"))
    return f"""WITH {files_sql()}, p AS (SELECT path, line_no, line, regexp_extract_all(line, {wrapped}, 1) AS gaps, regexp_extract_all(line, {wrapped}, 2) AS hits FROM lines WHERE NOT ({COMMENT_STARTS}) AND {plain}),
        k AS (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM p),
        m AS (SELECT path, line_no, line, (1 + list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0))::BIGINT AS col, hits[k] AS number FROM k),
        n AS (SELECT *, substr(line, 1, col - 1) AS before, substr(line, greatest(1, col - 5), length(number) + least(5, col - 1) + 5) AS around, try_cast(number AS DOUBLE) AS value FROM m)
        SELECT path, line_no::BIGINT AS line_no, col, number FROM n WHERE number NOT IN ({', '.join(map(quoted, quality.ALLOWED))}) AND {even} AND NOT {rx('around', r'\d+\.\d+\.\d+')} AND (value < -2 OR value > 10)"""


@query(_numbers_sql())
def magic_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.magic_numbers(_lines(spark, sf_dir))
    return found.select("path", F.col("line_no").cast("long"), F.col("col").cast("long").alias("col"), "number")


@query(f"""WITH {files_sql()}, c AS (SELECT path, line_no, {CODE} AS code FROM lines WHERE NOT ({COMMENT_STARTS}))
    SELECT path, line_no::BIGINT AS line_no, (CASE WHEN {rx('code', quality.CONSOLE)} THEN length(regexp_extract(code, {quoted('^([\\s\\S]*?)' + quality.CONSOLE)}, 1)) ELSE length(regexp_extract(code, {quoted('^([\\s\\S]*?)' + quality.PRINT)}, 1)) END + 1)::BIGINT AS col
    FROM c WHERE {rx('code', quality.CONSOLE)} OR {rx('code', quality.PRINT)}""")
def console_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.console_statements(_lines(spark, sf_dir)).select("path", F.col("line_no").cast("long"), "col")


@query(f"""WITH {files_sql()}, t AS (SELECT path, line_no, upper(regexp_extract(line, {quoted(quality.TAG)}, 1)) AS tag, regexp_extract(line, {quoted(quality.TAG)}, 2) AS rest FROM lines WHERE {rx('line', quality.TAG)})
    SELECT path, line_no::BIGINT AS line_no, tag, {TRIM_SQL.format('rest')} AS note, CASE WHEN tag IN ('FIXME', 'BUG') THEN 'medium' ELSE 'low' END AS severity FROM t""")
def todo_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.todo_tags(_lines(spark, sf_dir)).select("path", F.col("line_no").cast("long"), "tag", "note", "severity")


@query(f"""WITH {files_sql()}, n AS (SELECT path, line_no, line, {TRIM_SQL.format('lead(line, 1) OVER w')} AS one, {TRIM_SQL.format('lead(line, 2) OVER w')} AS two FROM lines WINDOW w AS (PARTITION BY path ORDER BY line_no))
    SELECT path, line_no::BIGINT AS line_no FROM n WHERE {rx('line', r'\bcatch\s*\(')} AND ({rx('line', r'catch\s*\([^)]*\)\s*\{\s*\}')} OR (ends_with({CODE}, '{{') AND (one = '}}' OR (one = '' AND two = '}}'))))""")
def empty_catch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.empty_catches(_lines(spark, sf_dir)).select("path", F.col("line_no").cast("long"))


def token_sql(column: str) -> str:
    out = TRIM_SQL.format(column)
    for expression, to in ((r"//.*$", ""), (r"#.*$", ""), (r"/\*.*?\*/", ""), (r"\s+", " ")):
        out = f"regexp_replace({out}, {quoted(expression)}, {quoted(to)}, 'g')"
    out = TRIM_SQL.format(out)
    for expression, to in (('"[^"]*"', '"STR"'), ("'[^']*'", "'STR'"), ("`[^`]*`", "`STR`"), (r"\b\d+\.?\d*\b", "NUM")):
        out = f"regexp_replace({out}, {quoted(expression)}, {quoted(to)}, 'g')"
    return out


def blocks_sql(min_tokens: int = DUP_MIN) -> str:
    return f"""WITH {files_sql()}, t AS (SELECT path, line_no, {token_sql('line')} AS t FROM lines),
        kept AS (SELECT * FROM t WHERE t NOT IN ('', '}}', '{{', ');')),
        framed AS (SELECT path, line_no AS start_line, max(line_no) OVER w AS end_line, list(t) OVER w AS ts, sum(len(string_split(t, ' '))) OVER w AS n_tokens FROM kept WINDOW w AS (PARTITION BY path ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
        blocks AS (SELECT path, start_line, end_line, sha256(array_to_string(ts, chr(10))) AS block, n_tokens FROM framed WHERE len(ts) = 6 AND n_tokens >= {min_tokens})"""


@query(f"{blocks_sql()} SELECT path, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, block, n_tokens::BIGINT AS n_tokens FROM blocks")
def dup_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.blocks(_lines(spark, sf_dir), min_tokens=DUP_MIN)
    return found.select("path", F.col("start_line").cast("long"), F.col("end_line").cast("long"), "block", F.col("n_tokens").cast("long"))


@query(f"""{blocks_sql()}, f AS (SELECT path, block, min(start_line) AS a_start, min(end_line) AS a_end FROM blocks GROUP BY path, block)
    SELECT path, a_start::BIGINT AS a_start, a_end::BIGINT AS a_end, start_line::BIGINT AS b_start, end_line::BIGINT AS b_end FROM f JOIN blocks USING (path, block) WHERE start_line > a_end""")
def dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.duplicate_pairs(quality.blocks(_lines(spark, sf_dir), min_tokens=DUP_MIN))
    return found.select("path", *(F.col(c).cast("long") for c in ("a_start", "a_end", "b_start", "b_end")))


@query(f"{blocks_sql()} SELECT * FROM (SELECT path, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, (min(start_line) OVER w)::BIGINT AS first, count(*) OVER w AS copies FROM blocks WINDOW w AS (PARTITION BY path, block)) WHERE copies > 1")
def dup_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.duplicate_classes(quality.blocks(_lines(spark, sf_dir), min_tokens=DUP_MIN))
    return found.select("path", *(F.col(c).cast("long") for c in ("start_line", "end_line", "first", "copies")))


def top_pairs_sql(min_tokens: int = DUP_MIN) -> str:
    return f"""{blocks_sql(min_tokens)}, seen AS (SELECT path, block, min(start_line) AS first FROM blocks GROUP BY path, block),
    pairs AS (SELECT a.path, a.start_line AS a_start, a.end_line AS a_end, b.start_line AS b_start, b.end_line AS b_end, row_number() OVER (PARTITION BY a.path ORDER BY s.first, a.block, a.start_line, b.start_line) AS nth
              FROM blocks a JOIN blocks b ON a.path = b.path AND a.block = b.block AND b.start_line > a.end_line JOIN seen s ON s.path = a.path AND s.block = a.block)
    SELECT path, nth::BIGINT AS nth, a_start::BIGINT AS a_start, a_end::BIGINT AS a_end, b_start::BIGINT AS b_start, b_end::BIGINT AS b_end, CASE WHEN a_end - a_start + 1 > 20 THEN 'medium' ELSE 'low' END AS severity FROM pairs WHERE nth <= 10"""


@query(top_pairs_sql())
def dup_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.duplicate_findings(quality.blocks(_lines(spark, sf_dir), min_tokens=DUP_MIN))
    return found.select("path", *(F.col(c).cast("long") for c in ("nth", "a_start", "a_end", "b_start", "b_end")), "severity")


def metrics_sql() -> str:
    """``m``: path, total, code, comment, blank and comment_ratio."""
    families = {"python": quality.HASHES, "php": quality.PHP, "ruby": quality.RUBY}

    def by_family(pick) -> str:
        whens = " ".join(f"WHEN '{name}' THEN {pick(family)}" for name, family in families.items())
        return f"CASE language {whens} ELSE {pick(quality.SLASHES)} END"

    return f"""{files_sql()}, c AS (SELECT path, line_no, {CODE} AS code, coalesce({LANGUAGE_SQL}, '') AS language FROM lines),
        s AS (SELECT path, line_no, code = '' AS blank, {by_family(lambda f: any_rx('code', f[0]))} AS single, {by_family(lambda f: rx('code', f[1]))} AS starts,
              CASE WHEN language = 'python' THEN {rx('code', quality.HASHES[2])} ELSE ({by_family(lambda f: rx('code', f[2]))}) AND code <> '/**/' END AS ends FROM c),
        t AS (SELECT *, coalesce(last_value(CASE WHEN blank THEN NULL WHEN ends THEN 0 WHEN starts THEN 1 END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS inside FROM s),
        u AS (SELECT path, blank, NOT blank AND (inside OR starts OR single) AS comment FROM t),
        v AS (SELECT path, count(*) AS total, count(*) FILTER (NOT blank AND NOT comment) AS code, count(*) FILTER (comment) AS comment, count(*) FILTER (blank) AS blank FROM u GROUP BY path),
        m AS (SELECT *, round(comment / total, 6) AS comment_ratio FROM v)"""


@query(f"WITH {metrics_sql()} SELECT * FROM m")
def file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.metrics(_lines(spark, sf_dir))


TEXT_SQL = "printf('%d lines: %d code, %d comment, %d blank; comments %d.%d%%', total, code, comment, blank, (2000 * comment + total) // (2 * total) // 10, (2000 * comment + total) // (2 * total) % 10)"


@query(f"WITH {metrics_sql()} SELECT path, 'QUA-METRICS-001' AS rule_id, {TEXT_SQL} AS message FROM m UNION ALL SELECT path, 'QUA-METRICS-002', {TEXT_SQL} FROM m WHERE code > 50 AND comment_ratio < {quality.MIN_COMMENT_RATIO}")
def metric_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.metric_findings(quality.metrics(_lines(spark, sf_dir)))


def _normal_sql() -> str:
    strings = "|".join(f"{q}(?:[^{q}\\\\\\n]|\\\\.)*{q}" for q in ('"', "'", "`"))
    word = quoted(semantic.WORD)
    keywords = ", ".join(map(quoted, semantic.KEYWORDS))
    keep = f"(w IN ({keywords}) OR regexp_matches(w, '^__.*__$'))"
    return f"""WITH {files_sql()},
        a AS (SELECT path, array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda x: {TRIM_SQL.format('x')}), lambda x: x <> '' AND NOT starts_with(x, '//') AND NOT starts_with(x, '#') AND NOT starts_with(x, '*')), chr(10)) AS t FROM files),
        b AS (SELECT path, regexp_replace(regexp_replace(t, {quoted(strings)}, '"__STR__"', 'g'), '\\b\\d+(?:\\.\\d+)?\\b', '__NUM__', 'g') AS t FROM a),
        c AS (SELECT path, regexp_extract_all(t, {word}) AS words, regexp_split_to_array(t, {word}) AS gaps FROM b),
        d AS (SELECT path, words, gaps, list_filter(words, lambda w, i: NOT {keep} AND list_position(words, w) = i) AS names FROM c)
        SELECT path, sha256(array_to_string(list_transform(gaps, lambda g, i: g || CASE WHEN i > len(words) THEN '' WHEN {keep.replace('w ', 'words[i] ').replace('(w,', '(words[i],')} THEN words[i] ELSE 'v' || (list_position(names, words[i]) - 1) END), '')) AS normal_sha256 FROM d"""


@query(_normal_sql())
def normalize_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", F.sha2(semantic.normalized(F.col("content")), 256).alias("normal_sha256"))


TOKENS_SQL = "list_filter(regexp_extract_all({0}, '[{{}}()\\[\\],;.]|[^\\s{{}}()\\[\\],;.]+'), lambda t: t <> '')"


def grams_sql(column: str) -> str:
    return f"list_distinct(list_transform(range(1, len({column}) - 1), lambda i: {column}[i] || ' ' || {column}[i + 1] || ' ' || {column}[i + 2]))"


@query(f"""WITH t AS (SELECT doc_id, text, {TOKENS_SQL.format('text')} AS k FROM documents),
    g AS (SELECT doc_id, text, {grams_sql('k')} AS g FROM t),
    p AS (SELECT a.doc_id, a.text AS x, b.text AS y, a.g AS ga, b.g AS gb FROM g a JOIN g b ON b.doc_id = a.doc_id + 1)
    SELECT doc_id, CASE WHEN x = y THEN 1.0 WHEN len(ga) = 0 OR len(gb) = 0 THEN 0.0 ELSE round(len(list_intersect(ga, gb)) / (len(ga) + len(gb) - len(list_intersect(ga, gb))), 6) END::DOUBLE AS similarity FROM p""")
def semantic_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the one with the next id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("key"), "text")
    pairs = docs.select(F.col("key").alias("a"), (F.col("key") + 1).alias("b"))
    return semantic.similarities(docs, pairs).select(F.col("a").alias("doc_id"), F.round("similarity", 6).alias("similarity"))


def _equivalence_sql() -> str:
    parts = []
    for kind, e in semantic.EQUIVALENCES:
        w = quoted(f"([\\s\\S]*?)({e})")
        parts.append(
            f"SELECT path, '{kind}' AS kind, (1 + len(regexp_extract_all(array_to_string(list_transform(range(1, k + 1), lambda i: gaps[i] || CASE WHEN i < k THEN hits[i] ELSE '' END), ''), chr(10))))::BIGINT AS line_no, hits[k] AS original "
            f"FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM (SELECT path, regexp_extract_all(content, {w}, 1) AS gaps, regexp_extract_all(content, {w}, 2) AS hits FROM files))"
        )
    return f"WITH {files_sql()} {' UNION ALL '.join(parts)}"


@query(_equivalence_sql())
def semantic_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.equivalences(files(spark, sf_dir))


def _context_sql() -> str:
    scores = []
    for i, (name, (_, (path, bonus))) in enumerate(semantic.CONTEXTS.items()):
        total = " + ".join([*(f"{w} * {count_sql(e, 'content')}" for e, w in semantic.context_words(name)), f"CASE WHEN {rx('lower(path)', path)} THEN {bonus} ELSE 0 END"])
        scores.append(f"{{'score': ({total})::INT, 'ord': {-i}, 'name': '{name}'}}")
    return f"""WITH {files_sql()}, s AS (SELECT path, [{', '.join(scores)}] AS a FROM files),
        b AS (SELECT path, list_max(a) AS best, list_sum(list_transform(a, lambda x: x.score)) AS total FROM s),
        c AS (SELECT path, best.name AS name, best.score AS score, CASE WHEN total > 0 THEN least(best.score / total, 1.0) * least(best.score / 10, 1.0) ELSE 0.0 END AS conf FROM b)
        SELECT path, CASE WHEN conf < 0.2 OR score < 5 THEN 'general' ELSE name END AS context, round(conf, 2)::DOUBLE AS confidence FROM c"""


@query(_context_sql())
def context_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.contexts(files(spark, sf_dir))


@query()
def taint_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taint.taint_findings(taint.taint_flows(classify(files(spark, sf_dir))))


def _structure_sql() -> str:
    """The flows that the pieces of code hold: a source that stands itself in a call, a template of it or an assigned property."""
    forms = (("eval(", "code_injection", 1, r"\beval\(\s*"), ("query(", "sql_injection", 1, r"\.query\(.*\$\{"), ("innerHTML", "xss", 0, r"\.innerHTML = "))
    source = r"req\.(?:body|query|params|headers)\b"
    return f"WITH {files_sql()}, coded AS (SELECT path, {LANGUAGE_SQL} AS language, line_no, line FROM lines) " + " UNION ALL ".join(
        f"SELECT path, language, regexp_extract(line, {quoted(source)}) AS source, line_no::INT AS source_line, {quoted(sink)} AS sink, {quoted(kind)} AS sink_kind, line_no::INT AS sink_line, 0 AS steps, {n} AS argument "
        f"FROM coded WHERE language IN ('javascript', 'typescript') AND regexp_matches(line, {quoted(form + source)})"
        for sink, kind, n, form in forms
    )


@query(_structure_sql())
def taint_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.structure_flows(classify(files(spark, sf_dir)))
