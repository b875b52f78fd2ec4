"""The registered queries of the thirteen operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.llm.decontamination import contaminated
from codesift.llm.filter_audit import filter_audit
from codesift.llm.line_dedup import line_dedup
from codesift.llm.minhash import minhash_groups
from codesift.llm.mixing import mix
from codesift.llm.neighbours import nearest
from codesift.llm.simhash import simhash_dedup
from codesift.llm.substring_dedup import substring_dedup
from codesift.llm.suffix_dedup import suffix_dedup
from codesift.llm.token_counts import token_counts
from codesift.llm.toxicity import toxicity_scores
from codesift.llm.url_filter import WORD_RULES, host_and_path, judged
from codesift.llm.whitening import whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.col("text").alias("before"))
    lines = lambda c: F.size(F.split(c, "\n", -1))
    found = line_dedup(docs)
    return found.select(
        "doc_id",
        "source",
        lines("before").cast("long").alias("n_lines"),
        (F.length("before") - F.length("text")).cast("long").alias("n_chars_removed"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def page_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 on web pages: lines of HTML on more than a tenth of the pages of their host."""
    host, _ = host_and_path(F.col("url"))
    pages = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), "html", F.col("html").alias("before"))
    found = line_dedup(pages, host_col="host", text_col="html")
    return found.select("page_id", "host", (F.length("before") - F.length("html")).cast("long").alias("n_chars_removed"), F.sha2("html", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_decontamination, op3_neighbours, op4_simhash, op5_token_counts, op6_suffix_dedup, op7_mixing, op8_toxicity, op9_substring_dedup, op10_line_dedup, op11_whitening, op12_filter_audit, op13_minhash, page_line_dedup)}


def _words_sql() -> str:
    """The word rule that decides, longest name first, as a chain of conditions."""
    order = sorted(range(len(WORD_RULES)), key=lambda i: (-len(WORD_RULES[i].name), i))
    return " ".join(f"WHEN regexp_matches(host || path, '{WORD_RULES[i].pattern}') THEN '{WORD_RULES[i].name}'" for i in order)


def _lines_sql(texts: str, result: str) -> str:
    """Line dedup of doc_id, host and text."""
    return f"""
        WITH docs AS (SELECT doc_id, host, text, string_split(text, chr(10)) AS lines FROM ({texts})),
        totals AS (SELECT host, count(*) AS total FROM docs GROUP BY host),
        once AS (SELECT DISTINCT doc_id, host, line FROM (SELECT doc_id, host, unnest(lines) AS line FROM docs) WHERE length(trim(line, ' ')) > 0),
        counts AS (SELECT host, line, count(*) AS pages FROM once GROUP BY host, line HAVING count(*) >= 2),
        flagged AS (SELECT c.host, list(c.line) AS gone FROM counts c JOIN totals t ON c.host IS NOT DISTINCT FROM t.host WHERE c.pages > 0.1 * t.total GROUP BY c.host),
        kept AS (SELECT d.doc_id, d.host, d.text AS before, d.lines,
                 CASE WHEN f.gone IS NULL THEN d.text ELSE array_to_string(list_filter(d.lines, lambda x: NOT list_contains(f.gone, x)), chr(10)) END AS text
                 FROM docs d LEFT JOIN flagged f ON d.host IS NOT DISTINCT FROM f.host)
        {result}
    """


ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": f"""
        WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        hosts AS (SELECT *, CASE
            WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
            WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
            WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
            WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM parts),
        judged AS (SELECT *, CASE WHEN rule IS NOT NULL THEN NULL {_words_sql()} END AS words FROM hosts)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL OR words IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, words
        FROM judged
    """,
    "op9_substring_dedup": """
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
        win AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS start, unnest(list_transform(range(1, len(w) - 18), lambda i: md5_number(array_to_string(w[i:i + 19], ' ')))) AS k FROM d),
        rep AS (SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY k ORDER BY doc_id, start) AS n FROM win) WHERE n > 1),
        words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
        marked AS (SELECT a.doc_id, a.i, word, coalesce(max(r.start) OVER x >= a.i - 19, false) AS gone FROM words a LEFT JOIN rep r ON r.doc_id = a.doc_id AND r.start = a.i WINDOW x AS (PARTITION BY a.doc_id ORDER BY a.i)),
        cut AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id
    """,
    "op10_line_dedup": _lines_sql(
        "SELECT doc_id, source AS host, text FROM documents",
        "SELECT doc_id, host AS source, len(lines)::BIGINT AS n_lines, (length(before) - length(text))::BIGINT AS n_chars_removed, sha256(text) AS kept_sha256 FROM kept",
    ),
    "op12_filter_audit": """
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
        marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT d.part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                     (len(w) < 100)::INT AS a, (100 * len(list_distinct(w)) < 80 * len(w))::INT AS b,
                     (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text))::INT AS c, regexp_matches(text, '[#$%&*|]')::INT AS d,
                     coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY sha256(text)), false)::INT AS e
              FROM d LEFT JOIN marks ON marks.doc_id = d.doc_id),
        masks AS (SELECT part, good, toxic, a, b, c, d, e, count(*) AS n FROM m GROUP BY ALL),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
        steps AS (SELECT filter_order, step::INT AS step, filter_order[step] AS f, filter_order[1:step - 1] AS before FROM orders, range(1, 6) g(step)),
        met AS (SELECT part, filter_order, step, f, good, toxic, n, a + b + c + d + e AS fails,
                      CASE f WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END = 1 AS fail,
                      a * strpos(before, 'A') + b * strpos(before, 'B') + c * strpos(before, 'C') + d * strpos(before, 'D') + e * strpos(before, 'E') > 0 AS gone FROM masks, steps),
        counted AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT gone AND NOT fail), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND fail), 0)::BIGINT AS removed,
                           coalesce(sum(n) FILTER (gone AND fail), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fail AND fails = 1), 0)::BIGINT AS unique_fails,
                           coalesce(sum(n) FILTER (NOT gone AND fail AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (NOT gone AND fail AND toxic), 0)::BIGINT AS toxic_lost FROM met GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM counted
    """,
    "op13_minhash": """
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
        s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                     ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS x FROM d),
        keyed AS (SELECT doc_id, len(x) AS n, CASE WHEN len(x) > 0 THEN md5(array_to_string(x, chr(10))) END AS k, x FROM s),
        nodes AS (SELECT k, min(doc_id) AS node, any_value(n) AS n, any_value(x) AS x FROM keyed WHERE k IS NOT NULL GROUP BY k),
        e AS (SELECT node, n, unnest(x) AS g FROM nodes),
        rare AS (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM e),
        prefix AS (SELECT node, n, g FROM rare QUALIFY row_number() OVER (PARTITION BY node ORDER BY c, g) <= 15 * n // 100 + 1),
        pairs AS (SELECT DISTINCT p.node AS a, q.node AS b FROM prefix p JOIN prefix q ON p.g = q.g AND p.node < q.node AND 100 * p.n >= 85 * q.n AND 100 * q.n >= 85 * p.n),
        links AS (SELECT a, b FROM pairs JOIN nodes x ON x.node = a JOIN nodes y ON y.node = b
                  WHERE 100 * len(list_intersect(x.x, y.x)) >= 85 * (x.n + y.n - len(list_intersect(x.x, y.x)))),
        reach(node, r) AS (SELECT node, node FROM nodes UNION SELECT way.v, reach.r FROM reach JOIN (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links) way ON way.u = reach.node AND reach.r < way.v),
        least AS (SELECT node, min(r) AS component_id FROM reach GROUP BY node)
        SELECT doc_id, keyed.n AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
        FROM keyed LEFT JOIN nodes ON nodes.k = keyed.k LEFT JOIN least ON least.node = nodes.node
    """,
    "page_line_dedup": _lines_sql(
        """SELECT page_id AS doc_id, html AS text, translate(regexp_extract(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '^([^/?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM pages""",
        "SELECT doc_id AS page_id, host, (length(before) - length(text))::BIGINT AS n_chars_removed, sha256(text) AS kept_sha256 FROM kept",
    ),
}
