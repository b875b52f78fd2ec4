"""Two thousand rules over the lines of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.detectors import COMMENT, DEFINITION, Pattern
from codesift.functions.text import explode_lines
from codesift.operators.many import matches_of_many
from codesift.queries.sql import any_rx, match_sql, rx

#: The 45 commonest pairs of letters of English text, by which rules are made: a word that begins with two of them.
PAIRS = "th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur me io ic co ro ll".split()
RULES = tuple(
    Pattern(f"word-{a}{b}", f" {a}{b}[a-z]*", f"a word in {a}{b}", "low", "low", "naming", "", "", skip_hit=("tion$",))
    for a in PAIRS
    for b in PAIRS
)


def many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each match of 2,025 rules in the lines of the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    found = matches_of_many(explode_lines(docs), RULES)
    rule = F.element_at(F.array(*(F.lit(p.rule) for p in RULES)), F.col("pattern_ord") + 1)
    return found.select("path", F.col("line_no").cast("long").alias("line_no"), F.col("col").cast("long").alias("col"), rule.alias("rule_id"), "hit")


# A hit begins at a blank and ends before the next, so those of all rules are the hits of one expression.
_NAMES = ", ".join(f"'{p}'" for p in PAIRS)
_LINES = "SELECT path, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM (SELECT doc_id::VARCHAR AS path, string_split(text, chr(10)) AS ls FROM documents)"
_PLAIN = f"(SELECT * FROM ({_LINES}) WHERE NOT {rx('line', COMMENT)} AND NOT {any_rx('line', DEFINITION)})"
_SQL = f"""SELECT path, line_no::BIGINT AS line_no, col::BIGINT AS col, 'word-' || lower(hit[2:5]) AS rule_id, hit FROM ({match_sql(_PLAIN, ' [a-z]{4}[a-z]*', '(?i)')})
    WHERE lower(hit[2:3]) IN ({_NAMES}) AND lower(hit[4:5]) IN ({_NAMES}) AND NOT regexp_matches(hit, 'tion$')"""

QUERIES = {"many_rules": many_rules}
ORACLE_SQL = {"many_rules": _SQL}
