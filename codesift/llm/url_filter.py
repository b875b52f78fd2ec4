"""URL filters (operator 1): pattern rules found by their rarest literal token.

Every rule names tokens that any URL it fits must hold whole.  It is filed
under the one that is rarest among the URLs at hand; a URL's tokens fetch the
rules filed under them, and only those run their regular expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.llm.tables import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts tokens; word boundaries (\b) stand between a token and anything else.
BETWEEN = r"[^a-z0-9_]+"
#: Rules up to this many (about 200 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    """A regular expression for host and path, laid end to end, in syntax that Java and RE2 share.

    Of the rules that fit a URL the one with the greatest (tier, length of name) decides, the first listed among equals.
    """

    name: str
    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    tier: int = 0


def host_rule(verdict: str, rule: str) -> Rule:
    """``example.com/en/``: the host and its subdomains, and the paths that start so (letter case counts in paths)."""
    host, slash, path = rule.partition("/")
    path = slash + path
    whole = path.split("/")[1:-1]  # what follows the last slash may go on in the URL
    tokens = [t for part in [*host.split("."), *whole] for t in re.split(BETWEEN, part.lower()) if t]
    return Rule(rule, r"^(?:[^/]*\.)?" + re.escape(host) + (re.escape(path) if path else r"(?:/|$)"), verdict, tuple(dict.fromkeys(tokens)), tier=1)


def word_rule(verdict: str, *words: str) -> Rule:
    """Words in a row, in any letter case, parted by one character that no token holds."""
    return Rule("-".join(words), r"(?i)\b" + "[^a-z0-9_]".join(map(re.escape, words)) + r"\b", verdict, tuple(w.lower() for w in words))


#: Host rules that come before the words.
HOST_RULES = (
    host_rule("allow", "com/"),
    host_rule("block", "example.com/en/"),
    host_rule("allow", "www.example.com/en/"),
    host_rule("block", "net/es/"),
    host_rule("block", "net/fr/"),
)
#: Words of gambling, adult and spam sites.
WORD_RULES = tuple(
    word_rule("block", *w.split())
    for w in ("free bets", "casino", "online casino", "poker", "sportsbook", "betting", "lottery", "porn", "xxx", "escorts", "viagra", "cheap pills", "payday loans", "torrent", "warez", "keygen")
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#``, A-Z lower-cased; path: then up to ``?`` or ``#``.  Else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


RULE_ROW = "place long, name string, pattern string, verdict string, tier int, tokens array<string>"
#: Rules without a token, which run on every URL.
MOST_LOOSE = 1_000


def rule_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """Rules as the rows that ``judged`` reads."""
    return spark.createDataFrame([(i, r.name, r.pattern, r.verdict, r.tier, list(r.tokens)) for i, r in enumerate(rules)], RULE_ROW)


def host_rules(listed: DataFrame, verdict_col: str = "verdict", rule_col: str = "rule") -> DataFrame:
    """Host rules (``host_rule``) of a table of verdicts and rules like ``example.com/en/``; rules of equal text keep one, a null rule is none."""
    rule = F.col(f"`{rule_col}`")
    rows = listed.where(rule.isNotNull()).groupBy(rule.alias("name")).agg(F.min(F.col(f"`{verdict_col}`")).alias("verdict"))
    host, path = F.split_part("name", F.lit("/"), F.lit(1)), F.regexp_extract("name", "^[^/]*(/.*)$", 1)
    quoted = lambda c: F.regexp_replace(c, r"([^A-Za-z0-9_/])", r"\\$1")
    whole = F.regexp_extract(path, "^(.*/)", 1)
    words = F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", host, whole)), BETWEEN), lambda t: t != ""))
    pattern = F.concat(F.lit(r"^(?:[^/]*\.)?"), quoted(host), F.when(path == "", F.lit(r"(?:/|$)")).otherwise(quoted(path)))
    return rows.select(F.xxhash64("name").alias("place"), "name", pattern.alias("pattern"), "verdict", F.lit(1).alias("tier"), words.alias("tokens"))


def judged(urls: DataFrame, rules: Iterable[Rule] | DataFrame = (*HOST_RULES, *WORD_RULES), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and words of every row.

    rules: a list, or a table of any size such as ``rule_table`` and
    ``host_rules`` return, with names that differ.  rule: the name of the host
    rule (tier 1) that decides, else null; words: that of the word rule (tier
    0), else null; verdict: that of either, else ``allow``.  Null URLs and URLs
    without ``://`` have an empty host and path and are allowed; repeated rows
    each get a row, null ids are passed on, an empty table gives an empty
    result; other columns are not read.
    """
    table = rules if isinstance(rules, DataFrame) else rule_table(urls.sparkSession, rules)
    table = written(table, "rules")
    host, path = host_and_path(F.col(f"`{url_col}`"))
    rows = urls.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    # A verdict depends on host and path alone: each pair is judged once, however many rows have it.
    pages = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("rows"))
    tokens = pages.select("host", "path", "rows", F.explode(F.array_distinct(F.split(F.lower(F.concat("host", "path")), BETWEEN))).alias("token"))
    hint = F.broadcast if table.count() <= BROADCAST_RULES else lambda df: df
    wanted = table.select(F.explode("tokens").alias("token")).distinct()
    often = tokens.join(hint(wanted), "token").groupBy("token").agg(F.sum("rows").alias("often"))
    filed = (
        table.select("*", F.explode("tokens").alias("token"))
        .join(hint(often), "token", "left")
        .groupBy("place", "name", "pattern", "verdict", "tier")
        .agg(F.min_by("token", F.struct(F.coalesce("often", F.lit(0)), "token")).alias("token"))
    )
    fetched = tokens.join(hint(written(filed, "filed")), "token").drop("token", "rows")
    fits = fetched.where(F.rlike(F.concat("host", "path"), F.col("pattern"))).drop("pattern")
    loose = table.where(F.size("tokens") == 0).orderBy("place").limit(MOST_LOOSE + 1).collect()
    if len(loose) > MOST_LOOSE:
        raise ValueError(f"more than {MOST_LOOSE} rules name no token and would run on every URL")
    if loose:
        tried = F.array(*(F.when(F.rlike(F.concat("host", "path"), F.lit(r["pattern"])), F.struct(*(F.lit(r[n]).alias(n) for n in ("place", "name", "verdict", "tier")))) for r in loose))
        fits = fits.unionByName(pages.select("host", "path", F.explode(F.array_compact(tried)).alias("_r")).select("host", "path", "_r.*"))
    # Written, so that the join below is of two scans and a page with very many rows is dealt to many tasks.
    best = written(fits.groupBy("host", "path").agg(F.max_by(F.struct("name", "verdict", "tier"), F.struct("tier", F.length("name"), -F.col("place"))).alias("best")), "verdicts")
    found = rows.join(best.hint("merge"), ["host", "path"], "left")
    return found.select(
        "page_id",
        "host",
        "path",
        F.when(F.col("best.tier") == 1, F.col("best.name")).alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
        F.when(F.col("best.tier") == 0, F.col("best.name")).alias("words"),
    )
