"""Pattern matching over lines: the generate operator behind all detectors, and its row filters."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.detectors import COMMENT, DEFINITION, Pattern
from codesift.functions.text import different_lines, explode_lines, placed
from codesift.session import written

SHORT = 10
#: Letters of the different lines with matches, and of what they match, that are broadcast; more meet all lines by a shuffle.
FEW = 4_000_000


def literal_of(p: Pattern) -> str | None:
    """A text that any match must hold, in lower case: the longest run of plain letters outside groups and options."""
    plain = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\][*+?]?|\{[^}]*\}", " ", p.regex)
    depth, out = 0, []
    for i, c in enumerate(plain):
        depth += c == "("
        out.append(c if depth == 0 and not (i + 1 < len(plain) and plain[i + 1] in "*?") else " ")
        depth -= c == ")"
    if "|" in "".join(out):
        return None
    runs = re.findall(r"[A-Za-z_]{3,}", "".join(out))
    return max(runs, key=len).lower() if runs else None


def any_of(column: Column, expressions: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (column.rlike(e) for e in expressions), F.lit(False))


def not_comment(line: Column) -> Column:
    return ~line.rlike(COMMENT)


def not_definition(line: Column) -> Column:
    return ~any_of(line, DEFINITION)


def matches(lines: DataFrame, patterns: Sequence[Pattern], keep: Sequence[str] = ()) -> DataFrame:
    """path, line_no, line, pattern_ord (place in ``patterns``), col, hit and the columns to ``keep`` of every match that no filter drops.

    ``lines`` has path, line_no and line, and for patterns with skip_file a
    boolean column for each of those expressions, named by ``file_flag``.
    Each line is judged for itself, as a stream needs; ``detect`` judges equal lines once.
    """
    flags = sorted({file_flag(e) for p in patterns for e in p.skip_file})
    return _of_files(_of_lines(lines, patterns, ("path", "line_no", *keep, *flags)), patterns, keep)


def line_matches(lines: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """line, pattern_ord, col and hit of every match of each different line, before the filters that look at its file."""
    return _of_lines(lines.select("line").distinct(), patterns)


def text_matches(files: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """``line_matches`` of the lines of whole texts (content)."""
    return _of_lines(different_lines(files), patterns)


def _of_lines(lines: DataFrame, patterns: Sequence[Pattern], keep: Sequence[str] = ()) -> DataFrame:
    """Each pattern runs once per line as a literal, so it is compiled once per
    task; places are found for the lines that match only.
    """
    line = F.col("line")
    rows = lines.where(not_comment(line) & not_definition(line)).withColumn("_low", F.lower(line))
    tests: dict[str | None, list[Column]] = {}
    for k, p in enumerate(patterns):
        test = line.rlike(p.java)
        if p.need_line:
            test &= line.rlike(p.need_line)
        if p.skip_line:
            test &= ~any_of(line, p.skip_line)
        tests.setdefault(literal_of(p), []).append(F.when(test, F.lit(k)))
    # Expressions run only on lines that hold the text their matches must hold.
    none = F.array().cast("array<int>")
    gated = [F.array(*t) if text is None else F.when(F.col("_low").contains(text), F.array(*t)).otherwise(none) for text, t in tests.items()]
    hit = F.filter(F.concat(*gated), lambda k: k.isNotNull())
    rows = rows.select(*keep, "line", F.explode(hit).alias("pattern_ord"))
    # Few lines are left: their expressions come from a table, and places are found for them only.
    table = lines.sparkSession.createDataFrame([(k, p.java, "|".join(f"(?:{e})" for e in p.skip_hit) or None) for k, p in enumerate(patterns)], "pattern_ord int, _java string, _skip string")
    rows = rows.join(F.broadcast(table), "pattern_ord").select(*keep, "line", "pattern_ord", "_skip", F.explode(placed(line, F.col("_java"))).alias("m"))
    rows = rows.select(*keep, "line", "pattern_ord", "_skip", F.col("m.col").alias("col"), F.col("m.hit").alias("hit"))
    return rows.where(F.col("_skip").isNull() | ~F.rlike("hit", F.col("_skip"))).drop("_skip")


def _of_files(found: DataFrame, patterns: Sequence[Pattern], keep: Sequence[str]) -> DataFrame:
    """Without the matches that their path or their file's flags exclude."""
    excluded: dict[tuple, list[int]] = {}
    for k, p in enumerate(patterns):
        if p.skip_path or p.skip_file:
            excluded.setdefault((p.skip_path, p.skip_file), []).append(k)
    for (paths, wholes), ks in excluded.items():
        out = any_of(F.col("path"), paths)
        for e in wholes:
            out |= F.col(file_flag(e))
        found = found.where(~(F.col("pattern_ord").isin(*ks) & F.coalesce(out, F.lit(True))))
    return found.select("path", "line_no", "line", *keep, "pattern_ord", "col", "hit")


def file_flag(expression: str) -> str:
    import hashlib

    return "file_" + hashlib.md5(expression.encode()).hexdigest()[:8]


def with_file_flags(files: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """A boolean column for each whole-file expression, computed once a file."""
    expressions = sorted({e for p in patterns for e in p.skip_file})
    return files.select("*", *(holds(F.col("content"), e).alias(file_flag(e)) for e in expressions))


def holds(text: Column, expression: str) -> Column:
    """``text.rlike(expression)``; what is looked for as plain words is searched as such, over whole files many times faster."""
    options = re.sub(r"^\(\?s\)", "", expression).split("|")
    if all(re.fullmatch(r"[\w-]+(?:\.\*[\w-]+)*", o) for o in options):
        words = lambda o: reduce(lambda a, b: a & b, (text.contains(w) for w in o.split(".*")))
        ordered = any(".*" in o for o in options)
        some = reduce(lambda a, b: a | b, map(words, options))
        return some & text.rlike(expression) if ordered else some
    return text.rlike(expression)


def rules_of(patterns: Sequence[Pattern]) -> list[tuple]:
    """pattern_ord and what a finding takes from its pattern, as rows of a small table."""
    return [(k, p.rule, p.severity, p.confidence, p.category, p.subcategory, p.cwe, p.message) for k, p in enumerate(patterns)]


RULE_COLUMNS = "pattern_ord int, rule_id string, severity string, confidence string, category string, subcategory string, cwe string, message string"


def detect(files: DataFrame, patterns: Sequence[Pattern], keep: Sequence[str] = (), around: int | None = None, along: Sequence[str] = (), source: DataFrame | None = None) -> DataFrame:
    """Matches with their rule's columns and the columns to ``keep``, over files (path, content) of at least ten characters.

    Code repeats its lines: the different ones are matched first, into a written
    table that all lines then meet in one join.
    ``around``, ``along``: as in ``explode_lines``; the snippet and the entries are kept too.
    ``source``: the same files, where their lines are cheaper to come by.
    """
    long_enough = files.where(F.length("content") >= SHORT)
    flagged = with_file_flags(long_enough.select("path", "content", *keep, *along), patterns)
    table = files.sparkSession.createDataFrame(rules_of(patterns), RULE_COLUMNS)
    once = written(text_matches(long_enough if source is None else source.where(F.length("content") >= SHORT), patterns), "lines")
    if (once.agg(F.sum(F.length("line") + F.length("hit"))).first()[0] or 0) <= FEW:
        by_line = once.groupBy("line").agg(F.collect_list(F.struct("pattern_ord", "col", "hit")).alias("_found"))
        lines = explode_lines(flagged, around=around, along=along, only=by_line)
        found = lines.select(*(c for c in lines.columns if c != "_found"), F.inline("_found"))
    else:
        found = explode_lines(flagged, around=around, along=along).join(once, "line")
    keep = (*keep, *along, *(["snippet"] if around is not None else []))
    return _of_files(found, patterns, keep).join(F.broadcast(table), "pattern_ord")
