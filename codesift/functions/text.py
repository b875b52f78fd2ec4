"""Column functions on source text: lines, trims, match positions, snippets, fingerprints."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = " \t\n\x0b\f\r\u00a0\u2028\u2029\ufeff"


def trimmed(text: Column) -> Column:
    """Without white space at both ends: tabs, line ends, no-break spaces and the like, not spaces alone."""
    return F.btrim(text, F.lit(BLANK))


def split_lines(content: Column) -> Column:
    """Lines end at a line feed; a carriage return stays, and so does an empty last line."""
    return F.split(content, "\n", -1)


def explode_lines(files: DataFrame, content: str = "content", around: int | None = None, along: Sequence[str] = (), only: DataFrame | None = None) -> DataFrame:
    """The rows of ``files``, without the content, for each of its lines: line_no (from 1) and line.

    ``around`` adds snippet, the line with so many before and after it, so that
    findings need not meet their file's content again.  ``along``: arrays with
    an entry for each line, of which a line gets its own.
    ``only``, a table small enough to be broadcast, has a row for each line
    that is wanted: snippets and entries are worked out for these alone.
    """
    others = [F.col(c) for c in files.columns if c not in (content, *along)]
    # Outer, though every text has a line: for inner ones Spark asks first whether there are any, and so splits thrice.
    files = files.where(F.col(content).isNotNull())
    if only is not None:
        # Within one stage a line does not copy its file's lines; its array is pointed at.
        rows = files.select(*others, *along, split_lines(F.col(content)).alias("_lines")).select("*", F.posexplode_outer("_lines").alias("_at", "line")).join(F.broadcast(only), "line")
        shown = [F.array_join(F.slice("_lines", F.greatest(F.col("_at") - around, F.lit(0)) + 1, F.least("_at", F.lit(around)) + around + 1), "\n").alias("snippet")] if around is not None else []
        return rows.select(*others, (F.col("_at") + 1).alias("line_no"), "line", *shown, *(F.get(c, F.col("_at")).alias(c) for c in along), *(c for c in only.columns if c != "line"))
    if around is None and not along:
        return files.select(*others, F.posexplode_outer(split_lines(F.col(content))).alias("_at", "line")).select(*others, (F.col("_at") + 1).alias("line_no"), "line")

    def cut(x: Column, i: Column) -> Column:
        shown = [F.array_join(F.slice("_lines", F.greatest(i - around, F.lit(0)) + 1, F.least(i, F.lit(around)) + around + 1), "\n").alias("snippet")] if around is not None else []
        return F.struct(x.alias("line"), *shown, *(F.get(c, i).alias(c) for c in along))

    rows = files.select(*others, *along, split_lines(F.col(content)).alias("_lines")).select(*others, F.posexplode_outer(F.transform("_lines", cut)).alias("_at", "_x"))
    return rows.select(*others, (F.col("_at") + 1).alias("line_no"), "_x.line", *(["_x.snippet"] if around is not None else []), *(f"_x.{c}" for c in along))


def different_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """line: each different line of the files once.  A batch drops its own repeats, so few rows are left to be shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = pc.unique(pc.list_flatten(pc.split_pattern(batch.column(0), "\n")))
            yield pa.RecordBatch.from_arrays([lines], names=["text"])

    some = files.select(content).mapInArrow(run, "text string")
    # Split once more by Spark, so that broken letters are read as in all other lines.
    return explode_lines(some.distinct(), "text").select("line").distinct()


def measured(lines: DataFrame, name: str, different: DataFrame | None = None, **columns: Column) -> DataFrame:
    """The lines with columns that hang on ``line`` alone, worked out once for each different line, as code repeats its lines.

    They lie in a written table, which Spark broadcasts if it is small enough.
    ``different`` has each different line once, where a caller knows them already.
    """
    from codesift.session import written

    once = (lines.select("line").distinct() if different is None else different).select("line", *(c.alias(n) for n, c in columns.items()))
    return lines.join(written(once, name), "line")


def positions(line: Column, java: str, prefix: str = "") -> Column:
    """All matches of an expression in a line, in order: array<struct<col, hit>>, columns from 1.

    The text is split at the matches; lengths of gaps and hits give the columns.
    Empty matches are left out.
    """
    none = F.array().cast("array<struct<col:int,hit:string>>")
    return F.when(line.rlike(f"{prefix}{java}"), placed(line, F.lit(f"{prefix}{java}"))).otherwise(none)


def placed(line: Column, expression: Column) -> Column:
    """As ``positions``, of an expression in a column: gaps and hits come from two plain searches."""
    gaps, hits = F.split(line, expression, -1), F.regexp_extract_all(line, expression, F.lit(0))
    # An empty match at the very begin splits nothing.
    pairs = F.arrays_zip(gaps.alias("gap"), F.when(F.size(gaps) == F.size(hits), F.slice(hits, 2, F.greatest(F.size(hits) - 1, F.lit(0)))).otherwise(hits).alias("hit"))
    start = F.named_struct(F.lit("at"), F.lit(1), F.lit("out"), F.array().cast("array<struct<col:int,hit:string>>"))
    return F.aggregate(
        pairs,
        start,
        lambda acc, x: F.named_struct(
            F.lit("at"),
            acc["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0)),
            F.lit("out"),
            F.concat(acc["out"], F.array(F.named_struct(F.lit("col"), acc["at"] + F.length(x["gap"]), F.lit("hit"), x["hit"]))),
        ),
        lambda acc: F.filter(acc["out"], lambda m: F.length(m["hit"]) > 0),
    )


def snippet(content: Column, line_no: Column, around: int = 3) -> Column:
    """The line with ``around`` lines before and after it."""
    lines = split_lines(content)
    first = F.greatest(line_no - around, F.lit(1))
    return F.array_join(F.slice(lines, first, F.least(line_no + around, F.size(lines)) - first + 1), "\n")


def fingerprint(rule: Column, path: Column, code: Column) -> Column:
    """16 hex digits of SHA-256 over rule, path and trimmed snippet; the line number plays no part."""
    return F.substring(F.sha2(F.concat_ws("::", rule, path, trimmed(code)), 256), 1, 16)


def entropy(token: Column) -> Column:
    """Shannon entropy in bits a character; 0 for an empty token."""
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda d: d == c)) / n
    return F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


#: Severities in order; anything else comes last.
SEVERITIES = ("critical", "high", "medium", "low")


def severity_rank(severity: Column) -> Column:
    rank = F.lit(len(SEVERITIES))
    for i, name in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(severity == name, i).otherwise(rank)
    return rank
