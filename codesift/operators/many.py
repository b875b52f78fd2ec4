"""Thousands of patterns at once: an automaton finds the texts that matches must hold, and only the patterns met run.

``match.matches`` tries every pattern on every line that passes its gate, so a
line costs as much as there are patterns.  Here each pattern is filed under a
set of texts, of which any match holds at least one, read off its parsed form
(inside groups and alternatives too).  All texts go into one Aho-Corasick
automaton, which each Python worker builds once; a line walks it once, whatever
the number of patterns, and the few patterns it meets run on it as a join with
the table of patterns.  Patterns that need no text run on every line as literals.
A pattern that begins with its texts and is made of letters and classes alone
(``anchored``) is tried in that same walk, at the very places of its texts, so
that lines are neither copied for it nor read again.
Results equal those of ``match.matches``.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Mapping, Sequence
from re import _constants as c
from re import _parser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.detectors import Pattern
from codesift.functions.text import explode_lines, placed
from codesift.operators.match import RULE_COLUMNS, SHORT, file_flag, not_comment, not_definition, rules_of, with_file_flags

#: Letters of a text at least, texts of a set at most, and texts that a stretch of a pattern may spell at most.
LEAST, MOST, SPELLED = 3, 64, 16
#: Bytes of a table of patterns that is broadcast; a larger one is joined as Spark sees fit.
BROADCAST_BYTES = 32 << 20

Texts = frozenset[str]
ZERO_WIDTH = (c.AT, c.ASSERT, c.ASSERT_NOT)
REPEATS = (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT)


def spelled(op, value) -> Texts | None:
    """All texts, in lower case, that an element of a pattern can be; None if they are many, or not all ASCII."""
    if op in ZERO_WIDTH:
        return frozenset([""])
    if op is c.LITERAL:
        return frozenset([chr(value).lower()]) if value < 128 else None
    if op is c.IN:
        if not all(kind is c.LITERAL and v < 128 for kind, v in value):
            return None
        found = frozenset(chr(v).lower() for _, v in value)
    elif op is c.SUBPATTERN or op is c.ATOMIC_GROUP:
        return all_spelled(value[-1] if op is c.SUBPATTERN else value)
    elif op is c.BRANCH:
        each = [all_spelled(alternative) for alternative in value[1]]
        if None in each:
            return None
        found = frozenset().union(*each)
    elif op in REPEATS and value[1] == 1:
        found = all_spelled(value[2])
        if found is None:
            return None
        found = found if value[0] else found | {""}
    else:
        return None
    return found if len(found) <= SPELLED else None


def all_spelled(items: Iterable) -> Texts | None:
    run = frozenset([""])
    for op, value in items:
        part = spelled(op, value)
        if part is None or len(run) * len(part) > SPELLED:
            return None
        run = frozenset(a + b for a in run for b in part)
    return run


def needed(items: Iterable) -> list[Texts]:
    """Sets of texts of a parsed pattern: of each of these sets a match holds at least one text, in some letter case."""
    out: list[Texts] = []
    run = frozenset([""])

    def close() -> None:
        if min(map(len, run)) >= LEAST:
            out.append(run)

    for op, value in items:
        part = spelled(op, value)
        if part is not None and len(run) * len(part) <= SPELLED:
            run = frozenset(a + b for a in run for b in part)
            continue
        close()
        run = part if part is not None else frozenset([""])
        if op is c.SUBPATTERN or op is c.ATOMIC_GROUP:
            out += needed(value[-1] if op is c.SUBPATTERN else value)
        elif op in REPEATS and value[0]:
            out += needed(value[2])
        elif op is c.BRANCH:
            each = [best(needed(alternative)) for alternative in value[1]]
            if None not in each and len(union := frozenset().union(*each)) <= MOST:
                out.append(union)
    close()
    return out


def best(sets: Sequence[Texts], counts: Mapping[str, int] | None = None) -> Texts | None:
    """The set that the fewest lines hold; without counts, that of the longest and then the fewest texts."""
    rarity = (lambda s: (sum(counts.get(t, 0) for t in s), -min(map(len, s)), len(s), sorted(s))) if counts is not None else (lambda s: (-min(map(len, s)), len(s), sorted(s)))
    return min(sets, key=rarity, default=None)


def texts_of(p: Pattern) -> list[Texts]:
    """The sets of a pattern; none if a match need hold no text, or the pattern says what only Java's syntax knows."""
    if "&&" in p.regex or "[[" in p.regex:
        return []
    try:
        return needed(_parser.parse(p.regex, re.DOTALL))
    except (re.error, RecursionError, OverflowError):
        return []


def begins(items: Iterable) -> Texts | None:
    """Texts that a match begins with, one of which it must be; None if they are short or many."""
    run = frozenset([""])
    for op, value in items:
        part = None if op in ZERO_WIDTH else spelled(op, value)
        if part is None or len(run) * len(part) > SPELLED:
            break
        run = frozenset(a + b for a in run for b in part)
    # Of one length, so that an automaton meets them in the order of their begins.
    size = min(map(len, run))
    return frozenset(t[:size] for t in run) if size >= LEAST else None


def is_plain(items: Iterable) -> bool:
    """Whether Java and Python agree on a parsed pattern, by its kinds of elements: ASCII letters, classes of these, and repeats, groups and alternatives of both."""
    for op, value in items:
        if op is c.LITERAL:
            fine = value < 128
        elif op is c.IN:
            fine = all(kind is c.LITERAL and v < 128 or kind is c.RANGE and v[1] < 128 for kind, v in value)
        elif op is c.SUBPATTERN:
            fine = not value[1] and not value[2] and is_plain(value[3])
        elif op is c.BRANCH:
            fine = all(map(is_plain, value[1]))
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            fine = is_plain(value[2])
        else:
            fine = False
        if not fine:
            return False
    return True


def anchored(p: Pattern) -> Texts | None:
    """The texts at whose places alone matches of a pattern begin, if it can be tried there: it is plain, and its line needs no other test."""
    if p.need_line or p.skip_line or "&&" in p.regex or "[[" in p.regex:
        return None
    try:
        parsed = list(_parser.parse(p.regex))
    except (re.error, RecursionError, OverflowError):
        return None
    return begins(parsed) if is_plain(parsed) else None


#: Texts with the patterns that begin with them: place, expression and whether letter case counts.
Starts = tuple[tuple[str, tuple[tuple[int, str, bool], ...]], ...]


def starting(patterns: Sequence[Pattern]) -> tuple[Starts, set[int]]:
    """The anchored patterns under their texts, and their places."""
    under: dict[str, list[tuple[int, str, bool]]] = {}
    places = set()
    for k, p in enumerate(patterns):
        for text in anchored(p) or ():
            under.setdefault(text, []).append((k, p.regex, p.case))
            places.add(k)
    return tuple((text, tuple(ps)) for text, ps in sorted(under.items())), places


@functools.lru_cache(maxsize=4)
def starter(starts: Starts):
    import ahocorasick

    built = ahocorasick.Automaton()
    compiled = functools.lru_cache(maxsize=None)(lambda regex, case: re.compile(regex, re.A if case else re.A | re.I).match)
    for text, patterns in starts:
        built.add_word(text, (len(text), tuple((k, compiled(regex, case)) for k, regex, case in patterns)))
    built.make_automaton()
    return built


#: ASCII letters only: some other letters become two, and places would shift.
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def tried(walked, line: str) -> list[tuple[int, int, str]]:
    """place, col and hit of each match of the anchored patterns in a line; a pattern's matches do not overlap."""
    out: list[tuple[int, int, str]] = []
    ends: dict[int, int] = {}
    for last, (length, patterns) in walked.iter(line.translate(LOWER)):
        at = last + 1 - length
        for k, match in patterns:
            if ends.get(k, 0) <= at and (m := match(line, at)):
                ends[k] = m.end()
                out.append((k, at + 1, m[0]))
    return out


MATCH = "array<struct<pattern_ord:int,col:int,hit:string>>"


def found_at(line: Column, starts: Starts) -> Column:
    """``tried`` of each line; a null line has no matches."""

    @F.arrow_udf(MATCH)
    def walk(lines: pa.Array) -> pa.Array:
        walked = starter(starts)
        ks, cols, hits, ends = [], [], [], [0]
        for x in lines.to_pylist():
            for k, col, hit in tried(walked, x) if x is not None else ():
                ks.append(k)
                cols.append(col)
                hits.append(hit)
            ends.append(len(ks))
        rows = pa.StructArray.from_arrays([pa.array(ks, pa.int32()), pa.array(cols, pa.int32()), pa.array(hits, pa.string())], names=["pattern_ord", "col", "hit"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return walk(line)


#: Texts with the places of the patterns filed under them.
Index = tuple[tuple[str, tuple[int, ...]], ...]


def indexed(patterns: Sequence[Pattern | None], counts: Mapping[str, int] | None = None) -> tuple[Index, list[int]]:
    """The index of the patterns, each under its rarest set, and the places of those that have none; a None is passed over."""
    under: dict[str, list[int]] = {}
    loose = []
    for k, p in enumerate(patterns):
        if p is None:
            continue
        chosen = best(texts_of(p), counts)
        if chosen is None:
            loose.append(k)
        for text in chosen or ():
            under.setdefault(text, []).append(k)
    return tuple((text, tuple(ks)) for text, ks in sorted(under.items())), loose


@functools.lru_cache(maxsize=4)
def automaton(index: Index):
    import ahocorasick

    built = ahocorasick.Automaton()
    for text, places in index:
        built.add_word(text, places)
    built.make_automaton()
    return built


def met(line: Column, index: Index) -> Column:
    """The places of the patterns of which a line holds a text, ascending; none of a null line."""
    if not index:
        return F.array().cast("array<int>")

    @F.pandas_udf("array<int>")
    def walk(lines: pd.Series) -> pd.Series:
        walked = automaton(index)
        return lines.map(lambda x: sorted({k for _, places in walked.iter(x.lower()) for k in places}) if x is not None else [])

    return walk(line)


def text_counts(lines: DataFrame, patterns: Sequence[Pattern]) -> dict[str, int]:
    """How many of all lines hold each text of each set, for ``counts``; as many entries as the patterns have texts."""
    texts = sorted({t for p in patterns for s in texts_of(p) for t in s})
    places = tuple((t, (k,)) for k, t in enumerate(texts))
    found = lines.select(F.explode(met(F.col("line"), places)).alias("k")).groupBy("k").count().collect()
    return {texts[r.k]: r["count"] for r in found}


#: The columns of a pattern's table.
TABLE = "pattern_ord int, _java string, _need string, _skip_line string, _skip_path string, _skip_file array<string>, _skip_hit string"


def table_of(patterns: Sequence[Pattern]) -> list[tuple]:
    either = lambda es: "|".join(f"(?:{e})" for e in es) or None
    return [
        (k, p.java, p.need_line, either(p.skip_line), either(p.skip_path), [file_flag(e) for e in p.skip_file], either(p.skip_hit))
        for k, p in enumerate(patterns)
    ]


def matches_of_many(lines: DataFrame, patterns: Sequence[Pattern], keep: Sequence[str] = (), counts: Mapping[str, int] | None = None) -> DataFrame:
    """As ``match.matches``, for any number of patterns: one walk of an automaton a line.

    ``counts``: of ``text_counts``, to file patterns under what is rare in
    these lines; the result is the same without.  Null lines match nothing.
    """
    patterns = list(patterns)
    spark, line = lines.sparkSession, F.col("line")
    starts, quick = starting(patterns)
    index, loose = indexed([p if k not in quick else None for k, p in enumerate(patterns)], counts)
    rows = lines.where(not_comment(line) & not_definition(line))
    always = F.filter(F.array(*(F.when(line.rlike(patterns[k].java), F.lit(k)) for k in loose)).cast("array<int>"), lambda k: k.isNotNull())
    flags = sorted({file_flag(e) for p in patterns for e in p.skip_file})
    held = F.filter(F.array(*(F.when(F.col(f), F.lit(f)) for f in flags)).cast("array<string>"), lambda f: f.isNotNull())
    rows = rows.select("path", "line_no", "line", *keep, held.alias("_held"), *([met(line, index).alias("_met")] if index or loose else []), *([found_at(line, starts).alias("_found")] if starts else []))
    # Matches come with their place; of the other patterns only it is known that their texts are there.
    both = ([F.col("_found")] if starts else []) + ([F.transform(F.concat("_met", always), lambda k: F.struct(k.alias("pattern_ord"), F.lit(None).cast("int").alias("col"), F.lit(None).cast("string").alias("hit")))] if index or loose else [])
    rows = rows.select("path", "line_no", "line", *keep, "_held", F.explode(F.concat(F.array().cast(MATCH), *both)).alias("_m")).select("path", "line_no", "line", *keep, "_held", "_m.*")
    listed = table_of(patterns)
    table = spark.createDataFrame(listed, TABLE)
    if sum(len(x) for row in listed for x in row if isinstance(x, str)) <= BROADCAST_BYTES:
        table = F.broadcast(table)
    fits = lambda column, e: F.col(e).isNotNull() & F.rlike(column, F.col(e))
    # A missing expression is null and skips nothing.
    rows = rows.join(table, "pattern_ord").where(F.col("_need").isNull() | F.rlike("line", F.col("_need")))
    rows = rows.where(~fits("line", "_skip_line") & ~fits("path", "_skip_path") & ~F.arrays_overlap("_skip_file", "_held"))
    if index or loose:
        known = F.array(F.struct("col", "hit"))
        rows = rows.select("path", "line_no", "line", *keep, "pattern_ord", "_skip_hit", F.explode(F.when(F.col("col").isNotNull(), known).otherwise(placed(line, F.col("_java")))).alias("m"))
        rows = rows.select("path", "line_no", "line", *keep, "pattern_ord", "_skip_hit", F.col("m.col").alias("col"), F.col("m.hit").alias("hit"))
    else:
        rows = rows.select("path", "line_no", "line", *keep, "pattern_ord", "_skip_hit", "col", "hit")
    return rows.where(~fits("hit", "_skip_hit")).drop("_skip_hit")


def detect_many(files: DataFrame, patterns: Sequence[Pattern], keep: Sequence[str] = (), around: int | None = None, along: Sequence[str] = (), counts: Mapping[str, int] | None = None) -> DataFrame:
    """As ``match.detect``, for any number of patterns."""
    long_enough = files.where(F.length("content") >= SHORT)
    lines = explode_lines(with_file_flags(long_enough.select("path", "content", *keep, *along), patterns), around=around, along=along)
    table = files.sparkSession.createDataFrame(rules_of(patterns), RULE_COLUMNS)
    return matches_of_many(lines, patterns, (*keep, *along, *(["snippet"] if around is not None else [])), counts).join(table, "pattern_ord")
