"""Pieces of whole files: literals, comments, imports, types, words and signs, over as many lines as they take.

A file is cut by one regular expression of its family of languages, whose
pieces laid end to end are the file.  The expressions are written in the syntax
that Python's ``re`` and RE2 share, so the oracles state them too.  Nothing is
ever refused: a literal without an end ends with its line, a comment, template
or triple-quoted text with the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRIPLE = r'"""(?:[\s\S]*?"""|[\s\S]*)'
DOUBLE = r'"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"?'
SINGLE = r"'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'?"
#: In some languages texts in double quotes run over lines, if they end at all.
WIDE = r'"[^"\\]*(?:\\[\s\S][^"\\]*)*"'
BLOCK_COMMENT = r"/\*(?:[\s\S]*?\*/|[\s\S]*)"
C_IMPORT = (
    r"""^[ \t]*(?:import[ \t*{"'][^;\n({]*(?:\{[^}]*\}|\([^)]*\))?[^;\n]*;?|#include\b[^\n]*|using[ \t]+[\w.]+;|use[ \t]+[\w\\]+;|package[ \t][^\n]*"""
    r"""|(?:const|let|var)[ \t]+[\w{}\s,:]+=\s*require\s*\([^)\n]*\)[^;\n]*;?)"""
)
#: An alias runs over lines that go on with | or &; an interface may hold braces in its braces.
TYPE = r"^[ \t]*(?:export[ \t]+)?(?:declare[ \t]+)?(?:type[ \t]+\w+[^=;\n]*=(?:[^;\n]|\n[ \t]*[|&])*;?|interface[ \t]+\w+[^{;\n]*(?:\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\})?)"
PYTHON_IMPORT = r"^[ \t]*(?:from[ \t]+[^\n]+?[ \t]import[ \t]*(?:\([^)]*\)|[^\n]*)|import[ \t][^\n;]*)"
#: Values in a template may hold literals, templates and one level of braces of their own.
TEMPLATE = r"""`(?:[^`\\$]|\\[\s\S]|\$\{(?:[^{}`"']|`[^`]*`|"[^"\n]*"|'[^'\n]*'|\{[^{}]*\})*\}|\$)*`?"""
#: A slash begins an expression after these signs and words and at the begin of a line; else it divides.
REGEX = r"(?:^[ \t]*|[(,=:\[!&|?{};+*%<>~^-][ \t]*|\b(?:return|typeof|case|in|of|delete|void|throw|new|else|do)[ \t]+)/(?:[^/*\\\n\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])(?:[^/\\\n\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])*/[a-z]*"
REST = (("word", r"[\w$]+"), ("newline", r"\n"), ("space", r"[^\S\n]+"), ("sign", r"[\s\S]"))

FAMILIES = {
    "script": (("import", C_IMPORT), ("type", TYPE), ("regex", REGEX), ("sign", "://"), ("comment", rf"//[^\n]*|{BLOCK_COMMENT}"), ("string", rf"{DOUBLE}|{SINGLE}"), ("template", TEMPLATE), *REST),
    "c": (("import", C_IMPORT), ("type", TYPE), ("sign", "://"), ("comment", rf"//[^\n]*|{BLOCK_COMMENT}"), ("string", rf"{TRIPLE}|{DOUBLE}|{SINGLE}|`[^`]*`?"), *REST),
    "rust": (("import", C_IMPORT), ("type", TYPE), ("comment", rf"//[^\n]*|{BLOCK_COMMENT}"), ("string", rf"{DOUBLE}|'(?:[^'\\\n]|\\[^\n]{{1,9}}?)'"), *REST),
    "php": (("import", C_IMPORT), ("type", TYPE), ("sign", "://"), ("comment", rf"//[^\n]*|#[^\n]*|{BLOCK_COMMENT}"), ("string", rf"{WIDE}|{DOUBLE}|{SINGLE}"), *REST),
    "python": (("import", PYTHON_IMPORT), ("comment", r"#[^\n]*"), ("string", rf"{TRIPLE}|'''(?:[\s\S]*?'''|[\s\S]*)|{DOUBLE}|{SINGLE}"), *REST),
    "ruby": (("comment", r"#[^\n]*|^=begin\b(?:[\s\S]*?\n=end[^\n]*|[\s\S]*)"), ("string", rf"{WIDE}|{DOUBLE}|{SINGLE}"), *REST),
}
FAMILY = {"javascript": "script", "typescript": "script", "python": "python", "ruby": "ruby", "php": "php", "rust": "rust"}
COMPILED = {name: (re.compile("|".join(f"({e})" for _, e in parts), re.M | re.A), tuple(kind for kind, _ in parts)) for name, parts in FAMILIES.items()}

#: After one of these signs a text is a value, though it stands alone on its line.
OPEN_ENDED = "=+-*/%&|^<>!~,([?.\\:"
#: Where a match does nothing.  Text in quotes may: a password or a piece of SQL is text.
HARMLESS = ("statement", "import", "type", "regex", "comment", "template")


def pieces(language: str, text: str) -> Iterator[tuple[str, int, int]]:
    """kind, begin and end (exclusive) of each piece: string, template, filled (with a value), regex, comment, import, type, word, newline, space, sign."""
    cutter, kinds = COMPILED[FAMILY.get(language, "c")]
    for m in cutter.finditer(text):
        kind, begin = kinds[m.lastindex - 1], m.start()
        if kind == "regex":
            begin = text.index("/", begin)
            if begin > m.start():
                yield "sign", m.start(), begin
        elif kind == "template" and "${" in m[0]:
            kind = "filled"
        yield kind, begin, m.end()


def spans(language: str, text: str) -> list[tuple[int, int, str]]:
    """begin, end and kind of each literal, comment, import and type; a text that stands alone between brackets' ends is a statement."""
    found = list(pieces(language, text))
    out, depth, last, fresh = [], 0, "", True
    for i, (kind, begin, end) in enumerate(found):
        if kind == "newline":
            fresh = True
            continue
        if kind in ("space", "comment"):
            if kind == "comment":
                out.append((begin, end, kind))
            continue
        if kind == "string":
            follow = next((x for x in found[i + 1 : i + 3] if x[0] != "space"), None)
            ends = follow is None or follow[0] in ("newline", "comment") or text[follow[1]] == ";"
            begins = not last or last in ";{}" or last == ":" and language == "python" or fresh and last not in OPEN_ENDED
            kind = "statement" if ends and begins and depth <= 0 else kind
        if kind not in ("word", "sign"):
            out.append((begin, end, kind))
        elif kind == "sign" and end - begin == 1:
            depth += (text[begin] in "([") - (text[begin] in ")]")
        piece = text[begin:end].rstrip()
        last, fresh = piece[-1:] or last, False
    return out


SPANS = "path string, kind string, line int, col int, end_line int, end_col int"


def span_table(files: DataFrame) -> DataFrame:
    """path, kind, and the first and last place (lines and columns from 1; the end is exclusive) of each span of files (path, language, content).

    Spans of a file never overlap.  Null contents have none; null and unknown languages are read as those of the C family.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, language, content in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "content")), strict=True):
                line, start, at = 1, 0, 0
                for begin, end, kind in spans(language, content or ""):
                    line, start = line + content.count("\n", at, begin), max(start, content.rfind("\n", at, begin) + 1)
                    first, col = line, begin - start + 1
                    line, start = line + content.count("\n", begin, end), max(start, content.rfind("\n", begin, end) + 1)
                    rows.append((path, kind, first, col, line, end - start + 1))
                    at = end
            if rows:
                types = [pa.string(), pa.string(), *[pa.int32()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in SPANS.split(", ")])

    return files.select("path", "language", "content").mapInArrow(run, SPANS)


def outside(matches: DataFrame, spans: DataFrame, exempt: Column | None = None) -> DataFrame:
    """The matches (path, line_no, col and others) that begin in none of the spans (of ``span_table``), and those that are ``exempt``.

    Spans of a file do not overlap, so the last span that begins before a match
    is the only one that can hold it: matches and spans are laid into one order
    by place and each match looks back to the last span.  That is one shuffle by
    path and no join by ranges.
    """
    at = matches.select(F.struct(F.col("path"), F.col("line_no").cast("int").alias("line"), F.col("col").cast("int").alias("col")).alias("_at"), F.lit(None).cast("struct<line:int,col:int>").alias("_end"), F.struct("*").alias("_row"), (F.lit(False) if exempt is None else F.coalesce(exempt, F.lit(False))).alias("_exempt"))
    ends = spans.select(F.struct("path", "line", "col").alias("_at"), F.struct(F.col("end_line").alias("line"), F.col("end_col").alias("col")).alias("_end"), F.lit(None).cast(at.schema["_row"].dataType).alias("_row"), F.lit(False).alias("_exempt"))
    # A span comes before a match at its first place.
    order = Window.partitionBy("_at.path").orderBy("_at.line", "_at.col", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = at.unionByName(ends).withColumn("_until", F.last("_end", ignorenulls=True).over(order))
    place = F.struct(F.col("_at.line").alias("line"), F.col("_at.col").alias("col"))
    return swept.where(F.col("_row").isNotNull() & (F.col("_exempt") | F.col("_until").isNull() | (place >= F.col("_until")))).select("_row.*")


#: A column beyond any line's end.
BEYOND = (1 << 31) - 1


def harmless_by_line(language: str, text: str) -> list[list[tuple[int, int]]]:
    """For each line the stretches (columns from 1, the end exclusive) in which a match does nothing."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(text.count("\n") + 1)]
    line = start = at = 0
    for begin, end, kind in spans(language, text):
        if kind not in HARMLESS:
            continue
        line, start, at = line + text.count("\n", at, begin), max(start, text.rfind("\n", at, begin) + 1), begin
        more = text.count("\n", begin, end)
        out[line].append((begin - start + 1, BEYOND if more else end - start + 1))
        for k in range(1, more):
            out[line + k].append((1, BEYOND))
        if more:
            out[line + more].append((1, end - text.rfind("\n", begin, end)))
    return out


def harmless(language: Column, content: Column) -> Column:
    """``harmless_by_line`` of files, so that each match can be judged by its own line, without meeting its file again; null for null contents."""

    @F.arrow_udf("array<array<struct<begin:int,end:int>>>")
    def cut(languages: pa.Array, contents: pa.Array) -> pa.Array:
        found = [harmless_by_line(x, t) if t is not None else [] for x, t in zip(languages.to_pylist(), contents.to_pylist(), strict=True)]
        lines = [x for f in found for x in f]
        stretches = [s for x in lines for s in x]
        ends = lambda sizes: pa.array([0, *accumulate(sizes)], pa.int32())
        pairs = pa.StructArray.from_arrays([pa.array([s[k] for s in stretches], pa.int32()) for k in (0, 1)], names=["begin", "end"])
        return pa.ListArray.from_arrays(ends(map(len, found)), pa.ListArray.from_arrays(ends(map(len, lines)), pairs))

    return cut(language, content)


def in_use(matches: DataFrame, files: DataFrame, exempt: Column | None = None) -> DataFrame:
    """The matches that stand neither in an expression's pattern, a comment, an import, a type, nor in text that nothing uses, and the exempt ones.

    Only files with matches are cut into pieces; a path names one file.  The
    matches are dealt by path once, for both their readers.
    """
    matches = matches.repartition("path")
    some = files.join(matches.select("path").distinct(), "path", "left_semi")
    return outside(matches, span_table(some).where(F.col("kind").isin(*HARMLESS)), exempt)
