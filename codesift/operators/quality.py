"""Quality operators: functions and complexity, nesting, smells, duplicates, metrics.

A file is bounded by the size filter of its source, so windows over the lines
of one file are small groups; no operator gathers more than a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesift.functions.text import measured, positions, trimmed

#: Decision points; an ``else if`` counts as both.
DECISIONS = (
    r"\bif\s*\(", r"\belse\s+if\s*\(", r"\bfor\s*\(", r"\bwhile\s*\(", r"\bdo\s*\{", r"\bcase\s+[^:]+:", r"\bcatch\s*\(",
    r"\?\s*[^:]+\s*:", r"\?\.", r"&&(?!=)", r"\|\|(?!=)", r"\?\?",
)
#: Shapes of a function's first line; control blocks look like the shorthand and count.
FUNCTIONS = (
    r"(?:function\s+\w+|(?:const|let|var)\s+\w+\s*=\s*(?:async\s+)?function)\s*\(",
    r"(?:const|let|var)\s+\w+\s*=\s*(?:async\s+)?\([^)]*\)\s*=>",
    r"(?:const|let|var)\s+\w+\s*=\s*(?:async\s+)?\w+\s*=>",
    r"(?:public|private|protected|static|async)\s+\w+\s*\([^)]*\)\s*(?::\s*\w+[<\[\]>|&\s]*)?\s*\{",
    r"\w+\s*\([^)]*\)\s*\{",
    r"def\s+\w+\s*\(",
)
NAME = r"(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=|(\w+)\s*\(|def\s+(\w+))"
#: Lines a function may span before the search for its end stops.
SPAN = 500

#: Thresholds.
MAX_COMPLEXITY, MAX_FILE_LINES, MAX_FUNCTION_LINES, MAX_NESTING, MIN_COMMENT_RATIO = 15, 500, 50, 4, 0.1


def _lines():
    return Window.partitionBy("path").orderBy("line_no")


def _so_far():
    return _lines().rowsBetween(Window.unboundedPreceding, Window.currentRow)



def count_of(text: Column, expression: str) -> Column:
    return F.regexp_count(text, F.lit(expression))


def _starts(line: Column, *marks: str) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | trimmed(line).startswith(m)
    return out


def functions(lines: DataFrame, different: DataFrame | None = None) -> DataFrame:
    """path, name, start_line, end_line, complexity and line_count of each function-like block.  ``different``: as in ``measured``.

    A body ends with the first line at which the braces opened since the start
    are closed; a Python function without braces ends before the first line that
    is not indented further; a body that never closes is its first line.
    """
    line = F.col("line")
    code = trimmed(line)
    shaped = F.lit(False)
    for shape in FUNCTIONS:
        shaped = shaped | code.rlike(shape)
    name = F.coalesce(*(F.when(F.length(x) > 0, x) for x in (F.regexp_extract(code, NAME, i) for i in (1, 2, 3, 4))), F.lit("anonymous"))
    told = measured(
        lines.select("path", "line_no", "line"),
        "functions",
        different,
        opens=count_of(line, r"\{"),
        closes=count_of(line, r"\}"),
        points=sum((count_of(line, d) for d in DECISIONS), F.lit(0)),
        indent=F.when(code == "", -1).otherwise(F.length(line) - F.length(F.regexp_replace(line, r"^\s+", ""))),
        shape=F.when(~_starts(line, "//", "*", "#") & shaped, F.struct(name.alias("name"), code.startswith("def ").alias("python"))),
    )
    # Lines of a file meet in one row; their running sums are the helper's.
    rows = told.select("path", F.struct("line_no", "opens", (F.col("opens") - F.col("closes")).alias("net"), "points", "indent", "shape").alias("x"))
    listed = rows.groupBy("path").agg(F.array_sort(F.collect_list("x")).alias("ls"))
    columns = [F.col(f"ls.{c}").cast("array<long>").alias(c) for c in ("opens", "net", "points", "indent")]
    starts = F.transform(F.filter("ls", lambda x: x["shape"].isNotNull()), lambda x: F.struct(x["line_no"].alias("line_no"), x["shape"]["name"].alias("name"), x["shape"]["python"].alias("python")))
    return listed.select("path", *columns, starts.alias("starts")).where(F.size("starts") > 0).mapInArrow(_ends, "path string, name string, start_line int, end_line int, complexity long, line_count int")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The functions of files: of each the first line that closes it, searched in its next ``SPAN`` lines."""
    for batch in batches:
        out = []
        for path, opens, net, points, indent, starts in zip(*(batch.column(c).to_pylist() for c in ("path", "opens", "net", "points", "indent", "starts")), strict=True):
            opened, depth, decided, indent = np.cumsum(opens), np.cumsum(net), np.cumsum(points), np.array(indent)
            for f in starts:
                at = f["line_no"] - 1
                upto = min(at + SPAN + 2, opened.size)
                before_open, before_depth = opened[at] - opens[at], depth[at] - net[at]
                closing = np.flatnonzero((opened[at:upto] > before_open) & (depth[at:upto] <= before_depth))
                if f["python"] and opened[upto - 1] <= before_open:
                    after = indent[at + 1 :]
                    outdent = np.flatnonzero((after >= 0) & (after <= indent[at]))
                    inside = np.flatnonzero(after[: outdent[0] if outdent.size else None] >= 0)
                    end = at + 1 + int(inside[-1]) if inside.size else at
                else:
                    end = at + int(closing[0]) if closing.size else at + SPAN + 1 if opened.size > at + SPAN + 1 else at
                out.append((path, f["name"], at + 1, end + 1, 1 + int(decided[end] - decided[at]) + points[at], end - at + 1))
        if out:
            types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["path", "name", "start_line", "end_line", "complexity", "line_count"])


def complexity_findings(found: DataFrame, max_complexity: int = MAX_COMPLEXITY, max_lines: int = MAX_FUNCTION_LINES) -> DataFrame:
    """path, line_no, rule_id and severity: too complex or too long functions; high beyond twice the limit."""
    def over(rule: str, value: str, limit: int) -> DataFrame:
        return found.where(F.col(value) > limit).select("path", F.col("start_line").alias("line_no"), F.lit(rule).alias("rule_id"), F.when(F.col(value) > 2 * limit, "high").otherwise("medium").alias("severity"), "name")

    return over("QUA-CMPLX-001", "complexity", max_complexity).unionByName(over("QUA-CMPLX-002", "line_count", max_lines))


def nesting(lines: DataFrame) -> DataFrame:
    """path, line_no, line and depth: braces open before a line, never below zero, plus those it opens.

    The depth clamped at zero is the running sum less its running minimum.  Lines
    in comments keep the depth; a line that closes a block comment has none.
    """
    code = trimmed(F.col("line"))
    opens, closes = code.contains("/*") & ~code.contains("*/"), code.contains("*/")
    mark = F.when(closes, 0).when(opens, 1)
    rows = lines.select("path", "line_no", "line", closes.alias("closes"), F.coalesce(F.last(mark, ignorenulls=True).over(_so_far()), F.lit(0)).alias("inside"))
    plain = ~F.col("closes") & (F.col("inside") == 0) & ~_starts(F.col("line"), "//", "#", "*")
    own = F.when(plain, count_of(F.col("line"), r"\{")).otherwise(0)
    rows = rows.withColumn("own", own).withColumn("change", F.when(plain, F.col("own") - count_of(F.col("line"), r"\}")).otherwise(0))
    rows = rows.withColumn("total", F.sum("change").over(_so_far()))
    rows = rows.withColumn("open", F.col("total") - F.least(F.lit(0), F.min("total").over(_so_far())))
    rows = rows.withColumn("depth", F.coalesce(F.lag("open").over(_lines()), F.lit(0)) + F.col("own"))
    return rows.where(~F.col("closes")).select("path", "line_no", "line", F.col("depth").cast("long").alias("depth"))


def deep_nesting(lines: DataFrame, limit: int = MAX_NESTING, apart: int = 5) -> DataFrame:
    """path, line_no, depth and severity of deep lines; after a report the next ``apart`` lines are quiet."""
    block = F.col("line").contains("{") | trimmed(F.col("line")).rlike(r"^(?:if|for|while|switch|try)\b")
    deep = nesting(lines).where((F.col("depth") > limit) & block)
    listed = deep.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "depth"))).alias("all"))
    none = F.array().cast("array<struct<line_no:int,depth:bigint>>")
    kept = F.aggregate("all", none, lambda acc, x: F.when((F.size(acc) == 0) | (x["line_no"] - F.element_at(acc, -1)["line_no"] > apart), F.concat(acc, F.array(F.struct(x["line_no"].cast("int").alias("line_no"), x["depth"].alias("depth"))))).otherwise(acc))
    # element_at of an empty array is never reached: the size is tested first.
    rows = listed.select("path", F.explode(kept).alias("x")).select("path", "x.line_no", "x.depth")
    return rows.select("*", F.when(F.col("depth") > limit + 2, "high").otherwise("medium").alias("severity"))


def long_files(files: DataFrame, limit: int = MAX_FILE_LINES) -> DataFrame:
    n = F.size(F.split("content", "\n", -1))
    return files.select("path", n.cast("long").alias("n_lines")).where(F.col("n_lines") > limit).select("*", F.when(F.col("n_lines") > 2 * limit, "high").otherwise("medium").alias("severity"))


IMPORT_LINE = r"^\s*(?:import|from)\b"


def unused_imports(lines: DataFrame) -> DataFrame:
    """path, line_no and name of imported names that no other line of the file holds as a word.

    Names meet the words of the lines that are no imports, a set for each file,
    so one join answers all files.
    """
    line = F.col("line")
    alias = lambda n: F.element_at(F.split(F.trim(n), r"\s+as\s+"), -1)
    listed = lambda text: F.transform(F.split(text, ","), lambda n: F.trim(alias(n)))
    none = F.array().cast("array<string>")
    named = F.when(line.rlike(r"import\s+\{[^}]+\}\s+from\s+"), F.filter(listed(F.regexp_extract(line, r"import\s+\{([^}]+)\}\s+from\s+", 1)), lambda n: (n != "") & (n != "type"))).otherwise(none)
    default = F.when(line.rlike(r"import\s+\w+\s+from\s+") & ~line.contains("{"), F.array(F.regexp_extract(line, r"import\s+(\w+)\s+from\s+", 1))).otherwise(none)
    python = F.when(line.rlike(r"from\s+\S+\s+import\s+.+"), F.filter(listed(F.regexp_extract(line, r"from\s+\S+\s+import\s+(.+)", 1)), lambda n: n != "")).otherwise(none)
    simple = F.when(line.rlike(r"^import\s+\w+") & ~line.contains("from"), F.array(F.regexp_extract(line, r"^import\s+(\w+)", 1))).otherwise(none)
    imports = lines.where(line.rlike(r"\b(?:import|from)\b") & ~line.rlike(r"import\s+type\b")).select("path", "line_no", F.explode(F.concat(named, default, python, simple)).alias("name"))
    words = lines.join(imports.select("path").distinct(), "path", "left_semi").where(~line.rlike(IMPORT_LINE))
    words = words.select("path", F.explode(F.array_distinct(F.regexp_extract_all(line, F.lit(r"\w+"), F.lit(0)))).alias("word")).groupBy("path").agg(F.collect_set("word").alias("words"))
    # Joined by path alone, so that lines that lie by file stay where they are.
    rows = imports.join(words, "path", "left")
    return rows.where(F.col("words").isNull() | ~F.array_contains("words", F.col("name"))).select("path", "line_no", "name")


#: Numbers that need no name.
ALLOWED = ("0", "1", "2", "-1", "0.0", "1.0", "100", "0.5", "1000", "60", "24", "3600", "86400", "200", "201", "204", "301", "302", "400", "401", "403", "404", "500", "1024", "2048", "4096", "8192")


def magic_numbers(lines: DataFrame) -> DataFrame:
    """path, line_no, col and number of unnamed numbers outside -2..10, quotes, versions and declarations."""
    line = F.col("line")
    rows = lines.where(
        ~_starts(line, "//", "*", "#")
        & ~line.rlike(r"^\s*(?:import|from|require)\b")
        & ~line.rlike(r"^\s*(?:const|final|static)\s+\w+\s*[:=]")
        & ~line.rlike(r"^\s*(?:export\s+)?(?:const|enum)\b")
        & ~line.rlike(r"\[\s*\d+\s*\]")
    )
    rows = rows.select("path", "line_no", "line", F.explode(positions(line, r"(?<!\w)-?\d+\.?\d*\b")).alias("m")).select("path", "line_no", "line", F.col("m.col").alias("col"), F.col("m.hit").alias("number"))
    before = F.expr("substring(line, 1, col - 1)")
    around = F.expr("substring(line, greatest(1, col - 5), length(number) + least(5, col - 1) + 5)")
    odd = lambda q: count_of(before, q) % 2 == 1
    value = F.expr("try_cast(number AS double)")
    return rows.where(~F.col("number").isin(*ALLOWED) & ~odd("'") & ~odd('"') & ~odd("`") & ~around.rlike(r"\d+\.\d+\.\d+") & ((value < -2) | (value > 10))).select("path", "line_no", "col", "number")


CONSOLE = r"\bconsole\.(?:log|debug|info|warn|error|trace|dir|table)\s*\("
PRINT = r"\b(?:print|println|puts|NSLog|System\.out\.print(?:ln)?)\s*\("
TAG = r"(?i)\b(TODO|FIXME|HACK|XXX|BUG|TEMP|WORKAROUND)\b[:\s]*(.*)"


def console_statements(lines: DataFrame) -> DataFrame:
    code = trimmed(F.col("line"))
    rows = lines.where(~_starts(F.col("line"), "//", "*", "#") & (code.rlike(CONSOLE) | code.rlike(PRINT)))
    at = F.when(code.rlike(CONSOLE), F.regexp_instr(code, F.lit(CONSOLE))).otherwise(F.regexp_instr(code, F.lit(PRINT)))
    return rows.select("path", "line_no", at.cast("long").alias("col"))


def todo_tags(lines: DataFrame) -> DataFrame:
    rows = lines.where(F.col("line").rlike(TAG))
    tag = F.upper(F.regexp_extract("line", TAG, 1))
    return rows.select("path", "line_no", tag.alias("tag"), trimmed(F.regexp_extract("line", TAG, 2)).alias("note"), F.when(tag.isin("FIXME", "BUG"), "medium").otherwise("low").alias("severity"))


def empty_catches(lines: DataFrame) -> DataFrame:
    """catch blocks without a body: on one line, closed by the next line, or by the one after a blank line."""
    one, two = (trimmed(F.lead("line", k, None).over(_lines())) for k in (1, 2))
    rows = lines.select("path", "line_no", "line", one.alias("one"), two.alias("two")).where(F.col("line").rlike(r"\bcatch\s*\("))
    same = F.col("line").rlike(r"catch\s*\([^)]*\)\s*\{\s*\}")
    opens = trimmed(F.col("line")).endswith("{")
    return rows.where(same | (opens & ((F.col("one") == "}") | ((F.col("one") == "") & (F.col("two") == "}"))))).select("path", "line_no")


def token_line(line: Column) -> Column:
    """A line without comments, white space runs and the values of its literals."""
    out = trimmed(line)
    for expression, to in ((r"//.*$", ""), (r"#.*$", ""), (r"/\*.*?\*/", ""), (r"\s+", " ")):
        out = F.regexp_replace(out, expression, to)
    out = trimmed(out)
    for expression, to in (('"[^"]*"', '"STR"'), ("'[^']*'", "'STR'"), ("`[^`]*`", "`STR`"), (r"\b\d+\.?\d*\b", "NUM")):
        out = F.regexp_replace(out, expression, to)
    return out


def blocks(lines: DataFrame, size: int = 6, min_tokens: int = 30, different: DataFrame | None = None) -> DataFrame:
    """path, start_line, end_line, block (hash of ``size`` token lines) and n_tokens of blocks with enough tokens.  ``different``: as in ``measured``."""
    rows = measured(lines.select("path", "line_no", "line"), "tokens", different, t=token_line(F.col("line"))).select("path", "line_no", "t").where(~F.col("t").isin("", "}", "{", ");"))
    frame = _lines().rowsBetween(0, size - 1)
    rows = rows.select("path", F.col("line_no").alias("start_line"), F.max("line_no").over(frame).alias("end_line"), F.collect_list("t").over(frame).alias("ts"), F.sum(F.size(F.split("t", " "))).over(frame).alias("n_tokens"))
    return rows.where((F.size("ts") == size) & (F.col("n_tokens") >= min_tokens)).select("path", "start_line", "end_line", F.sha2(F.array_join("ts", "\n"), 256).alias("block"), "n_tokens")


def duplicate_pairs(found: DataFrame) -> DataFrame:
    """Blocks of one file with equal content that do not overlap, each against the first of its kind: a_start, a_end, b_start, b_end.

    All pairs of a kind would be as many as the square of its copies; those of the first name every copy.
    """
    same = Window.partitionBy("path", "block").orderBy("start_line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = found.select("path", F.first("start_line").over(same).alias("a_start"), F.first("end_line").over(same).alias("a_end"), F.col("start_line").alias("b_start"), F.col("end_line").alias("b_end"))
    return rows.where("b_start > a_end")


def duplicate_classes(found: DataFrame) -> DataFrame:
    """path, start_line, end_line, first (the start of the first block of equal content) and copies, of every block that has a copy."""
    same = Window.partitionBy("path", "block")
    rows = found.select("path", "start_line", "end_line", F.min("start_line").over(same).alias("first"), F.count(F.lit(1)).over(same).alias("copies"))
    return rows.where("copies > 1")


def duplicate_findings(found: DataFrame, most: int = 10) -> DataFrame:
    """The first ``most`` pairs of a file, of all pairs that do not overlap: by first sight of the block, then by place.  Medium beyond 20 lines.

    Of a kind, only the copies that overlap the first and ``most`` more can be in such a pair.
    """
    kind = Window.partitionBy("path", "block")
    rows = found.select("path", "block", "start_line", "end_line", F.min("start_line").over(kind).alias("seen"), F.min("end_line").over(kind).alias("seen_end"), F.row_number().over(kind.orderBy("start_line")).alias("k"))
    rows = rows.withColumns({"near": F.count_if(F.col("start_line") <= F.col("seen_end")).over(kind), "last": F.max("start_line").over(kind)})
    # Most blocks have no copy that lies apart; those leave before the pairs are made.
    rows = rows.where((F.col("k") <= F.col("near") + most) & (F.col("last") > F.col("seen_end")))
    a, b = (rows.select("path", "block", "seen", F.col("start_line").alias(f"{n}_start"), F.col("end_line").alias(f"{n}_end")) for n in "ab")
    pairs = a.join(b, ["path", "block", "seen"]).where("b_start > a_end")
    order = Window.partitionBy("path").orderBy("seen", "block", "a_start", "b_start")
    return pairs.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select("path", "nth", "a_start", "a_end", "b_start", "b_end", F.when(F.col("a_end") - F.col("a_start") + 1 > 20, "medium").otherwise("low").alias("severity"))


#: Comment shapes by language: single-line expressions, block start and end.
SLASHES = ((r"^\s*//", r"^\s*\*"), r"^\s*/\*", r"\*/\s*$")
HASHES = ((r"^\s*#",), r"^\s*(?:\"\"\"|''')", r"(?:\"\"\"|''')\s*$")
PHP = ((r"^\s*//", r"^\s*#", r"^\s*\*"), r"^\s*/\*", r"\*/\s*$")
RUBY = ((r"^\s*#",), r"^=begin\b", r"^=end\b")


def metrics(lines: DataFrame) -> DataFrame:
    """path, total, code, comment, blank and comment_ratio of each file (path, language, line_no, line).

    A line that begins or ends a block comment sets the state, others leave it:
    the state of a line is the last that was set before it.
    """
    code, language = trimmed(F.col("line")), F.col("language")
    families = {"python": HASHES, "php": PHP, "ruby": RUBY}

    def by_family(pick) -> Column:
        out = code.rlike(pick(SLASHES))
        for name, family in families.items():
            out = F.when(language == name, code.rlike(pick(family))).otherwise(out)
        return out

    rows = lines.select(
        "path",
        "line_no",
        (code == "").alias("blank"),
        by_family(lambda f: "|".join(f"(?:{x})" for x in f[0])).alias("single"),
        by_family(lambda f: f[1]).alias("starts"),
        # An opening mark alone is no end; a lone docstring mark is its own end.
        F.when(language == "python", code.rlike(HASHES[2])).otherwise(by_family(lambda f: f[2]) & (code != "/**/")).alias("ends"),
    )
    state = F.when(F.col("blank"), None).when(F.col("ends"), False).when(F.col("starts"), True)
    inside = F.coalesce(F.last(state, ignorenulls=True).over(_lines().rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    rows = rows.select("path", "blank", (~F.col("blank") & (inside | F.col("starts") | F.col("single"))).alias("comment"))
    found = rows.groupBy("path").agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("blank") & ~F.col("comment")).alias("code"), F.count_if("comment").alias("comment"), F.count_if("blank").alias("blank"))
    return found.select("path", "total", "code", "comment", "blank", F.round(F.col("comment") / F.col("total"), 6).alias("comment_ratio"))


def metric_findings(measured: DataFrame, min_ratio: float = MIN_COMMENT_RATIO) -> DataFrame:
    """QUA-METRICS-001 for every file, and -002 for files of over 50 lines of code with too few comments."""
    # Tenths of a percent in whole numbers, halves up.
    tenths = F.expr("(2000 * comment + total) div (2 * total)")
    text = F.format_string("%d lines: %d code, %d comment, %d blank; comments %d.%d%%", "total", "code", "comment", "blank", F.floor(tenths / 10), tenths % 10)
    one = measured.select("path", F.lit("QUA-METRICS-001").alias("rule_id"), text.alias("message"))
    few = measured.where((F.col("code") > 50) & (F.col("comment_ratio") < min_ratio)).select("path", F.lit("QUA-METRICS-002").alias("rule_id"), text.alias("message"))
    return one.unionByName(few)
