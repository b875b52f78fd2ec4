"""Whole files in pieces, and matches against the spans of their file."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codesift.functions import lexer


def kind_at(language, text, needle, nth=1):
    at = -1
    for _ in range(nth):
        at = text.index(needle, at + 1)
    return next((k for b, e, k in lexer.spans(language, text) if b <= at < e), "code")


JS = """import {
  evalOne,
  evalTwo
} from 'pkg';
/* block
   eval(comment)
*/
const page = `
  <b>eval(text)</b>
  three lines`;
const value = `
  ${eval(filled)}
`;
type Kind =
  | 'eval(type)'
  | 'other';
interface Box {
  run: { eval(member): void };
}
'use strict eval(directive)';
call(
  'eval(argument)',
);
const sum = 'a' +
  'eval(operand)';
const re = /eval(regex)/g, half = a / b / eval(divided);
const url = 'http://x'; // eval(tail)
const nested = `a ${ `eval(inner)` } b`;
return /[/]eval(returned)/.test(x);
eval(code);
"""
PY = '''from os import (
    evalOne,
    path)
def f(x):
    """eval(docstring)
    more"""
    y = """
    eval(value)
    """
    # eval(comment)
    return eval(x) + "it's eval(text)"
'''


@pytest.mark.parametrize(
    ("needle", "kind"),
    [
        ("evalTwo", "import"), ("eval(comment", "comment"), ("eval(text", "template"), ("eval(filled", "filled"), ("eval(type", "type"), ("eval(member", "type"), ("eval(directive", "statement"), ("eval(argument", "string"),
        ("eval(operand", "string"), ("eval(regex", "regex"), ("eval(divided", "code"), ("eval(tail", "comment"), ("eval(inner", "filled"), ("eval(returned", "regex"), ("eval(code", "code"),
    ],
)
def test_spans_over_lines(needle, kind):
    assert kind_at("typescript", JS, needle) == kind


@pytest.mark.parametrize(("needle", "kind"), [("evalOne", "import"), ("eval(docstring", "statement"), ("eval(value", "string"), ("eval(comment", "comment"), ("eval(x)", "code"), ("eval(text", "string")])
def test_spans_python(needle, kind):
    assert kind_at("python", PY, needle) == kind


@pytest.mark.parametrize(
    ("language", "text", "needle", "kind"),
    [
        ("rust", "fn f<'a>(x: &'a str) { g('\\'', eval(x)); }", "eval", "code"), ("go", "q := `SELECT\n eval(x)`", "eval", "string"), ("ruby", "=begin\neval(x)\n=end\ny", "eval", "comment"), ("php", "# eval(x)\n$a = 1;", "eval", "comment"),
        ("java", 'String s = """\n eval(x)\n""";', "eval", "string"), ("javascript", "x = 'open\neval(y)", "eval", "code"), ("javascript", "/* open\neval(y)", "eval", "comment"), (None, "a; // eval(x)", "eval", "comment"), ("javascript", "import('eval')", "eval", "string"),
    ],
)
def test_spans_by_language(language, text, needle, kind):
    assert kind_at(language, text, needle) == kind


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([*lexer.FAMILY, "java", "go"]), st.text(alphabet="ab \n\t\"'`/\\*#${}[]();:=.é1", max_size=60))
def test_pieces_are_the_file(language, text):
    """Nothing is lost and nothing overlaps, whatever the text."""
    at = 0
    for _, begin, end in lexer.pieces(language, text):
        assert begin == at < end
        at = end
    assert at == len(text)


def test_long_literals():
    text = "x = '" + "\\n" * 200_000 + "'; /*" + "*" * 200_000 + "*/ `" + "a${b}" * 50_000 + "` eval(x)"
    assert kind_at("javascript", text, "eval") == "code" and [k for _, _, k in lexer.spans("javascript", text)] == ["string", "comment", "filled"]


def test_sweep(spark):
    """Matches against spans, by the sweep and by looking at each span."""
    rng = random.Random(3)
    files, matches = [], []
    for k in range(12):
        text = "".join(rng.choice(["'a b'", "/* c\n d */", "// e\n", "`x\ny`", "foo(", ")", "\n", " ", "1", "x = ", "'s'\n"]) for _ in range(120))
        language = rng.choice(["javascript", "python", "java", None])
        files.append((f"f{k}", language, text, "clash"))
        lines = text.split("\n")
        matches += [(f"f{k}", i + 1, c + 1, "x") for i, line in enumerate(lines) for c in range(len(line) + 1) if rng.random() < 0.4]
    files += [("none", "javascript", None, "x"), ("empty", "javascript", "", "x"), ("unmatched", "java", "'x'", "x")]
    matches += [("none", 1, 1, "x"), ("absent", 1, 1, "x"), ("f0", 1, 1, "twice"), ("f0", 1, 1, "twice")]
    want = []
    for path, line, col, tag in matches:
        found = next(((lang, t or "") for p, lang, t, _ in files if p == path), (None, ""))
        at = sum(len(x) + 1 for x in found[1].split("\n")[: line - 1]) + col - 1
        if tag == "twice" or not any(b <= at < e and k in lexer.HARMLESS for b, e, k in lexer.spans(*found)):
            want.append((path, line, col, tag))
    m = spark.createDataFrame(matches, "path string, line_no int, col int, kind string")
    got = lexer.in_use(m, spark.createDataFrame(files, "path string, language string, content string, col string"), m["kind"] == "twice")
    assert got.columns == m.columns and sorted(map(tuple, got.collect())) == sorted(want)
    assert 0.2 < len(want) / len(matches) < 0.98
    assert lexer.in_use(m.limit(0), spark.createDataFrame(files, "path string, language string, content string, col string")).count() == 0


def test_stretches_by_line_say_the_same_as_spans_of_files(spark):
    from pyspark.sql import functions as F

    texts = ["/* a\nb\n\nc */ x = 1\n// y", "const r = /a[/]b/;\n`plain\ntext` + f(`${v}`)", "'use strict'\nx = 'y'", "é /* ü\n*/ z\n", "", "\n\n/*\n\n", "import {\n a,\n b } from 'x'\nf(a)"]
    files = spark.createDataFrame([(f"f{k}", language, t) for k, t in enumerate(texts) for language in ("javascript", "python")], "path string, language string, content string").withColumn("path", F.concat("path", "language"))
    places = [(r.path, n, c) for r in files.collect() for n, line in enumerate(r.content.split("\n"), 1) for c in range(1, len(line) + 1)]
    want = lexer.outside(spark.createDataFrame(places, "path string, line_no int, col int"), lexer.span_table(files).where(F.col("kind").isin(*lexer.HARMLESS)))
    by_line = {r.path: r.h for r in files.select("path", lexer.harmless(F.col("language"), F.col("content")).alias("h")).collect()}
    got = {(p, n, c) for p, n, c in places if not any(s.begin <= c < s.end for s in by_line[p][n - 1])}
    assert got == {(r.path, r.line_no, r.col) for r in want.collect()} and 20 < len(got) < len(places)
    assert spark.range(1).select(lexer.harmless(F.lit("go"), F.lit(None).cast("string")).alias("h")).first().h in (None, [])


def test_contexts_are_judged_without_meeting_the_files_again(spark):
    from codesift.plans.scan import security_findings
    from codesift.sources import files as sources

    files = spark.createDataFrame([("a.js", "/*\neval(req.query.x)\n*/\neval(req.query.x)")], "path string, content string")
    found = security_findings(sources.route(sources.discover(files)), contexts=True)
    assert {r.line_no for r in found.collect()} == {4}
    assert "Window" not in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "MapInArrow" not in plan
