"""Many patterns at once against the matcher that tries each."""

from __future__ import annotations

import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from codesift.detectors import Pattern
from codesift.operators import many
from codesift.operators.match import detect, matches
from codesift.plans.scan import HAND_WRITTEN, RULE_PATTERNS, security_findings
from codesift.queries.many import RULES
from codesift.sources.files import discover, route
from codesift.sources.corpus import files

SF = "/root/testdata/sf0.001"


def pattern(regex, **more):
    return Pattern("R", regex, "m", "low", "low", "c", "", "", **more)


@pytest.mark.parametrize(
    "regex, want",
    [
        ("abc", [{"abc"}]), ("ABC", [{"abc"}]), ("ab", []), ("a*bcd", [{"bcd"}]), ("(?:abc)?", []), ("(?:abc)?def", [{"abcdef", "def"}]), ("[ab]cd", [{"acd", "bcd"}]), ("[^a]bcd", [{"bcd"}]), ("(?:foo|barr)x", [{"foox", "barrx"}]),
        ("(?:foo.*|barr.*)", [{"foo", "barr"}]), ("(?:foo.*|.*)", []), (r"\bexec\s*\(", [{"exec"}]), ("(?:abc)+x", [{"abc"}]), ("(?:abc){0,3}", []), ("(?:(?:abc)+)+", [{"abc"}]), ("é+abcé", [{"abc"}]), ("abc|", []), ("x(?=abc)yz", [{"xyz"}]),
        ("(?<!a)bcd", [{"bcd"}]), ("[a-z&&[^b]]xyz", []), (r"\h+abc", []), ("(?>abc)d", [{"abcd"}]), ("", []), (".*", []), ("abc.def", [{"abc"}, {"def"}]),
    ],
)
def test_texts(regex, want):
    assert sorted(map(sorted, many.texts_of(pattern(regex)))) == sorted(map(sorted, want))


def test_every_match_holds_a_text():
    """Random patterns on random lines: where one matches, a text of each of its sets stands in the line."""
    rng = random.Random(5)

    def part(depth):
        kind = rng.choice(["t", "t", "t", "set", "any", "group", "branch", "repeat"]) if depth else "t"
        if kind == "t":
            return "".join(rng.choices("abcAB", k=rng.randint(1, 4)))
        if kind == "set":
            return rng.choice(["[ab]", "[^a]", "[a-c]", r"\w", "[Aa]"])
        if kind == "any":
            return rng.choice([".", ".*", ".?"])
        inner = "".join(part(depth - 1) for _ in range(rng.randint(1, 3)))
        if kind == "group":
            return f"(?:{inner})"
        if kind == "branch":
            return f"(?:{inner}|{part(depth - 1)})"
        return f"(?:{inner}){rng.choice(['?', '*', '+', '{1}', '{0,1}', '{2,3}', '+?'])}"

    met = held = 0
    for _ in range(1500):
        regex = "".join(part(2) for _ in range(rng.randint(1, 4)))
        sets = many.texts_of(pattern(regex))
        held += bool(sets)
        for _ in range(8):
            line = "".join(rng.choices("abcAB", k=rng.randint(0, 9)))
            if re.search(regex, line, re.I):
                met += 1
                assert all(any(t in line.lower() for t in s) for s in sets), (regex, line, sets)
    assert met > 1000 and held > 500


def rows(found, *columns):
    return sorted(map(str, found.select("path", "line_no", "col", "pattern_ord", "hit", *columns).collect()))


def test_as_the_plain_matcher(spark):
    patterns = (*HAND_WRITTEN, *RULE_PATTERNS)
    every = files(spark, SF).select("path", "content").limit(80).collect()
    some = spark.createDataFrame(every, "path string, content string").repartition(4)
    want = rows(detect(some, patterns), "rule_id")
    assert len(want) > 50 and rows(many.detect_many(some, patterns), "rule_id") == want
    counts = many.text_counts(some.select(F.explode(F.split("content", "\n")).alias("line")), patterns)
    assert counts and rows(many.detect_many(some, patterns, counts=counts), "rule_id") == want
    assert many.best([frozenset({"longer"}), frozenset({"abc"})], {"longer": 9, "abc": 2}) == {"abc"}


def test_filters_and_awkward_lines(spark):
    patterns = [
        pattern("abc+"), pattern("ABC", case=True), pattern("abc", need_line="need"), pattern("abc", skip_line=("skip", "(?i)DROP")), pattern("abc", skip_path=("^t/",)), pattern("abc", skip_file=("whole",)), pattern("[abc]+", skip_hit=("^b",)),
        pattern(r"\p{Lu}x"), pattern("(?:kelvin|ſ)abc"),
    ]
    texts = ["abc need\nABC skip\nabcc drop\n\n", "whole abc abc", "Ax bx bcb\nkelvinabc Kelvinabc", "", None, "- " * 2_000 + "abc", "abcabc\nabcabc"]
    some = spark.createDataFrame([(f"{'t' if k % 2 else 's'}/{k}", x) for k, x in enumerate(texts)], "path string, content string")
    want = rows(detect(some, patterns), "message")
    assert len(want) > 20 and rows(many.detect_many(some, patterns), "message") == want
    assert many.detect_many(some.limit(0), patterns).count() == 0 and many.detect_many(some, []).count() == 0
    only_loose = [pattern(r"\p{Lu}x")]
    assert rows(many.detect_many(some, only_loose)) == rows(detect(some, only_loose)) and len(rows(detect(some, only_loose))) == 2


def test_scan_takes_thousands_of_rules(spark):
    every = files(spark, SF).select("path", "content").limit(80).collect()
    routed = route(discover(spark.createDataFrame(every, "path string, content string").repartition(4)))
    extra = tuple(pattern(f"never{k}seen") for k in range(2000))
    few = security_findings(routed).drop("pattern_ord")
    lots = security_findings(routed, (*RULE_PATTERNS, *extra)).drop("pattern_ord")
    assert lots.columns == few.columns and lots.exceptAll(few).count() == 0 == few.exceptAll(lots).count() and few.count() > 20


def test_query_matches_its_sql(spark):
    assert len({p.rule for p in RULES}) == len(RULES) == 2025
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(f"SELECT path, line_no, col, rule_id, hit FROM ({entry.oracle_sql()['many_rules']})").fetchall()
    got = entry.queries()["many_rules"](spark, SF).select("path", "line_no", "col", "rule_id", "hit").collect()
    assert len(want) > 100 and sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_time_is_flat_in_the_number_of_rules(spark):
    """The walk of a line does not grow with the rules: 20 times as many may take twice the time at most, measured by the best of three."""
    lines = ["the quick brown fox thanks others for enthusiasm " * 4] * 2000

    def seconds(n):
        index = many.indexed([pattern(f"never{k}seen") for k in range(n)])[0]
        walked = many.automaton(index)
        best = 1e9
        for _ in range(3):
            begun = time.perf_counter()
            for x in lines:
                list(walked.iter(x))
            best = min(best, time.perf_counter() - begun)
        return best

    assert seconds(4000) < 2 * seconds(200) + 0.02


def test_patterns_are_met_once(spark):
    index, loose = many.indexed([pattern("(?:foo|food)x"), pattern(".*"), pattern("foo")])
    found = spark.createDataFrame([("a food foox FOO",), ("",), (None,)], "line string").select(many.met(F.col("line"), index).alias("m"))
    assert [r.m for r in found.collect()] == [[0, 2], [], []] and loose == [1]
    plain = spark.createDataFrame([("p", 1, "a food foo")], "path string, line_no int, line string")
    assert rows(many.matches_of_many(plain, [pattern("foo")])) == rows(matches(plain, [pattern("foo")])) and len(rows(matches(plain, [pattern("foo")]))) == 2


def test_anchored_patterns_are_tried_at_their_texts_and_find_the_same(spark):
    some = ["(?:abcde|bcd)[a-z]*x", "abc[a-e]{0,3}?", "(?:aab|aaba)[ab]*", "ab(?:c|d)[0-9]+", "kelvin[a-z]*"]
    patterns = [Pattern(f"r{k}", e, "m", "low", "low", "c", "", "", skip_hit=("zz$",), case=k % 2 == 1) for k, e in enumerate(some)]
    assert all(map(many.anchored, patterns))
    others = [r"\babc", "abc$", "[a-z]+abc", "ab", "é+abc", "(a)bc.", "abc[^a]"]
    assert not any(many.anchored(Pattern("r", e, "m", "low", "low", "c", "", "")) for e in others)
    rng = random.Random(5)
    texts = ["".join(rng.choice("aabbcdex1ABİé") for _ in range(rng.randrange(60))) for _ in range(300)] + ["aabaabaab", "abcdebcdx", "Kelvin Kelvin İkelvins", "bcdx abcdezz abczz"]
    lines = spark.createDataFrame([("p", n, t) for n, t in enumerate(texts)] + [("p", -1, None)], "path string, line_no int, line string")
    mixed = [*patterns, Pattern("last", "[a-z]{2}1", "m", "low", "low", "c", "", "")]
    for rules in (patterns, mixed):
        got, want = (sorted((r.line_no, r.pattern_ord, r.col, r.hit) for r in f(lines, rules).collect()) for f in (many.matches_of_many, matches))
        assert got == want and len(got) > 50
