"""How much a scan and its report put on disk."""

from __future__ import annotations

import glob
import gzip
import json
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codesift.operators import reports
from codesift.operators.findings import first_of_fingerprint, resolve_overlaps, summary
from codesift.plans.scan import quality_scanner, security_findings
from codesift.session import CLEANUP, held, written
from codesift.sources import files as sources
from codesift.sources import members


def shuffles(df) -> int:
    """The shuffles of a plan that ran, each that is read again once."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum("Exchange hashpartitioning" in line and "ReusedExchange" not in line for line in plan.splitlines())


def code(n: int) -> str:
    return "\n".join(["import { a, b } from './x'", "// TODO tidy", "function f(x) {", "try { go(); } catch (e) {}", "eval(req.query.code); eval(user.input);", f"  let y = {n} * 4711;", "console.log(y);"] + ["save(a, b, c, d, e, 'done', 77);"] * 14 + ["}"])


def test_a_scan_shuffles_texts_once_a_scanner(spark, tmp_path):
    """Every quality operator, each set of duplicates and the overlaps made a shuffle of lines or findings (F2, F3 of round 4)."""
    rows = [(f"src/f{n}.js", code(n)) for n in range(40)]
    spark.createDataFrame(rows, "path string, content string").write.parquet(str(tmp_path / "f"))
    routed = sources.route(sources.discover(spark.read.parquet(str(tmp_path / "f"))))
    found = security_findings(routed, by_file=True).unionByName(quality_scanner(routed), allowMissingColumns=True)
    total = summary(resolve_overlaps(first_of_fingerprint(found)))
    got = {(r.dimension, r.value): r.n for r in total.collect()}
    assert got["scanner", "quality"] >= 5 * 40 and got["scanner", "security"] >= 40
    assert shuffles(total) <= 8


def test_fingerprints_are_told_apart_in_the_shuffle_of_overlaps(spark):
    rows = [("a", 1, 1, "m", "x"), ("a", 1, 1, "m", "x"), ("b", 1, 1, "m", "y")]
    found = spark.createDataFrame(rows, "path string, line_no int, col int, message string, fingerprint string")
    found = found.withColumns({"scanner": F.lit("security"), "scanner_ord": F.lit(0), "pattern_ord": F.lit(0), "rule_id": F.lit("r"), "severity": F.lit("low"), "category": F.lit("c")})
    best = resolve_overlaps(first_of_fingerprint(found))
    assert sorted(r.path for r in best.collect()) == ["a", "b"] and shuffles(best) == 1


def test_a_written_table_leaves_no_shuffle(spark):
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    kept = lambda: {f for d in folders for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    before = kept()
    written(spark.range(1000).repartition("id").groupBy((F.col("id") % 7).alias("k")).count(), "test")
    for _ in range(100):
        if not kept() - before:
            break
        time.sleep(0.1)
    assert not kept() - before
    assert spark.conf.get(CLEANUP) == "false"


def test_a_held_table_goes(spark):
    with held(spark.range(5), "test") as table:
        assert table.count() == 5
        (path,) = {f.rsplit("/", 1)[0].removeprefix("file://") for f in table.inputFiles()}
        assert glob.glob(f"{path}/*.parquet")
    assert not glob.glob(path)


def test_members_are_one_gzip_text(tmp_path, monkeypatch):
    monkeypatch.setattr(members, "MEMBER", 10)
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("ab\n\u00e9\U0001f600"), 500)).encode()
    with pa.OSFile(str(tmp_path / "t.gz"), "wb") as raw:
        out = members.MemberStream(raw)
        for at in range(0, len(text), 7):
            out.write(text[at : at + 7])
        out.close()
    assert gzip.decompress((tmp_path / "t.gz").read_bytes()) == text
    with pa.OSFile(str(tmp_path / "t.gz")) as raw:
        index = members.places(raw)
        file = members.MemberFile(raw, index)
        assert len(index) == -(-len(text) // 10) + 1 and index[-1, 1] == len(text)
        assert all(file.read_at(size, at) == text[at : at + size] for at in range(len(text) + 2) for size in (0, 1, 9, 10, 25, 1000))
    for other in (b"", b"x" * 40, gzip.compress(text), (tmp_path / "t.gz").read_bytes()[:-3]):
        (tmp_path / "o.gz").write_bytes(other)
        with pa.OSFile(str(tmp_path / "o.gz")) as raw:
            assert members.places(raw) is None


@pytest.fixture(scope="module")
def findings(spark):
    rows = [(f"security-{n}", f"r{n % 7}", "security", ("critical", "high", "low")[n % 3], "high", "xss", f"src/f{n % 50}.js", n, 1, 'says "a", {b}\n[c] \u00e9 \\', "CWE-1", "x" * 100, f"{n:016x}", 0, 0) for n in range(2000)]
    return spark.createDataFrame(rows, "id string, rule_id string, scanner string, severity string, confidence string, category string, path string, line_no int, col int, message string, cwe string, snippet string, fingerprint string, scanner_ord int, pattern_ord int").repartition(5)


def test_a_compressed_report(spark, findings, tmp_path, monkeypatch):
    """The report took 17 times the input on disk (F4 of round 4); compressed, many tasks still write and read it."""
    monkeypatch.setattr(members, "MEMBER", 4096)
    for name in ("r.json", "r.json.gz"):
        reports.write_file(findings, str(tmp_path / name), "json", about={"target": "t"})
    plain = (tmp_path / "r.json").read_bytes()
    assert gzip.decompress((tmp_path / "r.json.gz").read_bytes()) == plain
    assert (tmp_path / "r.json.gz").stat().st_size * 4 < len(plain)
    told = json.loads(plain)
    assert [f["id"] for f in told["findings"]] == [r.id for r in reports.ordered(findings).collect()] and set(told["findings"][0]) == set(findings.columns)
    read = reports.read_report(spark, str(tmp_path / "r.json.gz"), 50_000)
    assert read.rdd.getNumPartitions() > 5
    assert sorted(read.collect()) == sorted(findings.select(*read.columns).collect())


@pytest.mark.parametrize("lines", [False, True])
def test_reports_that_others_compressed(spark, findings, tmp_path, lines):
    rows = [json.loads(x) for x in reports.json_report(findings.limit(20)).toPandas()["value"]]
    text = "\n".join(map(json.dumps, rows)) if lines else json.dumps({"findings": rows}, indent=1)
    (tmp_path / "o.json.gz").write_bytes(gzip.compress(text.encode()))
    assert {r.id for r in reports.read_report(spark, str(tmp_path / "o.json.gz")).collect()} == {r["id"] for r in rows}
