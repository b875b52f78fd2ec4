"""Reports in one file: written by many tasks, read by many tasks, against Python's own JSON and CSV readers."""

from __future__ import annotations

import csv
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from codesift.operators import reports
from codesift.operators.findings import ordered
from codesift.sources import jsonlist, onefile
from codesift.sources.jsonlist import read_list

FOUND = "path string, line_no int, col int, scanner_ord int, pattern_ord int, rule_id string, severity string, confidence string, category string, scanner string, message string, cwe string, snippet string, fingerprint string, id string"


@pytest.fixture(scope="module")
def found(spark):
    levels = ("low", "critical", "medium", "high")
    rows = [(f"d/f{i % 7}.js", i + 1, 1, 0, i % 5, f"R{i % 11}", levels[i % 4], "high", "xss", "security", f'say "{i}", é\r\nand [{{\\', "CWE-79" if i % 3 else "", None if i % 2 else "x\ny", f"fp{i}", f"id{i}") for i in range(300)]
    return spark.createDataFrame(rows, FOUND).repartition(9)


def plain(rows):
    return [{k: v for k, v in r.asDict().items() if v is not None} for r in rows]


def no_parts(folder):
    return not [n for n in os.listdir(folder) if ".parts-" in n]


def test_json_file(spark, found, tmp_path):
    target = str(tmp_path / "new" / "r.json")
    reports.write_file(found, target, "json", about={"target": 'a "b"', "config": {"deep": True}})
    told = json.loads(open(target, encoding="utf-8").read())
    assert told["findings"] == plain(ordered(found).collect()) and told["target"] == 'a "b"' and told["config"] == {"deep": True}
    assert [(s["dimension"], s["value"], s["n"]) for s in told["summary"]][-1] == ("total", "all", 300) and no_parts(tmp_path / "new")
    for size in (4_001, 1 << 20):
        assert sorted(r.id for r in reports.read_report(spark, target, size).collect()) == sorted(f"id{i}" for i in range(300))


def test_csv_file(found, tmp_path):
    reports.write_file(found, str(tmp_path / "r.csv"), "csv")
    raw = (tmp_path / "r.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfID,Rule") and raw.endswith(b"\r\n")
    rows = list(csv.reader(raw.decode("utf-8-sig").splitlines(keepends=True)))
    assert rows[0] == list(reports.CSV_HEADER)
    assert rows[1:] == [[r.id, r.rule_id, r.scanner, r.severity, r.confidence, r.category, r.path, str(r.line_no), r.message, r.message] for r in ordered(found).collect()]
    reports.write_file(found.limit(0), str(tmp_path / "none.csv"), "csv")
    assert (tmp_path / "none.csv").read_bytes() == b"\xef\xbb\xbf" + ",".join(reports.CSV_HEADER).encode() + b"\r\n"


def test_sarif_file(found, tmp_path):
    reports.write_file(found, str(tmp_path / "r.sarif"), "sarif")
    run = json.loads((tmp_path / "r.sarif").read_text())["runs"][0]
    rules = run["tool"]["driver"]["rules"]
    assert [r["fingerprints"]["primary"] for r in run["results"]] == [r.fingerprint for r in ordered(found).collect()]
    assert all(rules[r["ruleIndex"]]["id"] == r["ruleId"] for r in run["results"]) and len(rules) == 11
    assert all(r["shortDescription"]["text"] and r["defaultConfiguration"]["level"] in ("error", "warning", "note") for r in rules)
    assert [t["id"] for t in run["taxonomies"][0]["taxa"]] == ["CWE-79"]
    reports.write_file(found.limit(0), str(tmp_path / "none.sarif"), "sarif")
    assert json.loads((tmp_path / "none.sarif").read_text())["runs"][0]["results"] == []


def test_targets(spark, found, tmp_path):
    target = tmp_path / "r.json"
    target.write_text("old")
    with pytest.raises(Exception, match="r.json"):
        reports.write_file(found, str(target), "json")
    assert target.read_text() == "old"
    reports.write_file(found, f"file://{target}", "json", overwrite=True)
    assert len(json.loads(target.read_text())["findings"]) == 300
    reports.convert_report(spark, str(target), str(tmp_path / "c.csv"), "csv")
    assert (tmp_path / "c.csv").read_bytes().count(b"\r\n") == 1 + 3 * 300 and no_parts(tmp_path)


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    rows = spark.range(0, 100, 1, 5).select(F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("value"))
    (tmp_path / "r.txt").write_text("old")
    with pytest.raises(Exception, match="broken"):
        onefile.write_one([rows], str(tmp_path / "r.txt"), ["<", ">"], ",", overwrite=True)
    with pytest.raises(Exception, match="broken"):
        onefile.write_one([rows], str(tmp_path / "s.txt"), ["<", ">"], ",")
    assert os.listdir(tmp_path) == ["r.txt"] and (tmp_path / "r.txt").read_text() == "old"


def test_sections_and_order(spark, tmp_path):
    many = spark.range(0, 1000, 1, 7).select(F.col("id").cast("string").alias("value"), F.lit(1).alias("section"))
    gaps = spark.createDataFrame([("a",), (None,), ("",)], "value string").coalesce(1)
    onefile.write_one([many, many.where("value < 0"), gaps], str(tmp_path / "x"), ["<", "|", "|", ">"], ",", ";")
    assert (tmp_path / "x").read_text() == "<" + ",".join(f"{i};" for i in range(1000)) + "||a;,;>"


def value(random, depth=0):
    kind = random.randrange(7 if depth < 3 else 4)
    if kind == 4:
        return [value(random, depth + 1) for _ in range(random.randrange(4))]
    if kind > 4:
        return {random.choice(["findings", "k", '"', "\\", "ü"]) + str(random.randrange(9)) * random.randrange(2): value(random, depth + 1) for _ in range(random.randrange(4))}
    return [random.randrange(-9, 10**6), None, random.random() < 0.5, "".join(random.choice(['\\', '"', "[", "]", "{", "}", ",", ":", "é", "x", "\n", "findings"]) for _ in range(random.randrange(12)))][kind]


@pytest.mark.parametrize("seed", range(12))
def test_lists_of_random_documents(seed, tmp_path, monkeypatch):
    """All cuts: every range and block size against Python's reader, without Spark."""
    r = random.Random(seed)
    document = {f"a{i}": value(r) for i in range(r.randrange(4))} | {"findings": [value(r) for _ in range(r.randrange(9))]} | {f"z{i}": value(r) for i in range(r.randrange(4))}
    text = json.dumps(document, indent=r.choice([None, 0, 3]), ensure_ascii=r.random() < 0.5, separators=r.choice([(",", ":"), (" ,\n ", "\t: ")]))
    (tmp_path / "d.json").write_text(text)
    for size, block in ((1, 1), (2, 3), (5, 2), (7, 4), (16, 5), (50, 1 << 20), (1 << 20, 3), (1 << 20, 1 << 20)):
        monkeypatch.setattr(jsonlist, "BLOCK", block)
        assert [json.loads(e) for e in local(str(tmp_path / "d.json"), "findings", size)] == document["findings"], (size, block)


class Local:
    """``mapInArrow`` over a range in this process."""

    def __init__(self, n):
        self.n = n

    def mapInArrow(self, run, ddl):
        import pyarrow as pa
        from pyspark.sql import Row

        self.rows = [Row(**d) for b in run([pa.record_batch({"id": list(range(self.n))})]) for d in b.to_pylist()]
        return self

    def collect(self):
        return self.rows


class LocalSpark:
    def range(self, start, end, step, parts):
        return Local(end)

    def createDataFrame(self, rows, ddl):
        return Local(0).mapInArrow(lambda _: [], ddl)


def local(path, name, size):
    got = read_list(LocalSpark(), path, name, size)
    return None if got is None else [r.value for r in got.collect()]


def test_awkward_files(spark, tmp_path):
    def of(text, name="findings", size=4):
        (tmp_path / "a.json").write_bytes(text.encode() if isinstance(text, str) else text)
        return local(str(tmp_path / "a.json"), name, size)

    assert of("") is None and of("{}") is None and of('{"findings": 3}') is None and of('["findings", [1]]') is None and of('{"x": {"findings": [1]}}') is None
    assert of('{"findings": []}') == [] and of('{"findings": [ \n ]}') == [] and of('{"x": "findings", "findings": [1]}') == ["1"]
    assert of('﻿{"findings" : [1, [2, 3], {"a": [4]}], "findings": [5]}') == ["1", "[2, 3]", '{"a": [4]}']
    assert of('{"e": "' + "\\\\" * 9000 + '", "findings": ["' + "\\\\" * 5001 + '\\"]", 2]}', size=1000) == ['"' + "\\\\" * 5001 + '\\"]"', "2"]
    assert of('{"findings"' + " " * 9000 + ":" + "\n" * 9000 + "[7]}", size=100) == ["7"] and of('{"findings": [1, 2', size=3) == ["1", "2"]
    long = '{"findings": ["' + "y" * 300_000 + '",' + "1," * 50_000 + '{"k": "]"}]}'
    (tmp_path / "long.json").write_text(long)
    rows = read_list(spark, str(tmp_path / "long.json"), "findings", 40_000)
    assert sorted(r.value for r in rows.collect()) == sorted(['"' + "y" * 300_000 + '"', '{"k": "]"}', *["1"] * 50_000])


def test_command_line_writes_one_file(spark, tmp_path):
    from codesift.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.js").write_text("document.write(location.hash);\neval(req.body.x);\n")
    code = main(["scan", str(tmp_path / "in"), "--format", "json", "--output", str(tmp_path / "out.json")])
    told = json.loads((tmp_path / "out.json").read_text())
    assert code == 1 and told["findings"] and told["target"] == str(tmp_path / "in") and told["config"]["security"] is True
    assert {s["n"] for s in told["summary"] if s["dimension"] == "scanned"} == {1}


def test_parts_go_as_they_are_copied(tmp_path, monkeypatch):
    """A report is on disk once while it is put together, not twice."""
    import json

    from codesift.sources import onefile

    system, _ = onefile.opened(str(tmp_path))
    seen = []

    class Watched:
        def __getattr__(self, name):
            return getattr(system, name)

        def open_input_stream(self, path):
            seen.append(sorted(p.name for p in folder.iterdir() if p.name != "whole"))
            return system.open_input_stream(path)

    writer = onefile.OneFileWriter({"path": str(tmp_path / "r.json"), "layout": json.dumps(["[", "]"]), "separator": ","})
    folder = tmp_path / writer.folder.rsplit("/", 1)[1]
    folder.mkdir()
    parts = [onefile.Part(k, {0: f"0-{k}-9"}) for k in range(3)]
    for k in range(3):
        (folder / f"0-{k}-9").write_text(str(k))
    monkeypatch.setattr(onefile, "opened", lambda path: (Watched(), onefile_path(path)))
    writer.commit(parts)
    assert (tmp_path / "r.json").read_text() == "[0,1,2]" and not folder.exists()
    assert seen == [["0-0-9", "0-1-9", "0-2-9"], ["0-1-9", "0-2-9"], ["0-2-9"]]


def onefile_path(path: str) -> str:
    return path.removeprefix("file://")
