"""The folder source against a plain walk of the same folders."""

from __future__ import annotations

import json
import os

import pytest

from codesift.plans.scan import scan
from codesift.sources import tree

FILES = {
    "__init__.py": "x", "_app.tsx": "eval(req.body.x);\n", "pkg/_form.html.erb": "y", "pkg/__init__.py": "z", "pkg/deep/er/a.js": "b", "pkg/deep/er/B.JS": "c", ".env": "s", ".git/config": "g", "node_modules/m/index.js": "n",
    "pkg/node_modules/k.js": "k", "vendor/keep.js": "v", "vendor/drop.js": "v", "build/x.js": "b", "empty.js": "", "big.js": "x" * 5000, "noext": "n", "é 1/ü.js": "u",
}


@pytest.fixture
def root(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "latin.js").write_bytes(b"\xe9")
    return tmp_path


def names(rows, root):
    return sorted(os.path.relpath(r.path.removeprefix("file:"), root) for r in rows)


def test_all_names(spark, root):
    found = tree.read_tree(spark, str(root)).collect()
    want = [n for n, text in FILES.items() if text and not any(x.startswith(".") for x in n.split("/"))] + ["latin.js"]
    assert names(found, root) == sorted(want)
    rows = {names([r], root)[0]: r for r in found}
    assert rows["pkg/__init__.py"].content == "z" and rows["pkg/deep/er/B.JS"].extension == ".js" and rows["noext"].extension == "" and rows["é 1/ü.js"].content == "u"
    assert not rows["latin.js"].readable and rows["latin.js"].content is None and rows["latin.js"].error == "not UTF-8" and rows["_app.tsx"].size == 18
    everything = tree.read_tree(spark, f"file://{root}", hidden=True).collect()
    assert names(everything, root) == sorted([n for n, text in FILES.items() if text] + ["latin.js"])


def test_ignored_folders_are_not_listed(spark, root):
    ignore = ["node_modules/", "/build", "vendor/", "!vendor/keep.js", "*.tsx", "big.js", "!big.js"]
    found = tree.read_tree(spark, str(root), ignore)
    assert names(found.collect(), root) == sorted(["__init__.py", "big.js", "latin.js", "noext", "pkg/__init__.py", "pkg/_form.html.erb", "pkg/deep/er/B.JS", "pkg/deep/er/a.js", "é 1/ü.js"])

    class Noted(tree.Walk):
        seen: list[str] = []

        def listed(self, relative):
            self.seen.append(relative)
            return super().listed(relative)

    reader = tree.TreeReader({"path": str(root), "ignore": json.dumps(ignore), "partitions": "3"})
    reader.walk.__class__ = Noted
    parts = reader.partitions()
    assert len(parts) > 3 and sum(b.num_rows for p in parts for b in reader.read(p)) == 9
    assert "pkg/deep/er" in Noted.seen and not any(x.startswith(("node_modules", "build", ".git", "vendor", "pkg/node_modules")) for x in Noted.seen)


@pytest.mark.parametrize("wanted", [1, 2, 5, 100])
def test_parts_cover_each_file_once(root, wanted):
    reader = tree.TreeReader({"path": str(root), "partitions": str(wanted), "hidden": "true"})
    paths = [p for part in reader.partitions() for b in reader.read(part) for p in b.column("path").to_pylist()]
    assert len(paths) == len(set(paths)) == sum(bool(t) for t in FILES.values()) + 1


def test_pushdown(spark, root):
    found = tree.read_tree(spark, str(root))
    some = found.where("size >= 18 and size < 100 and extension in ('.tsx', '.js') and path is not null")
    assert names(some.collect(), root) == ["_app.tsx"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "size >=" not in plan.split("BatchScan")[0] and "extension IN" not in plan.split("BatchScan")[0]
    assert names(found.where("extension = '.js' and extension in ('.js', '.py') and size = 1").collect(), root) == sorted(n for n in [*FILES, "latin.js"] if n.lower().endswith(".js") and FILES.get(n, "1") and len(FILES.get(n, "1").encode()) == 1)
    assert found.where("extension = '.js' and extension = '.py'").count() == 0


def test_awkward_roots(spark, root):
    assert tree.read_tree(spark, str(root / "absent")).count() == 0 and tree.read_tree(spark, str(root / "pkg/node_modules")).count() == 1
    assert [r.content for r in tree.read_tree(spark, str(root / "_app.tsx")).collect()] == ["eval(req.body.x);\n"]
    assert tree.readable_by_tree(str(root)) and not tree.readable_by_tree(str(root / "absent")) and not tree.readable_by_tree("viewfs://store/in")


def test_scan_sees_underscored_names(spark, root):
    found = scan(spark, str(root)).findings
    assert {names([r], root)[0] for r in found.where("rule_id like 'SEC%' or rule_id like 'security%'").collect()} == {"_app.tsx"}
