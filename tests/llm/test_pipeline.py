"""The pipeline stage by stage against brute force, and over tables that are empty or hold awkward rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def tables(folder, docs, labels, items, **more):
    docs = [(d, t, "xx", s, len(t or "")) for d, t, s in docs]
    columns = {n: pa.array([r[i] for r in docs], t) for i, (n, t) in enumerate(zip(COLUMNS, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())))}
    pq.write_table(pa.table(columns | {k: pa.array([v] * len(docs), pa.string()) for k, v in more.items()}), folder / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([0] * len(labels), pa.int32()), "toxic": pa.array([x[1] for x in labels], pa.int32())}), folder / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array(range(len(items)), pa.int64()), "text": pa.array(items, pa.string())}), folder / "benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    rng = random.Random(31)
    plain = [f"plain{k}" for k in range(500)]
    text = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    items = [text(30), text(25)]
    docs, labels = [], []
    for i in range(600):
        t = text(rng.randrange(30, 90))
        if i % 6 == 0:
            t = " ".join(w if k % 12 else rng.choice(["vileone", "viletwo", "vilethree"]) for k, w in enumerate(t.split()))
        docs.append((i, ("menu of the site\n" if i % 3 == 0 else "") + t, f"s{i % 3}"))
        labels.append((i, int(i % 6 == 0)))
    base = docs[1][1]
    docs += [(600, base, "s1"), (601, base.replace(base.split()[20], "edited", 1), "s2"), (602, text(40) + " " + items[0], "s2"), (603, text(5) + " " + " ".join(w if k % 10 else "x" for k, w in enumerate(items[1].split())), None), (604, None, "s0"), (605, "", None), (None, text(50), "s1")]
    return tables(tmp_path_factory.mktemp("sf"), docs, labels, items)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "simhash near-dedup", "benchmark decontamination", "mixing"]
    first = docs.count()

    toxic = dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, corpus)
    assert toxic.columns == COLUMNS
    gone = {r["doc_id"] for r in rows(docs)} - {r["doc_id"] for r in rows(toxic)}
    planted = {i for i in range(600) if i % 6 == 0}
    assert len(gone & planted) >= 0.95 * len(planted) and len(gone - planted) <= 0.01 * first

    kept = dict(corpus_pipeline.STAGES)["line dedup"](spark, toxic, corpus)
    before, pages, held = rows(toxic), Counter(), Counter()
    for r in before:
        pages[r["source"]] += 1
        held.update((r["source"], x) for x in set((r["text"] or "").split("\n")) if x.strip(" "))
    cut = {r["doc_id"]: None if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if not (held[r["source"], x] >= 2 and held[r["source"], x] > 0.1 * pages[r["source"]])) for r in before}
    after = rows(kept)
    assert {r["doc_id"]: r["text"] for r in after} == cut and len(after) == len(before) and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in after)
    assert not any("menu of the site" in (t or "") for t in cut.values())

    one = dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, kept, corpus)
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)) if w) for w in (words((r["text"] or "").lower()) for r in after)]
    where = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s or {()}:
            where[x].add(i)
    label = list(range(len(after)))
    for i, s in enumerate(sets):
        for j in set().union(*(where[x] for x in s or {()})):
            if j < i and (s == sets[j] or len(s & sets[j]) >= 0.8 * len(s | sets[j])) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    order = lambda i: -(1 << 63) if after[i]["doc_id"] is None else after[i]["doc_id"]
    want = {min((i for i, x in enumerate(label) if x == k), key=order) for k in set(label)}
    assert sorted(str(r["doc_id"]) for r in rows(one)) == sorted(str(after[i]["doc_id"]) for i in want) and one.columns == COLUMNS
    assert not {600, 601} & {r["doc_id"] for r in rows(one)}

    clean = dict(corpus_pipeline.STAGES)["benchmark decontamination"](spark, one, corpus)
    assert {r["doc_id"] for r in rows(one)} - {r["doc_id"] for r in rows(clean)} == {602, 603} and clean.columns == COLUMNS

    mixed = dict(corpus_pipeline.STAGES)["mixing"](spark, clean, corpus)
    assert mixed.columns == [*COLUMNS, "copy"]
    size, taken = Counter(), Counter()
    for r in rows(clean):
        size[r["source"]] += len(words(r["text"]))
    for r in rows(mixed):
        taken[r["source"]] += len(words(r["text"]))
        assert 1 <= r["copy"] <= 3
    names = sorted(size, key=lambda s: (s is None, s or ""))
    due, total = {}, sum(size.values())
    weights = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, rest = set(names), float(total)
    while left:
        share = {s: rest * weights[s] / sum(weights[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 3 * size[s]}
        due |= {s: 3.0 * size[s] for s in over} or share
        rest -= sum(3 * size[s] for s in over)
        left = left - over if over else set()
    assert all(abs(taken[s] - due[s]) <= max(20, 0.01 * due[s]) for s in names)


def test_run_is_its_stages(spark, corpus):
    found = rows(corpus_pipeline.run(spark, corpus))
    again = rows(corpus_pipeline.run(spark, corpus))
    assert found and sorted(map(str, found)) == sorted(map(str, again))


def test_awkward_tables(spark, tmp_path_factory):
    empty = tables(tmp_path_factory.mktemp("sf"), [], [], [])
    assert corpus_pipeline.run(spark, empty).count() == 0
    # Clashing names, no labels, no items, rows that are alike in everything.
    docs = [(1, "same words here and there again", None), (1, "same words here and there again", None), (None, None, None), (2, "x" * 100_000, "s"), (3, "", "s")]
    odd = tables(tmp_path_factory.mktemp("sf"), docs, [], [], copy="c", _cs_uid="c", _uid="c", route="c", _cs_flagged="c", _cs_times="c")
    found = corpus_pipeline.run(spark, odd)
    assert found.columns == [*COLUMNS, "copy", "_cs_uid", "_uid", "route", "_cs_flagged", "_cs_times", "copy_2"]
    assert {r.doc_id for r in found.collect()} <= {1, 2, 3, None} and all(r.copy == "c" for r in found.collect())
