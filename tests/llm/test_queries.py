"""Every registered query over whole tables with awkward rows, against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash

import __spark_entry__
from codesift.llm import decontamination, token_counts, tokens


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """A folder of tables: ties, nulls, blanks, repeated ids, long texts, clashing columns; documents in several files."""
    rng = random.Random(21)
    folder = tmp_path_factory.mktemp("sf")
    vocabulary = [f"w{i}" for i in range(400)] + ["Ärger", "naïve", "X" * 40]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [text(n) for n in (30, 30, 25, 12, 3)]
    base = [text(n) for n in (5, 25, 60, 150, 400, 900)]
    passage = text(90)
    texts = [*base, base[4], base[4].upper(), base[4].replace("w7 ", "w8 "), base[5] + " end", None, "", " \n\t ", "one", "menu\n" + base[2] + "\nfooter", "menu\n" + base[3] + "\nfooter"]
    texts += [text(40) + "\n" + passage + " " + text(30), passage + text(20), text(50) + " " + items[0] + " " + text(10), text(9) + " " + " ".join(w if i % 9 else "zz" for i, w in enumerate(items[1].split())) + " tail", "ab" * 3000, "x " * 3000, "\t" * 5000 + "end"]
    texts += [text(rng.randrange(1, 120)) for _ in range(120)]
    ids = [*range(len(texts) - 4), 3, 3, None, -7]
    sources = [None if i % 11 == 5 else "hot" if i % 3 else f"s{i % 5}" for i in range(len(texts))]
    docs = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": [None if i % 13 == 4 else "" if i % 13 == 5 else f"l{i % 2}" for i in range(len(texts))], "source": sources, "n_chars": pa.array([len(t or "") for t in texts], pa.int64()), "_uid": ["clash"] * len(texts), "copy": ["clash"] * len(texts), "_cs_uid": ["clash"] * len(texts)})
    (folder / "documents.parquet").mkdir()
    for k in range(3):
        pq.write_table(docs.slice(k * 50, 50 if k < 2 else len(texts)), folder / "documents.parquet" / f"part-{k}.parquet")
    pq.write_table(pa.table({"item_id": pa.array([0, 1, 2, 3, 4, 5, None], pa.int64()), "text": [*items, None, ""]}), folder / "benchmark.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([*range(0, 100, 2), None], pa.int64()), "quality": pa.array([0] * 51, pa.int32()), "toxic": pa.array([int(i % 5 == 0) for i in range(51)], pa.int32())}), folder / "labels.parquet")
    urls = ["http://www.Example.com/en/x?q#f", "http://a.example.com/en/", "http://x.net/es/1", "ftp://b.net", "no scheme", None, "", "http://casino.org/a", "http://h.org/p", "http://h.org/q", "http://h.org/r"]
    pages = [f"<html>\nnav\n{u}\n</html>" for u in urls[:-1]] + [None]
    pq.write_table(pa.table({"page_id": pa.array([*range(10), None], pa.int64()), "url": urls, "html": pages}), folder / "pages.parquet")
    g = np.random.default_rng(5)
    vectors = [v.tolist() for v in g.standard_normal((400, 12)).astype(np.float32)]
    vectors[60] = vectors[61] = vectors[50]
    vectors += [None, [0.0] * 12, [float("nan")] + [1.0] * 11, [None] + [1.0] * 11]
    pq.write_table(pa.table({"vec_id": pa.array([*range(400), 450, 500, 550, 600], pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * 404, pa.int32())}), folder / "embeddings.parquet")
    return folder


@pytest.fixture(scope="module")
def docs(tables):
    """The rows in the order that breaks ties of equal ids: that of the table."""
    rows = [r for k in range(3) for r in pq.read_table(tables / "documents.parquet" / f"part-{k}.parquet").to_pylist()]
    return sorted(rows, key=lambda r: -(1 << 63) if r["doc_id"] is None else r["doc_id"])


def result(spark, tables, name):
    return [r.asDict() for r in __spark_entry__.queries()[name](spark, str(tables)).collect()]


def same(found, want):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(found, key=key) == sorted(want, key=key)


def test_op4(spark, tables, docs):
    def fingerprint(text):
        w = words(lowered(text or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fingerprint(r["text"]) for r in docs]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    least = {k: min((r["doc_id"] for r, x in zip(docs, label) if x == k and r["doc_id"] is not None), default=None) for k in set(label)}
    same([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in result(spark, tables, "op4_simhash")], [(r["doc_id"], f"{p:016x}", least[x]) for r, p, x in zip(docs, prints, label)])


def runs(mask):
    return sum(g and (i == 0 or not mask[i - 1]) for i, g in enumerate(mask))


def test_op6(spark, tables, docs):
    texts = [(r["text"] or "").encode() for r in docs]
    count = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    want = []
    for r, t in zip(docs, texts):
        gone = [False] * len(t)
        for i in range(len(t) - 399):
            if count[t[i : i + 400]] > 1:
                gone[i : i + 400] = [True] * 400
        want.append((r["doc_id"], len(t), sum(gone), runs(gone), sha(bytes(b for b, g in zip(t, gone) if not g))))
    same([tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in result(spark, tables, "op6_suffix_dedup")], want)


def test_op9(spark, tables, docs):
    seen, want = set(), []
    for r in docs:
        w = words(r["text"])
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(k)
        want.append((r["doc_id"], len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    same([tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in result(spark, tables, "op9_substring_dedup")], want)


def smith_waterman(a, b):
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best


def test_op2(spark, tables, docs):
    plain = lambda t: [w for w in (re.sub(r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", "", w) for w in words(lowered(t or ""))) if w]
    items = [(r["item_id"], plain(r["text"])) for r in pq.read_table(tables / "benchmark.parquet").to_pylist()]
    want = {}
    for r in docs:
        w = plain(r["text"])
        for i, item in items:
            if len(item) >= decontamination.LEAST_WORDS and (s := smith_waterman(item, w) / (2 * len(item))) >= decontamination.THRESHOLD:
                want.setdefault((r["doc_id"], i), []).append(s)
    found = defaultdict(list)
    for r in result(spark, tables, "op2_decontamination"):
        found[r["doc_id"], r["item_id"]].append(r["score"])
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()} and any(0.6 <= s[0] < 1 for s in want.values())


def test_op5(spark, tables, docs):
    ranks = {__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, open(token_counts.VOCABULARY, "rb"))}
    encode = tiktoken.Encoding("brute", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in docs:
        text = r["text"] or ""
        lines = text.split("\n")
        sections = [line + "\n" for line in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
        owner = [i for i, s in enumerate(sections) for _ in s.encode()]
        lead = [b & 0xC0 != 0x80 for b in text.encode()]
        n, crossing, at = [0] * len(sections), [0] * len(sections), 0
        found = encode.encode_ordinary(text)
        for t in found:
            end = at + len(encode.decode_single_token_bytes(t))
            held = Counter()
            for i in range(at, end):
                held[owner[i]] += lead[i]
            chosen = min(held, key=lambda s: (-held[s], s))
            n[chosen] += 1
            crossing[chosen] += len(held) > 1
            at = end
        begin = 0
        for i, s in enumerate(sections):
            end = begin + len(s.encode())
            want.append((r["doc_id"], i, begin, end, n[i], crossing[i], len(found)))
            begin = end
    same([tuple(r[c] for c in ("doc_id", "section", "begin", "end", "n_tokens", "n_crossing", "doc_tokens")) for r in result(spark, tables, "op5_token_counts")], want)


def test_op3(spark, tables):
    rows = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in pq.read_table(tables / "embeddings.parquet").to_pylist() if r["vec_id"] < 400}
    found, hit = defaultdict(list), 0
    for r in sorted(result(spark, tables, "op3_neighbours"), key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append(r)
    assert set(found) == set(range(0, 400, 50))
    for q, near in found.items():
        score = {i: float(v @ rows[q] / np.sqrt((v @ v) * (rows[q] @ rows[q]))) for i, v in rows.items() if i != q}
        want = sorted(score, key=lambda i: (-round(score[i], 12), i))[:5]
        hit += len({r["vec_id"] for r in near} & set(want))
        assert [r["rank"] for r in near] == [1, 2, 3, 4, 5] and all(abs(score[r["vec_id"]] - r["score"]) < 1e-12 for r in near)
    assert hit >= 0.9 * 5 * len(found)
    assert [r["vec_id"] for r in found[50]][:2] == [60, 61]


def test_op7(spark, tables, docs):
    found = result(spark, tables, "op7_mixing")
    sizes = Counter()
    for r in docs:
        sizes[r["source"]] += len(words(r["text"]))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    due, open_, rest = {}, set(names), sum(sizes.values())
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        due |= {s: 3 * sizes[s] for s in over} if over else share
        rest -= sum(3 * sizes[s] for s in over)
        open_ = open_ - set(over) if over else set()
    same([(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in found], [(r["doc_id"], len(words(r["text"])), sizes[r["source"]], round(float(due[r["source"]]), 6)) for r in docs])
    taken = Counter()
    for r in found:
        assert r["size"] == 0 == r["taken"] or r["taken"] % r["size"] == 0 and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
    assert all(abs(taken[sizes[s], round(float(due[s]), 6)] - due[s]) <= max(5, 0.01 * due[s]) for s in names)
    assert sorted(map(str, found)) == sorted(map(str, result(spark, tables, "op7_mixing")))


def test_op8(spark, tables, docs):
    found = result(spark, tables, "op8_toxicity")
    same([(r["doc_id"], r["held_out"]) for r in found], [(r["doc_id"], r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in docs])
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)


def boilerplate(rows):
    """host and text of each row: texts without the lines that are on more than a tenth, and on two, of the host's."""
    pages, held = Counter(), Counter()
    for host, text in rows:
        pages[host] += 1
        held.update((host, x) for x in set((text or "").split("\n")) if x.strip(" "))
    return [None if t is None else "\n".join(x for x in t.split("\n") if not (held[h, x] >= 2 and held[h, x] > 0.1 * pages[h])) for h, t in rows]


def test_op10(spark, tables, docs):
    kept = boilerplate([(r["source"], r["text"]) for r in docs])
    same([(r["doc_id"], r["kept_sha256"]) for r in result(spark, tables, "op10_line_dedup")], [(r["doc_id"], None if t is None else sha(t.encode())) for r, t in zip(docs, kept)])


def test_page_lines(spark, tables):
    rows = pq.read_table(tables / "pages.parquet").to_pylist()
    host = lambda u: lowered(re.match(r"[^/?#]*", u.split("://", 1)[1])[0]) if u and "://" in u else ""
    kept = boilerplate([(host(r["url"]), r["html"]) for r in rows])
    same([(r["page_id"], r["host"], r["kept_sha256"]) for r in result(spark, tables, "page_line_dedup")], [(r["page_id"], host(r["url"]), None if t is None else sha(t.encode())) for r, t in zip(rows, kept)])


def test_op11(spark, tables):
    rows = {r["vec_id"]: np.floor(64 * np.array(r["embedding"], dtype=float)).astype(int) + 1_000_000 for r in pq.read_table(tables / "embeddings.parquet").to_pylist() if r["vec_id"] < 400 or r["vec_id"] == 500}
    x = np.array(list(rows.values()))
    off = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(off.T @ off / len(x))
    found = result(spark, tables, "op11_whitening")
    assert len(found) == len(x) * 12 and len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-10
    sign = {}
    for r in found:
        i, c = list(rows).index(r["vec_id"]), r["component"]
        want = off[i] @ vectors[:, -c] / np.sqrt(values[-c])
        sign.setdefault(c, np.sign(want * r["whitened"]))
        assert abs(want * sign[c] - r["whitened"]) < 1e-9 and abs(r["explained"] - values[-c] / values.sum()) < 1e-12
        assert r["n"] == len(x) and r["deviation"] == sum((len(x) * int(a) - int(b)) ** 2 for a, b in zip(x[i], x.sum(axis=0)))


def test_op12(spark, tables, docs):
    labels = defaultdict(lambda: (False, False))
    for r in pq.read_table(tables / "labels.parquet").to_pylist():
        if r["doc_id"] is not None:
            labels[r["doc_id"]] = (labels[r["doc_id"]][0] or r["quality"] == 1, labels[r["doc_id"]][1] or r["toxic"] == 1)
    fails, parts = [], defaultdict(list)
    for r in docs:
        t = r["text"] or ""
        w = words(t)
        smaller = any(r["doc_id"] is not None and o["doc_id"] is not None and o["doc_id"] < r["doc_id"] and (o["text"] or "") == t for o in docs)
        fails.append({"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": smaller})
        parts[r["lang"] or ""].append((fails[-1], *labels[r["doc_id"]]))
    want = []
    for part, rows in parts.items():
        counts, removed = [], Counter()
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order):
                gone = lambda x, n=step, o=order: any(x[k] for k in o[:n])
                out = [(g, t) for x, g, t in rows if x[f] and not gone(x)]
                removed[f] += len(out)
                kept = sum(not x[f] and not gone(x) for x, _, _ in rows)
                counts.append((f, (part, "".join(order), step + 1, kept, len(out), sum(x[f] and gone(x) for x, _, _ in rows), sum(x[f] and sum(x.values()) == 1 for x, _, _ in rows), sum(g for g, _ in out), sum(t for _, t in out))))
        want += [(*row, removed[f]) for f, row in counts]
    same([tuple(r[c] for c in ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in result(spark, tables, "op12_filter_audit")], want)


def shingle_set(text, n=5):
    w = words(lowered(text or ""))
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_op13(spark, tables, docs):
    sets = [shingle_set(r["text"]) for r in docs]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    least = {k: min((r["doc_id"] for r, x in zip(docs, label) if x == k and r["doc_id"] is not None), default=None) for k in set(label)}
    same([tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in result(spark, tables, "op13_minhash")], [(r["doc_id"], len(s), least[x], r["doc_id"] == least[x]) for r, s, x in zip(docs, sets, label)])


def test_op1(spark, tables):
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in result(spark, tables, "op1_url_filter")}
    assert found[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and found[1][2:] == ("example.com/en/", "block")
    assert found[2][2:] == ("net/es/", "block") and found[3] == ("b.net", "", None, "allow") and found[4] == found[5] == found[6] == ("", "", None, "allow")
    assert found[7][2:] == (None, "block") and len(found) == 11
