"""Each operator against a brute-force version, on texts with all the awkward cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from codesift.llm import components, decontamination, line_dedup, mixing, neighbours, repeats, simhash, substring_dedup, suffix_dedup, token_counts, tokens, toxicity, url_filter

SPACES = " \t\n\x0b\f\r"
SCHEMA = "doc_id long, text string, source string, kept_text string, _uid string, route int, key string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus():
    rng = random.Random(7)
    vocabulary = ["the", "of", "ée", "Étre", "zu", "a", "run", "tion", "x" * 30, "naïve", "　wide", "nbsp in"]
    base = [" ".join(rng.choice(vocabulary) + rng.choice(["", ".", ","]) for _ in range(n)) for n in (5, 19, 20, 21, 60, 300, 900)]
    shared = " ".join(f"shared{i}" for i in range(45))
    texts = [*base, base[5], base[6][100:2500], base[4] + "\n" + shared, shared + " tail words here", base[5].replace("run", "RUN", 2), None, "", " \t\n ", "one", "aa " * 400, "ab" * 900, base[6] + " " + base[6], "\r\n".join(base[:4])]
    rows = [(i, t, None if i % 7 == 3 else f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(4, base[4], "s1"), (4, base[4], "s1"), (None, base[5], None), (None, None, "s0"), (-5, shared, "s2")]
    return [(*r, "clash", "clash", 1, "clash") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).coalesce(3)


@pytest.fixture(scope="module")
def listed(docs):
    """The rows in the order that breaks ties of equal ids: that of the row numbers the operators give."""
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("at")).collect()
    return sorted(((-(1 << 63) if r.doc_id is None else r.doc_id, r["at"], r.text or "") for r in rows))


def test_words_and_ranges():
    text = "  Ab c\x0bd é\n\nz "
    chunk = next(tokens.chunks(__import__("pyarrow").array([text, None, "", "q"])))
    chunk.words()
    raw = bytes(chunk.buf)
    assert [raw[a:b].decode() for a, b in zip(chunk.start, chunk.end)] == ["Ab", "c", "d", "é", "z", "q"]
    assert chunk.word_bounds.tolist() == [0, 5, 5, 5, 6]
    h = np.array([9, 3, 7, 3, 5, 3], dtype=np.uint64)
    assert tokens.sliding_argmin(h, 3).tolist() == [1, 1, 3, 3]


def thue_morse(k, a="a", b="b"):
    """2**k letters, and the same with the letters exchanged."""
    text = [a]
    for _ in range(k):
        text += [b if c == a else a for c in text]
    return "".join(text), "".join(b if c == a else a for c in text)


def test_long_names_do_not_collide():
    one, two = thue_morse(11)
    buf = np.frombuffer((one + two + one).encode(), np.uint8)
    start = np.arange(3) * 2048
    for base in tokens.BASES:
        old = tokens.Rolling(buf, base).ranges(start, start + 2048)
        new = tokens.names(buf, start, start + 2048, base)
        assert old[0] == old[1] and new[0] == new[2] != new[1]
    short = np.array([0, 5, 2048]), np.array([511, 300, 2548])
    assert (tokens.names(buf, *short, tokens.BASES[0]) == tokens.Rolling(buf, tokens.BASES[0]).ranges(*short)).all()


def test_words_built_to_collide_are_kept(spark):
    pairs = [thue_morse(10, chr(97 + k), chr(107 + k)) for k in range(6)] + [thue_morse(11, chr(77 + k), "z") for k in range(4)]
    rows = [(1, " ".join(a for a, _ in pairs)), (2, " ".join(b for _, b in pairs)), (3, " ".join(a for a, _ in pairs))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(docs, length=10, anchor=4).collect()}
    assert found == {1: (10, 0), 2: (10, 0), 3: (10, 10)}


def removed(units_of, rows, length, earlier):
    """unit lists and their removal masks, by brute force."""
    seen, count = set(), Counter()
    lists = [units_of(t) for _, _, t in rows]
    for u in lists:
        count.update(tuple(u[s : s + length]) for s in range(len(u) - length + 1))
    masks = []
    for u in lists:
        gone = [False] * len(u)
        for s in range(len(u) - length + 1):
            k = tuple(u[s : s + length])
            if (k in seen) if earlier else count[k] > 1:
                gone[s : s + length] = [True] * length
            seen.add(k)
        masks.append(gone)
    return lists, masks


@pytest.mark.parametrize(("length", "anchor"), [(20, 8), (20, 20), (3, 1), (1, 1)])
def test_substring_dedup(docs, listed, length, anchor):
    lists, masks = removed(words, listed, length, True)
    want = sorted((r[0], len(u), sum(m), " ".join(w for w, g in zip(u, m) if not g).encode()) for r, u, m in zip(listed, lists, masks))
    found = substring_dedup.substring_dedup(docs, length, anchor).collect()
    assert sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, bytes(r.kept_text)) for r in found) == want


@pytest.mark.parametrize(("length", "window", "modulus", "gram"), [(400, 16, 64, 256), (40, 4, 8, 8), (40, 8, 2, 40), (60, 4, 10**6, 20)])
def test_suffix_dedup(docs, listed, length, window, modulus, gram):
    lists, masks = removed(lambda t: list(t.encode()), listed, length, False)
    want = sorted((r[0], len(u), sum(m), bytes(b for b, g in zip(u, m) if not g)) for r, u, m in zip(listed, lists, masks))
    found = suffix_dedup.suffix_dedup(docs, length, window, modulus, gram).collect()
    assert sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept_bytes)) for r in found) == want


def test_simhash_components(spark):
    rng = random.Random(3)
    base = " ".join(f"w{rng.randrange(400)}" for _ in range(300))
    texts = [base, base, base.upper(), base + " tail", None, "", "  ", "a b", "unrelated words only"]
    texts += [" ".join(w if rng.random() > 0.01 else "edit" for w in base.split()) for _ in range(40)]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(100, base), (None, base)]
    found = simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()

    def fingerprint(text):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
        shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {k: min((r[0] for r, x in zip(rows, label) if x == k and r[0] is not None), default=None) for k in set(label)}
    want = sorted((str(r[0]), p, least[x]) for r, p, x in zip(rows, prints, label))
    assert sorted((str(r.doc_id), int.from_bytes(r.fingerprint, "big"), r.component_id) for r in found) == want


@pytest.mark.parametrize("n", [1, 2, 5, 40, 300])
def test_bk_tree_links_connect_what_brute_force_connects(n):
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    points = centres[rng.integers(0, 5, n)] ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    links = simhash.tree_links(points[:, None], 4)
    label, want = list(range(n)), list(range(n))
    for i, j in links:
        assert int(points[i] ^ points[j]).bit_count() <= 4
        a, b = label[i], label[j]
        assert a != b
        label = [a if x == b else x for x in label]
    for i in range(n):
        for j in range(i):
            if int(points[i] ^ points[j]).bit_count() <= 4:
                a, b = want[i], want[j]
                want = [a if x == b else x for x in want]
    assert len(set(label)) == len(set(want))


def test_large_shards_are_dealt_as_block_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 10)
    rows = [(i, " ".join(f"w{(i * 0 + k)}" for k in range(200)) + f" extra{i}") for i in range(60)]
    found = simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    prints = {r.doc_id: int.from_bytes(r.fingerprint, "big") for r in found}
    for r in found:
        assert all(s.component_id == r.component_id for s in found if (prints[r.doc_id] ^ prints[s.doc_id]).bit_count() <= 4)


def test_exact_keys_meet():
    rng = np.random.default_rng(1)
    for n in (10, 10**6, 10**9):
        keys = simhash.exact_keys(n, 64, 4)
        for _ in range(200):
            flipped = set(rng.choice(64, 4, replace=False).tolist())
            assert any(not flipped & set(k.tolist()) for k in keys)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(50, 40), (40, 50), (60, 60)] + [(100, 100 + k) for k in range(1, 20)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 31)} | {50: 40} | {100 + k: 100 for k in range(1, 20)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_keeps_columns(spark):
    rng = random.Random(5)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(400))
    near = base.split()
    near[7] = "edited"
    rows = [(3, base, "x"), (1, " ".join(near), "x"), (2, " ".join(f"v{rng.randrange(5000)}" for _ in range(400)), "y"), (9, "", "z"), (8, None, "z")]
    out = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, _uid string"))
    assert out.columns == ["doc_id", "text", "_uid"]
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 8]


def test_one_of_each_at_the_similarity(spark):
    rng = random.Random(8)
    rows, want = [], set()
    for i in range(80):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        edits = 6 if i < 40 else 7  # Jaccard 266 / 326 = 0.816 and 261 / 331 = 0.789
        near = [f"e{i}" if k % 40 == 20 and k < 40 * edits else w for k, w in enumerate(base)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near))]
        want |= {2 * i} if i < 40 else {2 * i, 2 * i + 1}
    out = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in out.collect()} == want


def test_one_of_each_beyond_a_refuted_link(spark):
    # a-c and b-c are similar enough, a-b is not: whichever links a forest takes, all three are one group.
    rng = random.Random(9)
    c = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    a = [f"a{k}" if k % 60 == 20 else w for k, w in enumerate(c)]
    b = [f"b{k}" if k % 60 == 40 else w for k, w in enumerate(c)]
    out = simhash.one_of_each(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate((a, b, c))], "doc_id long, text string"))
    assert [r.doc_id for r in out.collect()] == [0]


def test_line_dedup(spark):
    rows = [(i, f"menu\nown {i}\n \n" + ("rare\n" if i < 2 else "") + "menu", None if i % 2 else "h") for i in range(30)] + [(98, None, "h"), (99, "", "h"), (97, "menu", "h")]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_pages=5)
    text = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == ["doc_id", "text", "source"]
    assert text[0] == "own 0\n \nrare" and text[5] == "own 5\n \n".rstrip("\n") and text[98] is None and text[99] == "" and text[97] == ""
    few = line_dedup.line_dedup(spark.createDataFrame(rows[:4], "doc_id long, text string, source string"))
    assert {r.doc_id: r.text for r in few.collect()} == {0: "own 0\n \nrare", 1: "own 1\n \nrare", 2: "own 2\n ", 3: "own 3\n "}
    alone = line_dedup.line_dedup(spark.createDataFrame(rows[:1], "doc_id long, text string, source string"))
    assert alone.first().text == rows[0][1]


def test_targets():
    assert mixing.targets([10, 10, 10], [1, 2, 3]) == [5, 10, 15]
    assert mixing.targets([100, 1, 1], [1, 2, 3]) == [96, 3, 3]
    assert mixing.targets([], []) == [] and mixing.targets([0, 5], [1, 1]) == [0, 5]


def test_mixing(spark, docs):
    rng = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 400))), f"s{min(i % 5, 2)}") for i in range(900)] + [(900, None, None), (901, "a b c", None), (3, "x y", "s0"), (None, "z", "s1")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = [r.asDict() for r in mixing.mix(table.repartition(3)).collect()]
    again = [r.asDict() for r in mixing.mix(table.repartition(5)).collect()]
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(found, key=key) == sorted(again, key=key) and len(found) == len(rows)
    by = {}
    for r in found:
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        by.setdefault((r["target"], r["source_size"]), []).append(r)
    for (target, size), group in by.items():
        assert sum(r["size"] for r in group) == size
        assert abs(sum(r["taken"] for r in group) - target) <= max(5, 0.01 * target)
    assert math.isclose(sum(t for t, _ in by), sum(s for _, s in by))
    out = mixing.mixed(docs)
    assert out.columns == [*docs.columns, "copy"]


def test_url_filter(spark):
    urls = [
        "http://www.Example.com/en/x?q#f", "http://example.com/en", "http://a.example.com/en/", "http://myexample.com/en/", "http://x.net/es/1", "http://net/fr/", "ftp://b.net", "http://x.net/EN/es/",
        "no scheme", None, "", "://", "http://casino.org/a", "http://x.org/Online-Casino/y", "http://supercasino.org/", "http://casino.com/", "http://h?://example.com/en/", "http://example.com./en/", "http://m.free-bets.org", "http://example.com:80/en/",
    ]
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

    def brute(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0].translate({c: c + 32 for c in range(65, 91)})
            path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        best = None
        for verdict, rule in rules:
            h, _, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
                best = (verdict, rule)
        if best:
            return host, path, best[1], best[0]
        hit = any(re.search(r.pattern, host + path) for r in url_filter.WORD_RULES)
        return host, path, None, "block" if hit else "allow"

    rows = list(enumerate(urls)) + [(0, urls[0]), (None, urls[2])]
    found = url_filter.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in found) == sorted((str(i), *(str(x) if k == 2 else x for k, x in enumerate(brute(u)))) for i, u in rows)
    free = url_filter.Rule("digits", r"\d{4}", "block", ())
    kept = url_filter.judged(spark.createDataFrame([(1, "http://a.b/2024"), (2, "http://a.b/20")], "page_id long, url string"), [*url_filter.HOST_RULES, free]).collect()
    assert {r.page_id: r.verdict for r in kept} == {1: "block", 2: "allow"}
    assert url_filter.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_decontamination(spark):
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    items = [(i, text(30)) for i in range(20)] + [(20, "tiny item"), (21, ""), (22, None), (None, text(25))]
    edited = items[3][1].split()
    edited[5], edited[14] = "changed", "changed"
    del edited[20]
    docs = [(0, text(200)), (1, text(50) + " " + items[0][1].upper() + " " + text(50)), (2, text(80) + "\n" + " ".join(edited) + text(10)), (3, "a tiny, ITEM! here"), (4, None), (5, ""), (6, " | ".join(items[7][1].split())), (7, " ".join(items[9][1].split()[:12])), (None, items[23][1]), (1, items[1][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(d, b).collect()}
    assert set(found) == {(1, 0), (2, 3), (3, 20), (6, 7), (None, None), (1, 1)}
    assert found[1, 0].score == 1.0 and (found[1, 0].begin, found[1, 0].end) == (50, 80) and 0.6 <= found[2, 3].score < 1
    assert sorted(str(r.doc_id) for r in decontamination.clean(d, b).collect()) == ["0", "4", "5", "7"]
    assert decontamination.contaminated(d, b.limit(0)).count() == 0 and decontamination.contaminated(d.limit(0), b).count() == 0


def test_edited_copy_of_an_item_that_leaked_often(spark):
    item = [f"w{k}" for k in range(30)]
    edited = ["other" if k % 7 == 6 else w for k, w in enumerate(item)]
    d = spark.createDataFrame([(i, " ".join(item)) for i in range(1000)] + [(1000, " ".join(edited))], "doc_id long, text string")
    found = {r.doc_id: r.score for r in decontamination.contaminated(d, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert len(found) == 1001 and found[1000] == 0.8


def test_item_split_by_an_insertion(spark):
    item = [f"w{k}" for k in range(40)]
    text = [*(f"a{k}" for k in range(9)), *item[:20], *(f"b{k}" for k in range(26)), *item[20:], "z"]
    d, b = spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert [(r.score, r.begin, r.end) for r in decontamination.contaminated(d, b).collect()] == [((80 - 26) / 80, 9, 75)]


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 12))
        h = np.zeros((a.size + 1, b.size + 1), dtype=int)
        for i in range(a.size):
            for j in range(b.size):
                h[i + 1, j + 1] = max(0, h[i, j] + (decontamination.MATCH if a[i] == b[j] else decontamination.MISMATCH), h[i, j + 1] + decontamination.GAP, h[i + 1, j] + decontamination.GAP)
        assert decontamination.align(a, b)[0] == h.max()


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((1500, 16)).astype(np.float32)
    vectors[200:260] = vectors[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [None] * 16), (None, vectors[0].tolist()), (5, vectors[5].tolist()), (2200, [])]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 50))
    u = vectors.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = 0
    for q, near in got.items():
        s = u @ u[q]
        want = [i for i in np.lexsort((np.arange(1500), -np.round(s, 12))) if i != q][:5]
        hit += len({v for v, _ in near} & set(want))
        assert len(near) == 5 and all(abs(s[v] - x) < 1e-9 for v, x in near)
    assert hit / (5 * len(got)) >= 0.9
    assert [v for v, _ in got[200]] == [100, 201, 202, 203, 204]
    few = neighbours.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")).collect()
    assert len(few) == 2
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_token_counts(spark, docs):
    found = token_counts.token_counts(docs).collect()
    encode, _, _ = token_counts.encoding(open(token_counts.VOCABULARY, "rb").read(), token_counts.PATTERN)
    by = Counter()
    for r in found:
        by[r.doc_id] += r.n_tokens
    want = Counter()
    for row in corpus():
        want[row[0]] += len(encode.encode_ordinary(row[1] or ""))
    assert by == want


def test_tokens_across_bounds():
    text = "a\n\n\nbé c".encode()
    ends = np.array([1, 4, 6, 7, 9])  # 'a', three line feeds, 'b' and half of 'é', its rest, ' c'
    bounds = token_counts.line_bounds(text)
    assert bounds.tolist() == [0, 2, 3, 4, 9]
    section, crosses = token_counts.owners(text, ends, bounds, "most")
    assert section.tolist() == [0, 0, 3, 3, 3] and crosses.tolist() == [False, True, False, False, False]
    assert token_counts.owners(text, np.array([3, 9]), bounds, "first")[0].tolist() == [0, 2]
    assert token_counts.owners(text, np.array([3, 9]), bounds, "most")[0].tolist() == [0, 3]


def test_toxicity_learns_and_keeps_to_the_split(spark):
    rng = random.Random(6)
    good, bad = [f"plain{k}" for k in range(300)], ["vileone", "viletwo", "vilethree", "vilefour"]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 6 == 0
        w = [rng.choice(good) for _ in range(rng.randrange(30, 120))]
        for _ in range(4 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        if i % 3 != 2:
            labels.append((i, int(toxic)))
    rows += [(5000, None), (5001, ""), (None, "plain1 vileone")]
    d, l = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (3, None)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.toxicity_scores(d, l).collect()}
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items() if i is not None)
    wrong = [i for i, r in found.items() if i is not None and i < 1500 and r.predicted != (i % 6 == 0)]
    assert len(wrong) <= 15 and not found[5000].predicted and not found[5001].predicted
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    again = {r.doc_id: r.score for r in toxicity.toxicity_scores(d, spark.createDataFrame(flipped, "doc_id long, toxic int")).collect()}
    assert again == {i: r.score for i, r in found.items()}


def test_toxicity_takes_texts_in_small_batches(spark):
    """A task of 40 MB goes to Python in batches of about 4 MB, but a size that the session has set stays."""
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(size)
    d = spark.range(400, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 10_000).alias("text"))
    toxicity.train(d.limit(10), spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    found = [r.n for r in d.mapInArrow(sizes, "n long").collect()]
    assert sum(found) == 400 and max(found) * 110_000 < 6_000_000
    spark.conf.set(size, "9m")
    toxicity.train(d.limit(10), spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int"))
    assert spark.conf.get(size) == "9m"
    spark.conf.unset(size)


def test_toxicity_counts_all_training_rows(spark):
    rng = random.Random(11)
    good = [f"plain{k}" for k in range(300)]
    rows, labels, late, held = [], [], 0, []
    for i in range(1500):
        part, toxic = zlib.crc32(str(i).encode()) % 5, i % 6 == 0
        w = [rng.choice(good) for _ in range(60)]
        if toxic:
            word = "vileone"
            if part == 4 and late < 12 or part == 0:  # all training rows with this word have remainder 4
                word, late = "zzqxjk", late + (part == 4)
                held += [i] if part == 0 else []
            for k in (5, 25, 45):
                w[k] = word
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    found = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert late == 12 and held and all(found[i] for i in held)


@pytest.mark.parametrize("size", [1, 5, 63, 64, 65, 123, 124, 500])
def test_long_words_are_read_to_their_end(size):
    long = "".join(random.Random(size).choice("abcdefgh") for _ in range(size))
    chunk = next(tokens.chunks(__import__("pyarrow").array(["one two", None, f"({long}) tail", "last"])))
    low, begin, end, bounds = toxicity.trimmed(chunk)
    units = [low.tobytes()[a:b].decode() for a, b in zip(begin, end)]
    n = toxicity.ORDER + 1
    assert units[:2] == ["one", "two"] and bounds[:3].tolist() == [0, 2, 2] and units[bounds[3] - 1 :] == ["tail", "last"]
    pieces = units[2 : bounds[3] - 1]
    assert pieces[0] + "".join(p[toxicity.ORDER :] for p in pieces[1:]) == long and max(map(len, pieces)) <= toxicity.LETTERS
    assert {long[k : k + n] for k in range(size - n + 1)} == {p[k : k + n] for p in pieces for k in range(len(p) - n + 1)}


def test_curve_converges_on_separable_rows():
    model = toxicity.Model.__new__(toxicity.Model)
    rng = np.random.default_rng(0)
    t = (rng.random(2000) < 0.1).astype(float)
    f = np.stack([t * rng.random(2000), t * 4 + rng.random(2000) * 0.1, rng.random(2000) * 6], axis=1)
    model.curve = np.zeros(4)
    model.fit(f, t)
    assert ((model.score(f) >= 0.5) == t).mean() > 0.99


def test_merge():
    assert repeats.merge([{"begin": 3, "end": 9}, {"begin": 0, "end": 4}, {"begin": 12, "end": 30}], 20) == [(0, 9), (12, 20)]
    assert repeats.merge(None, 5) == []


def test_kept_digest(docs):
    found = substring_dedup.substring_dedup(docs).select("kept_text", F.sha2("kept_text", 256).alias("d")).first()
    assert found.d == hashlib.sha256(bytes(found.kept_text)).hexdigest()


@pytest.mark.parametrize("operator", [substring_dedup.substring_dedup, suffix_dedup.suffix_dedup, simhash.simhash_dedup, line_dedup.line_dedup, mixing.mix, token_counts.token_counts])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("hot", [1, 20_000])
@pytest.mark.parametrize("operator", ["words", "bytes"])
def test_keys_with_many_contexts(spark, monkeypatch, hot, operator):
    # One passage with other words around it in every document: under its keys all stretches differ.
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(13)
    passage = " ".join(f"p{k}" for k in range(130))
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(8))) + " " + passage + " " + " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(8))) for _ in range(60)]
    rows = [(i, i, t) for i, t in enumerate(texts)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    if operator == "words":
        lists, masks = removed(words, rows, 20, True)
        found = {r.doc_id: bytes(r.kept_text) for r in substring_dedup.substring_dedup(table).collect()}
        assert found == {i: " ".join(w for w, g in zip(u, m) if not g).encode() for i, (u, m) in enumerate(zip(lists, masks))}
    else:
        lists, masks = removed(lambda t: list(t.encode()), rows, 400, False)
        found = {r.doc_id: bytes(r.kept_bytes) for r in suffix_dedup.suffix_dedup(table).collect()}
        assert found == {i: bytes(b for b, g in zip(u, m) if not g) for i, (u, m) in enumerate(zip(lists, masks))}


def test_orders_of_phrase_and_parse_suffixes():
    rng = random.Random(14)
    pieces = [bytes(rng.choice(b"\0ab") for _ in range(rng.randrange(6))) for _ in range(200)]
    group = np.array([rng.randrange(3) for _ in pieces])
    order, shared = repeats.sorted_pieces(group, pieces)
    assert [(group[i], pieces[i]) for i in order] == sorted(zip(group.tolist(), pieces))
    least = repeats.range_least(shared)
    common = lambda x, y: next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    for _ in range(500):
        a, b = sorted(rng.sample(range(200), 2))
        i, j = order[a], order[b]
        want = common(pieces[i], pieces[j]) if group[i] == group[j] else -1
        assert least(np.array([a + 1]), np.array([b + 1]))[0] == want


def test_phrases_overlap_by_a_trigger_and_spell_the_text():
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 101, n, dtype=np.uint8) for n in (300, 3, 0, 500)]
    buf, bounds = np.concatenate(texts), np.concatenate([[0], np.cumsum([t.size for t in texts])])
    ends, doc = suffix_dedup.triggers(buf, bounds, 4, 8)
    assert set(doc.tolist()) == {0, 3} and all(bounds[d] + 4 <= e <= bounds[d + 1] for e, d in zip(ends, doc))
    strings = {bytes(buf[e - 4 : e]) for e in ends}
    for t in texts:
        for k in range(t.size - 3):  # a string is a trigger wherever it stands
            at = [e for e in ends if bytes(buf[e - 4 : e]) == bytes(t[k : k + 4])]
            assert bool(at) == (bytes(t[k : k + 4]) in strings)
    names, owner = suffix_dedup.phrase_names(buf, bounds, 4, 8)
    assert len(names) == sum(max(int((doc == d).sum()) - 1, 0) for d in (0, 3)) and sorted(set(owner.tolist())) == [0, 3]


def test_row_numbers_do_not_depend_on_how_files_are_split(spark, tmp_path):
    from codesift.llm.tables import numbered

    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20).alias("text"))
    rows.repartition(3).write.option("parquet.block.size", 4096).parquet(str(tmp_path / "t"))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    try:
        for limit in ("128m", "8k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
            table = numbered(spark.read.parquet(str(tmp_path / "t")), "n")
            found.append((table.rdd.getNumPartitions(), sorted((r.doc_id, r.n) for r in table.select("doc_id", "n").collect())))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert found[0][0] < found[1][0] and found[0][1] == found[1][1] and len({n for _, n in found[0][1]}) == 5000
    joined = numbered(rows.join(rows.withColumnRenamed("text", "t2"), "doc_id"), "n")
    assert joined.select("doc_id", "n").exceptAll(joined.select("doc_id", "n")).count() == 0 and joined.select("n").distinct().count() == 5000
    clash = numbered(spark.read.parquet(str(tmp_path / "t")).withColumn("_cs_row", F.lit(1)), "n")
    assert clash.columns == ["doc_id", "text", "_cs_row", "n"] and clash.select("n").distinct().count() == 5000


def test_tree_is_searched_by_edges():
    rng = np.random.default_rng(5)
    points = np.unique(rng.integers(0, 1 << 63, 2000, dtype=np.uint64))[:, None]
    visits = []
    simhash.tree_links(points, 4, visits)
    assert sum(visits) < 0.5 * points.shape[0] ** 2


def test_url_rules_as_a_table(spark):
    rules = [("block", f"site{k}.example/a{k}/") for k in range(5000)] + [("allow", "site7.example/a7/deep/"), ("block", "c++.example"), ("block", None)]
    table = url_filter.host_rules(spark.createDataFrame(rules, "verdict string, rule string"))
    urls = [(1, "http://x.site7.example/a7/"), (2, "http://site7.example/a7/deep/er"), (3, "http://site7.example/a8/"), (4, "http://C++.example/z"), (5, "http://cxx.example/z"), (6, "http://c++.examples"), (7, "http://site4999.example/a4999/q"), (8, None)]
    found = {r.page_id: (r.rule, r.verdict) for r in url_filter.judged(spark.createDataFrame(urls, "page_id long, url string"), table).collect()}
    assert found == {1: ("site7.example/a7/", "block"), 2: ("site7.example/a7/deep/", "allow"), 3: (None, "allow"), 4: ("c++.example", "block"), 5: (None, "allow"), 6: (None, "allow"), 7: ("site4999.example/a4999/", "block"), 8: (None, "allow")}
    same = url_filter.judged(spark.createDataFrame(urls, "page_id long, url string"), [url_filter.host_rule(v, r) for v, r in rules if r])
    assert {r.page_id: (r.rule, r.verdict) for r in same.collect()} == found


def test_neighbours_of_extreme_and_tied_vectors(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((60, 8))
    v[1], v[2] = v[0] * 1e-200, v[0] * 1e200
    v[3:30] = v[0] * np.arange(2, 29)[:, None]  # all at cosine 1
    found = neighbours.nearest(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()
    near = {r.rank: (r.vec_id, r.score) for r in found if r.query_id == 0}
    assert all(abs(s - 1) < 1e-12 for _, s in near.values())
    u = v / np.abs(v).max(axis=1, keepdims=True)
    exact = lambda i: float((u[0] * u[i]).sum() / np.sqrt((u[0] * u[0]).sum() * (u[i] * u[i]).sum()))
    assert all(abs(exact(i) - 1) < 1e-12 for i, _ in near.values()) and len(near) == 5
    poor = neighbours.nearest(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.eye(8)[[0, 1, 2]])], "vec_id long, embedding array<double>"), every=1).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in poor) == [(q, k + 1, c, 0.0) for q in range(3) for k, c in enumerate(x for x in range(3) if x != q)]


def test_a_shard_is_scored_in_bounded_memory():
    """All queries of a batch against all vectors of a shard would be 64 MB of cosines here, and gigabytes at size (F1 of round 4)."""
    import tracemalloc

    rng = np.random.default_rng(5)
    n, m = 4000, 2000
    v = rng.standard_normal((n + m, 8))
    whole = lambda x, t=None: pa.array(np.full(x, 0), t)
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, 8 * len(x) + 1, 8), pa.int32()), pa.array(x.ravel()))
    names = ["lsh", "shard", "block", "code", "class", "_vec", "probes"]
    own = pa.RecordBatch.from_arrays([whole(n), whole(n), whole(n), whole(n), pa.array(np.arange(n)), lists(v[:n]), pa.nulls(n, pa.list_(pa.int64()))], names)
    asked = pa.RecordBatch.from_arrays([whole(m), whole(m), whole(m), pa.nulls(m, pa.int64()), pa.array(np.arange(n, n + m)), lists(v[n:]), pa.array([[0]] * m)], names)
    tracemalloc.start()
    got = {}
    for batch in neighbours.score_shards(3)(iter([own, asked])):
        for r in batch.to_pylist():
            got.setdefault(r["query"], []).append(r["class"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert got == {n + j: np.argsort(-(u[:n] @ u[n + j]))[:3].tolist() for j in range(m)}
    assert peak < 40e6


def test_a_hot_shard_is_cut_into_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = rng.standard_normal(8) + 0.01 * rng.standard_normal((600, 8))  # all in a shard or two
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, neighbours.nearest(df).collect()))
    monkeypatch.setattr(neighbours, "BLOCK_NUMBERS", 8 * 50)
    assert sorted(map(tuple, neighbours.nearest(df).collect())) == want and len(want) == 60
    rows = neighbours.blocked(*(spark.createDataFrame(r, neighbours.SHARD_ROW) for r in ([(0, 7, 1, c, [1.0] * 8, None) for c in range(600)], [(0, 7, None, 1, [1.0] * 8, [1]), (0, 8, None, 1, [1.0] * 8, [1])])), spark.createDataFrame([(0, 7)] * 600, "lsh long, shard long"), 8)
    sizes = {r.block: (r.n, r.asked) for r in rows.groupBy("block").agg(F.count("code").alias("n"), F.count_if(F.col("code").isNull()).alias("asked")).collect()}
    assert set(sizes) == set(range(12)) and max(n for n, _ in sizes.values()) < 100 and {a for _, a in sizes.values()} == {1}


def test_probes_come_in_order_of_success():
    import itertools

    rng = np.random.default_rng(0)
    for k, cosine in itertools.product((2, 5, 7), (0.0, 0.4, 0.9)):
        hashes = neighbours.Hashes(16, k, 2, cosine)
        unit = neighbours.units(rng.standard_normal((1, 16)))[0]
        shards, buckets, mass = hashes.probes(unit, 1)
        every = sorted(((sum(c[0] for c in x), sum(c[2] for c in x) & neighbours.WORD, math.prod(c[1] for c in x)) for x in itertools.product(*hashes.chances(unit @ hashes.a[1], 1))), reverse=True)
        reached = np.cumsum([math.exp(x[0]) for x in every])
        n = int(np.searchsorted(reached, 1 - (1 - neighbours.SUCCESS) ** 0.5)) + 1
        assert len(buckets) == len(set(buckets)) == min(n, len(every)) and abs(mass - sum(x[2] for x in every[:n])) < 1e-6
        assert buckets[0] == every[0][1]


@pytest.mark.parametrize("size", [20_000, 2_000_000])
def test_tokens_of_long_white_space(spark, size):
    texts = [" " * size, "a" + "\n" * size + "b", "\t" * size + " x", "x" * size]
    found = token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).groupBy("doc_id").agg(F.max("end").alias("end"), F.sum("n_tokens").alias("n"), F.first("doc_tokens").alias("d")).collect()
    assert {r.doc_id: r.end for r in found} == {i: len(t) for i, t in enumerate(texts)} and all(r.n == r.d > 0 for r in found)
    raw = spark.createDataFrame([(1, bytearray(b"ab \xff\xfe cd\nx"))], "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"))
    bad = token_counts.token_counts(raw).orderBy("section").collect()
    assert [(r.begin, r.end) for r in bad] == [(0, 13), (13, 14)] and sum(r.n_tokens for r in bad) == bad[0].doc_tokens


def test_recall_of_seeds_on_edited_items():
    # Every text and item that full alignment finds, at several rates of substitution, deletion, insertion and moved halves.
    rng = np.random.default_rng(12)
    items, texts = [rng.integers(0, 400, rng.integers(2, 40)).astype(np.uint64) for _ in range(30)], []
    for item in items:
        for rate in (0.1, 0.25, 0.4):
            for kind in range(4):
                w = item.tolist()
                hit = rng.random(len(w)) < rate
                w = [[x for x, h in zip(w, hit) if not h], [999 if h else x for x, h in zip(w, hit)], [y for x, h in zip(w, hit) for y in ([x, 998] if h else [x])], w[len(w) // 2 :] + w[: len(w) // 2]][kind]
                texts.append(np.concatenate([rng.integers(0, 400, 30), np.array(w, dtype=np.int64), rng.integers(0, 400, 30)]).astype(np.uint64))
    held = decontamination.Items.of(list(range(30)), items, 0.6)
    chunk = next(tokens.chunks(__import__("pyarrow").array([" ".join(f"w{x}" for x in t) for t in texts])))
    named = lambda a: decontamination.plain_words(next(tokens.chunks(__import__("pyarrow").array([" ".join(f"w{x}" for x in a)]))))[0]
    held = decontamination.Items.of(list(range(30)), [named(i) for i in items], 0.6)
    found = {(d, i): s for d, i, s, _, _ in decontamination.matches(chunk, held, 0.6)}
    want = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            share = decontamination.align(t, item)[0] / (2 * item.size)
            if share >= 0.6 and item.size >= decontamination.LEAST_WORDS:
                want[d, i] = share
    assert found == want and len(want) > 150
