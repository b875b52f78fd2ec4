"""Whitening, the filter audit and MinHash near-dedup beyond their queries: parts, options, empty and awkward tables."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codesift.llm import bottomk, filter_audit, minhash, whitening

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize(("dim", "n", "parts", "batch"), [(1, 5, 2, 2), (3, 2, 2, 1), (8, 300, 5, 60), (8, 300, 5, 7), (24, 10, 3, 4), (40, 900, 3, 100)])
def test_spectrum(dim, n, parts, batch):
    """Spectra of parts, updated batch by batch and combined, are the spectrum of all."""
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, dim)) * np.exp(2 * rng.standard_normal(dim)) + 100 * rng.standard_normal(dim)
    if dim == 8:
        x[:, 3], x[:, 5] = x[:, 2], 7.0  # equal and constant columns: deflation
    x = np.concatenate([x, x[: n // 2]])
    total = whitening.Spectrum.empty(dim)
    for part in np.array_split(x, parts):
        one = whitening.Spectrum.empty(dim)
        for k in range(0, len(part), batch):
            one.add(part[k : k + batch])
        total.combine(one)
    off = x - x.mean(axis=0)
    scatter = off.T @ off
    size = np.abs(scatter).max()
    assert total.n == len(x) and np.allclose(total.mean, x.mean(axis=0), rtol=1e-12)
    assert np.abs(total.values - np.linalg.eigvalsh(scatter)).max() < 1e-11 * size
    assert np.abs(total.vectors.T @ total.vectors - np.eye(dim)).max() < 1e-11
    assert np.abs(total.vectors @ np.diag(total.values) @ total.vectors.T - scatter).max() < 1e-11 * size


def test_secular_close_poles():
    """Roots stay between their poles, however close those are and however small the update's entries."""
    d = np.array([1.0, 1.0 + 1e-9, 1.0 + 2e-9, 5.0, 5.0 + 1e-6, 1e6])
    z2 = np.array([1e-12, 1.0, 1e-20, 3.0, 1e-4, 1e-8])
    pole, x = whitening.secular(d, z2)
    roots = d[pole] + x
    assert (roots[:-1] <= d[1:]).all() and (roots >= d).all() and roots[-1] <= d[-1] + z2.sum() + 1e-3
    assert np.isclose(roots.sum(), d.sum() + z2.sum())


def test_whitening_awkward(spark):
    ok = [[1.0, 2.0, 0.5], [0.0, -1.0, 2.0], [3.0, 0.25, 0.125], [0.0, -1.0, 2.0]]
    rows = [(i, v, "x") for i, v in enumerate(ok)] + [(None, [9.0, 9.0, 9.0], "x"), (7, None, "x"), (8, [], "x"), (9, [1.0, None, 2.0], "x"), (10, [1.0, float("inf"), 0.0], "x"), (11, [float("nan"), 0.0, 0.0], "x"), (12, [1.0, 2.0], "x"), (13, [1e30, 0.0, 0.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string").repartition(5)
    found = whitening.whitening(df).collect()
    assert sorted({r.vec_id for r in found if r.vec_id is not None}) == [0, 1, 2, 3] and len(found) == 15
    w = np.zeros((5, 3))
    for r in found:
        w[4 if r.vec_id is None else r.vec_id, r.component - 1] = r.whitened
    assert np.abs(w.T @ w / 5 - np.eye(3)).max() < 1e-12 and found[0].identity_error < 1e-12
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whitening(one).count() == 0 and whitening.whitening(one.limit(0)).count() == 0 and whitening.whitening(df.where("vec_id = 7")).count() == 0
    big = spark.createDataFrame([(1, [1e11, 0.0]), (2, [-1e11, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whitening(big).where("vec_id < 3").collect()} == {None}


def test_whitening_many_parts(spark):
    """More parts than one level of the combination takes."""
    x = np.random.default_rng(1).standard_normal((400, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(80)
    found = whitening.fitted(whitening.taking_part(df, "vec_id", "embedding"))
    whole = np.floor(64 * x) + 1_000_000
    assert found.n == 400 and found.sums == whole.sum(axis=0).astype(int).tolist()
    assert np.allclose(found.values, np.linalg.eigvalsh(np.cov(whole.T, bias=True))[::-1], rtol=1e-12)


def test_packed_counts():
    """Fields never carry, however large the counts."""
    names = "ABC"
    total = sum(filter_audit.outcomes(names, mask, mask % 2 == 0, mask % 3 == 0) * (2**60 + mask) for mask in range(4))
    counts = filter_audit.unpack(names, filter_audit.packed(names, total))
    assert (counts[:, :, :3].sum(axis=2) <= 4 * 2**60 + 6).all() and counts[0, 0, 0] == 2 * 2**60 + 2 and counts[0, 0, 1] == 2 * 2**60 + 4


def test_filter_audit_options(spark):
    docs = spark.createDataFrame([(1, "a a", "x"), (2, "a a", None), (3, "b", ""), (None, "a a", "x"), (2, "a a", "x"), (4, None, "x"), (5, "", "x")], DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1)], LABELS)
    found = filter_audit.filter_audit(docs, labels, {"S": F.length("text") < 2, "N": F.lit(None).cast("boolean")}, copies="C")
    rows = {(r.part, r.filter_order, r.step): r for r in found.collect()}
    assert len(rows) == 2 * 6 * 3
    # part x: 1 "a a" first, null id no copy, 2 copy, 4 null = empty text, 5 its copy and short.
    r = rows["x", "CNS", 1]
    assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) == (3, 2, 0, 1, 1, 1)
    r = rows["x", "CNS", 3]
    assert (r.kept, r.removed, r.redundant, r.unique_fails) == (3, 0, 1, 0) and rows["x", "SNC", 1].removed == 1
    assert rows["x", "SNC", 3].shapley == 3 * 1 + 3 * 2 and rows["", "CNS", 1].removed == 1
    assert filter_audit.filter_audit(docs.limit(0), labels).count() == 0
    with pytest.raises(ValueError):
        filter_audit.filter_audit(docs, labels, {"E": F.lit(True)})


def test_filter_audit_hot_copies(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("x").alias("lang")).repartition(70)
    found = {(r.filter_order, r.step): r for r in filter_audit.filter_audit(docs, spark.createDataFrame([], LABELS)).collect()}
    assert found["EABCD", 1].removed == 4999 and found["EABCD", 2].removed == 1 and found["AEBCD", 2].redundant == 4999


def shingled(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def groups(sets, percent=85):
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    return label


@pytest.mark.parametrize("block", [4000, 7])
def test_minhash(spark, monkeypatch, block):
    """Chains, groups around a base that comes last, texts near the threshold, shared passages, long and short texts, in lists cut into blocks."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 1_000_000 if block > 7 else 0)
    rng = random.Random(block)
    text = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = []
    for size in (6, 30, 90, 300, 1500):
        base = text(size)
        for edits in (1, 1, 2, 3, 5, 8, 12):
            copy = list(base)
            for _ in range(max(1, edits * size // 500)):
                copy[rng.randrange(size)] = f"e{rng.random()}"
            texts.append(copy)
        texts.append(base)
    step = text(400)
    for k in range(12):  # a chain: neighbours are similar, ends are not
        step = [*step[20:], *text(20)] if k % 3 else [*step[9:], *text(9)]
        texts.append(step)
    passage = text(120)
    texts += [[*passage, *text(rng.randrange(5, 60))] for _ in range(25)] + [[*text(20), *passage, *text(5)] for _ in range(10)]
    rows = [" ".join(t) for t in texts] + [" ".join(texts[3]).upper(), "\t" + "\n".join(texts[3]), "one two", "ONE  two", "one", "", None, " \n"]
    order = list(range(len(rows)))
    rng.shuffle(order)
    df = spark.createDataFrame([(1000 - i, rows[k], "x", "clash") for i, k in enumerate(order)], DOCS + ", sketch string").repartition(3)
    sets = [shingled(rows[k]) for k in order]
    label = groups(sets)
    least = {x: min(1000 - i for i, y in enumerate(label) if y == x) for x in set(label)}
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.minhash_groups(df).collect()}
    assert found == {1000 - i: (len(s), least[x], least[x] == 1000 - i) for i, (s, x) in enumerate(zip(sets, label))}
    assert 5 < len(set(label)) < len(rows) - 20
    kept = minhash.minhash_dedup(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(least.values())


def test_estimates():
    """Whole sets are settled, what is shown is true, and no similar pair is below its bound."""
    rng = np.random.default_rng(3)
    bound = bottomk.least_matches(minhash.SKETCH, 85)
    assert 75 <= bound <= 100 and bottomk.least_matches(4, 85) == 0
    for size in (40, 400, 4000):
        for _ in range(200):
            union = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            which = rng.random(union.size)
            a, b = union[which > 0.07], union[which < 0.93]
            holds = 100 * int(((which > 0.07) & (which < 0.93)).sum()) >= 85 * union.size
            for cut in (lambda x: x[:128], bottomk.high_halves):
                may, shown = bottomk.similar(cut(a), cut(b), a.size, b.size, 85)
                assert may or not holds
                assert holds or not shown
                assert cut(a).size < a.size or cut(b).size < b.size or may == holds


def test_minhash_empty(spark):
    assert minhash.minhash_groups(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "a b c d e f g", "x"), (None, "a b c d e f g", "x"), (3, None, "x")]
    assert sorted(map(str, (tuple(r)[:4] for r in minhash.minhash_groups(spark.createDataFrame(rows, DOCS)).collect()))) == ["(3, 0, 3, True)", "(None, 3, None, True)", "(None, 3, None, True)"]


def test_toxicity_scores_in_small_chunks():
    """A worker's arrays grow with the chunk, beside the model (pipeline, check of round 3: over 3000 MB in this stage)."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from codesift.llm import tokens, toxicity

    names = ("ordinary", "toxic", "words", "ordinary_next", "toxic_next", "words_next")
    model = toxicity.Model({"ord": np.zeros(0, np.int64), "context": np.zeros(0, np.int64)} | {n: np.zeros(0, np.float32) for n in names})
    texts = pa.array([" ".join(f"w{(i * 7919 + j) % 99991}" for j in range(400)) for i in range(800)])

    def scored(*limit: int) -> tuple[np.ndarray, int]:
        tracemalloc.start()
        found = np.concatenate([model.features(x) for x in tokens.chunks(texts, *limit)])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return found, peak

    small, low = scored(toxicity.CHUNK_BYTES)
    usual, high = scored()
    assert np.array_equal(small, usual) and low < high / 2
