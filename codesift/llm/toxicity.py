"""Toxicity (operator 8): class-conditional Kneser-Ney models of the letters of words.

For either class the letter after a context of up to ``ORDER`` bytes of the
same word is predicted from that class's counts, discounted; what the discount
frees goes to one backoff model that both classes share.  Its counts are of
distinct words, not of occurrences, as in Kneser and Ney's continuation
counts, so an expression that a class has not seen costs both classes alike.
A word's evidence is the difference of its two log-likelihoods; a text's, the
clear evidence of its words divided by their number.  A logistic curve, fitted
on a sample of training rows by a model that did not count them, turns this
into a score.

The counts that score cover all training rows, the sample too, and grow with
them until they are hashed into tables of fixed size, which bound the model
that goes to the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.llm import tokens
from codesift.llm.tables import columns, small_batches, written

U64 = np.uint64
ORDER = 5
CONTEXTS, GRAMS = 1 << 19, 1 << 20
DISCOUNT = 0.75
#: Evidence of a word, in nats, below which it is noise.
CLEAR = 2.0
#: Bytes of a word; a longer one, as in a text without spaces, is read as pieces that overlap by ``ORDER``.
LETTERS = 64
#: Bytes of text that a task counts or scores at a time: a quarter of the usual, as a model lies in memory too.
CHUNK_BYTES = 512 << 10
#: Of a text, for the curve.
FEATURES = 4
#: Distinct words a task holds before it passes their counts on.
FLUSH = 500_000
#: Labels up to this many rows (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
#: Training rows the curve is fitted on, the first by a hash of their id.
CURVE_ROWS = 20_000
#: Counts of a word, and of a gram: of all training rows, and of those outside the curve's sample.
CLASSES = ("ordinary", "toxic", "fit_ordinary", "fit_toxic")
COUNTS = ("ordinary", "toxic", "words", "fit_ordinary", "fit_toxic", "fit_words")


def trimmed(chunk: tokens.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of a chunk, its words' begins and ends without ASCII punctuation around them, and their bounds by text.

    Words of more than ``LETTERS`` bytes come as consecutive pieces.
    """
    chunk.words()
    low = chunk.lowered()
    mark = np.zeros(256, dtype=bool)
    mark[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
    begin, end = chunk.start.copy(), chunk.end.copy()
    for _ in range(2):
        end -= (end - begin > 1) & mark[low[end - 1]]
        begin += (end - begin > 1) & mark[low[begin]]
    step = LETTERS - ORDER
    times = np.maximum(-(-(end - begin - ORDER) // step), 1)
    before = np.concatenate([[0], np.cumsum(times)])
    piece = np.repeat(begin, times) + (np.arange(before[-1]) - np.repeat(before[:-1], times)) * step
    return low, piece, np.minimum(piece + LETTERS, np.repeat(end, times)), before[chunk.word_bounds]


def distinct(low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first occurrence of each word, and which of them each word is."""
    name = tokens.names(low, begin, end, tokens.BASES[0])
    _, first, which = np.unique(name, return_index=True, return_inverse=True)
    return first, which


def letters(low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with a byte 1 before and 2 after, end to end: bytes, the word of each byte, each word's first byte."""
    size = end - begin + 2
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(size.size), size)
    offset = np.arange(word.size) - first[word]
    flat = low[np.minimum(begin[word] + np.maximum(offset - 1, 0), max(low.size - 1, 0))] if word.size else np.zeros(0, np.uint8)
    flat[offset == 0] = 1
    flat[offset == size[word] - 1] = 2
    return flat, word, first


def contexts(flat: np.ndarray, word: np.ndarray, first: np.ndarray, order: int, rolling: tokens.Rolling, at: np.ndarray) -> np.ndarray:
    """The hashed context, of at most ``order`` bytes of the same word, of each place in ``at``."""
    return (rolling.ranges(np.maximum(at - order, first[word[at]]), at) % U64(CONTEXTS)).astype(np.int64)


def gram_bucket(order: np.ndarray | int, context: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return (tokens.mix((context * 256 + byte + (order + 1 << 40)).astype(U64)) % U64(GRAMS)).astype(np.int64)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, and by class its occurrences in all rows and (``fit_``) in those outside the curve's sample: each word once per task or flush."""
    held: dict[bytes, list[int]] = {}

    def flushed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), *(pa.array([v[i] for v in held.values()], pa.int64()) for i in range(4))], names=["word", *CLASSES])
        held.clear()
        return out

    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        fit = 1 - batch.column("curve").to_numpy(zero_copy_only=False).astype(np.int64)
        for chunk in tokens.chunks(batch.column("_text"), CHUNK_BYTES):
            low, begin, end, bounds = trimmed(chunk)
            if not begin.size:
                continue
            first, which = distinct(low, begin, end)
            rows, times = slice(chunk.first, chunk.first + chunk.n), np.diff(bounds)
            good, bad = (1 - toxic[rows], toxic[rows])
            sums = [np.bincount(which, np.repeat(v, times), first.size).astype(np.int64).tolist() for v in (good, bad, good * fit[rows], bad * fit[rows])]
            raw = low.tobytes()
            for a, b, *found in zip(begin[first].tolist(), end[first].tolist(), *sums, strict=True):
                have = held.setdefault(raw[a:b], [0, 0, 0, 0])
                for i, v in enumerate(found):
                    have[i] += v
            if len(held) > FLUSH:
                yield flushed()
    if held:
        yield flushed()


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ord, context, byte and their counts: occurrences by class, and words, in all and (``fit_``) outside the sample.  The input's words are distinct."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = tokens.binary(batch.column("word"))
        good, bad, fit_good, fit_bad = (batch.column(n).to_numpy() for n in CLASSES)
        for chunk in tokens.chunks(column):
            flat, word, first = letters(chunk.buf, chunk.bounds[:-1], chunk.bounds[1:])
            at = np.flatnonzero(np.diff(word, prepend=-1) == 0)
            rolling, byte = tokens.Rolling(flat, tokens.BASES[1]), flat[at].astype(np.int64)
            for order in range(ORDER + 1):
                key = contexts(flat, word, first, order, rolling, at) * 256 + byte
                gram, which = np.unique(key, return_inverse=True)
                owner = word[at] + chunk.first
                sums = [np.bincount(which, v, gram.size).astype(np.int64) for v in (good[owner], bad[owner], np.ones(owner.size), fit_good[owner], fit_bad[owner], (fit_good + fit_bad > 0)[owner])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(gram.size, order)), pa.array(gram // 256), pa.array(gram % 256), pa.array(gram_bucket(order, gram // 256, gram % 256)), *map(pa.array, sums)], names=["ord", "context", "byte", "bucket", *COUNTS])


class Model:
    """Counts in tables of fixed size; row 0 of the class tables is ordinary, row 1 toxic."""

    def __init__(self, by_context: dict[str, np.ndarray]):
        """by_context: ord, context, and for each of ordinary, toxic, words: the sum and ``_next``, the distinct next bytes."""
        self.total = np.zeros((2, CONTEXTS), dtype=np.float32)
        self.following = np.zeros((2, CONTEXTS), dtype=np.float32)
        self.gram = np.zeros((2, GRAMS), dtype=np.float32)
        top = by_context["ord"] == ORDER
        for c, name in enumerate(("ordinary", "toxic")):
            self.total[c, by_context["context"][top]] = by_context[name][top]
            self.following[c, by_context["context"][top]] = by_context[f"{name}_next"][top]
        self.shared_total = np.zeros((ORDER, CONTEXTS), dtype=np.float32)
        self.shared_next = np.zeros((ORDER, CONTEXTS), dtype=np.float32)
        self.shared_gram = np.zeros(GRAMS, dtype=np.float32)
        low = ~top
        self.shared_total[by_context["ord"][low], by_context["context"][low]] = by_context["words"][low]
        self.shared_next[by_context["ord"][low], by_context["context"][low]] = by_context["words_next"][low]
        self.curve = np.array([-2.0, 1.0, 1.0, -0.5, 1.0])

    def add_grams(self, by_gram: dict[str, np.ndarray]) -> None:
        """by_gram: ord, bucket and the sums."""
        own = by_gram["ord"] == ORDER
        for c, name in enumerate(("ordinary", "toxic")):
            self.gram[c, by_gram["bucket"][own]] = by_gram[name][own]
        np.add.at(self.shared_gram, by_gram["bucket"][~own], by_gram["words"][~own])

    def evidence(self, low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Toxic minus ordinary log-probability of each word."""
        flat, word, first = letters(low, begin, end)
        at = np.flatnonzero(np.diff(word, prepend=-1) == 0)
        rolling, byte = tokens.Rolling(flat, tokens.BASES[1]), flat[at].astype(np.int64)
        d = np.float32(DISCOUNT)

        def step(count, total, following, lower):
            seen = np.minimum(count, total)  # buckets may be shared
            return np.where(total > 0, (np.maximum(seen - d, 0) + d * following * lower) / np.maximum(total, 1), lower)

        shared = np.full(at.size, 1 / 256, dtype=np.float32)
        for order in range(ORDER):
            context = contexts(flat, word, first, order, rolling, at)
            shared = step(self.shared_gram[gram_bucket(order, context, byte)], self.shared_total[order][context], self.shared_next[order][context], shared)
        context = contexts(flat, word, first, ORDER, rolling, at)
        bucket = gram_bucket(ORDER, context, byte)
        good, bad = (np.log(np.maximum(step(self.gram[c][bucket], self.total[c][context], self.following[c][context], shared), 1e-12)) for c in (0, 1))
        return np.bincount(word[at], bad - good, begin.size)

    def features(self, chunk: tokens.Chunk) -> np.ndarray:
        """Per text: clear evidence per distinct word, its logarithm in all, that of the number of words, and the
        difference of the two log-likelihoods of the whole text per word.

        Evidence is clear beyond ``CLEAR``, and a word that a text repeats counts
        once for it; the difference takes every word as often as it stands there.
        """
        low, begin, end, bounds = trimmed(chunk)
        n = np.diff(bounds)
        if not begin.size:
            return np.zeros((chunk.n, FEATURES))
        first, which = distinct(low, begin, end)
        evidence = self.evidence(low, begin[first], end[first])
        clear = np.maximum(evidence - CLEAR, 0)
        pair = np.unique(tokens.spread(bounds) * first.size + which)
        doc = pair // first.size
        total = np.bincount(doc, clear[pair % first.size], chunk.n)
        mean = np.bincount(tokens.spread(bounds), evidence[which], chunk.n) / np.maximum(n, 1)
        return np.stack([total / np.maximum(np.bincount(doc, minlength=chunk.n), 1), np.log1p(total), np.log1p(n), mean], axis=1)

    def fit(self, features: np.ndarray, toxic: np.ndarray) -> None:
        """Newton steps of a ridge logistic regression, halved until the loss falls; with one class only, the default curve stays."""
        if not 0 < toxic.sum() < len(toxic):
            return
        x = np.column_stack([np.ones(len(features)), features])
        w, ridge = np.zeros(x.shape[1]), np.array([1e-3] + [1e-2] * features.shape[1])

        def loss(w: np.ndarray) -> float:
            z = x @ w
            return float((np.logaddexp(0, z) - toxic * z).sum() + 0.5 * (ridge * w * w).sum())

        now = loss(w)
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            slope = x.T @ (toxic - p) - ridge * w
            step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge), slope)
            while (then := loss(w + step)) > now and np.abs(step).max() > 1e-9:
                step /= 2
            w, before, now = w + step, now, then
            if before - now < 1e-9 * max(now, 1.0):
                break
        self.curve = w

    def score(self, features: np.ndarray) -> np.ndarray:
        return on_curve(self.curve, features)


def on_curve(curve: np.ndarray, features: np.ndarray) -> np.ndarray:
    x = np.column_stack([np.ones(len(features)), features])
    return 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))


def remainder(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5, F.lit(0))


def _columns(df: DataFrame) -> dict[str, np.ndarray]:
    table = df.toArrow()
    return {n: table.column(n).to_numpy() for n in table.column_names}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[Broadcast, np.ndarray]:
    """The model, broadcast, and its curve.

    Fits the curve on a sample of the labelled rows whose remainder is 4, with counts of all others of 1 to 4;
    then counts the sample too for the model that scores.  0 is held out.

    Of several labels of an id the largest counts; null labels, null ids and ids without a text are not used.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).dropna().groupBy("_id").agg(F.max("toxic").alias("toxic"))
    if labels.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    rows = columns(docs, id_col, text_col).where("_id is not null").withColumn("part", remainder(F.col("_id"))).where("part > 0").join(known, "_id")
    share = CURVE_ROWS / max(rows.where("part = 4").select("_id").count(), CURVE_ROWS)
    rows = rows.withColumn("curve", (F.col("part") == 4) & (F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * share)))
    words = rows.select("_text", "toxic", "curve").mapInArrow(count_words, "word binary, " + ", ".join(f"{c} long" for c in CLASSES)).groupBy("word").agg(*(F.sum(c).alias(c) for c in CLASSES))
    grams = words.mapInArrow(count_grams, "ord long, context long, byte long, bucket long, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("ord", "context", "byte", "bucket").agg(*(F.sum(c).alias(c) for c in COUNTS))
    grams = written(grams, "grams")

    def counted(prefix: str) -> Model:
        counts = {c: F.col(prefix + c) for c in ("ordinary", "toxic", "words")}
        seen = grams.where(counts["words"] > 0)
        by_context = seen.groupBy("ord", "context").agg(*(F.sum(c).cast("float").alias(n) for n, c in counts.items()), *(F.count_if(c > 0).cast("float").alias(f"{n}_next") for n, c in counts.items()))
        by_gram = seen.groupBy("ord", "bucket").agg(*(F.sum(c).cast("float").alias(n) for n, c in counts.items()))
        model = Model(_columns(by_context.withColumns({"ord": F.col("ord").cast("byte"), "context": F.col("context").cast("int")})))
        model.add_grams(_columns(by_gram.withColumns({"ord": F.col("ord").cast("byte"), "bucket": F.col("bucket").cast("int")})))
        return model

    model = counted("fit_")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in tokens.chunks(batch.column("_text"), CHUNK_BYTES):
                found = held.value.features(chunk)
                yield pa.RecordBatch.from_arrays([*map(pa.array, np.ascontiguousarray(found.T)), batch.column("toxic").slice(chunk.first, chunk.n)], names=[*"abcd", "toxic"])

    sample = _columns(rows.where("curve").select("_text", "toxic").mapInArrow(features, "a double, b double, c double, d double, toxic int").orderBy(*"abcd", "toxic"))
    model.fit(np.stack([sample[n] for n in "abcd"], axis=1), sample["toxic"].astype(np.float64))
    curve = model.curve
    held.destroy()
    del model
    return docs.sparkSession.sparkContext.broadcast(counted("")), curve


def scorer(held: Broadcast, curve: np.ndarray):
    """A trained model as a column function: text to score, 0 to 1.  Null and empty texts get the score of no evidence."""

    @F.arrow_udf("double")
    def toxicity(text: pa.Array) -> pa.Array:
        parts = [on_curve(curve, held.value.features(chunk)) for chunk in tokens.chunks(text, CHUNK_BYTES)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return toxicity


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.5) of every row.

    Learns only from labelled rows whose remainder is not 0; ``labels`` and any
    other columns are never inputs of a score.  Null and empty texts get a score,
    repeated rows each get theirs, a null id counts as held out, an empty table
    gives an empty result.  Without labels of both classes all texts without
    evidence score alike, below 0.5.
    """
    toxicity = scorer(*train(docs, labels, id_col, text_col))
    return (
        docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), toxicity(F.col(f"`{text_col}`")).alias("score"))
        .select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    )
