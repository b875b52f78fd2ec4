"""Benchmark decontamination (operator 2): n-gram seeds, then Smith-Waterman alignment.

Seeds join passages of documents to items; only there words are aligned.  A
local alignment of m equal words in r unbroken runs scores at most 2m - (r - 1),
and m is at most the item's n words.  So a score of the share t of the item's
own 2n holds at least (2t - 1)n - 1 pairs of neighbouring words of the item:
word pairs are the seeds, and a passage is aligned only if so many of them lie
within the gaps that the score allows.  Nothing that full alignment finds is
lost.  Items of few words have single words for seeds.

Items go to the executors in blocks of bounded size, one pass over the
documents for each; the documents are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.llm import tokens
from codesift.llm.tables import columns

U64 = np.uint64
#: Items of fewer words match nothing: one word is no evidence of a leak.
LEAST_WORDS = 2
#: Smith-Waterman weights of equal words, different words and gaps.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of items in a block: about 50 MB on each executor.
BLOCK_WORDS = 1_000_000
#: A share of the item's own score from which a document counts as contaminated.
THRESHOLD = 0.6

PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def plain_words(chunk: tokens.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of lower-cased words without ASCII punctuation around them, their bounds by text, and their place among all words.

    Words of punctuation alone are left out.
    """
    chunk.words()
    low = chunk.lowered()
    begin, end = chunk.start.copy(), chunk.end.copy()
    for _ in range(4):
        end -= (end - begin > 1) & PUNCTUATION[low[end - 1]]
        begin += (end - begin > 1) & PUNCTUATION[low[begin]]
    real = ~((end - begin == 1) & PUNCTUATION[low[begin]]) if begin.size else np.zeros(0, dtype=bool)
    before = np.concatenate([[0], np.cumsum(real)])
    place = np.flatnonzero(real)
    hashes = tokens.names(low, begin[real], end[real], tokens.BASES[0])
    return hashes, before[chunk.word_bounds], place - np.repeat(chunk.word_bounds[:-1], np.diff(before[chunk.word_bounds]))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    return tokens.Rolling(hashes, tokens.WORD_BASES[0]).windows(n) + U64(n)


class Lookup:
    """Membership of many hashes in a sorted array: a bitmap first, a search for those that pass."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bitmap = np.zeros(1 << 22, dtype=bool)
        self.bitmap[(keys & U64((1 << 22) - 1)).astype(np.int64)] = True

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a hash is a key, and which."""
        at = np.flatnonzero(self.bitmap[(hashes & U64((1 << 22) - 1)).astype(np.int64)])
        which = np.searchsorted(self.keys, hashes[at])
        real = self.keys[np.minimum(which, self.keys.size - 1)] == hashes[at]
        return at[real], which[real]


def slack(n: int, threshold: float) -> int:
    """Gaps that an alignment of the threshold's score can hold."""
    return int(MATCH * n * (1 - threshold) / -GAP + 1e-9)


def seed_words(n: int, threshold: float) -> tuple[int, int]:
    """Words of a seed of an item of n words, and how many seeds an alignment of the threshold's score holds at least."""
    pairs = math.ceil((2 * threshold - 1) * n - 1 - 1e-9)
    return (2, pairs) if pairs >= 1 else (1, max(1, math.ceil(threshold * n - 1e-9)))


@dataclass
class Items:
    """A block of test items: ids, words, least seeds and slack of each, and their seeds as (key, item, offset) sorted by key."""

    ids: list[int | None]
    words: list[np.ndarray]
    least: np.ndarray
    slack: np.ndarray
    lookups: dict[int, Lookup]
    owners: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def of(ids: list[int | None], words: list[np.ndarray], threshold: float) -> Items:
        rows: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        least = np.ones(len(words), dtype=np.int64)
        for i, w in enumerate(words):
            if w.size >= LEAST_WORDS:
                n, least[i] = seed_words(w.size, threshold)
                own = grams(w, n)
                rows.setdefault(n, []).append((own, np.full(own.size, i), np.arange(own.size)))
        items = Items(ids, words, least, np.array([slack(w.size, threshold) for w in words], dtype=np.int64), {}, {})
        for n, found in rows.items():
            key, item, offset = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((offset, item, key))
            keys, first = np.unique(key[order], return_index=True)
            items.lookups[n], items.owners[n] = Lookup(keys), (np.append(first, key.size), item[order], offset[order])
        return items


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: the best local score and where it ends in a and b (exclusive)."""
    ramp = np.arange(a.size + 1) * -GAP
    row = np.zeros(a.size + 1, dtype=np.int64)
    best = (0, 0, 0)
    for j in range(b.size):
        fresh = np.zeros(a.size + 1, dtype=np.int64)
        fresh[1:] = np.maximum(np.maximum(row[:-1] + np.where(a == b[j], MATCH, MISMATCH), row[1:] + GAP), 0)
        row = np.maximum.accumulate(fresh + ramp) - ramp  # gaps in b's direction
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (int(row[k]), k, j + 1)
    return best


def best_alignment(text: np.ndarray, item: np.ndarray, diagonals: np.ndarray, threshold: float) -> tuple[float, int, int]:
    """Share of the item's own score, and the aligned words of the text, over the stretches that seeds point to.

    Stretches that cannot reach ``threshold`` are left out.
    """
    wide = slack(item.size, threshold)
    span, least = item.size + wide, threshold * item.size - 1e-9  # equal words that the score needs
    own = np.unique(item)
    found = (0.0, 0, 0)
    diagonals = np.unique(diagonals)
    for group in np.split(diagonals, np.flatnonzero(np.diff(diagonals) > wide) + 1):
        for d in group.tolist():
            if d >= 0 and np.array_equal(text[d : d + item.size], item):
                return 1.0, d, d + item.size
        lo = max(0, int(group[0]) - wide)
        part = text[lo : int(group[-1]) + item.size + wide]
        common = np.concatenate([[0], np.cumsum(own[np.minimum(np.searchsorted(own, part), own.size - 1)] == part)])
        if (common[min(span, part.size) :] - common[: max(1, common.size - span)]).max() < least:
            continue
        score, end, item_end = align(part, item)
        share = score / (MATCH * item.size)
        if share > found[0]:
            _, back, _ = align(part[:end][::-1], item[:item_end][::-1])
            found = (share, lo + end - back, lo + end)
    return found


def matches(chunk: tokens.Chunk, items: Items, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
    """text, item, score, and the words of the text from and to, of every text and item that reach the threshold."""
    hashes, bounds, place = plain_words(chunk)
    hits: list[np.ndarray] = []
    for n, lookup in items.lookups.items():
        if hashes.size < n:
            continue
        at, which = lookup.places(grams(hashes, n))
        doc = np.searchsorted(bounds, at, side="right") - 1
        inside = at + n <= bounds[doc + 1]
        at, which, doc = at[inside], which[inside], doc[inside]
        first, item, offset = items.owners[n]
        times = first[which + 1] - first[which]
        row = np.repeat(first[which], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        hits.append(np.stack([np.repeat(doc, times), item[row], np.repeat(at - bounds[doc], times) - offset[row]]))
    if not hits:
        return
    doc, item, diagonal = np.concatenate(hits, axis=1)
    order = np.lexsort((diagonal, item, doc))
    doc, item, diagonal = doc[order], item[order], diagonal[order]
    # Only runs of enough seeds within the slack of each other can belong to an alignment.
    last = np.arange(doc.size) + items.least[item] - 1
    end = np.minimum(last, doc.size - 1)
    whole = (last < doc.size) & (doc[end] == doc) & (item[end] == item) & (diagonal[end] - diagonal <= items.slack[item])
    cover = np.zeros(doc.size + 1, dtype=np.int64)
    np.add.at(cover, np.flatnonzero(whole), 1)
    np.add.at(cover, last[whole] + 1, -1)
    some = np.cumsum(cover[:-1]) > 0
    doc, item, diagonal = doc[some], item[some], diagonal[some]
    edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]), [True]])) if doc.size else []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        d, i = int(doc[a]), int(item[a])
        text = hashes[bounds[d] : bounds[d + 1]]
        share, begin, end = best_alignment(text, items.words[i], diagonal[a:b], threshold)
        if share >= threshold:
            own = place[bounds[d] : bounds[d + 1]]
            yield d, i, share, int(own[begin]), int(own[end - 1]) + 1


def item_blocks(docs: DataFrame, benchmark: DataFrame, threshold: float, item_col: str, text_col: str) -> Iterator[Broadcast]:
    """Blocks of items with their seeds, each broadcast.  The driver holds one block at a time."""
    spark = docs.sparkSession
    ids: list = []
    words: list = []

    def block() -> Broadcast:
        items = Items.of(list(ids), list(words), threshold)
        ids.clear()
        words.clear()
        return spark.sparkContext.broadcast(items)

    chosen = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    for row in chosen.orderBy("_id", "_text").toLocalIterator():
        chunk = next(tokens.chunks(pa.array([row._text], pa.string())))
        ids.append(row._id)
        words.append(plain_words(chunk)[0])
        if sum(w.size for w in words) >= BLOCK_WORDS:
            yield block()
    if ids:
        yield block()


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, score, begin and end (words of the text, end exclusive) of every document and item that align.

    score: the Smith-Waterman score over that of the item with itself, 0 to 1;
    rows reach ``threshold``.  Words are lower-cased (A-Z) and stripped of ASCII
    punctuation.  Of several places of an item in a text the best counts, the
    first among equals.  Null, empty and blank texts or items match nothing, nor
    do items of a single word (``LEAST_WORDS``);
    repeated rows of either table repeat the result; null ids are passed on; an
    empty table gives an empty result; other columns are not read.
    """
    rows = columns(docs, id_col, text_col)
    found = None
    for held in item_blocks(rows, benchmark, threshold, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], held: Broadcast = held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("_id").to_pylist()
                for chunk in tokens.chunks(batch.column("_text")):
                    out = [(ids[chunk.first + d], held.value.ids[i], s, a, b) for d, i, s, a, b in matches(chunk, held.value, threshold)]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "score", "begin", "end"])

        part = rows.mapInArrow(run, "doc_id long, item_id long, score double, begin long, end long")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, begin long, end long")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text aligns with no item: a filter, without a shuffle."""
    for held in item_blocks(docs.select(F.col(f"`{text_col}`").alias("_text")), benchmark, threshold, "item_id", "text"):
        docs = docs.where(~_aligned(held, threshold)(F.col(f"`{text_col}`")))
    return docs


def _aligned(held: Broadcast, threshold: float):
    @F.arrow_udf("boolean")
    def aligned(text: pa.Array) -> pa.Array:
        hit = np.zeros(len(text), dtype=bool)
        for chunk in tokens.chunks(text):
            for d, *_ in matches(chunk, held.value, threshold):
                hit[chunk.first + d] = True
        return pa.array(hit)

    return aligned
