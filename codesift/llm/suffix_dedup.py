"""Exact byte-level dedup of repetitive text (operator 6) by prefix-free parsing.

Triggers are the ``WINDOW``-byte strings whose rolling hash is 0 modulo
``MODULUS``.  They cut every document into phrases, each from the start of one
trigger to the end of the next, so no phrase suffix longer than a trigger
begins another.  The distinct phrases are the dictionary, the sequence of a
document's phrases is its parse.

A text suffix is a phrase suffix followed by a parse suffix.  The order of all
text suffixes is the order of the phrase suffixes, and within equal phrase
suffixes that of the parse suffixes behind them.  Two ``length``-byte strings
are equal if and only if their suffixes share that many bytes, and of those that
share them some are neighbours.  So, of a string with a trigger:

* the phrases between its first and last trigger must each occur twice in the
  dictionary; other strings are unique and are dropped (``dictionary``);
* the parse between these triggers names a bucket (its core), in which equal strings meet;
* in a bucket the phrase suffixes before the core are put in the dictionary's
  order with the bytes that neighbours share, the parse suffixes behind it in
  the parse's order likewise, and both are combined (``repeats.extend``).

The order is needed within a bucket only, so no bucket is ordered against
another.  A string without a trigger lies inside one long phrase; there, and
only there, the least ``gram``-byte string by hash is its core.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.llm import repeats, tokens
from codesift.llm.tables import identified, written

#: Bytes of a trigger, and one in how many strings is one.
WINDOW, MODULUS = 16, 64

SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("removed", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
        ("kept_bytes", pa.binary()),
    ]
)


def triggers(values: np.ndarray, bounds: np.ndarray, window: int, modulus: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the triggers, ascending, and the document of each."""
    ends = np.flatnonzero(repeats.roll(values, 0).windows(window) % np.uint64(modulus) == 0) + window
    doc = np.searchsorted(bounds, ends - 1, side="right") - 1
    inside = ends - window >= bounds[doc]
    return ends[inside], doc[inside]


def phrase_names(values: np.ndarray, bounds: np.ndarray, window: int, modulus: int) -> tuple[np.ndarray, np.ndarray]:
    """The parse: names of the phrases between triggers, in order, and the document of each."""
    ends, doc = triggers(values, bounds, window, modulus)
    whole = np.flatnonzero(doc[1:] == doc[:-1])
    return tokens.signed(tokens.names(values, ends[whole] - window, ends[whole + 1], tokens.BASES[1])), doc[whole]


def parse_cores(length: int, gram: int, window: int, modulus: int):
    """The core of a window: from the start of its first trigger to the end of its last."""

    def cores(values: np.ndarray, bounds: np.ndarray, starts: np.ndarray, known: list | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not starts.size:
            return starts, starts, starts
        ends, doc = triggers(values, bounds, window, modulus)
        upto = np.zeros(values.size + 1, dtype=np.int32)
        upto[ends] = 1
        np.cumsum(upto, out=upto)
        first = upto[starts + window - 1].astype(np.int64)
        last = upto[starts + length].astype(np.int64) - 1
        has = last >= first
        # Phrases that occur once: a window that holds one is unique.
        single = np.zeros(ends.size, dtype=np.int32)
        single[:-1] = doc[1:] == doc[:-1]
        if known is not None:
            base = np.searchsorted(doc, np.arange(len(known)))
            for d, listed in enumerate(known):
                if listed:
                    single[base[d] + np.array(listed)] = 0
        before = np.concatenate([[0], np.cumsum(single)])
        keep = ~has
        keep[has] = before[last[has]] == before[first[has]]
        begin, end = np.zeros(starts.size, dtype=np.int64), np.zeros(starts.size, dtype=np.int64)
        begin[has], end[has] = ends[first[has]] - window, ends[last[has]]
        bare = np.flatnonzero(~has)
        edge = np.flatnonzero(np.diff(starts[bare], prepend=-2) != 1)
        for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), bare.size][: edge.size], strict=True):
            a = int(starts[bare[lo]])
            part = values[a : a + hi - lo - 1 + length]
            begin[bare[lo:hi]] = a + repeats.least_grams(repeats.roll(part, 0).windows(gram), length - gram + 1)[: hi - lo]
            end[bare[lo:hi]] = begin[bare[lo:hi]] + gram
        return starts[keep], begin[keep], end[keep]

    return cores


def parsed(texts: DataFrame, window: int, modulus: int) -> DataFrame:
    """_uid and names, the parse, of every text with phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column("_uid").to_numpy()
            for chunk in tokens.chunks(batch.column("_text")):
                names, doc = phrase_names(chunk.buf, chunk.bounds, window, modulus)
                offsets = np.searchsorted(doc, np.arange(chunk.n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(uid[chunk.first : chunk.first + chunk.n]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(names))], names=["_uid", "names"])

    return texts.select("_uid", "_text").mapInArrow(run, "_uid long, names array<long>").where(F.size("names") > 0)


def dictionary(parse: DataFrame) -> DataFrame:
    """The names of phrases that occur more than once.  A phrase is counted in each task before the shuffle."""
    return parse.select(F.explode("names").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")


def cut_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text, spans in zip(batch.column("_id").to_pylist(), repeats.tokens.binary(batch.column("_text")).to_pylist(), batch.column("spans").to_pylist(), strict=True):
            gone = repeats.merge(spans, len(text))
            at, kept = 0, []
            for begin, end in gone:
                kept.append(text[at:begin])
                at = end
            kept = b"".join([*kept, text[at:]])
            out.append((doc, len(text), len(text) - len(kept), [{"begin": a, "end": b} for a, b in gone], kept))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)


def suffix_dedup(docs: DataFrame, length: int = 400, window: int = WINDOW, modulus: int = MODULUS, gram: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes every byte covered by a ``length``-byte string that also starts anywhere else.

    All copies go, the first too; strings never cross documents and are judged
    on the input.  ``window`` and ``modulus``: the triggers; ``gram``: bytes of
    the core of a string without one.  The result is the same for any of them.

    Returns doc_id, n_bytes, n_removed, removed (maximal byte ranges, end
    exclusive) and kept_bytes, which may split a character.  One row per input
    row: null and empty texts have zero bytes, repeated rows are separate
    documents and so remove each other, an empty table gives an empty result,
    and other columns are not read.
    """
    window, gram = min(window, length), min(gram, length)
    rows = identified(docs, id_col, text_col)
    texts = repeats.by_uid(rows)
    parse = written(parsed(rows, window, modulus), "parse")
    twice = written(dictionary(parse), "dictionary")
    known = parse.select("_uid", F.posexplode("names").alias("at", "name")).join(twice, "name").groupBy("_uid").agg(F.collect_list("at").alias("known"))
    rule = repeats.Rule("byte", length, False, parse_cores(length, gram, window, modulus))
    spans = repeats.repeated(texts.join(written(known, "known"), "_uid", "left"), rule)
    return texts.join(spans, "_uid", "left").select("_id", "_text", "spans").mapInArrow(cut_bytes, repeats.spark_schema(SCHEMA))
