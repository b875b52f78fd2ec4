"""Substring dedup (operator 9): seed on winnowed anchors, extend both ways to maximal repeats, keep the first copy.

An anchor is the least of the ``anchor``-word strings of a window by hash.
Documents that share one are joined on it, and the match is extended to the
left and to the right (``repeats``); what reaches ``length`` words is a repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codesift.llm import repeats
from codesift.llm.tables import identified

SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("removed", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
        ("kept_text", pa.binary()),
    ]
)


def anchors(length: int, anchor: int):
    def cores(values: np.ndarray, bounds: np.ndarray, starts: np.ndarray, known: list | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not starts.size:
            return starts, starts, starts
        at = repeats.least_grams(repeats.roll(values, 0).windows(anchor), length - anchor + 1)[starts]
        return starts, at, at + anchor

    return cores


def cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text, spans in zip(batch.column("_id").to_pylist(), repeats.tokens.binary(batch.column("_text")).to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words = text.split()
            gone = repeats.merge(spans, len(words))
            kept, at = [], 0
            for begin, end in gone:
                kept += words[at:begin]
                at = end
            kept += words[at:]
            out.append((doc, len(words), len(words) - len(kept), [{"begin": a, "end": b} for a, b in gone], b" ".join(kept)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)


def substring_dedup(docs: DataFrame, length: int = 20, anchor: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes every word covered by a ``length``-word run that also starts earlier.

    Earlier: in a document with a smaller id (null is smallest; among equal ids,
    the earlier row), or earlier in the same document.  Runs are judged on the
    input.  Seeds are winnowed ``anchor``-word strings: each run of ``length``
    words holds at least one, chosen by content alone, so equal runs meet.

    Returns doc_id, n_words, n_removed, removed (maximal word ranges, end
    exclusive) and kept_text (UTF-8 bytes, kept words joined by one space).
    One row per input row: null and empty texts give zero words and an empty
    kept_text, repeated rows count as separate documents, an empty table gives
    an empty result, and other columns are not read.
    """
    rule = repeats.Rule("word", length, True, anchors(length, min(anchor, length)))
    rows = repeats.by_uid(identified(docs, id_col, text_col))
    spans = repeats.repeated(rows, rule)
    return rows.join(spans, "_uid", "left").select("_id", "_text", "spans").mapInArrow(cut_words, repeats.spark_schema(SCHEMA))
