"""Token counts (operator 5): tokens of whole documents attributed to their sections.

A document is encoded once, as a whole, so counts add up to what a model would
see.  Token and section spans are intervals of the same bytes; a binary search
of all token ends among the section bounds joins them.  A token that crosses a
bound goes, whole, to the section that holds most of its characters.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.llm import tokens

#: A rank file of a byte-level vocabulary, and the pattern that splits text before the merges (fixed values).
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Characters of a run of white space that the pattern is not asked to match: its look-ahead steps back over each of them.
LONG_RUN = 10_000
#: Unicode's White_Space characters (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A long run, less its last character if other text follows: what ``\\s+(?!\\S)`` cuts off as one piece.
LONG_PIECE = re.compile(f"[{WHITE}]{{{LONG_RUN},}}(?![^{WHITE}])")


@lru_cache(maxsize=1)
def encoding(ranks: bytes, pattern: str) -> tuple[tiktoken.Encoding, tiktoken.Encoding, np.ndarray]:
    """The encoding, one that takes any text as a single piece, and the bytes of each token."""
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    size = np.zeros(max(table.values()) + 1, dtype=np.int64)
    for token, rank in table.items():
        size[rank] = len(token)
    own, whole = (tiktoken.Encoding("own", pat_str=p, mergeable_ranks=table, special_tokens={}) for p in (pattern, r"[\s\S]+"))
    return own, whole, size


def encoded(text: str, encode: tiktoken.Encoding, whole: tiktoken.Encoding, pattern: str) -> np.ndarray:
    """The tokens of a whole text.

    Long runs of white space are cut off where the pattern cuts them, as it
    cannot match runs of a million characters itself; tokens are the same.
    """
    parts, at = [], 0
    for run in LONG_PIECE.finditer(text) if r"\s+(?!\S)" in pattern else ():
        parts += [encode.encode_to_numpy(text[at : run.start()], disallowed_special=()), whole.encode_to_numpy(run[0], disallowed_special=())]
        at = run.end()
    parts.append(encode.encode_to_numpy(text[at:], disallowed_special=()))
    return np.concatenate(parts).astype(np.int64)


def line_bounds(text: bytes) -> np.ndarray:
    """Sections are lines, each with the line feed at its end; a text that ends with one has no further section."""
    ends = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 10) + 1
    bounds = np.concatenate([[0], ends])
    return bounds if len(text) and bounds[-1] == len(text) else np.append(bounds, len(text))


def owners(text: bytes, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and which tokens cross a bound.

    rule: 'most' (the section with most of the token's characters, the earlier
    among equals) or 'first' (where the token begins).  A character belongs
    where its first byte is.
    """
    begins = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(bounds, begins, side="right") - 1
    last = np.searchsorted(bounds, ends - 1, side="right") - 1
    section, crosses = first.copy(), first != last
    if rule == "most":
        for t in np.flatnonzero(crosses).tolist():
            edges = [int(begins[t]), *bounds[first[t] + 1 : last[t] + 1].tolist(), int(ends[t])]
            held = [sum(1 for b in text[lo:hi] if b & 0xC0 != 0x80) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
            section[t] = first[t] + held.index(max(held))
    return section, crosses


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, rule: str = "most", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, section (from 0), begin and end (bytes), n_tokens, n_crossing (of them, across a bound), doc_tokens.

    One row for each section of each row.  Null and empty texts are one empty
    section without tokens; repeated rows repeat the result; null ids are passed
    on; an empty table gives an empty result; other columns are not read.  Bytes
    that are not UTF-8 are read as U+FFFD, and begin and end count the bytes of
    the text so read.  A text of white space alone, of any length, is tokens like any other.  The
    vocabulary file, a few MB at any corpus size, is read by the driver and broadcast.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())
    names = ("doc_id", "section", "begin", "end", "n_tokens", "n_crossing", "doc_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, whole, size = encoding(held.value, pattern)
        for batch in batches:
            ids = batch.column("_id").to_pylist()
            texts = tokens.binary(batch.column("_text"))
            for at in range(0, len(ids), 256):
                doc, parts = [], []
                for d, text in zip(ids[at : at + 256], texts.slice(at, 256).to_pylist(), strict=True):
                    read = text.decode(errors="replace")
                    if "\ufffd" in read:
                        text = read.encode()
                    found = encoded(read, encode, whole, pattern)
                    bounds = line_bounds(text)
                    n = bounds.size - 1
                    section, crosses = owners(text, np.cumsum(size[found]), bounds, rule) if found.size else (found, np.zeros(0, bool))
                    doc += [d] * n
                    parts.append(np.stack([np.arange(n), bounds[:-1], bounds[1:], np.bincount(section, minlength=n), np.bincount(section[crosses], minlength=n), np.full(n, found.size)]))
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), *(pa.array(c) for c in np.concatenate(parts, axis=1).astype(np.int64))], names=list(names))

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))
