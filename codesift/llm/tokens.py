"""Vectorised words and rolling hashes over whole texts.

Tasks see texts as Arrow binary columns.  A column is cut into chunks of whole
documents, and each chunk is handled with numpy: one pass finds the words
(runs of ``[^\\x20\\x09-\\x0D]``), prefix sums of a polynomial give the hash of
any byte range or of any run of words in constant time.

Nulls count as empty texts.  A document is never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text held in numpy form at a time; a longer document is a chunk of its own.
CHUNK_BYTES = 2 << 20

U64 = np.uint64
#: Odd multipliers of the two polynomial hashes (bytes), and of word runs.
BASES = (0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4D)
WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

#: Byte ranges of this size and up are named by a digest: some built texts of 1,024 bytes and up are equal to any odd multiplier.
LONG = 512

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**i modulo 2**64 for i < n (or its inverse), kept for the worker's next chunks."""
    key = (base, inverse)
    have = _powers.get(key)
    if have is None or have.size < n:
        have = None
        size = max(4096, 1 << (n - 1).bit_length())
        step = np.full(size, pow(base, -1, 1 << 64) if inverse else base, dtype=U64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if size <= 4 * CHUNK_BYTES:
            _powers[key] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads the high bits of a polynomial hash over the word."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0x9FB21C651E98DF25)
    h ^= h >> U64(32)
    return h


class Rolling:
    """Hashes of ranges of a sequence of unsigned integers."""

    def __init__(self, values: np.ndarray, base: int):
        n = values.size
        self.base = base
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum((values.astype(U64) + U64(1)) * powers(base, n), out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        back = powers(self.base, self.sums.size, inverse=True)
        return mix((self.sums[end] - self.sums[start]) * back[start])

    def windows(self, m: int) -> np.ndarray:
        """The hash of every window of m values."""
        if self.sums.size <= m:
            return np.zeros(0, dtype=U64)
        out = self.sums[m:] - self.sums[:-m]
        out *= powers(self.base, self.sums.size, inverse=True)[: out.size]
        return mix(out)


def names(buf: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A name of each byte range: its polynomial hash, or of a long one 64 bits of its digest.

    Meant for ranges that hardly overlap (words, phrases), as long ones are read one by one.
    """
    out = Rolling(buf, base).ranges(start, end)
    for i in np.flatnonzero(end - start >= LONG):
        digest = hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8, person=base.to_bytes(8, "little")).digest()
        out[i] = U64(int.from_bytes(digest, "little"))
    return out


class Chunk:
    """Whole documents laid end to end: ``buf`` bytes, document i in bytes[i]:bytes[i+1]."""

    def __init__(self, first: int, buf: np.ndarray, bounds: np.ndarray):
        self.first, self.buf, self.bounds = first, buf, bounds
        self.n = bounds.size - 1

    def words(self) -> None:
        """Sets ``start`` and ``end`` of each word (bytes) and ``word_bounds`` of each document (words)."""
        buf, n = self.buf, self.buf.size
        solid = np.zeros(n + 2, dtype=bool)
        solid[1:-1] = ~SPACE[buf]
        inner = self.bounds[1:-1]
        starts = solid[1:-1] & ~solid[:-2]
        ends = solid[1:-1] & ~solid[2:]
        cut = inner[(inner > 0) & (inner < n)]
        starts[cut] = solid[1:-1][cut]
        ends[cut - 1] = solid[1:-1][cut - 1]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.word_bounds = np.searchsorted(self.start, self.bounds)

    def word_hashes(self, base: int = BASES[0], buf: np.ndarray | None = None) -> np.ndarray:
        return names(self.buf if buf is None else buf, self.start, self.end, base)

    def lowered(self) -> np.ndarray:
        """The bytes with A-Z lower-cased."""
        upper = (self.buf >= 65) & (self.buf <= 90)
        return self.buf + (upper.astype(np.uint8) << np.uint8(5))


def binary(column: pa.Array) -> pa.Array:
    """A string column as bytes, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = column.cast(pa.large_binary())
    return out.fill_null(b"") if out.null_count else out


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The documents of a string or binary column, a few at a time."""
    column = binary(column)
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        upto = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        upto = min(max(upto, at + 1), len(column))
        yield Chunk(at, data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at])
        at = upto


def spread(bounds: np.ndarray) -> np.ndarray:
    """The index of the document each element belongs to."""
    return np.repeat(np.arange(bounds.size - 1), np.diff(bounds))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values, the index of its leftmost least one."""
    n = h.size - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    low, at, width = h.copy(), np.arange(h.size, dtype=np.int64), 1
    while width < w:  # low[i] covers h[i:i+width]
        step = min(width, w - width)
        other, other_at = low[step:], at[step:]
        size = other.size
        take = other < low[:size]
        low = np.where(take, other, low[:size])
        at = np.where(take, other_at, at[:size])
        width += step
    return at[:n]
