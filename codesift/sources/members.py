"""Gzip files that can be read from any place: rows of members that tell their size.

Each member is a gzip stream of its own, so any gzip reader takes the file as
one text.  An extra field of its header (RFC 1952, 2.3.1.1) holds the length of
the member and of its text; whoever hops from header to header knows where each
part of the text lies.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa

#: Bytes of text in a member, at most, and how hard it is compressed.
MEMBER, LEVEL = 1 << 20, 1
#: Magic, method, flags; time; extra flags, system; length of the extra field, its name, its length; length of member and text.
HEAD, TAIL = struct.Struct("<4BI2BH2sHII"), struct.Struct("<II")


def member(text: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = packer.compress(text) + packer.flush()
    return HEAD.pack(0x1F, 0x8B, 8, 4, 0, 0, 255, 12, b"CS", 8, HEAD.size + len(body) + TAIL.size, len(text)) + body + TAIL.pack(zlib.crc32(text), len(text))


class MemberStream:
    """Writes a text as members."""

    def __init__(self, out: pa.NativeFile):
        self.out, self.held = out, bytearray()

    def write(self, text: bytes) -> None:
        self.held += text
        full = len(self.held) // MEMBER * MEMBER
        for at in range(0, full, MEMBER):
            self.out.write(member(bytes(self.held[at : at + MEMBER])))
        del self.held[:full]

    def close(self) -> None:
        if self.held:
            self.out.write(member(bytes(self.held)))
            self.held.clear()
        self.out.close()


def places(file: pa.NativeFile) -> np.ndarray | None:
    """Where each member and its text begin, and last where they end; None for a file of other members, or none."""
    at = text = 0
    found, size = [], file.size()
    while at < size:
        head = file.read_at(HEAD.size, at)
        if len(head) < HEAD.size:
            return None
        *marks, length, n = HEAD.unpack(head)
        if marks[:4] != [0x1F, 0x8B, 8, 4] or marks[7:] != [12, b"CS", 8] or not HEAD.size + TAIL.size < length <= size - at:
            return None
        found.append((at, text))
        at, text = at + length, text + n
    return np.array([*found, (at, text)], dtype=np.int64) if found else None


class MemberFile:
    """The text of such a file, by place."""

    def __init__(self, file: pa.NativeFile, index: np.ndarray):
        self.file, self.index, self.last = file, index, (-1, b"")

    def _text(self, k: int) -> bytes:
        if self.last[0] != k:
            begin, end = self.index[k, 0], self.index[k + 1, 0]
            self.last = k, zlib.decompress(self.file.read_at(int(end - begin), int(begin)), zlib.MAX_WBITS | 16)
        return self.last[1]

    def read_at(self, size: int, at: int) -> bytes:
        end, out = min(at + size, int(self.index[-1, 1])), []
        k = int(np.searchsorted(self.index[:, 1], at, side="right")) - 1
        while at < end:
            begin = int(self.index[k, 1])
            out.append(self._text(k)[at - begin : end - begin])
            at, k = int(self.index[k + 1, 1]), k + 1
        return b"".join(out)
