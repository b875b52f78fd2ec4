"""One large JSON file whose rows stand in a list, read by many tasks.

Whether a byte stands in a text, and how deep in brackets, depends on all
before it.  So there are three passes, each over byte ranges:

1. each range counts its quotes and brackets for both cases, begun inside or
   outside a text; a running sum over the ranges tells which case holds;
2. the ranges that come up to the outermost object look for the list's name
   and for the list's end;
3. each range yields the elements whose preceding bracket or comma it holds,
   and reads on until the last of them ends.

The driver sees a few numbers for each range, no content.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from codesift.sources import members
from codesift.sources.tree import opened

#: Bytes of a range, and of the blocks in which a task reads it.
RANGE, BLOCK = 64 << 20, 1 << 20
#: Characters of elements in a batch.
BATCH = 8 << 20

QUOTE, BACKSLASH, COMMA = b'"\\,'
SPACES = b" \t\r\n"
STEP = np.zeros(256, dtype=np.int64)
STEP[list(b"[{")], STEP[list(b"]}")] = 1, -1


@dataclass
class State:
    """Where a block begins: an odd run of backslashes before it, in a text (1) or not (0), brackets open."""

    odd: int = 0
    text: int = 0
    depth: int = 0


class Marks:
    """Quotes that bound texts, brackets and commas of a block, for one state at its begin."""

    def __init__(self, block: bytes, state: State):
        buf = np.frombuffer(block, dtype=np.uint8)
        quotes = np.flatnonzero(buf == QUOTE)
        slashes = np.flatnonzero(buf == BACKSLASH)
        odd = 0
        if slashes.size or state.odd:
            first = slashes[np.diff(slashes, prepend=-2) != 1]
            before = lambda at: at - first[np.maximum(np.searchsorted(first, at - 1, side="right") - 1, 0)] if first.size else np.zeros_like(at)
            ends = np.append(quotes, buf.size)
            follows = np.zeros(ends.size, dtype=bool)
            follows[ends > 0] = buf[ends[ends > 0] - 1] == BACKSLASH
            run = np.where(follows, before(ends), 0)
            run += np.where(run == ends, state.odd, 0)  # the run reaches back over the block's begin
            odd, quotes = int(run[-1] & 1), quotes[run[:-1] & 1 == 0]
        self.buf, self.quotes, self.state = buf, quotes, state
        self.brackets = np.flatnonzero(STEP[buf])
        self.odd = odd

    def inside(self, at: np.ndarray) -> np.ndarray:
        """Whether places stand in a text."""
        return (np.searchsorted(self.quotes, at) + self.state.text & 1).astype(bool)

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """The brackets outside texts, and the depth after each."""
        real = self.brackets[~self.inside(self.brackets)]
        return real, self.state.depth + np.cumsum(STEP[self.buf[real]])

    def after(self) -> State:
        depths = self.steps()[1]
        return State(self.odd, int(self.state.text + self.quotes.size & 1), int(depths[-1]) if depths.size else self.state.depth)


def odd_before(file: pa.NativeFile, at: int) -> int:
    """Whether an odd number of backslashes stands before a place."""
    n = 0
    while at > 0:
        size = min(at, 4096)
        piece = file.read_at(size, at - size)
        run = size - len(piece.rstrip(b"\\"))
        n, at = n + run, at - size
        if run < size:
            break
    return n & 1


def blocks(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    for at in range(start, end, BLOCK):
        yield at, file.read_at(min(BLOCK, end - at), at)


def counted(file: pa.NativeFile, start: int, end: int) -> tuple[int, list[int], list[int]]:
    """Quotes (odd or even), and for both cases the change of depth and the least depth on the way."""
    out, least = [State(odd_before(file, start), text) for text in (0, 1)], [0, 0]
    for _, block in blocks(file, start, end):
        for case in (0, 1):
            marks = Marks(block, out[case])
            depths = marks.steps()[1]
            least[case] = min(least[case], int(depths.min()) if depths.size else 0)
            out[case] = marks.after()
    return out[0].text, [s.depth for s in out], least


def spaced(file: pa.NativeFile, at: int) -> tuple[int, bytes]:
    """The next place that is no space, and its byte; none at the end."""
    while piece := file.read_at(4096, at):
        rest = piece.lstrip(SPACES)
        if rest:
            return at + len(piece) - len(rest), rest[:1]
        at += len(piece)
    return at, b""


def bounds(file: pa.NativeFile, start: int, end: int, state: State, name: str) -> tuple[int, int, int]:
    """Where the list begins (behind its bracket), where it ends if it does in this range, and the first end of anything at its depth; -1 for none."""
    begin = close = first = -1
    key = b'"' + name.encode() + b'"'
    for at, block in blocks(file, start, end):
        marks = Marks(block, state)
        real, depths = marks.steps()
        if begin < 0:
            opening = marks.quotes[~marks.inside(marks.quotes)]
            level = np.concatenate([[state.depth], depths])[np.searchsorted(real, opening)]
            for q in opening[level == 1].tolist():
                if file.read_at(len(key), at + q) == key:
                    place, sign = spaced(file, at + q + len(key))
                    place, bracket = spaced(file, place + 1) if sign == b":" else (0, b"")
                    if bracket == b"[":
                        begin = place + 1
                        break
        closing = at + real[(depths == 1) & (STEP[marks.buf[real]] < 0)]
        if first < 0 and closing.size:
            first = int(closing[0])
        if close < 0 and begin >= 0 and (closing >= begin).any():
            close = int(closing[closing >= begin][0])
        state = marks.after()
    return begin, close, first


def elements(file: pa.NativeFile, start: int, end: int, state: State, begin: int, close: int) -> Iterator[bytes]:
    """The elements behind the list's bracket or a comma in [start, end), whole, without the spaces around."""
    pending: list[bytes] | None = [] if start == begin else None
    for at, block in blocks(file, start, close):
        if at >= end and pending is None:
            return
        marks = Marks(block, state)
        real, depths = marks.steps()
        commas = np.flatnonzero(marks.buf == COMMA)
        commas = commas[~marks.inside(commas)]
        commas = commas[np.concatenate([[state.depth], depths])[np.searchsorted(real, commas)] == 2]
        last = 0
        for c in commas.tolist():
            if pending is not None:
                pending.append(block[last:c])
                yield b"".join(pending).strip(SPACES)
            if at + c >= end:
                return
            pending, last = [], c + 1
        if pending is not None:
            pending.append(block[last:])
        state = marks.after()
    if pending is not None and (text := b"".join(pending).strip(SPACES)):
        yield text


def read_list(spark: SparkSession, path: str, name: str, size: int = RANGE) -> DataFrame | None:
    """A column ``value``: the text of each element of the list that the outermost object of one JSON file holds under a name.

    None if the file has no such list (the first counts, its name written
    without escapes).  The file is UTF-8, with or without a byte-order mark.
    An element is a row, however long; texts of any length and brackets in
    texts are told apart.  What is no JSON gives rows that are none either.
    A path that ends in .gz is read by the places of its members
    (``sources.members``); None if it has others.
    """
    system, inner = opened(path)
    length, index = system.get_file_info(inner).size, None
    if path.lower().endswith(".gz"):
        with system.open_input_file(inner) as file:
            index = members.places(file)
        if index is None:
            return None
        length = int(index[-1, 1])
    ranges = [(at, min(at + size, length)) for at in range(0, length, size)]
    if not ranges:
        return None

    def over(rows: list[tuple], function, ddl: str) -> DataFrame:
        """The function's rows, for each row a task of its own."""
        kinds = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in ddl.split(", ")])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, inner = opened(path)
            with system.open_input_file(inner) as raw:
                file = raw if index is None else members.MemberFile(raw, index)
                for batch in batches:
                    for k in batch.column("id").to_pylist():
                        for columns in function(file, *rows[k]):
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.types, strict=True)], schema=kinds)

        return spark.range(0, len(rows), 1, len(rows)).mapInArrow(run, ddl)

    def count(file, start, end):
        text, change, least = counted(file, start, end)
        yield tuple([x] for x in (start, odd_before(file, start), text, *change, *least))

    counts = over(ranges, count, "start long, odd long, text long, change0 long, change1 long, least0 long, least1 long")
    state, states, touched = State(), [], []
    for (start, end), row in zip(ranges, sorted(counts.collect()), strict=True):
        states.append((start, end, row.odd, state.text, state.depth))
        if state.depth + row[f"least{state.text}"] <= 1:
            touched.append(states[-1])
        state = State(0, state.text ^ row.text, state.depth + row[f"change{state.text}"])
    if not touched:
        return None

    def locate(file, start, end, *state):
        yield tuple([x] for x in (start, *bounds(file, start, end, State(*state), name)))

    places = sorted(over(touched, locate, "start long, begin long, close long, first long").collect())
    at = next((k for k, p in enumerate(places) if p.begin >= 0), None)
    if at is None:
        return None
    begin = places[at].begin
    # The bracket may stand in the range after its name's, where the first end at that depth is still the list's.
    close = places[at].close if places[at].close >= 0 else next((p.first for p in places[at + 1 :] if p.first >= begin), length)

    def read(file, start, end, *state):
        rows, held = [], 0
        for text in elements(file, start, end, State(*state), begin, close):
            rows.append(text.decode("utf-8", "replace"))
            held += len(text)
            if held >= BATCH:
                yield (rows,)
                rows, held = [], 0
        if rows:
            yield (rows,)

    # The range with the list's begin starts there: just behind the bracket, outside texts and two brackets deep.
    inside = [s if s[0] > begin else (begin, s[1], 0, 0, 2) for s in states if s[1] > begin and s[0] < close]
    return over(inside, read, "value string") if inside else spark.createDataFrame([], "value string")
