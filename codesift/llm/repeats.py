"""Which runs of a fixed length occur again elsewhere: what the two substring operators share.

A text is a sequence of units (bytes, or words as 64-bit hashes); a window is
``length`` consecutive units of one document.  Nothing is compared in pairs.

1. *Cores.*  Each operator chooses, by content alone, a part of every window:
   its core.  Equal windows have equal cores at equal places, so they meet
   under the core's key.  Neighbouring windows mostly share their core: one row
   stands for the windows lo..hi of a stretch.
2. *Stretches.*  Under one key, stretches with the same content are counted and
   the first is found.  A stretch seen before (or, in the other mode, seen
   twice) has all its windows settled at once.  Most repeated text ends here.
3. *Extension.*  Keys under which stretches differ are where a match begins or
   ends.  There the units left and right of each distinct stretch's core are
   compared (``extend``): what stands before the cores is sorted from the core
   leftwards, what follows from the core rightwards, with the lengths that
   neighbours in either order share.  For each length to the left, stretches
   that share it are a group, ordered by what follows; neighbours in that order
   that share enough to the right hold the same window.

Hot keys: each task first settles repeats within its own batch and sends one
row per stretch and batch, so a passage in a third of all documents reaches a
key as a row per batch.  A key with more than ``HOT`` distinct stretches is
dealt out window by window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codesift.llm import tokens

#: Low bits of a sort key that hold a position, so that one minimum finds value and place: texts of up to 2**36 units.
PLACE_BITS = np.uint64(36)
#: Distinct stretches of a key that one task compares.
HOT = 1_000
U64 = np.uint64


@dataclass(frozen=True)
class Rule:
    """unit: 'byte' or 'word'.  earlier: a window counts if it also starts earlier; else if it starts anywhere else.

    cores: for units, bounds of documents, flat starts of windows (ascending),
    and a list for each document or None, the begin and end of each window's core.
    """

    unit: str
    length: int
    earlier: bool
    cores: Callable[[np.ndarray, np.ndarray, np.ndarray, list | None], tuple[np.ndarray, np.ndarray, np.ndarray]]


def units(chunk: tokens.Chunk, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """The units of a chunk and the bounds of its documents among them."""
    if rule.unit == "byte":
        return chunk.buf, chunk.bounds
    chunk.words()
    return chunk.word_hashes(), chunk.word_bounds


def roll(values: np.ndarray, which: int) -> tokens.Rolling:
    return tokens.Rolling(values, (tokens.BASES if values.dtype == np.uint8 else tokens.WORD_BASES)[which])


def least_grams(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` grams the place of the least, the leftmost on ties."""
    best = (grams >> PLACE_BITS << PLACE_BITS) | np.arange(grams.size, dtype=U64)
    have = 1
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    return (best & ((U64(1) << PLACE_BITS) - U64(1))).astype(np.int64)


def window_starts(bounds: np.ndarray, length: int) -> np.ndarray:
    """The flat starts of all windows that lie in one document."""
    n = np.maximum(np.diff(bounds) - length + 1, 0)
    return np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def stretches(values: np.ndarray, bounds: np.ndarray, rule: Rule, known: list | None) -> tuple[np.ndarray, ...]:
    """Core key, content hash, document, first window and last window of each stretch."""
    starts, begin, end = rule.cores(values, bounds, window_starts(bounds, rule.length), known)
    if not starts.size:
        return tuple(np.zeros(0, dtype=t) for t in (U64, U64, np.int64, np.int64, np.int64))
    new = np.ones(starts.size, dtype=bool)
    new[1:] = (begin[1:] != begin[:-1]) | (end[1:] != end[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], starts.size) - 1
    lo, hi = starts[first], starts[last]
    doc = np.searchsorted(bounds, lo, side="right") - 1
    key = tokens.mix(roll(values, 0).ranges(begin[first], end[first]) + (end[first] - begin[first]).astype(U64))
    return key, roll(values, 1).ranges(lo, hi + rule.length), doc, lo, hi


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts by keys[0], then keys[1], ..., and where a new value of the first two begins."""
    order = np.lexsort(keys[::-1])
    new = np.ones(order.size, dtype=bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys[:2]], axis=0)
    return order, new


def known_of(batch: pa.RecordBatch) -> list | None:
    return batch.column("known").to_pylist() if "known" in batch.schema.names else None


def find_stretches(rule: Rule):
    schema = pa.schema([(n, pa.int64()) for n in ("route", "content", "_ord", "_uid")] + [("lo", pa.int32()), ("hi", pa.int32()), ("settled", pa.bool_()), ("twice", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, uid = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("_ord", "_uid"))
            known, found = known_of(batch), []
            for chunk in tokens.chunks(batch.column("_text")):
                values, bounds = units(chunk, rule)
                key, content, doc, lo, hi = stretches(values, bounds, rule, known and known[chunk.first : chunk.first + chunk.n])
                begin = bounds[doc]
                found.append((key, content, doc + chunk.first, lo - begin, hi - begin))
            if not found:
                continue
            key, content, doc, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
            order, new = groups(key, content, rank[doc], uid[doc], lo)
            count = np.diff(np.append(np.flatnonzero(new), new.size))
            twice = np.repeat(count > 1, count) if count.size else np.zeros(0, dtype=bool)
            key, content, doc, lo, hi = (x[order] for x in (key, content, doc, lo, hi))
            # The first of each stretch speaks for this batch; the others are repeats, and one row for those in a row.
            again = np.flatnonzero(~new)
            again = again[np.lexsort((lo[again], doc[again]))]
            head = np.ones(again.size, dtype=bool)
            head[1:] = (doc[again][1:] != doc[again][:-1]) | (lo[again][1:] > hi[again][:-1] + 1)
            top = np.flatnonzero(head)
            until = np.append(top[1:], again.size) - 1 if again.size else top
            first, run_of = np.flatnonzero(new), again[top]
            row = np.concatenate([first, run_of])
            far = np.concatenate([hi[first], hi[again[until]]])
            settled = np.arange(row.size) >= first.size
            key, content, doc, lo, twice = (x[row] for x in (key, content, doc, lo, twice))
            route = np.where(settled, tokens.mix(key ^ uid[doc].astype(U64) * U64(0x9E3779B97F4A7C15) ^ lo.astype(U64)), key)
            columns = [tokens.signed(route), tokens.signed(content), rank[doc], uid[doc], lo.astype(np.int32), far.astype(np.int32), settled, twice]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return run, schema


CONTEXT = pa.schema([("key", pa.int64()), ("check", pa.int64()), ("_ord", pa.int64()), ("_uid", pa.int64()), ("at", pa.int32()), ("size", pa.int32()), ("least", pa.int32()), ("twice", pa.bool_()), ("left", pa.binary()), ("right", pa.binary())])


def send_contexts(rule: Rule):
    """For each stretch to compare: its core's key and a second hash, where the core begins and its size, how much of the
    left a window takes at least, and the units left and right of the core.

    A stretch of a hot key gives a row for each window, which is all core; those
    that a batch holds again need no other batch and go to keys of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, uid = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("_ord", "_uid"))
            listed, known = batch.column("stretches").to_pylist(), known_of(batch)
            windows = []
            for chunk in tokens.chunks(batch.column("_text")):
                values, bounds = units(chunk, rule)
                some = listed[chunk.first : chunk.first + chunk.n]
                p = [(i, s["key"], s["lo"], s["hi"], s["twice"], s["hot"]) for i, x in enumerate(some) for s in sorted(x, key=lambda s: s["lo"])]
                if not p:
                    continue
                doc, key, lo, hi, twice, hot = (np.array(c) for c in zip(*p, strict=True))
                base = bounds[doc]
                kept, begin, end = rule.cores(values, bounds, lo + base, known and known[chunk.first : chunk.first + chunk.n])
                assert kept.size == lo.size
                check, row = roll(values, 1), doc + chunk.first
                if hot.any():
                    at = np.flatnonzero(hot)
                    n = (hi - lo)[at] + 1
                    at = np.repeat(at, n)
                    start = (lo + base)[at] + np.arange(at.size) - np.repeat(np.cumsum(n) - n, n)
                    windows.append((roll(values, 0).ranges(start, start + rule.length), check.ranges(start, start + rule.length), row[at], start - base[at], twice[at]))
                own = ~hot
                raw, wide = values.tobytes(), values.dtype.itemsize
                pieces = [[raw[a * wide : b * wide] for a, b in zip(x[own].tolist(), y[own].tolist(), strict=True)] for x, y in ((lo + base, begin), (end, hi + base + rule.length))]
                columns = [key[own], tokens.signed(check.ranges(begin[own], end[own])), rank[row[own]], uid[row[own]], (begin - base)[own], (end - begin)[own], (begin - base - hi)[own], twice[own], *pieces]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, CONTEXT.types, strict=True)], schema=CONTEXT)
            if windows:
                key, check, row, at, twice = (np.concatenate(c) for c in zip(*windows, strict=True))
                order, new = groups(key, check, rank[row], uid[row], at)
                key, check, row, at, twice = (c[order] for c in (key, check, row, at, twice))
                count = np.diff(np.append(np.flatnonzero(new), new.size))
                twice = ~new | (np.zeros(new.size, dtype=bool) if rule.earlier else twice | np.repeat(count > 1, count))
                key = np.where(new, key, tokens.mix(key ^ uid[row].astype(U64) * U64(0x9E3779B97F4A7C15) ^ at.astype(U64)))
                none = pa.array([b""] * new.size, pa.binary())
                columns = [tokens.signed(key), tokens.signed(check), rank[row], uid[row], at, np.full(new.size, rule.length), np.zeros(new.size), twice]
                yield pa.RecordBatch.from_arrays([*(pa.array(c).cast(t) for c, t in zip(columns, CONTEXT.types, strict=False)), none, none], schema=CONTEXT)

    return run, CONTEXT


def sorted_pieces(group: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order of the pieces by group, then bytes (a piece before those it begins), and the bytes each shares with the one before it."""
    size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    width = -(-int(size.max(initial=0)) // 8) * 8
    table = np.zeros((size.size, width + 16), dtype=np.uint8)
    table[:, :8] = group.astype(">u8").view(np.uint8).reshape(-1, 8)
    table[:, width + 8 :] = size.astype(">u8").view(np.uint8).reshape(-1, 8)
    flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    row = np.repeat(np.arange(size.size), size)
    table[row, np.arange(flat.size) - np.repeat(np.cumsum(size) - size, size) + 8] = flat
    order = np.argsort(table.view(f"V{width + 16}").ravel(), kind="stable")
    table, size = table[order], size[order]
    shared = np.zeros(size.size, dtype=np.int64)
    differ = table[1:, 8 : width + 8] != table[:-1, 8 : width + 8]
    shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1) if width else 0, width)
    shared[1:] = np.minimum(shared[1:], np.minimum(size[1:], size[:-1]))
    shared[1:][(table[1:, :8] != table[:-1, :8]).any(axis=1)] = -1
    return order, shared


def range_least(values: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The least of values[a:b] for many ranges that are not empty."""
    levels = [values]
    while 2 << len(levels) - 1 <= values.size:
        half = 1 << len(levels) - 1
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))

    def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.zeros(a.size, dtype=values.dtype)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(levels[k][a[at]], levels[k][b[at] - (1 << k)])
        return out

    return least


def extend(rule: Rule, group: np.ndarray, first: np.ndarray, size: np.ndarray, least: np.ndarray, twice: np.ndarray, left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Contexts (by number) and units of their left, for every window that is a repeat.

    first: places of the contexts in the order that decides which copy is the earlier.
    """
    wide = 1 if rule.unit == "byte" else 8
    n_left = np.fromiter(map(len, left), dtype=np.int64, count=len(left)) // wide
    order, shared = sorted_pieces(group, [x[::-1] for x in left])
    by_right, follow = sorted_pieces(group, right)
    place = np.empty(order.size, dtype=np.int64)
    place[by_right] = np.arange(order.size)
    # A group of another key shares nothing, not even the core.
    shared, follow = (np.where(x < 0, -1, x // wide) for x in (shared, follow))
    least_follow = range_least(follow)
    found, lengths = [], []
    for a in range(int(least.min(initial=0)), int(n_left.max(initial=0)) + 1):
        name = np.cumsum(shared < a)
        some = (least[order] <= a) & (n_left[order] >= a)
        who, name = order[some], name[some]
        if who.size < 2 and not twice[who].any():
            continue
        inner = np.lexsort((place[who], name))
        who, name = who[inner], name[inner]
        same = np.zeros(who.size, dtype=bool)
        pair = np.flatnonzero(name[1:] == name[:-1])
        need = rule.length - size[who[pair]] - a
        same[pair + 1] = least_follow(place[who[pair]] + 1, place[who[pair + 1]] + 1) >= need
        head = np.flatnonzero(~same)
        count = np.diff(np.append(head, who.size))
        if rule.earlier:
            hit = twice[who] | (first[who] != np.repeat(np.minimum.reduceat(first[who], head), count))
        else:
            hit = np.repeat((count > 1) | np.maximum.reduceat(twice[who], head), count)
        found.append(who[hit])
        lengths.append(np.full(int(hit.sum()), a))
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(found), np.concatenate(lengths)) if found else (none, none)


def compare_contexts(rule: Rule):
    """Rows come sorted by key; the last key of a batch waits for the next one."""
    schema = pa.schema([("_uid", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())])

    def settle(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        key, check, rank, uid, at, size, least, twice = (table.column(n).to_numpy() for n in ("key", "check", "_ord", "_uid", "at", "size", "least", "twice"))
        order, new = groups(key, check, rank, uid, at)
        group = np.empty(order.size, dtype=np.int64)
        group[order] = np.cumsum(new)
        first = np.empty(order.size, dtype=np.int64)
        first[order] = np.arange(order.size)
        who, a = extend(rule, group, first, size.astype(np.int64), least, twice, table.column("left").to_pylist(), table.column("right").to_pylist())
        uid, start = uid[who], at[who] - a
        order = np.lexsort((start, uid))
        uid, start = uid[order], start[order]
        new = np.ones(uid.size, dtype=bool)
        new[1:] = (uid[1:] != uid[:-1]) | (start[1:] > start[:-1] + rule.length)
        first = np.flatnonzero(new)
        last = np.append(first[1:], uid.size) - 1 if uid.size else first
        return pa.RecordBatch.from_arrays([pa.array(uid[first]), pa.array(start[first].astype(np.int32)), pa.array((start[last] + rule.length).astype(np.int32))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            keys = batch.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut or waiting[0].column("key")[0].as_py() != keys[-1]:
                waiting[-1] = batch.slice(0, cut)
                yield settle(pa.Table.from_batches(waiting))
                waiting = [batch.slice(cut)]
        if waiting:
            yield settle(pa.Table.from_batches(waiting))

    return run, schema


def repeated(docs: DataFrame, rule: Rule) -> DataFrame:
    """For each document of ``by_uid()`` that has any: ``_uid`` and ``spans``, unmerged ranges of units to remove."""
    order = F.coalesce("_id", F.lit(-(1 << 63))).alias("_ord")
    known = [c for c in docs.columns if c == "known"]
    run, schema = find_stretches(rule)
    rows = docs.select(order, "_uid", "_text", *known).mapInArrow(run, spark_schema(schema)).repartition("route")
    same_key = Window.partitionBy("route")
    same_content = Window.partitionBy("route", "content").orderBy("_ord", "_uid", "lo")
    whole = same_content.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select(
        "*",
        F.row_number().over(same_content).alias("nth"),
        F.count("lo").over(whole).alias("times"),
        F.max("twice").over(whole).alias("often"),
    ).select("*", F.count_if((F.col("nth") == 1) & ~F.col("settled")).over(same_key).alias("differ"))
    again = F.col("settled") | (F.col("nth") > 1 if rule.earlier else F.col("twice") | F.col("often") | (F.col("times") > 1))
    rows = rows.select("route", "_ord", "_uid", "lo", "hi", "differ", again.alias("again"), ((F.col("differ") > 1) & ~F.col("settled") & (F.col("nth") == 1)).alias("compare")).where("again or compare")
    # One row per stretch to settle: its own span if it is a repeat, and its key if others must be compared with it.
    per_doc = rows.groupBy("_uid").agg(
        F.collect_list(F.when(F.col("again"), F.struct(F.col("lo").alias("begin"), (F.col("hi") + rule.length).alias("end")))).alias("spans"),
        F.collect_list(F.when(F.col("compare"), F.struct(F.col("route").alias("key"), "lo", "hi", F.col("again").alias("twice"), (F.col("differ") > HOT).alias("hot")))).alias("stretches"),
    )
    run, schema = send_contexts(rule)
    contexts = (
        docs.join(per_doc.where(F.size("stretches") > 0).select("_uid", "stretches"), "_uid")
        .select(order, "_uid", "_text", "stretches", *known)
        .mapInArrow(run, spark_schema(schema))
        .repartition("key")
        .sortWithinPartitions("key")
    )
    run, schema = compare_contexts(rule)
    more = contexts.mapInArrow(run, spark_schema(schema)).groupBy("_uid").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    both = per_doc.where(F.size("spans") > 0).select("_uid", "spans").unionByName(more)
    return both.groupBy("_uid").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def by_uid(docs: DataFrame) -> DataFrame:
    """The texts dealt out by row.  Always the same columns, so that all joins of a query share one exchange."""
    return docs.select("_uid", "_id", "_text").repartition("_uid")


def spark_schema(schema: pa.Schema):
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)


def merge(spans: list[dict] | None, n: int) -> list[tuple[int, int]]:
    """Disjoint, sorted, maximal ranges within 0..n."""
    out: list[list[int]] = []
    for begin, end in sorted((s["begin"], min(s["end"], n)) for s in spans or ()):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]
