"""SimHash near-dedup (operator 4): fingerprints linked by BK-trees in shards, then components.

Shards: fingerprints within the radius share a key, so a tree holds only one
key's fingerprints and is searched by those alone.  Trees are not broadcast as
the list of all fingerprints grows with the corpus; the shuffle takes each
fingerprint to the trees that can hold its neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.llm import tokens
from codesift.llm.bottomk import high_halves, similar
from codesift.llm.components import components
from codesift.llm.repeats import spark_schema
from codesift.llm.tables import columns, free_name, identified, numbered, written

U64 = np.uint64
#: Fingerprints a shard may hold; a larger shard is dealt out as pairs of blocks of that size.
SHARD = 20_000
#: Bands of minima, and minima in a band: Jaccard 0.8 shares no band with probability 0.0008.
BANDS, ROWS = 18, 5
SALTS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS).astype(U64) * U64(2) + U64(1)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` lower-cased words, or of all words if there are fewer."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, dtype=U64)
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(line, 42)], dtype=U64)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], 42) for a, b in zip(begins[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], dtype=U64)


def simhash(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """64 bits a lane: bit i is 1 if it is set in over half the hashes.  Lanes after the first rehash them."""
    out = np.zeros(lanes, dtype=U64)
    for lane in range(lanes if hashes.size else 0):
        h = hashes if not lane else tokens.mix(hashes + U64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[lane] = np.packbits(ones * 2 > h.size, bitorder="little").view(U64)[0]
    return out


def fingerprints(docs: DataFrame, words: int = 4, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id and fingerprint (8 bytes a lane, most significant first) of each row."""
    schema = pa.schema([("_id", pa.int64()), ("fingerprint", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [simhash(shingle_hashes(t.as_py(), words), lanes).byteswap().tobytes() for t in tokens.binary(batch.column("_text"))]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(prints, pa.binary())], schema=schema)

    return columns(docs, id_col, text_col).mapInArrow(run, spark_schema(schema))


def exact_keys(n: int, bits: int, radius: int) -> list[np.ndarray]:
    """Bit positions of each key such that any two fingerprints within the radius agree on a key.

    The bits are cut into radius + c blocks; two fingerprints differ in at most
    ``radius`` of them, so some c blocks agree.  c grows with n, so that shards stay small.
    """

    def cost(c: int) -> float:
        return math.comb(radius + c, c) * (20 + n / 2 ** min(bits * c / (radius + c), 200))

    c = min(range(1, 6), key=cost)
    blocks = np.array_split(np.arange(bits), radius + c)
    return [np.concatenate(x) for x in combinations(blocks, c)]


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band of ``ROWS`` minima of the shingles: texts of Jaccard J agree on one with probability J ** ROWS."""
    least = np.full(SALTS.size, np.iinfo(U64).max, dtype=U64)
    for a in range(0, shingles.size, 4096):
        np.minimum(least, np.multiply.outer(SALTS, shingles[a : a + 4096]).min(axis=1), out=least)
    mixed = tokens.mix(least.reshape(BANDS, ROWS) + np.arange(ROWS, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return tokens.mix(np.bitwise_xor.reduce(mixed, axis=1) + np.arange(BANDS, dtype=U64) * U64(0xD6E8FEB86659FD93))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def tree_links(points: np.ndarray, radius: int, visits: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect all points within the radius of each other: a spanning forest, no more.

    A BK-tree: the first point of a node is its parent, the others go to the
    child keyed by their distance to it.  The points that search a node
    together follow only the edges whose key is within ``radius`` of their own
    distance.  ``visits`` gets the points that each node was compared with.
    """
    group, links = np.arange(len(points)), []
    everyone = np.arange(len(points))
    todo = [(everyone, everyone)]
    while todo:
        node, seekers = todo.pop()
        parent, rest = int(node[0]), node[1:]
        if (group[seekers] == group[parent]).all() and (group[rest] == group[parent]).all():
            continue  # all connected: nothing here can add a link
        to_parent = distance(points[seekers], points[parent])
        if visits is not None:
            visits.append(seekers.size)
        found = seekers[to_parent <= radius]
        for j in found[group[found] != group[parent]].tolist():
            if group[j] != group[parent]:
                links.append((parent, j))
                group[group == group[j]] = group[parent]
        if rest.size:
            edge = distance(points[rest], points[parent])
            order = np.argsort(edge, kind="stable")
            rest, edge = rest[order], edge[order]
            first = np.flatnonzero(np.concatenate([[True], edge[1:] != edge[:-1]]))
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), edge.size], strict=True):
                follow = seekers[np.abs(to_parent - edge[lo]) <= radius]
                if follow.size > 1 or follow.size and follow[0] != rest[lo]:
                    todo.append((rest[lo:hi], follow))
    return links


def middle_first(points: np.ndarray) -> np.ndarray:
    """The order of the points with that nearest to the majority of their bits in front.

    Copies of a text differ from each other more than from it, so links to the
    middle of a group are the likeliest to hold.
    """
    bits = np.unpackbits(points.view(np.uint8).reshape(len(points), -1), axis=1)
    majority = np.packbits(bits.mean(axis=0) > 0.5).view(U64)
    middle = int(distance(points, majority).argmin())
    return np.concatenate([[middle], np.delete(np.arange(len(points)), middle)])


def deal(keys: list[np.ndarray]):
    """A row for each fingerprint and key."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("fingerprint", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            prints = batch.column("fingerprint")
            bits = np.unpackbits(np.frombuffer(b"".join(prints.to_pylist()), dtype=np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
            for i, places in enumerate(keys):
                packed = np.packbits(bits[:, places], axis=1)
                wide = np.zeros((len(prints), -(-packed.shape[1] // 8) * 8), dtype=np.uint8)
                wide[:, : packed.shape[1]] = packed
                key = tokens.mix(np.bitwise_xor.reduce(tokens.mix(wide.view(U64) + np.arange(1, wide.shape[1] // 8 + 1, dtype=U64)), axis=1) + U64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                yield pa.RecordBatch.from_arrays([pa.array(tokens.signed(key)), batch.column("node"), prints], schema=schema)

    return run, schema


def root_links(points: np.ndarray, radius: int, roots: np.ndarray, size: np.ndarray, common: np.ndarray, key: np.ndarray, high: np.ndarray, keys: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """All pairs within the radius whose roots differ, whose sets could be similar enough, and whose first shared key is this shard's.

    Whether sets could be: by how much they share with other roots, and by their sketches.

    ``common``: how many of a set's elements sets of other roots have, so no two
    of different roots share more than the lesser of theirs.
    """
    links, step, percent = [], max(1, (1 << 20) // len(points)), round(100 * similarity)
    if (roots == roots[0]).all():
        return links
    high = [np.frombuffer(x, np.uint32) for x in high]
    for lo in range(0, len(points), step):
        some = slice(lo, lo + step)
        near = (roots[some][:, None] != roots[None]) & (np.minimum(common[some][:, None], common[None]) * (1 + similarity) >= similarity * (size[some][:, None] + size[None]) - 1e-9)
        i, j = np.nonzero(near)
        i, j = i[i + lo < j], j[i + lo < j]
        at = np.flatnonzero(distance(points[i + lo], points[j]) <= radius)
        same = keys[i[at] + lo] == keys[j[at]]
        at = at[keys[i[at] + lo, same.argmax(axis=1)] == key[0]]
        pairs = zip((i[at] + lo).tolist(), j[at].tolist(), strict=True)
        links += [(x, y) for x, y in pairs if similar(high[x], high[y], int(size[x]), int(size[y]), percent)[0]]
    return links


def search(radius: int, rooted: float | None = None):
    """Rows come sorted by shard; the last shard of a batch waits for the next batch.

    Links of a forest, or if ``rooted`` is a similarity, all that lead from one root to another and could reach it.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(table: pa.Table) -> pa.RecordBatch:
        shard, node = table.column("shard").to_numpy(), table.column("node").to_numpy()
        points = np.frombuffer(b"".join(table.column("fingerprint").to_pylist()), dtype=U64).reshape(len(node), -1)
        roots, size, common, key, high = (table.column(c).to_numpy() if rooted else node for c in ROOTED[:-1])
        keys = np.array(table.column(ROOTED[-1]).to_pylist()) if rooted else node
        edge = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
        a, b = [], []
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if hi - lo > 1:
                order = lo + (np.arange(hi - lo) if rooted else middle_first(points[lo:hi]))
                found = root_links(points[order], radius, *(x[order] for x in (roots, size, common, key, high, keys)), rooted) if rooted else tree_links(points[order], radius)
                for i, j in found:
                    a.append(node[order[i]])
                    b.append(node[order[j]])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            shards = batch.column("shard").to_numpy()
            cut = int(np.searchsorted(shards, shards[-1]))
            if cut or waiting[0].column("shard")[0].as_py() != shards[-1]:
                waiting[-1] = batch.slice(0, cut)
                yield links(pa.Table.from_batches(waiting))
                waiting = [batch.slice(cut)]
        if waiting:
            yield links(pa.Table.from_batches(waiting))

    return run, schema


#: Further columns of a search from root to root.
ROOTED = ("root", "size", "common", "key", "high", "keys")


def shard_links(dealt: DataFrame, radius: int, rooted: float | None = None) -> DataFrame:
    """Links (a, b) within the radius among the rows (key, node, fingerprint, and if ``rooted`` the columns ``ROOTED``) of equal key."""
    rest = ["node", "fingerprint", *(ROOTED if rooted else ())]
    # At most (rows / SHARD) keys are over the limit, few enough to broadcast.
    large = dealt.groupBy("key").agg(F.ceil(F.count("node") / SHARD).cast("int").alias("blocks")).where("blocks > 1")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = (
        dealt.join(F.broadcast(large), "key", "left")
        .withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
        .select(F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least(own, "other"), F.greatest(own, "other"))).alias("shard"), *rest)
    )
    run, schema = search(radius, rooted)
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, spark_schema(schema))


def near_groups(nodes: DataFrame, radius: int) -> DataFrame:
    """fingerprint, least and component_id of ``nodes`` (one row a fingerprint, with the least id that has it).

    component_id is the least id of all fingerprints that links of ``radius`` or
    fewer differing bits reach.  Every link is found.  Each join is of two
    written tables, so that a component of any size is dealt to many tasks.
    """
    nodes = written(nodes.withColumn("node", F.conv(F.hex("fingerprint"), 16, -10).cast("long")), "nodes")
    some = nodes.agg(F.count("node"), F.max(F.length("fingerprint"))).first()
    n, bits = some[0], 8 * (some[1] or 8)
    run, schema = deal(exact_keys(n, bits, radius))
    roots = components(shard_links(nodes.select("node", "fingerprint").mapInArrow(run, spark_schema(schema)), radius))
    rooted = written(nodes.join(roots, "node", "left").select("fingerprint", "least", F.coalesce("root", "node").alias("root")), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    return written(rooted.join(least, "root").select("fingerprint", "component_id"), "groups")


def profiles(rows: DataFrame, words: int, lanes: int) -> DataFrame:
    """_uid, _ord, and of the text's distinct shingles: a digest, the fingerprint and the band keys.  ``rows``: of ``identified()``."""
    schema = pa.schema([("_uid", pa.int64()), ("_ord", pa.int64()), ("digest", pa.binary()), ("fingerprint", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words)) for t in tokens.binary(batch.column("_text"))]
            digests = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            prints = [simhash(x, lanes).tobytes() for x in sets]
            keys = [tokens.signed(band_keys(x)) for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column("_uid"), batch.column("_ord"), *(pa.array(c, t) for c, t in zip((digests, prints, keys), schema.types[2:], strict=True))], schema=schema)

    return rows.mapInArrow(run, spark_schema(schema))


def shingle_sets(rows: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, shingles (sorted hashes, 8 bytes each) and high (a sketch, 4 bytes a value) of the texts of ``nodes`` (``_uid`` of ``rows``), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words)) for t in tokens.binary(batch.column("_text"))]
            yield pa.RecordBatch.from_arrays([batch.column("_uid"), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([high_halves(x).tobytes() for x in sets], pa.binary())], names=["node", "shingles", "high"])

    return written(rows.join(nodes.select(F.col("node").alias("_uid")), "_uid", "left_semi").select("_uid", "_text").mapInArrow(run, "node long, shingles binary, high binary"), "shingles")


def distinct_links(links: DataFrame) -> DataFrame:
    return written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")


def ends(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def alike(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b: nodes of ``sets``) whose sets have that Jaccard index or more."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=U64), np.frombuffer(y, dtype=U64)
                both = np.intersect1d(x, y, assume_unique=True).size
                keep.append(both >= similarity * (x.size + y.size - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first, second = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return written(links.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "alike")


def linkable(sets: DataFrame, rooted: DataFrame, similarity: float) -> DataFrame:
    """node, root, size and common (the shingles that a set of another root has too) of those that can reach the similarity with another root.

    ``rooted``: node and root of all sets.  A set shares at least ``similarity``
    of itself with any that is so similar, so one with fewer shingles in common
    with all other roots is similar to none of them.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [np.frombuffer(x, dtype=np.int64) for x in batch.column("shingles").to_pylist()]
            if flat:
                size = np.array([x.size for x in flat])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(flat)), *(pa.array(np.repeat(batch.column(c).to_numpy(), size)) for c in ("node", "root"))], names=["shingle", "node", "root"])

    rows = written(sets.join(rooted, "node"), "rooted")
    each = rows.mapInArrow(listed, "shingle long, node long, root long")
    shared = each.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("shingle").repartition(F.col("shingle") % 1_000_003)
    common = each.select("shingle", "node").join(shared, "shingle").groupBy("node").agg(F.count(F.lit(1)).alias("common"))
    found = rows.select("node", "root", (F.length("shingles") / 8).cast("long").alias("size")).join(common, "node")
    return written(found.where(F.col("common") >= similarity * F.col("size") - 1e-9), "linkable")


def simhash_dedup(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (binary, most significant byte first) and component_id of every row.

    Texts are lower-cased (A-Z) and cut into words ``[^\\x20\\x09-\\x0D]+`` and
    ``words``-word shingles, repeats included; a shorter text is one shingle.
    component_id: the smallest doc_id that links reach, its own included.

    Null, empty and blank texts have fingerprint zero and link like any other.
    Repeated rows and ids all get a row; a null id is passed on and never a
    component_id, unless its component has no other.  An empty table gives an
    empty result; other columns are not read.
    """
    prints = written(fingerprints(docs, words, 1, id_col, text_col), "fingerprints")
    found = near_groups(prints.groupBy("fingerprint").agg(F.min("_id").alias("least")), radius)
    return prints.join(found, "fingerprint").select(F.col("_id").alias("doc_id"), "fingerprint", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: the smallest id of each group stays.

    Texts link if the Jaccard index of their sets of ``words``-word shingles
    is ``similarity`` or more; that is checked on the shingles.  Candidates
    share a band key and have 256-bit fingerprints within a radius: at Jaccard
    J the cosine of equally long texts is 2J / (1 + J), the angle is the share
    of differing bits, and the radius is five deviations more.  A first search
    links candidates by forests around the middles of shards; a second takes all
    candidates that the checked links of the first leave apart, but for texts
    that have too much of their own to be similar to any.

    Null and empty texts are copies of each other, as are texts of fewer words
    than a shingle only if equal.  Of rows with equal ids the first of the table
    stays, null ids come first, an empty table gives an empty result, other
    columns are passed on whatever their names.
    """
    bits = 256
    angle = math.acos(2 * similarity / (1 + similarity)) / math.pi
    radius = math.floor(bits * angle + 5 * math.sqrt(bits * angle * (1 - angle)))
    uid = free_name(docs, "_cs_uid")
    docs = numbered(docs, uid)
    rows = identified(docs, id_col, text_col, uid)
    known = profiles(rows, words, bits // 64).groupBy("digest")
    nodes = written(known.agg(F.min("_uid").alias("node"), F.min(F.struct("_ord", "_uid")).alias("first"), F.any_value("fingerprint").alias("fingerprint"), F.any_value("keys").alias("keys")), "nodes")
    candidates = distinct_links(shard_links(nodes.select(F.explode("keys").alias("key"), "node", "fingerprint"), radius))
    # The links of a forest touch every node that has any candidate.
    sets = shingle_sets(rows, ends(candidates), words)
    links = alike(candidates, sets, similarity)
    rooted = sets.select("node").join(components(links), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    apart = nodes.join(linkable(sets, rooted, similarity), "node").join(sets.select("node", "high"), "node").select(F.explode("keys").alias("key"), "node", "fingerprint", "root", "size", "common", "high", "keys")
    links = links.unionByName(alike(distinct_links(shard_links(apart, radius, similarity)), sets, similarity))
    found = nodes.join(components(links), "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    keep = written(found.groupBy("root").agg(F.min("first")["_uid"].alias(uid)).select(uid), "kept")
    return docs.join(keep, uid, "left_semi").drop(uid)
