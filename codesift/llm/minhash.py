"""MinHash near-dedup (operator 13): bottom-k sketches of one hash function, inverted lists, and exact Jaccard indexes.

A text's sketch holds the least ``SKETCH`` hashes of its shingles.  Texts whose
sketches begin alike meet in the inverted lists of the first ``LISTED`` values,
and texts that share too few of these with any other are done.
The bottom values of two sketches together are a sample of the union of the two
sets, so the share of them that both sketches hold estimates the Jaccard index:
pairs that cannot reach it are left out, the rest are checked on the full sets.

Lists are never expanded into pairs.  Equal sets are one node.  First each node
of a list is checked against one hub of the list; links that hold join nodes
under a root.  Then only lists with nodes of several roots are looked at again,
and of these only nodes that share enough of their sketch with other roots to be
similar to any.  They meet list by list with larger sketches, most of which
are whole sets, and a pair is written only if it links two roots.

What can be lost: texts at the threshold J share none of their first n values
with probability (1 - J)^n (1e-10 at 12 and 0.85), and each bound on shared
values is missed with probability ``bottomk.LOSS``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.llm import tokens
from codesift.llm.bottomk import least_matches, similar
from codesift.llm.components import components
from codesift.llm.repeats import spark_schema
from codesift.llm.simhash import shingle_hashes, shingle_sets
from codesift.llm.tables import free_name, identified, numbered, written

U64 = np.uint64
#: Values that a sketch retains, those that have an inverted list, and the first of these, whose lists are searched.
SKETCH, LISTED, FIRST = 128, 20, 12
#: Nodes of a list that one task compares; a longer list is dealt out as pairs of blocks.
BLOCK = 4_000
#: Node ids (8 bytes each) that are broadcast to pick their rows; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def sketches(rows: DataFrame, words: int) -> DataFrame:
    """_uid, _id, size of the set, its digest, the values with a list and the sketch.  ``rows``: of ``identified()``."""
    schema = pa.schema([("_uid", pa.int64()), ("_id", pa.int64()), ("size", pa.int64()), ("digest", pa.binary()), ("listed", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words)) for t in tokens.binary(batch.column("_text"))]
            columns = ([x.size for x in sets], [xxhash.xxh3_128_digest(x.tobytes()) for x in sets], [tokens.signed(x[:LISTED]) for x in sets], [x[:SKETCH].tobytes() for x in sets])
            yield pa.RecordBatch.from_arrays([batch.column("_uid"), batch.column("_id"), *(pa.array(c, t) for c, t in zip(columns, schema.types[2:], strict=True))], schema=schema)

    return rows.mapInArrow(run, spark_schema(schema))


def pairs_of(links: DataFrame, values: DataFrame, *columns: str) -> DataFrame:
    """The links (a, b) with the columns of both nodes, named x_ and y_."""
    side = lambda node, mark: values.select(F.col("node").alias(node), *(F.col(c).alias(f"{mark}_{c}") for c in columns))
    return links.join(side("a", "x"), "a").join(side("b", "y"), "b")


def estimated(links: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """The links that the union of the two sketches allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, n, m = (batch.column(c).to_pylist() for c in ("x_sketch", "y_sketch", "x_size", "y_size"))
            keep = [similar(np.frombuffer(a, U64), np.frombuffer(b, U64), i, j, percent)[0] for a, b, i, j in zip(x, y, n, m, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return written(pairs_of(links, sketched, "sketch", "size").mapInArrow(run, "a long, b long"), "estimated")


def verified(links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links whose full sets are similar, by whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x_shingles").to_pylist(), batch.column("y_shingles").to_pylist(), strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = np.intersect1d(x, y, assume_unique=True).size
                keep.append(100 * both >= percent * (x.size + y.size - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return written(pairs_of(links, sets, "shingles").mapInArrow(run, "a long, b long"), "verified")


def overlaps(values: list[np.ndarray], need: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each i, the j > i that share as many values as the lesser of their needs, by inverted lists."""
    size = np.array([v.size for v in values])
    flat, owner = np.concatenate(values), np.repeat(np.arange(size.size), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    edge = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1], [True]]))
    first, last = np.repeat(edge[:-1], np.diff(edge)), np.repeat(edge[1:], np.diff(edge))
    by_owner = np.argsort(owner, kind="stable")
    ends = np.cumsum(size)
    for i in range(size.size - 1):
        mine = by_owner[ends[i] - size[i] : ends[i]]
        met = np.concatenate([owner[k + 1 : last[k]] for k in mine]) if mine.size else owner[:0]
        count = np.bincount(met, minlength=size.size)
        yield i, np.flatnonzero(count >= np.minimum(need, need[i]))


def list_links(nodes: np.ndarray, roots: np.ndarray, sizes: np.ndarray, firsts: list[np.ndarray], large: list[np.ndarray], value: int, percent: int, halves: np.ndarray | None) -> list[tuple[int, int]]:
    """Pairs of a list that may link two roots and have no smaller value in common.

    A pair that the larger sketches show to be similar joins its roots, so the
    pairs are a forest of these and all others that the estimate allows.
    """
    links, joined = [], {r: r for r in roots.tolist()}

    def root(r: int) -> int:
        while joined[r] != r:
            joined[r] = r = joined[joined[r]]
        return r

    if len(joined) == 1:
        return links
    short = [x[:SKETCH] for x in large]
    # A set of n values shares at least percent of them with any that is so similar.
    need = np.minimum(least_matches(SKETCH, percent), [-(-percent * x.size // 100) for x in short])
    for i, near in overlaps(short, need):
        for j in near.tolist():
            if halves is not None and halves[i] == halves[j] or root(roots[i]) == root(roots[j]):
                continue
            common = np.intersect1d(firsts[i], firsts[j], assume_unique=True)
            if common[0] != value:
                continue
            may, shown = similar(large[i], large[j], int(sizes[i]), int(sizes[j]), percent)
            if may:
                links.append((int(nodes[i]), int(nodes[j])))
                if shown:
                    joined[root(roots[i])] = root(roots[j])
    return links


def search(percent: int):
    """Rows come sorted by shard; the last shard of a batch waits for the next batch."""

    def links(table: pa.Table) -> pa.RecordBatch:
        shard, node, root, size, value, half = (table.column(c).to_numpy() for c in ("shard", "node", "root", "size", "value", "half"))
        large = [np.frombuffer(x, np.uint32) for x in table.column("high").to_pylist()]
        firsts = [np.array(x[:FIRST], np.int64).view(U64) for x in table.column("listed").to_pylist()]
        edge = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
        found: list[tuple[int, int]] = []
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if hi - lo > 1:
                halves = half[lo:hi] if (half[lo:hi] != half[lo]).any() else None
                found += list_links(node[lo:hi], root[lo:hi], size[lo:hi], firsts[lo:hi], large[lo:hi], value[lo : lo + 1].view(U64)[0], percent, halves)
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

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

    return run


def few(nodes: DataFrame) -> DataFrame:
    """The distinct nodes, marked for broadcast if they are few, so that texts and sketches of all others do not move."""
    nodes = written(nodes.select("node").distinct(), "ids")
    return F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes


def enough(lists: DataFrame) -> DataFrame:
    """The rows of the nodes that are in as many of the lists as they need to be similar to any other."""
    counts = lists.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("least")).where("n >= least").select("node")
    return written(lists.join(written(counts, "enough"), "node"), "enough-lists")


def contested(met: DataFrame, sketched: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """value, node, root of lists whose nodes have several roots, without nodes that share too little of their sketch with other roots."""
    rooted = written(met.select("value", "node", "place", "need").join(roots, "node", "left").select("value", "node", "place", "need", F.coalesce("root", "node").alias("root")), "rooted")
    open_ = written(rooted.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("value"), "open")
    rooted = enough(written(rooted.join(open_, "value"), "open-lists"))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [np.frombuffer(x, np.int64) for x in batch.column("sketch").to_pylist()]
            if flat:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(flat)), *(pa.array(np.repeat(batch.column(c).to_numpy(), [x.size for x in flat])) for c in ("node", "root"))], names=["at", "node", "root"])

    some = rooted.select("node", "root").distinct().join(sketched, "node")
    each = written(some.select("node", "root", "sketch").mapInArrow(values, "at long, node long, root long"), "values")
    shared = written(each.groupBy("at").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("at"), "shared")
    common = each.join(shared, "at").groupBy("node").agg(F.count(F.lit(1)).alias("common"))
    need = F.when(F.col("size") > SKETCH, least_matches(SKETCH, percent)).otherwise(F.ceil(percent * F.col("size") / 100))
    able = sketched.select("node", "size").join(common, "node").where(F.col("common") >= need).select("node")
    # The least value that two texts have in common is among the first of both.
    return written(rooted.where(F.col("place") < FIRST).select("value", "node", "root").join(written(able, "able"), "node"), "contested")


def dealt(lists: DataFrame, large: DataFrame) -> DataFrame:
    """The rows of lists by shard: a list, or of a list with over ``BLOCK`` nodes, two of its blocks."""
    blocks = written(lists.groupBy("value").agg(F.ceil(F.count("node") / BLOCK).cast("int").alias("blocks")), "blocks")
    rows = written(lists.join(blocks, "value"), "dealt").join(large, "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("half", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # Pairs of one block are compared in the shard of that block alone.
    return rows.select(F.xxhash64("value", F.least("half", "other"), F.greatest("half", "other")).alias("shard"), "value", F.when(F.col("half") == F.col("other"), 0).otherwise(F.col("half")).alias("half"), "node", "root", "size", "listed", "high")


def minhash_groups(docs: DataFrame, words: int = 5, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", uid_col: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row, and _uid and _first, the row numbers of the row and of its component's first row.

    Texts are lower-cased (A-Z) and cut into words ``[^\\x20\\x09-\\x0D]+``; the
    set is that of distinct ``words``-word shingles, of a shorter text the whole
    sequence.  Sets link if 100 * shared >= percent * union.  component_id: the
    smallest doc_id that links reach, its own included; kept: it is its own.

    Null, empty and blank texts have empty sets and are linked with nothing, each
    its own component.  Repeated rows and ids all get a row; a null id is no
    component_id, unless its component has no other, and then is kept.  An empty
    table gives an empty result; other columns are not read.
    """
    rows = identified(docs, id_col, text_col, uid_col)
    prints = written(sketches(rows, words), "sketches")
    known = prints.where("size > 0").groupBy("digest").agg(F.min("_uid").alias("node"), F.min("_id").alias("least"), F.min(F.struct(F.coalesce("_id", F.lit(-(1 << 63))).alias("o"), "_uid")).alias("first"), F.any_value("listed").alias("listed"))
    nodes = written(known, "nodes")
    # Of the least values of two sets' union, both have listed those that they share; of a short set all are.
    need = F.least(F.lit(least_matches(LISTED, percent)), F.ceil(percent * F.size("listed") / 100)).cast("int")
    lists = written(nodes.select(F.posexplode("listed").alias("place", "value"), "node", need.alias("need")), "lists")
    shared = written(lists.groupBy("value").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("value", "hub"), "hubs")
    met = enough(written(lists.join(shared, "value"), "met"))
    sketched = written(prints.select(F.col("_uid").alias("node"), "size", "sketch").join(few(met), "node"), "sketched")

    # Similar texts meet in most of their lists; what meets its hub in few is left to the second search.
    often = met.where("node <> hub").groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LISTED // 4)
    stars = estimated(written(often.select("a", "b"), "stars"), sketched, percent)
    ends = stars.select(F.explode(F.array("a", "b")).alias("node"))
    links = verified(stars, shingle_sets(rows, few(ends), words), percent)
    lists = contested(met, sketched, components(links), percent)
    sets = shingle_sets(rows, few(lists), words)
    large = sets.select("node", (F.length("shingles") / 8).cast("long").alias("size"), "high").join(nodes.select("node", "listed"), "node")
    found = dealt(lists, large).repartition("shard").sortWithinPartitions("shard").mapInArrow(search(percent), "a long, b long")
    links = links.unionByName(verified(written(found, "found"), sets, percent))

    rooted = written(nodes.join(components(links), "node", "left").select("digest", "least", "first", F.coalesce("root", "node").alias("root")), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first")["_uid"].alias("_first")), "least")
    groups = written(rooted.join(least, "root").select("digest", "component_id", "_first"), "groups")
    out = prints.join(groups, "digest", "left")
    component = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("_id"))
    return out.select(F.col("_id").alias("doc_id"), F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"), "_uid", F.coalesce("_first", "_uid").alias("_first"))


def minhash_dedup(docs: DataFrame, words: int = 5, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: of each component of ``minhash_groups`` that with the smallest id stays.

    Of rows with equal ids the first of the table stays, null ids come first.
    Texts without words all stay.  Other columns are passed on whatever their names.
    """
    uid = free_name(docs, "_cs_uid")
    docs = numbered(docs, uid)
    keep = written(minhash_groups(docs, words, percent, id_col, text_col, uid).where("_uid = _first").select(F.col("_uid").alias(uid)), "kept")
    return docs.join(keep, uid, "left_semi").drop(uid)
