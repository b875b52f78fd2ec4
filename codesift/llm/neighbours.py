"""Approximate nearest neighbours (operator 3): multiprobe p-stable hashing and exact reranking.

A table has k hash functions floor((a . u + b) / w) of unit vectors u.  For each
query the cells of all functions are weighed by the chance that a neighbour
falls there, given its expected cosine.  Buckets, combinations of cells, are
visited in the order of that chance: a heap holds the next-best perturbations,
each popped set gives at most three more, and the search ends at the wanted
success.  A query with close neighbours visits few buckets and one without
visits many.  Tables are merged and the candidates ranked by their true cosine.
A shard of many vectors is cut into blocks, to each of which its queries go; a
task holds one block and the cosines of a bounded number of pairs.

k follows the number of vectors, the number of tables is that of the least
estimated work.  Equal vectors are one candidate.  A bucket is scored as a
matrix product where it lies, and only the best of it leave, so pairs are never written out.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codesift.llm.tables import small_batches, written

WIDTH = 3.0
#: Vectors of a bucket, about; hash functions that vary within a shard, the unit of a task's memory.
BUCKET, INNER = 48, 5
#: Estimated success of a query's search over all tables.
SUCCESS = 0.99
#: Vectors on which the expected cosine of a neighbour is fitted, and how many of them are queries.
SAMPLE, SAMPLE_QUERIES = 20_000, 200
#: Numbers of tables to choose from, and queries of the sample that the choice is made on.
TABLES, TRIALS = (1, 2, 3, 4), 24
#: Vectors of a block of the exact search for queries that found too few.
EXACT_BLOCK = 4096
#: Numbers in the vectors of a block, and cosines of pairs, that a task holds at a time.
BLOCK_NUMBERS, PAIRS = 1 << 20, 1 << 20
#: Cells of a function that have a bucket of their own; those beyond share the outermost.
CELLS = 16
WORD = (1 << 64) - 1


class Hashes:
    """The tables' functions, the same for the same dimension, k and number of tables.

    A bucket's code is the sum of random words for its cells, so that k has no
    bound; a shard's is that of the first functions.  Two buckets of one code
    would just be visited together.
    """

    def __init__(self, dim: int, k: int, tables: int, cosine: float):
        rng = np.random.default_rng(42)
        self.k, self.outer, self.cosine, self.tables = k, k - min(INNER, k - 1), cosine, tables
        self.a = rng.standard_normal((tables, dim, k))
        self.b = rng.uniform(0, WIDTH, (tables, k))
        self.names = rng.integers(0, 1 << 64, (k, CELLS), dtype=np.uint64)

    def codes(self, unit: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Shards and buckets."""
        cells = np.clip(np.floor((unit @ self.a[table] + self.b[table]) / WIDTH).astype(np.int64) + CELLS // 2, 0, CELLS - 1)
        names = self.names[np.arange(self.k), cells]
        return names[:, : self.outer].sum(axis=1, dtype=np.uint64).view(np.int64), names.sum(axis=1, dtype=np.uint64).view(np.int64)

    def chances(self, at: np.ndarray, table: int) -> list[list[tuple[float, float, int]]]:
        """For each function its cells, likeliest first: loss of log-chance against the best cell, share of all vectors, word."""
        spread = math.sqrt(max(1 - self.cosine**2, 1e-4))
        normal = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))
        found = []
        for i, x in enumerate(at.tolist()):
            own = math.floor((x + self.b[table, i]) / WIDTH)
            edges = [c * WIDTH - self.b[table, i] for c in range(own - 3, own + 5)]
            near = [normal((e - self.cosine * x) / spread) for e in edges]
            every = [normal(e) for e in edges]
            cells = [(max(near[j + 1] - near[j], 1e-300), every[j + 1] - every[j], int(self.names[i, min(max(own - 3 + j + CELLS // 2, 0), CELLS - 1)])) for j in range(7)]
            cells.sort(reverse=True)
            found.append([(math.log(p), share, name) for p, share, name in cells if p > 1e-3 or p == cells[0][0]])
        return found

    def probes(self, unit: np.ndarray, table: int) -> tuple[list[int], list[int], float]:
        """Shards and buckets of one query in the order of estimated success, as many as needed, and their share of all vectors."""
        cells = self.chances(unit @ self.a[table], table)
        order = sorted(range(self.k), key=lambda i: cells[i][0][0] - cells[i][1][0] if len(cells[i]) > 1 else math.inf)
        loss = [[c[0][0] - x[0] for x in c] for c in (cells[i] for i in order)]
        ratio = [[x[1] / max(c[0][1], 1e-300) for x in c] for c in (cells[i] for i in order)]
        code = [[x[2] - c[0][2] for x in c] for c in (cells[i] for i in order)]
        in_shard = [i < self.outer for i in order]
        best = math.exp(sum(c[0][0] for c in cells))
        share = math.prod(c[0][1] for c in cells)
        shard, bucket = sum(c[0][2] for c in cells[: self.outer]), sum(c[0][2] for c in cells)
        wanted = 1 - (1 - SUCCESS) ** (1 / self.tables)
        shards, buckets, reached, mass = [shard & WORD], [bucket & WORD], best, share
        free = sum(len(x) > 1 for x in loss)
        # A set of perturbations: cost, its last function, that function's cell, and the sums; functions come by the cost of their second cell.
        heap = [(loss[0][1], 0, 1, shard + (code[0][1] if in_shard[0] else 0), bucket + code[0][1], share * ratio[0][1])] if free else []
        while heap and reached < wanted:
            cost, j, r, s, b, m = heapq.heappop(heap)
            shards.append(s & WORD)
            buckets.append(b & WORD)
            reached += best * math.exp(-cost)
            mass += m
            here, held = code[j], in_shard[j]
            if r + 1 < len(here):
                step = here[r + 1] - here[r]
                heapq.heappush(heap, (cost + loss[j][r + 1] - loss[j][r], j, r + 1, s + step if held else s, b + step, m * ratio[j][r + 1] / ratio[j][r] if ratio[j][r] else 0.0))
            if j + 1 < free:
                step = code[j + 1][1]
                heapq.heappush(heap, (cost + loss[j + 1][1], j + 1, 1, s + step if in_shard[j + 1] else s, b + step, m * ratio[j + 1][1]))
                if r == 1:
                    back = here[1]
                    heapq.heappush(heap, (cost + loss[j + 1][1] - loss[j][1], j + 1, 1, (s - back if held else s) + (step if in_shard[j + 1] else 0), b - back + step, m * ratio[j + 1][1] / ratio[j][1] if ratio[j][1] else 0.0))
        return shards, buckets, mass


def matrix(column: pa.Array) -> np.ndarray:
    """The lists of a column, of equal length, as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The vectors times powers of two that keep squares within range; cosines stay what they are."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=-1, keepdims=True))
    return np.ldexp(vectors, -exponent)


def units(vectors: np.ndarray) -> np.ndarray:
    v = scaled(vectors)
    return v / np.sqrt((v * v).sum(axis=-1, keepdims=True))


def cosines(vector: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The cosine of one vector and each of the others, by the same sums wherever it is computed."""
    a, b = scaled(vector), scaled(others)
    return (b * a).sum(axis=1) / (math.sqrt((a * a).sum()) * np.sqrt((b * b).sum(axis=1)))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """_id and _vec (doubles): one vector an id, the least if they differ; none null, empty, zero or with a null or non-finite part."""
    vec = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("_id"), vec.alias("_vec")).where("_id is not null and _vec is not null")
    bad = F.exists("_vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad & F.exists("_vec", lambda x: x != 0))
    return rows.groupBy("_id").agg(F.min("_vec").alias("_vec"))


def sampled(classes: DataFrame, n: int) -> np.ndarray:
    """Unit vectors, about ``SAMPLE`` of all."""
    share = min(1.0, SAMPLE / max(n, 1))
    return units(matrix(classes.where(F.pmod(F.xxhash64("class"), F.lit(1_000_000)) < int(1_000_000 * share)).select("class", "_vec").orderBy("class").toArrow().column("_vec")))


def expected_cosine(u: np.ndarray, top: int) -> float:
    """A low quartile of the cosine of the last wanted neighbour, among a bounded sample."""
    if len(u) <= top:
        return 0.0
    found = []
    for q in range(0, len(u), max(1, len(u) // SAMPLE_QUERIES)):
        found.append(np.partition(np.delete(u @ u[q], q), -top)[-top])
    return float(np.clip(np.percentile(found, 25), 0.0, 0.999))


def plan(own: DataFrame, dim: int, n: int, top: int) -> Hashes:
    """The hash functions: k by the number of vectors, tables by the least share of vectors that sampled queries would visit."""
    k = max(2, round(math.log2(max(n / BUCKET, 4))))
    sample = sampled(own, n)
    cosine = expected_cosine(sample, top)
    best = None
    for tables in TABLES:
        hashes = Hashes(dim, k, tables, cosine)
        some = sample[:: max(1, len(sample) // TRIALS)][:TRIALS]
        work = sum(n * mass + len(buckets) for u in some for t in range(tables) for _, buckets, mass in [hashes.probes(u, t)])
        if best is None or work < best[0]:
            best = (work, hashes)
    return best[1]


def index_rows(hashes: Hashes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u = units(matrix(batch.column("_vec")))
                for t in range(hashes.tables):
                    shards, codes = hashes.codes(u, t)
                    none = pa.nulls(len(codes), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), t)), pa.array(shards), pa.array(codes), batch.column("class"), batch.column("_vec"), none], names=["lsh", "shard", "code", "class", "_vec", "probes"])

    return run


def shard_rows(hashes: Hashes):
    """The table and shard of each vector, without the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u = units(matrix(batch.column("_vec")))
                for t in range(hashes.tables):
                    shards, _ = hashes.codes(u, t)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(shards), t)), pa.array(shards)], names=["lsh", "shard"])

    return run


def blocked(index: DataFrame, probes: DataFrame, shards: DataFrame, dim: int) -> DataFrame:
    """Vectors and queries with the block they belong to: a query goes to every block of its shard, and to no shard without vectors.

    ``shards`` has table and shard of each vector.
    """
    blocks = F.ceil(F.count(F.lit(1)) / F.lit(max(1, BLOCK_NUMBERS // dim))).cast("int").alias("blocks")
    # A row for each shard that holds any vector: 24 bytes for hundreds of vectors.
    sizes = F.broadcast(written(shards.groupBy("lsh", "shard").agg(blocks), "shards"))
    own = index.join(sizes, ["lsh", "shard"]).withColumn("block", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    asked = probes.join(sizes, ["lsh", "shard"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return own.unionByName(asked).drop("blocks")


def probe_rows(hashes: Hashes):
    """One row for each query and shard that holds any bucket it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("_vec").to_pylist()
            for c, v, u in zip(batch.column("class").to_pylist(), vectors, units(matrix(batch.column("_vec"))) if vectors else [], strict=True):
                for t in range(hashes.tables):
                    shard, code, _ = hashes.probes(u, t)
                    shard, code = (np.array(x, dtype=np.uint64).view(np.int64) for x in (shard, code))
                    order = np.argsort(shard, kind="stable")
                    shards, first = np.unique(shard[order], return_index=True)
                    size = len(shards)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(first, shard.size).astype(np.int32)), pa.array(code[order]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(size, t)), pa.array(shards), pa.array([None] * size, pa.int64()), pa.array([c] * size, pa.int64()), pa.array([v] * size, pa.list_(pa.float64())), lists], names=["lsh", "shard", "code", "class", "_vec", "probes"])

    return run


SHARD_ROW = "lsh long, shard long, code long, class long, _vec array<double>, probes array<long>"
FOUND_ROW = "query long, class long, score double"


def best_of(near: np.ndarray, vector: np.ndarray, points: np.ndarray, ids: np.ndarray, where: np.ndarray, top: int) -> list[tuple[int, float]]:
    """The ``top`` best of ``points[where]``: id and cosine, the largest cosine first, then the smaller id.

    ``near`` are their cosines as the matrix product rounds them: all within a margin of the border are ranked by the exact measure.
    """
    if near.size > top:
        where = where[near >= np.partition(near, -top)[-top] - 1e-9]
    exact = cosines(vector, points[where])
    order = np.lexsort((ids[where], -exact))[:top]
    return list(zip(ids[where[order]].tolist(), exact[order].tolist(), strict=True))


def score_shards(top: int):
    """Rows sorted by table, shard and block, vectors before queries.  A query's best of a block leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ready = None, [], None

        def closed() -> tuple[np.ndarray, ...]:
            """Ids, vectors and unit vectors by bucket, and each bucket's code, begin and end."""
            code = np.concatenate([h[0] for h in held])
            order = np.argsort(code, kind="stable")
            ids, points = np.concatenate([h[1] for h in held])[order], np.concatenate([h[2] for h in held])[order]
            held.clear()
            buckets, first = np.unique(code[order], return_index=True)
            return ids, points, units(points), buckets, first, np.append(first[1:], code.size)

        for batch in batches:
            table, shard, block = (batch.column(c).to_numpy() for c in ("lsh", "shard", "block"))
            is_query = batch.column("code").is_null().to_numpy(zero_copy_only=False)
            changes = (table[1:] != table[:-1]) | (shard[1:] != shard[:-1]) | (block[1:] != block[:-1]) | (is_query[1:] != is_query[:-1])
            edge = np.flatnonzero(np.concatenate([[True], changes, [True]])) if len(table) else []
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                part, here = batch.slice(lo, hi - lo), (table[lo], shard[lo], block[lo])
                if here != at:
                    at, ready = here, None
                    held.clear()
                ids, vectors = part.column("class").to_numpy(), matrix(part.column("_vec"))
                if not is_query[lo]:
                    held.append((part.column("code").to_numpy(), ids, vectors))
                    continue
                if not held and ready is None:
                    continue
                ready = ready or closed()
                points, buckets = ready[1], ready[3]
                lengths = part.column("probes").value_lengths().to_numpy()
                flat = part.column("probes").flatten().to_numpy()
                place = np.searchsorted(buckets, flat)
                real = buckets[np.minimum(place, buckets.size - 1)] == flat
                query, place = np.repeat(np.arange(len(ids)), lengths)[real], place[real]
                # A few queries at a time: all of them against a block would be as many cosines as their product.
                turn = query // max(1, PAIRS // len(points))
                order = np.lexsort((place, turn))
                query, place, turn = query[order], place[order], turn[order]
                q = units(vectors)
                turns = np.flatnonzero(np.concatenate([[True], turn[1:] != turn[:-1], [True]])) if turn.size else []
                for t0, t1 in zip(turns[:-1], turns[1:], strict=True):
                    yield from scored(q, vectors, ids, query[t0:t1], place[t0:t1], ready)

    def scored(q: np.ndarray, vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, place: np.ndarray, ready: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        """The best of these queries, whose buckets are in order of place."""
        own, points, u, _, first, last = ready
        found: dict[int, list] = {}
        visit = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]]))
        for a, b in zip(visit[:-1], visit[1:], strict=True):
            f, e = first[place[a]], last[place[a]]
            near = q[query[a:b]] @ u[f:e].T
            for j, row in zip(query[a:b].tolist(), near, strict=True):
                found.setdefault(j, []).append((row, f, e))
        rows = []
        for j, parts in found.items():
            near = np.concatenate([p[0] for p in parts])
            where = np.concatenate([np.arange(p[1], p[2]) for p in parts])
            rows += [(int(ids[j]), *x) for x in best_of(near, vectors[j], points, own, where, top)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query", "class", "score"])

    return run


def searched(dealt: DataFrame, top: int) -> DataFrame:
    return dealt.repartition("lsh", "shard", "block").sortWithinPartitions("lsh", "shard", "block", F.col("code").isNull()).mapInArrow(score_shards(top + 1), FOUND_ROW)


def exact(own: DataFrame, seekers: DataFrame, n: int, top: int) -> DataFrame:
    """A few queries against all vectors, block by block: a query goes to every block."""
    blocks = math.ceil(n / EXACT_BLOCK)
    rows = own.select(F.lit(0).cast("long").alias("lsh"), F.pmod(F.xxhash64("class"), F.lit(blocks)).alias("shard"), F.lit(0).cast("long").alias("code"), "class", "_vec", F.lit(None).cast("array<long>").alias("probes"))
    asked = seekers.select(F.lit(0).cast("long").alias("lsh"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("shard"), F.lit(None).cast("long").alias("code"), "class", "_vec", F.array(F.lit(0).cast("long")).alias("probes"))
    return searched(rows.unionByName(asked).withColumn("block", F.lit(0)), top)


def nearest(vectors: DataFrame, every: int = 50, top: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``top`` largest cosines found for each row whose id ``every`` divides.

    All rows but the query's own are candidates; ties go to the smaller id.  The
    score is the cosine of the original vectors in double precision.  Vectors
    that are null, empty, zero or hold null or non-finite parts, and null ids,
    take no part; of repeated ids one row counts (the least vector); vectors of
    another length are apart.  Queries that find fewer than ``top`` in their
    buckets search all rows.  An empty table gives an empty result; other
    columns are not read.
    """
    small_batches(vectors.sparkSession)
    rows = usable(vectors, id_col, vector_col)
    same = Window.partitionBy("_vec").orderBy("_id")
    # The first top + 1 ids of a vector: enough for any query, its own id left out.
    firsts = rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= top + 1)
    classes = written(firsts.groupBy("_vec").agg(F.min("_id").alias("class"), F.sort_array(F.collect_list("_id")).alias("ids")).withColumn("dim", F.size("_vec")), "vectors")
    asked = written(rows.where(F.col("_id") % every == 0).join(classes.select("_vec", "class"), "_vec").select(F.col("_id").alias("query_id"), "class"), "queries")
    found = None
    for dim, n in sorted((r.dim, r.n) for r in classes.groupBy("dim").agg(F.count("class").alias("n")).collect()):
        own = classes.where(F.col("dim") == dim)
        seekers = own.join(asked.select("class").distinct(), "class", "left_semi").select("class", "_vec")
        hashes = plan(own, dim, n, top)
        indexed = own.select("class", "_vec")
        dealt = blocked(indexed.mapInArrow(index_rows(hashes), SHARD_ROW), seekers.mapInArrow(probe_rows(hashes), SHARD_ROW), indexed.mapInArrow(shard_rows(hashes), "lsh long, shard long"), dim)
        hits = written(searched(dealt, top).distinct(), "candidates")
        reached = hits.join(own.select("class", F.size("ids").alias("m")), "class").groupBy("query").agg(F.sum("m").alias("m"))
        poor = written(seekers.join(reached.where(F.col("m") > top), F.col("class") == F.col("query"), "left_anti"), "poor")
        if not poor.isEmpty():
            hits = hits.unionByName(exact(own, poor, n, top))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ranked = Window.partitionBy("query").orderBy(F.col("score").desc(), "class")
    best = found.distinct().withColumn("nth", F.row_number().over(ranked)).where(F.col("nth") <= top + 1)
    listed = best.join(classes.select("class", "ids"), "class").select("query", "score", F.explode("ids").alias("vec_id"))
    pairs = asked.join(listed, F.col("class") == F.col("query")).where("query_id <> vec_id")
    final = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
