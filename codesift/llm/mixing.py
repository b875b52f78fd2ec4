"""Mixing sources to target weights (operator 7) by the cube method.

Each document of a source is due target / size copies.  The whole part is
taken; for the rest all documents start with the same inclusion probability,
and the flight moves them, three at a time, along the null space of the two
balancing constraints, number of documents and number of words, until one of
the three reaches 0 or 1.  Blocks of a source fly apart from each other, the
few that each leaves open fly together on the next level, and the last few of a
source land on the combination that keeps the words nearest.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.llm.tables import free_name, n_words, numbered, written

#: Documents of a block of the flight; 24 bytes each.
BLOCK = 4096
#: Sources that can be mixed: their list, about 100 bytes each, is held on the driver and broadcast.
MOST_SOURCES = 200_000
EXACT = 1e-9
#: Documents of a block that do not fly and, with the two the flight leaves, land together or go to the next level.
GROUND = 12


def targets(sizes: Sequence[float], weights: Sequence[float], most: float = 3.0) -> list[float]:
    """Shares of the sum of ``sizes`` by weight, none above ``most`` times its size; the excess is shared again by weight."""
    due, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in sorted(open_) if rest * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                due[i] = rest * weights[i] / total
            break
        for i in over:
            due[i] = most * sizes[i]
        rest -= sum(due[i] for i in over)
        open_ -= set(over)
    return due


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> None:
    """Moves the probabilities in place until at most two are neither 0 nor 1."""
    pool: list[int] = []
    draws = iter(rng.random(p.size + 8).tolist())
    for i in range(p.size):
        if not EXACT < p[i] < 1 - EXACT:
            p[i] = round(p[i])
            continue
        pool.append(i)
        while len(pool) == 3:
            a, b, c = pool
            u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(pool, u, strict=True) if x)
            down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(pool, u, strict=True) if x)
            step = up if next(draws) * (up + down) < down else -down
            for k, x in zip(pool, u, strict=True):
                p[k] += step * x
                if p[k] < EXACT or p[k] > 1 - EXACT:
                    p[k] = round(p[k])
            pool = [k for k in pool if 0 < p[k] < 1]


def land(p: np.ndarray, size: np.ndarray) -> None:
    """Rounds the open probabilities, a few at most, to the combination that keeps words, and then documents, nearest."""
    left = np.flatnonzero((p > 0) & (p < 1))
    choices = np.arange(1 << left.size)[:, None] >> np.arange(left.size) & 1
    moved = choices - p[left]
    cost = np.abs(moved @ size[left]) + 0.05 * size.mean() * np.abs(moved.sum(axis=1)) if left.size else np.zeros(1)
    p[left] = choices[cost.argmin()]


def fly(last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "place", "_ord", "_uid"], kind="stable").reset_index(drop=True)
        p, size = rows["p"].to_numpy(dtype=float, copy=True), rows["size"].to_numpy(dtype=float)
        # Some documents of all lengths stay on the ground: they make the landing exact.
        ground = np.unique(np.linspace(0, p.size - 1, min(GROUND, p.size)).round().astype(int))
        air = np.setdiff1d(np.arange(p.size), ground)
        order = np.argsort(rows["place"].to_numpy()[air], kind="stable")
        flying = p[air[order]]
        flight(flying, size[air[order]], np.random.default_rng([int(k) & (1 << 32) - 1 for k in key]))
        p[air[order]] = flying
        p[p < EXACT], p[p > 1 - EXACT] = 0, 1
        if last:
            land(p, size)
        rows["p"] = p
        return rows

    return run


def copies(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", uid_col: str | None = None) -> DataFrame:
    """_uid (or ``uid_col``), _id, size, source_size, target and copies of every row; ``mix`` describes them.

    The list of sources, which the weights are given for, is held on the driver
    and may have ``MOST_SOURCES``; documents never are.  Blocks are dealt by id
    and text; rows that are alike in both are dealt by their number where there are more than fit a block.
    """
    chosen = [F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"), F.col(f"`{source_col}`").cast("string").alias("_source")]
    rows = numbered(docs.select(*chosen), "_uid") if uid_col is None else docs.select(F.col(f"`{uid_col}`").alias("_uid"), *chosen)
    order = F.coalesce("_id", F.lit(-(1 << 63)))
    rows = written(rows.select("_uid", order.alias("_ord"), "_id", "_source", n_words(F.col("_text")).alias("size"), F.xxhash64(order, "_text", F.lit(seed)).alias("place")), "sizes")
    by_source = written(rows.groupBy("_source").agg(F.sum("size").alias("size"), F.count("size").alias("n")), "sources")
    if (found := by_source.count()) > MOST_SOURCES:
        raise ValueError(f"{found} sources; a mix can have {MOST_SOURCES}")
    sources = sorted(by_source.collect(), key=lambda r: (r._source is None, (r._source or "").encode()))
    due = targets([r.size for r in sources], [weights[i % len(weights)] for i in range(len(sources))], most)
    plan = []
    for i, (r, t) in enumerate(zip(sources, due, strict=True)):
        each = min(t / r.size, most) if r.size else 0.0
        whole = math.floor(each + EXACT)
        plan.append((i, r._source, r.size, float(t), whole, max(each - whole, 0.0), max(1, math.ceil(r.n / BLOCK))))
    if not plan:
        return rows.select("_uid", "_id", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("copies"))
    table = docs.sparkSession.createDataFrame(plan, "source int, _name string, source_size long, target double, whole long, p double, blocks long")
    rows = rows.join(F.broadcast(table), F.col("_source").eqNullSafe(F.col("_name"))).drop("_source", "_name")
    # At most (rows / BLOCK) places are over the limit.
    alike = written(rows.groupBy("source", "place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select(F.col("source").alias("_hot"), F.col("place").alias("_at")), "alike")
    if not alike.isEmpty():
        rows = rows.join(alike, (F.col("source") == F.col("_hot")) & (F.col("place") == F.col("_at")), "left").withColumn("place", F.when(F.col("_at").isNull(), F.col("place")).otherwise(F.xxhash64("place", "_uid"))).drop("_hot", "_at")
    blocks, done, level = max(p[6] for p in plan), None, 0
    schema = "source int, block long, _uid long, _ord long, size long, place long, p double"
    small = rows.select("source", F.pmod("place", F.col("blocks")).alias("block"), "_uid", "_ord", "size", "place", "p", "blocks")
    while True:
        last = blocks == 1
        flown = written(small.drop("blocks").groupBy("source", "block").applyInPandas(fly(last), schema), "flight")
        settled = flown.where((F.col("p") == 0) | (F.col("p") == 1)).select("_uid", F.col("p").cast("long").alias("more"))
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        level, blocks = level + 1, math.ceil((GROUND + 2) * blocks / BLOCK)
        small = flown.where("p > 0 and p < 1").withColumn("block", F.pmod(F.xxhash64("place", F.lit(level)), F.lit(blocks)))
    return rows.join(done, "_uid").select("_uid", "_id", "size", "source_size", "target", (F.col("whole") + F.col("more")).alias("copies"))


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size (words), source_size, target (of its source) and taken (words, repeats counted) of every row.

    Sources in the order of their code points, null last, get ``weights`` in
    turn and share 100 % of all words; none gets more than ``most`` times its
    own, and no document more than ``most`` copies.  The same rows give the same
    mix.  Null and empty texts have size 0; a source without words has target
    0; repeated rows are documents of their own; an empty table gives an empty
    result; other columns are not read.
    """
    found = copies(docs, weights, most, seed, id_col, text_col, source_col)
    return found.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as it is taken, and ``copy`` (from 1).

    Where the rows have a column ``copy`` it stays, and the number's name is ``copy_2`` (or the first such that is free).
    """
    uid, times, copy = (free_name(docs, n) for n in ("_cs_uid", "_cs_times", "copy"))
    docs = numbered(docs, uid)
    taken = copies(docs, weights, most, seed, id_col, text_col, source_col, uid).where("copies > 0").select(F.col("_uid").alias(uid), F.col("copies").cast("int").alias(times))
    return docs.join(taken, uid).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(uid, times)
