"""Connected components by alternating large-star and small-star steps, one written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.llm.tables import written


def _large(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its least neighbour (or itself)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).repartition("m")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).repartition("m")
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for every node of ``edges`` (a, b: long) but the roots.

    Self-links are ignored and repeated links do no harm; rounds grow with the
    logarithm of the longest path.  The least neighbours are dealt out anew before
    they are joined: as the join then shuffles both its sides, Spark splits the
    side of a node with very many links.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    seen = None
    while True:
        state = edges.agg(F.count("a"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == seen or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        edges = written(_small(_large(edges).where("a <> b").distinct()).where("a <> b").distinct(), "links")
