"""Line dedup (operator 10): lines that a large share of a site's pages contain are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.llm.tables import free_name, written

#: Flagged lines up to this many (about 60 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_LINES = 200_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def boilerplate(docs: DataFrame, ratio: float, min_pages: int, host_col: str, text_col: str) -> DataFrame:
    """_host, _line (MD5), _pages and _total of the lines on more than ``ratio`` of a host's pages.

    A host has at most (distinct lines of a mean page / ratio) of them.  Counts
    are summed in each task before the shuffle, so a hot host or line is no large group.
    """
    pages = docs.select(F.col(f"`{host_col}`").alias("_host"), F.col(f"`{text_col}`").alias("_text"))
    totals = pages.groupBy("_host").agg(F.count(F.lit(1)).alias("_total"))
    # A line counts once a page; blank lines are no boilerplate.
    each = F.transform(F.filter(F.array_distinct(_lines(F.col("_text"))), lambda x: F.length(F.trim(x)) > 0), _key)
    counts = pages.select("_host", F.explode(each).alias("_line")).groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_pages")).where(F.col("_pages") >= min_pages)
    joined = counts.join(totals.withColumnRenamed("_host", "_same"), F.col("_host").eqNullSafe(F.col("_same"))).drop("_same")
    return joined.where(F.col("_pages") > ratio * F.col("_total"))


def line_dedup(docs: DataFrame, ratio: float = 0.1, min_pages: int = 2, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, their texts without the lines on more than ``ratio`` of their host's pages.

    Lines end at a line feed and are compared exactly; lines of spaces are kept.
    At least ``min_pages`` pages must hold a line for it to go: a line of one
    page is no duplicate, however few pages the host has.  A null text stays null, a text of boilerplate alone becomes empty, a null host is a host
    of its own, repeated rows are pages of their own, an empty table gives an
    empty result.
    """
    flagged = written(boilerplate(docs, ratio, min_pages, host_col, text_col).groupBy("_host").agg(F.collect_set("_line").alias("_gone")), "boilerplate")
    small = flagged.agg(F.coalesce(F.sum(F.size("_gone")), F.lit(0))).first()[0] <= BROADCAST_LINES
    found = free_name(docs, "_cs_flagged")
    flagged = flagged.select(F.struct("_host", "_gone").alias(found))
    joined = docs.join(F.broadcast(flagged) if small else flagged, F.col(f"`{host_col}`").eqNullSafe(F.col(f"{found}._host")), "left")
    kept = F.array_join(F.filter(_lines(F.col(f"`{text_col}`")), lambda x: ~F.array_contains(F.col(f"{found}._gone"), _key(x))), "\n")
    return joined.withColumn(text_col, F.when(F.col(found).isNull(), F.col(f"`{text_col}`")).otherwise(kept)).drop(found)
