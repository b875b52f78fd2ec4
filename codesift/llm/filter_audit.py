"""Filter interaction audit (operator 12): what each filter removes in every order of the filters, from one pass.

Which filters a document fails is its mask, and the mask alone says what happens
to it at each step of each order.  So every mask (with the two labels) has a big
integer made of fields, one for each outcome of each step of each order: 1 where
the document has that outcome.  Adding these integers adds all fields at once.
A field is 64 bits wide and counts rows, which Spark itself numbers with 63, so
no field ever carries into the next and the sum unpacks to exact counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cache, reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesift.llm.tables import written

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a field.
FIELD = 8
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Parts whose sums a task holds at a time (about 30 kB each for five filters); when there are more, it hands its sums on and starts anew.
HELD_PARTS = 500
#: Sums that meet in one task at each level of the addition.
FAN_IN = 64

TOTALS = "part string, total binary"


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")


def standard_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text (never null): short, repetitive, shouting, markup."""
    words = word_list(text)
    return {
        "A": F.regexp_count(text, F.lit(WORD)) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


@cache
def orders(names: str) -> tuple[tuple[int, ...], ...]:
    """All orders of the filters as places in ``names``, sorted by their letters."""
    return tuple(permutations(range(len(names))))


@cache
def outcomes(names: str, mask: int, good: bool, toxic: bool) -> int:
    """The big integer of a document: field (order, step, outcome) is 1 where it has that outcome."""
    fields = np.zeros((len(orders(names)), len(names), len(OUTCOMES)), dtype="<i8")
    for i, order in enumerate(orders(names)):
        gone = False
        for step, f in enumerate(order):
            fails = bool(mask >> f & 1)
            removed = fails and not gone
            fields[i, step] = (not (gone or fails), removed, fails and gone, mask == 1 << f, removed and good, removed and toxic)
            gone |= fails
    return int.from_bytes(fields.tobytes(), "little")


def unpack(names: str, total: bytes) -> np.ndarray:
    """Counts by order, step and outcome."""
    return np.frombuffer(total, dtype="<i8").reshape(len(orders(names)), len(names), len(OUTCOMES))


def packed(names: str, total: int) -> bytes:
    return total.to_bytes(FIELD * len(orders(names)) * len(names) * len(OUTCOMES), "little")


def _sums(names: str, addends):
    """Adds by part the integers that ``addends`` gives for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([packed(names, t) for t in held.values()], pa.binary())], names=["part", "total"])

        for batch in batches:
            for part, number in addends(batch):
                held[part] = held.get(part, 0) + number
                if len(held) > HELD_PARTS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return run


def mask_sums(counts: DataFrame, names: str) -> DataFrame:
    """part and total of rows (part, mask, good, toxic, n): sums of big integers, one row for each part and task."""

    def addends(batch: pa.RecordBatch) -> Iterator[tuple[str, int]]:
        table = pa.Table.from_batches([batch]).group_by(["part", "mask", "good", "toxic"]).aggregate([("n", "sum")])
        for r in table.to_pylist():
            yield r["part"], r["n_sum"] * outcomes(names, r["mask"], r["good"], r["toxic"])

    return counts.mapInArrow(_sums(names, addends), TOTALS)


def part_sums(sums: DataFrame, names: str, tasks: int) -> DataFrame:
    """One row a part.  Sums of a part are added by groups of ``FAN_IN`` tasks, level by level, so no task meets more than a fixed number of them for each of its parts."""

    def addends(batch: pa.RecordBatch) -> Iterator[tuple[str, int]]:
        for part, total in zip(batch.column("part").to_pylist(), batch.column("total").to_pylist(), strict=True):
            yield part, int.from_bytes(total, "little")

    sums = sums.withColumn("task", F.spark_partition_id())
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        sums = sums.select("part", F.floor(F.col("task") / FAN_IN).cast("int").alias("task"), "total").repartition("part", "task").sortWithinPartitions("part", "task")
        sums = sums.mapInArrow(_by_key(names), "part string, task int, total binary")
    return sums.select("part", "total").repartition("part").sortWithinPartitions("part").mapInArrow(_sums(names, addends), TOTALS)


def _by_key(names: str):
    """Adds neighbouring rows of equal part and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int32()), pa.array([packed(names, total)], pa.binary())], names=["part", "task", "total"])
        for batch in batches:
            for part, task, number in zip(*(batch.column(c).to_pylist() for c in ("part", "task", "total")), strict=True):
                if key != (part, task):
                    if key is not None:
                        yield row()
                    key, total = (part, task), 0
                total += int.from_bytes(number, "little")
        if key is not None:
            yield row()

    return run


def mask_counts(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column], copies: str, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, mask, good, toxic and n: how many documents of a part fail just the filters of the mask.

    Bit i of the mask is the i-th letter of ``filters`` and ``copies`` in
    alphabetical order.  Copies of a text share all its other bits, so only
    (digest, part, labels) groups and their least ids are shuffled, never texts;
    a group of any size is counted where its rows lie before it moves.
    """
    names = "".join(sorted([*filters, copies]))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    mask = reduce(Column.bitwiseOR, (F.when(fails, 1 << names.index(name)).otherwise(0) for name, fails in filters.items()), F.lit(0))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), mask.cast("int").alias("mask"), F.sha2(text.cast("binary"), 256).alias("digest"))
    marks = labels.groupBy(F.col(f"`{id_col}`").cast("long").alias("_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(marks, "_id", "left").select("_id", "part", "mask", "digest", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    by = ["digest", "part", "mask", "good", "toxic"]
    # n_least: rows of the group that hold its least id; a null id is neither smaller nor larger than any.
    each = rows.groupBy("_id", *by).agg(F.count(F.lit(1)).alias("n"))
    groups = each.groupBy(*by).agg(F.sum("n").alias("n"), F.min("_id").alias("least"), F.sum(F.when(F.col("_id").isNull(), F.col("n"))).alias("n_null"), F.min_by("n", "_id").alias("n_least"))
    first = F.min("least").over(Window.partitionBy("digest"))
    groups = groups.withColumn("fine", F.coalesce("n_null", F.lit(0)) + F.when(F.col("least") == first, F.col("n_least")).otherwise(0))
    bit = 1 << names.index(copies)
    outcome = F.explode(F.array(F.struct(F.col("mask"), F.col("fine").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(bit)).alias("mask"), (F.col("n") - F.col("fine")).alias("n"))))
    return groups.select("part", "good", "toxic", outcome.alias("o")).where("o.n > 0").select("part", "o.mask", "good", "toxic", "o.n")


def filter_audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None, copies: str = "E", part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, zeros included, for each part, each order of the filters and each step.

    ``filters``: a failure condition (null: passes) for each letter, up to six in
    all; the letter ``copies`` is for texts identical to any of a smaller id, in
    whatever part and whether removed or not.  Columns: part, filter_order, step
    (from 1), and counts of documents: kept after the step, removed at it,
    redundant (fail its filter, were removed before), unique_fails (fail its
    filter alone), good_lost and toxic_lost (removed at it with quality or toxic
    1), shapley (removed by its filter, summed over all orders).

    A null part or text is the empty one; a null id is neither smaller nor larger
    than any, so it is no copy and makes none; rows of equal ids are no copies of
    each other.  A document with several labels counts as good or toxic if any of
    them says so; one without is neither.  An empty table has no parts and gives
    no rows.  Other columns are not read.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    filters = standard_filters(text) if filters is None else dict(filters)
    names = "".join(sorted([*filters, copies]))
    if len(set(names)) < len(names) or len(names) > 6 or any(len(k) != 1 for k in (*filters, copies)):
        raise ValueError("filters are up to six different letters")
    sums = written(mask_sums(mask_counts(docs, labels, filters, copies, part_col, id_col, text_col), names), "sums")
    totals = part_sums(sums, names, sums.rdd.getNumPartitions())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = np.array(orders(names))
        named = ["".join(names[f] for f in order) for order in orders(names)]
        for batch in batches:
            for part, total in zip(batch.column("part").to_pylist(), batch.column("total").to_pylist(), strict=True):
                counts = unpack(names, total)
                removed = counts[:, :, OUTCOMES.index("removed")]
                shapley = np.array([removed[letters == f].sum() for f in range(len(names))])
                n = letters.size
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * n, pa.string()),
                        pa.array(np.repeat(named, len(names)).tolist(), pa.string()),
                        pa.array(np.tile(np.arange(1, len(names) + 1, dtype=np.int32), len(named))),
                        *(pa.array(counts[:, :, i].ravel().astype(np.int64)) for i in range(len(OUTCOMES))),
                        pa.array(shapley[letters].ravel().astype(np.int64)),
                    ],
                    names=["part", "filter_order", "step", *OUTCOMES, "shapley"],
                )

    return totals.mapInArrow(rows, f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in OUTCOMES)}, shapley long")
