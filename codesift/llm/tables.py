"""Row identity, input columns and intermediate tables for the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir, or where that is unset and all runs on one machine, a local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = f"file://{tempfile.mkdtemp(prefix='codesift-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends here and lost executors cost no rerun.

    The table goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/codesift/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def drop() -> None:
        try:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
        except Exception:  # the JVM may be gone by then
            pass

    atexit.register(drop)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows that a task hands to Python at a time.  Spark's 64 MB lie in the JVM and in Python, and in the JVM twice while a buffer grows.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_BYTES`` for the session, unless it has a size of its own."""
    if (size := "spark.sql.execution.arrow.maxBytesPerBatch") not in spark.conf.getAll:
        spark.conf.set(size, str(BATCH_BYTES))


def columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only what an operator reads, under names that no other column can clash with."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"))


#: Files of a table whose numbers are broadcast (about 30 bytes each); a table of more is copied once instead.
NUMBERED_FILES = 500_000
#: Bits of a row number that hold the row's place in its file.
ROW_BITS = 36


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The rows and ``name``, a long that tells them apart and is the same however often and by however many cores they are read.

    Rows of a file are numbered by file and place in it.  Rows that a scan does
    not give directly (a join, data of the driver) are written once, with their numbers.
    """
    spark = df.sparkSession
    try:
        at = df.select("*", F.col("_metadata.file_path").alias("_cs_file"), F.col("_metadata.row_index").alias("_cs_row"))
    except AnalysisException:
        at = None
    files = at.select("_cs_file").distinct().orderBy("_cs_file").limit(NUMBERED_FILES + 1).toArrow().column(0).to_pylist() if at is not None else []
    if at is None or len(files) > NUMBERED_FILES or any(c.startswith("_cs_") for c in df.columns):
        return written(df.withColumn(name, F.monotonically_increasing_id()), "rows")
    numbers = spark.createDataFrame([(f, i << ROW_BITS) for i, f in enumerate(files)], "_cs_name string, _cs_base long")
    joined = at.join(F.broadcast(numbers), F.col("_cs_file") == F.col("_cs_name"))
    # Never null, so joins on it add no filter and all readers of a repartitioned table share one exchange.
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), F.coalesce(F.col("_cs_base") + F.col("_cs_row"), F.lit(-1)).alias(name))


def identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", uid_col: str | None = None) -> DataFrame:
    """``columns()`` with ``_uid``, the row's number (that of ``uid_col``, if given), and ``_ord``, which orders documents: their id, null first."""
    if uid_col is None:
        rows = numbered(columns(df, id_col, text_col), "_uid")
    else:
        rows = df.select(F.col(f"`{uid_col}`").alias("_uid"), F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    return rows.select("_uid", F.coalesce("_id", F.lit(-(1 << 63))).alias("_ord"), "_id", "_text")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or where the rows have such a column (in any letter case), the first of ``name_2``, ``name_3`` ... that they lack."""
    taken, n, free = {c.lower() for c in df.columns}, 1, name
    while free.lower() in taken:
        n += 1
        free = f"{name}_{n}"
    return free


def n_words(text: Column) -> Column:
    """How many words ``[^\\x20\\x09-\\x0D]+`` a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
