"""The corpus pipeline: five stages, each over all that its predecessor kept.

Every stage takes and, but for the last, returns all columns of its documents,
whatever their names.  A null text is a text without words: it is never toxic
or contaminated, stays null, and is a copy of the empty texts.  A null id comes
before all others; a null source is a source of its own.  Repeated rows are
documents of their own until the near-dedup keeps one.  Empty tables pass
through; without labels of both classes nothing is toxic, without items nothing
is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.llm import decontamination, line_dedup, mixing, simhash, toxicity
from codesift.llm.tables import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a toxicity score of 0.5 or more go; the model learns from the labels of the rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = toxicity.scorer(*toxicity.train(docs, labels))
    return docs.where(score(F.col("text")) < 0.5)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a tenth of a source's documents go; n_chars follows."""
    return line_dedup.line_dedup(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are similar by 0.8 or more, directly or by others between, that with the smallest id stays."""
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, edited or not, go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, up to three times, numbered by ``copy`` (``copy_2`` where there is such a column)."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The toxicity model is fitted, and the mix is drawn by the cube method: SQL states neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's documents are written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
