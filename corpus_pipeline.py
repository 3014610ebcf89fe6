"""A corpus of documents through five stages to packed token sequences.

Each stage takes and returns a table of documents; all but the last keep its columns.
Stages are written as Parquet in the shared folder and read again, so a lost executor
costs no more than the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import decontaminate, packing, quality, repeats, simhash
from tidelog.llm.common import read
from tidelog.session import materialize


def good_quality(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, read(spark, root, "labels"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """One document, that with the least id, of each group of near copies."""
    return simhash.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """Documents without the passages that occur earlier."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(repeats.BATCH_ROWS))
    return repeats.strip(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontaminate.clean(docs, read(spark, root, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """Pieces of documents in full sequences of tokens."""
    return packing.report(docs)


STAGES = [
    ("quality", good_quality),
    ("near_copies", one_of_near_copies),
    ("repeats", without_repeats),
    ("benchmark", without_benchmark),
    ("packing", packed),
]

#: No SQL: the classifier, the fingerprints and the tokens are not SQL's.
ORACLE_SQL = None


def run(spark: SparkSession, root: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = read(spark, root, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, root)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
