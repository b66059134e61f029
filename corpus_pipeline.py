"""A corpus pipeline: five stages, each on all that its predecessor kept.

    identify     documents in no known language go
    deduplicate  one document of each group of near copies stays
    shorten      sentences in repeated passages go, the first passage stays
    protect      documents with benchmark items go
    pack         the rest is packed into windows with its nearest neighbours

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each result as Parquet into the shared folder and reads it for the next stage.
A stage begins with small heaps, as executors keep what the one before took.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.common import shrink_heaps, small_batches, table
from textloom.llm.decontaminate import decontaminated
from textloom.llm.langid import filtered
from textloom.llm.retrieval_packing import retrieval_packed
from textloom.llm.sentences import shortened
from textloom.llm.simhash import deduplicated
from textloom.storage import written


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null, empty and blank texts go."""
    small_batches(spark)
    shrink_heaps(spark)
    return filtered(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of exact and near copies: that of the least doc_id. Rows without text stay."""
    small_batches(spark)
    shrink_heaps(spark)
    return deduplicated(docs)


def shorten(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentences that repeat a passage seen before; those left without text go."""
    small_batches(spark)
    shrink_heaps(spark)
    return shortened(docs)


def protect(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, neither word for word nor nearly."""
    shrink_heaps(spark)
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of doc_ids with the places of their words."""
    small_batches(spark)
    shrink_heaps(spark)
    return retrieval_packed(docs)


STAGES = [("identify", identify), ("deduplicate", deduplicate), ("shorten", shorten), ("protect", protect), ("pack", pack)]

#: Hyperplane codes, a fitted classifier and greedy packing have no SQL; run() is tested against plain code stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
