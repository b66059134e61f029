"""Queries over the supplied tables, one for each operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import table
from textloom.llm.decontaminate import leaks
from textloom.llm.langid import language_id
from textloom.llm.nndescent import duplicate_classes
from textloom.llm.ppm import lm_scores
from textloom.llm.retrieval_packing import retrieval_packed
from textloom.llm.sentences import dedup_sentences
from textloom.llm.simhash import simhash_groups
from textloom.llm.tokens import pack_tokens, token_counts
from textloom.llm.warc import reassembled, segmented


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each vector: the class it is in and the number of its links."""
    return duplicate_classes(table(spark, sf_dir, "embeddings")).classes.withColumnRenamed("id", "vec_id")


def op2_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return dedup_sentences(docs).select("doc_id", "text", "removed_bytes", "removed_runs")


def op6_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, written as segmented records with chunked bodies and put together again."""
    out = reassembled(segmented(table(spark, sf_dir, "pages")))
    page = F.nullif(F.regexp_extract("record_id", r"^urn:page:(-?\d*):", 1), F.lit("")).cast("bigint")
    return out.select(page.alias("page_id"), "target_uri", "status", F.decode("body", "UTF-8").alias("html"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op8_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_packed(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_near_dedup, op2_token_packing, op3_simhash_near_dedup, op4_language_id, op5_substring_dedup, op6_warc_reassembly, op7_lm_scoring, op8_retrieval_packing, op9_benchmark_decontamination, op10_token_counts)}


OP1_SQL = """
WITH RECURSIVE links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings AS a JOIN embeddings AS b
    ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding, b.embedding) >= 0.9
), reached AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION
    SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
)
SELECT vec_id, min(reached.b) AS class_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links
FROM embeddings JOIN reached ON vec_id = reached.a GROUP BY vec_id
"""

OP6_SQL = "SELECT page_id, url AS target_uri, 'ok' AS status, html FROM pages WHERE html IS NOT NULL"


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": OP1_SQL, "op6_warc_reassembly": OP6_SQL}
