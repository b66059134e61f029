"""Schemas of documents, chunks and what parsing finds, and their invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLES = "array<struct<content:string,start_index:int,end_index:int>>"
CODE = "array<struct<content:string,language:string,start_index:int,end_index:int>>"
IMAGES = "array<struct<alias:string,content:string,start_index:int,end_index:int,link:string>>"
PIECE = "pos int, text string, start_index int, end_index int, token_count int"
CHUNK_COLUMNS = ["id", "doc_id", "pos", "text", "start_index", "end_index", "token_count", "context", "embedding", "metadata"]

DOCUMENT = "doc_id bigint, content string, metadata map<string,string>"
CHUNK = "id string, doc_id bigint, pos int, text string, start_index int, end_index int, token_count int, context string, embedding array<float>, metadata map<string,string>"

_OID = "6ba7b8129dad11d180b400c04fd430c8"


def name_uuid(name: Column) -> Column:
    """The version-5 UUID of a name in the OID namespace, as an expression: equal names, equal ids, on every run."""
    digest = F.sha1(F.concat(F.unhex(F.lit(_OID)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12)
    )


def chunk_ids(chunks: DataFrame, collection: str = "chunks") -> DataFrame:
    """chunks with the column id, named after collection, document, place and text."""
    name = F.concat(F.lit(f"{collection}::chunk-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("-"), F.col("pos").cast("string"), F.lit(":"), F.col("text"))
    return chunks.withColumn("id", name_uuid(name))


def full_chunks(chunks: DataFrame, collection: str = "chunks") -> DataFrame:
    """chunks in all columns of the schema, those missing null or empty."""
    blank = {"context": F.lit(None).cast("string"), "embedding": F.lit(None).cast("array<float>"), "metadata": F.create_map().cast("map<string,string>")}
    out = chunks if "id" in chunks.columns else chunk_ids(chunks, collection)
    out = out.withColumns({k: v for k, v in blank.items() if k not in out.columns})
    return out.select(*CHUNK_COLUMNS)


def is_blank(text: Column) -> Column:
    """Whether nothing is left of text without white space, control separators counting as such; true for null."""
    return F.coalesce(~text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(True))


def merged_metadata(document: Column, chunk: Column) -> Column:
    """Both maps in one; the chunk's value wins where both have a key."""
    empty = F.create_map().cast("map<string,string>")
    d, c = F.coalesce(document, empty), F.coalesce(chunk, empty)
    return F.map_concat(F.map_filter(d, lambda k, _: ~F.map_contains_key(c, k)), c)


def with_document_metadata(chunks: DataFrame, documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """chunks with their document's metadata below their own."""
    meta = documents.select(F.col(id_col).alias("doc_id"), F.col("metadata").alias("_document_metadata"))
    return chunks.join(meta, "doc_id", "left").withColumn("metadata", merged_metadata(F.col("_document_metadata"), F.col("metadata"))).select(*chunks.columns)


def reconstructed(chunks: DataFrame) -> DataFrame:
    """(doc_id, content) put together from chunks that may overlap: each adds what lies beyond the ones before it."""
    parts = F.array_sort(F.collect_list(F.struct("start_index", "end_index", "text")))
    zero = F.struct(F.lit("").alias("text"), F.lit(0).alias("end"))

    def step(acc: Column, x: Column) -> Column:
        skip = F.greatest(acc["end"] - x["start_index"], F.lit(0))
        fresh = F.when(x["end_index"] > acc["end"], F.substr(x["text"], skip + 1)).otherwise("")
        return F.struct(F.concat(acc["text"], fresh).alias("text"), F.greatest(acc["end"], x["end_index"]).alias("end"))

    return chunks.groupBy("doc_id").agg(F.aggregate(parts, zero, step)["text"].alias("content"))
