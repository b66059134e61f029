"""Chunking of document streams. Chunkers look at one document at a time, so a stream needs neither state nor watermark."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from textloom.operators.vectors import VectorTable
from textloom.schema import chunk_ids


def document_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    """Documents of Parquet files as they arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def write_stream(chunks: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Chunks added to a Parquet table, each exactly once."""
    writer = chunks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def upsert_stream(chunks: DataFrame, table: VectorTable, checkpoint: str, available_now: bool = False, refine: Callable[..., DataFrame] | None = None, **options: Any) -> StreamingQuery:
    """Chunks written into a vector table batch by batch; ids depend on the chunk, so a batch that is repeated changes nothing.

    refine, for instance refine_overlap, is applied to each batch: the chunks
    of a document come in one.
    """

    def write(batch: DataFrame, _: int) -> None:
        rows = refine(batch, **options) if refine else batch
        table.write(rows if "id" in rows.columns else chunk_ids(rows))

    writer = chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
