"""How functions over one text, or over one document's chunks, run on DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.memory import small_batches, trim
from textloom.schema import PIECE

Piece = tuple[str, int, int, int]  # text, start, end, tokens
#: Characters and bytes of rows that a worker holds before it sends them on.
OUT_BYTES = 4 << 20


def table_function(df: DataFrame, id_col: str, text_col: str, f: Callable[..., Iterable[tuple]], schema: str = PIECE, extra: tuple[str, ...] = (), numbered: bool = True) -> DataFrame:
    """(doc_id, rows of f(text, *extra)) of every document that has text, rows numbered by pos if numbered.

    Only the columns that f reads go to Python, by Arrow, in batches of bounded
    bytes; what it returns is sent on in batches too, so that neither a table
    nor a long document needs to fit with all its rows.
    """
    small_batches(df.sparkSession)
    fields = [x.strip() for x in _split_schema(schema)]
    kind = df.schema[id_col].dataType.simpleString()
    full = f"doc_id {kind}, {schema}"
    types = [_arrow(t) for t in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [(v.as_py() for v in c) for c in batch.columns[1:]]  # one row at a time
            origin: list[int] = []
            out: list[list[Any]] = [[] for _ in fields]
            size = 0

            def flush() -> pa.RecordBatch:
                arrays = [batch.column(0).take(pa.array(origin, pa.int64()))] + [pa.array(c, t) for c, t in zip(out, types, strict=True)]  # noqa: B023
                got = pa.RecordBatch.from_arrays(arrays, ["doc_id", *[x.split(" ")[0] for x in fields]])
                origin.clear()  # noqa: B023
                for c in out:  # noqa: B023
                    c.clear()
                return got

            for i, args in enumerate(zip(*columns, strict=True)):
                if args[0] is None:
                    continue
                for pos, row in enumerate(f(*args)):
                    origin.append(i)
                    values = (pos, *row) if numbered else row
                    for c, v in zip(out, values, strict=True):
                        c.append(v)
                    size += 64 + sum(len(v) if isinstance(v, str) else getattr(v, "nbytes", 0) for v in row)
                    if size > OUT_BYTES:
                        yield flush()
                        size = 0
            if origin:
                yield flush()
        trim()

    rows = df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("_text"), *[df[c].alias(f"_{i}") for i, c in enumerate(extra)])
    return rows.mapInArrow(run, full)


def per_document(chunks: DataFrame, f: Callable[[list[dict]], list[dict]], schema: str, order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """f over each document's rows in order. Documents meet by doc_id, sorted in their partition, and pass one at a time."""

    small_batches(chunks.sparkSession)
    kinds = pa.schema([pa.field(x.strip().split(" ", 1)[0], _arrow(x.strip())) for x in _split_schema(schema)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[dict] = []
        size = 0
        for batch in batches:
            for row in (r for a in range(0, batch.num_rows, 256) for r in batch.slice(a, 256).to_pylist()):
                if held and row["doc_id"] != held[0]["doc_id"]:
                    for own in f(held):
                        out.append(own)
                        size += 64 + sum(len(v) for v in own.values() if isinstance(v, str))
                        if size > OUT_BYTES or len(out) > 4096:
                            yield pa.RecordBatch.from_pylist(out, kinds)
                            out, size = [], 0
                    held = []
                held.append(row)
        out += f(held) if held else []
        for a in range(0, len(out), 4096):
            yield pa.RecordBatch.from_pylist(out[a : a + 4096], kinds)
        trim()

    return chunks.repartition("doc_id").sortWithinPartitions("doc_id", *order).mapInArrow(run, schema)


def _split_schema(ddl: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def _arrow(field: str) -> pa.DataType:
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(T.StructType.fromDDL(field)[0].dataType)


def rechunked(chunks: DataFrame, chunker: Callable[..., DataFrame], **options: Any) -> DataFrame:
    """Chunks of chunks: each is chunked as a text of its own, the results' places shifted to its start."""
    own = F.struct("doc_id", "pos", "start_index").alias("_parent")
    parts = chunker(chunks.select(own, "text"), id_col="_parent", text_col="text", **options)
    shift = F.col("doc_id.start_index")
    moved = parts.select(
        F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.pos").alias("parent_pos"), "pos", "text", (F.col("start_index") + shift).alias("start_index"), (F.col("end_index") + shift).alias("end_index"), "token_count"
    )
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("parent_pos", "pos")) - 1
    return moved.select("doc_id", place.cast("int").alias("pos"), "text", "start_index", "end_index", "token_count")
