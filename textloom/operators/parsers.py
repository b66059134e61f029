"""From documents to their parts: tables, code, images and what lies between them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from textloom.functions.tables import Span, csv_table, pipe_spans, table_spans, workbook_tables
from textloom.functions.tokenizers import tokenizer
from textloom.operators.base import Piece
from textloom.schema import CODE, IMAGES, PIECE, TABLES
from textloom.sources.files import base_name, extension

GAPS = f"array<struct<{', '.join(x.replace(' ', ':') for x in PIECE.split(', '))}>>"
_FENCE = "`" * 3
_CODE = re.compile(_FENCE + r"(?P<kind>[\w+-]*)\n?(?P<body>.*?)\n?" + _FENCE, re.DOTALL | re.ASCII)
_PICTURE = r"!\[([^\]]*)\]\(([^)]+)\)"
_IMAGE = re.compile(rf"\[{_PICTURE}\]\(([^)]+)\)|{_PICTURE}")


def code_parts(text: str) -> list[dict[str, Any]]:
    """Fenced blocks: what is inside the fences and its language; places take in the fences."""
    return [{"content": m["body"], "language": m["kind"] or None, "start_index": m.start(), "end_index": m.end()} for m in _CODE.finditer(text)]


def image_parts(text: str) -> list[dict[str, Any]]:
    """Images, with a link around them or not. Named by their text, else by the last part of their path; repeated names are numbered."""
    out: list[dict[str, Any]] = []
    taken: set[str] = set()
    for m in _IMAGE.finditer(text):
        linked = m[2] is not None
        alt, source, link = (m[1], m[2], m[3]) if linked else (m[4], m[5], None)
        name = alt or ("base64_image" if source.startswith("data:") else source.rstrip("/").rsplit("/", 1)[-1])
        alias, n = name, 0
        while alias in taken:
            n += 1
            alias = f"{name}_{n}"
        taken.add(alias)
        out.append({"alias": alias, "content": source, "start_index": m.start(), "end_index": m.end(), "link": link})
    return out


def gap_pieces(text: str, spans: Iterable[Span], name: Any = "character") -> list[Piece]:
    """What no span covers, blank gaps left out."""
    t, out, at = tokenizer(name), [], 0
    for a, z in [*sorted(spans), (len(text), len(text))]:
        if a > at and (gap := text[at:a]).strip():
            out.append((gap, at, a, t.count(gap)))
        at = max(at, z)
    return out


def _spans(text: str, spans: Iterable[Span]) -> list[dict[str, Any]]:
    return [{"content": text[a:z], "start_index": a, "end_index": z} for a, z in spans]


def markdown_parts(text: str, name: Any = "character") -> dict[str, list]:
    tables, code, images = _spans(text, pipe_spans(text, True)), code_parts(text), image_parts(text)
    taken = [(p["start_index"], p["end_index"]) for p in (*tables, *code, *images)]
    fields = ("pos", "text", "start_index", "end_index", "token_count")
    gaps = [dict(zip(fields, (i, *p), strict=True)) for i, p in enumerate(gap_pieces(text, taken, name))]
    return {"tables": tables, "code": code, "images": images, "chunks": gaps}


def _parsed(df: DataFrame, text_col: str, parse, schema: str) -> DataFrame:
    """df with the columns of schema, made of its texts in one pass; of null texts they are null."""
    kind = T.StructType.fromDDL(schema)

    want = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([None if t is None else parse(t) for t in texts.to_pylist()], want)

    parts = "_parsed_parts"
    return df.withColumn(parts, run(df[text_col])).withColumns({f.name: F.col(f"{parts}.{f.name}") for f in kind}).drop(parts)


def parse_text(df: DataFrame, text_col: str = "content") -> DataFrame:
    """Documents as they are."""
    return df


def parse_markdown(df: DataFrame, text_col: str = "content", tokenizer_: Any = "character") -> DataFrame:
    """df with its texts' tables, code, images, and as chunks what lies between them."""
    schema = f"tables {TABLES}, code {CODE}, images {IMAGES}, chunks {GAPS}"
    return _parsed(df, text_col, lambda text: markdown_parts(text, tokenizer_), schema)


def parse_tables(df: DataFrame, text_col: str = "content") -> DataFrame:
    """df with its texts' pipe and HTML tables; an HTML table takes in the pipe tables it overlaps."""
    return _parsed(df, text_col, lambda text: {"tables": _spans(text, table_spans(text))}, f"tables {TABLES}")


def table_files(files: DataFrame) -> DataFrame:
    """CSV and xlsx files as documents of pipe tables, those of a workbook's sheets with an empty line between.

    Any other extension is an error. Places of a table count from the start of
    the document.
    """

    def convert(path: str, kind: str, data: bytes) -> dict[str, Any]:
        if kind == ".csv":
            found = [csv_table(data)]
        elif kind == ".xlsx":
            found = workbook_tables(data)
        else:
            raise ValueError(f"{path} is neither a CSV nor an xlsx file")
        spans, at = [], 0
        for t in found:
            spans.append((at, at + len(t)))
            at += len(t) + 1
        text = "\n".join(found)
        return {"content": text, "tables": _spans(text, spans)}

    schema = T.StructType.fromDDL(f"content string, tables {TABLES}")

    want = to_arrow_type(schema)

    @F.arrow_udf(schema)
    def run(paths: pa.Array, kinds: pa.Array, data: pa.Array) -> pa.Array:
        return pa.array([convert(p, k, d) for p, k, d in zip(paths.to_pylist(), kinds.to_pylist(), data.to_pylist(), strict=True)], want)

    rows = files.select("path", run(F.col("path"), F.lower(extension(F.col("path"))), F.col("content")).alias("p"))
    return rows.select(F.xxhash64("path").alias("doc_id"), "p.content", F.create_map(F.lit("filename"), base_name(F.col("path"))).alias("metadata"), "p.tables")


def gap_chunks(parsed: DataFrame) -> DataFrame:
    """The chunks of parse_markdown(), a row each."""
    return parsed.select("doc_id", F.explode("chunks").alias("c")).select("doc_id", "c.pos", "c.text", "c.start_index", "c.end_index", "c.token_count")
