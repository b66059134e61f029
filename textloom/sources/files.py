"""Documents from files, tables and texts: doc_id, content, metadata."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.schema import DOCUMENT


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The extension with its dot, in its own case; empty where the name has none or only begins with dots."""
    return F.regexp_extract(base_name(path), r"^\.*[^.].*?(\.[^.]*)$", 1)


def find_files(spark: SparkSession, path: str | None = None, dir: str | None = None, ext: Iterable[str] | str | None = None) -> DataFrame:
    """(path, length, content) of one file, or of all files below a directory with one of the given extensions.

    Exactly one of path and dir must be given. The listing and the reading are
    Spark's own, by partitions; content is only read if it is used. Files
    whose names begin with a dot or an underscore are skipped, as by every
    reader of Spark.
    """
    if (path is None) == (dir is None):
        raise ValueError("give either path or dir")
    reader = spark.read.format("binaryFile")
    try:
        found = reader.load(path) if path is not None else reader.option("recursiveFileLookup", True).load(dir)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path or dir) from e
        raise
    out = found.select("path", "length", "content")
    if dir is not None and ext is not None:
        out = out.where(extension(F.col("path")).isin([ext] if isinstance(ext, str) else list(ext)))
    return out


def find_file(spark: SparkSession, dir: str, name: str) -> DataFrame:
    """The file of that name right in a directory."""
    return find_files(spark, path=f"{dir.rstrip('/')}/{name}")


def file_documents(files: DataFrame) -> DataFrame:
    """Files as UTF-8 documents; bytes that aren't valid become the replacement character. The path gives doc_id."""
    text = F.make_valid_utf8(F.decode("content", "UTF-8"))
    return files.select(F.xxhash64("path").alias("doc_id"), text.alias("content"), F.create_map(F.lit("filename"), base_name(F.col("path"))).alias("metadata"))


def read_files(spark: SparkSession, path: str | None = None, dir: str | None = None, ext: Iterable[str] | str | None = None) -> DataFrame:
    """The documents of find_files()."""
    return file_documents(find_files(spark, path, dir, ext))


def text_documents(spark: SparkSession, texts: str | list[str]) -> DataFrame:
    """Documents numbered from 0 of texts that the driver holds."""
    rows = [texts] if isinstance(texts, str) else list(texts)
    return spark.createDataFrame([(i, t, {}) for i, t in enumerate(rows)], DOCUMENT)


def table_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", metadata_cols: Iterable[str] = ()) -> DataFrame:
    """The rows of any table as documents, the named columns as metadata; null values are left out of it."""
    pairs = [x for c in metadata_cols for x in (F.lit(c), df[c].cast("string"))]
    meta = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("content"), meta.alias("metadata"))


def joined_documents(df: DataFrame, id_col: str, order_col: str, text_col: str, separator: str = "\n") -> DataFrame:
    """Documents of several ordered rows each, such as the turns of a conversation. Rows without text are left out."""
    rows = F.array_sort(F.collect_list(F.when(df[text_col].isNotNull(), F.struct(df[order_col].alias("o"), df[text_col].alias("t")))))
    text = F.array_join(F.transform(rows, lambda r: r["t"]), separator)
    return df.groupBy(df[id_col].alias("doc_id")).agg(text.alias("content")).withColumn("metadata", F.create_map().cast("map<string,string>"))


def converted_documents(files: DataFrame, convert, extensions: Iterable[str] | None = None) -> DataFrame:
    """Documents that a converter makes of binary files, such as text recognition of scans and office formats.

    convert(data, name) gives the text, or a list of pages, which are joined by
    an empty line. With extensions, a file of any other is an error.
    """
    allowed = None if extensions is None else {e.lower() for e in extensions}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, name = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                suffix = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
                if allowed is not None and suffix not in allowed:
                    raise ValueError(f"{path}: files of kind {suffix or 'without extension'} can't be converted")
                got = convert(batch.column(2)[i].as_py(), name)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([got if isinstance(got, str) or got is None else "\n\n".join(got)], pa.string())], ["path", "content"])

    rows = files.select("path", base_name(F.col("path")).alias("name"), "content").mapInArrow(run, "path string, content string")
    return rows.select(F.xxhash64("path").alias("doc_id"), "content", F.create_map(F.lit("filename"), base_name(F.col("path"))).alias("metadata"))
