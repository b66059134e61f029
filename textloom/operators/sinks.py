"""Writing chunks as JSON and Parquet."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame


def write_json(chunks: DataFrame, path: str, lines: bool = True) -> None:
    """JSON with all fields, null ones too.

    With lines, a folder of files with an object on each line, written by the
    executors. Without, one local file that holds an array indented by 4; its
    rows pass through the driver partition by partition.
    """
    if lines:
        chunks.write.option("ignoreNullFields", "false").json(path)
        return
    with Path(path).open("w", encoding="utf-8") as out:
        sep = "["
        for row in chunks.toLocalIterator():
            body = json.dumps(row.asDict(recursive=True), ensure_ascii=False, indent=4)
            out.write(sep + "\n    " + body.replace("\n", "\n    "))
            sep = ","
        out.write("[]" if sep == "[" else "\n]")


def write_parquet(chunks: DataFrame, path: str) -> None:
    chunks.write.parquet(path)
