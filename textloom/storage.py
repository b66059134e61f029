"""Intermediate tables that survive the loss of an executor.

They are written below the folder that the session names in
``spark.checkpoint.dir``.  Only a local session without that setting gets a
temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; raises where a cluster names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="textloom-")
    return _own[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, its lineage cut."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/textloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._textloom_path = path
    return back


def dropped(df: DataFrame) -> None:
    """Delete a table made by written() that nothing reads any more."""
    path = getattr(df, "_textloom_path", None)
    if path is None:
        return
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
