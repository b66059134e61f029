"""Bounds on the memory of Python workers: they live long and share an executor's memory."""

from __future__ import annotations

import ctypes
import functools
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession


def _give_back_memory() -> None:
    """Let freed arrays of a few MB go back to the system at once: workers live long and share an executor's memory."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError):  # another C library
        return
    for parameter in (-1, -3):  # M_TRIM_THRESHOLD, M_MMAP_THRESHOLD
        mallopt(parameter, 4 << 20)


_give_back_memory()


def trimming(f: Callable) -> Callable:
    """A worker's generator function that gives its freed memory back when it ends, as idle workers stay."""

    @functools.wraps(f)
    def run(*args):
        try:
            yield from f(*args)
        finally:
            trim()

    return run


def trim() -> None:
    """Give freed memory of this worker back to the system."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Bound the Arrow batches of the session's queries, of which JVM and worker hold several at a time; a smaller bound of its own stays."""
    stated = re.fullmatch(r"(\d+)([bkmg]?)b?", str(spark.conf.get(ARROW_BYTES, None)).lower())
    if not stated or int(stated[1]) << 10 * "bkmg".index(stated[2] or "b") > limit:
        spark.conf.set(ARROW_BYTES, f"{limit}b")
