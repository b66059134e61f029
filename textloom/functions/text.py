"""Small repairs of texts that come through other systems."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unescaped(text: Column) -> Column:
    """Line feeds, tabs and carriage returns that were written out as escapes."""
    for escape, char in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r")):
        text = F.replace(text, F.lit(escape), F.lit(char))
    return text


def sanitized(data: Column) -> Column:
    """Bytes as valid UTF-8; what isn't becomes the replacement character."""
    return F.make_valid_utf8(data.cast("string"))
