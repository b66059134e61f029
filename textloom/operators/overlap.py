"""Context from neighbouring chunks."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.tokenizers import Tokenizer, count_column, head_column, tail_column, tokenizer
from textloom.operators.base import per_document
from textloom.operators.kernels import split_text
from textloom.operators.rules import Level, Rules

EXPRESSIBLE = ("character", "word", "row")


def checked(context_size: int | float, mode: str, method: str) -> None:
    if isinstance(context_size, float) and not 0 < context_size <= 1:
        raise ValueError("a context_size that is a share must be above 0 and at most 1")
    if isinstance(context_size, int) and context_size <= 0:
        raise ValueError("context_size must be positive")
    if mode not in ("token", "recursive") or method not in ("suffix", "prefix", "justified"):
        raise ValueError("mode is token or recursive, method suffix, prefix or justified")


def refine_overlap(chunks: DataFrame, tokenizer_: Any = "character", context_size: int | float = 0.25, mode: str = "token", method: str = "suffix", rules: Rules | None = None, merge: bool = True) -> DataFrame:
    """chunks with the context of their neighbours in context, and added to the text if merge.

    suffix takes the head of the next chunk, prefix the tail of the one before,
    justified both.  A share is of the neighbour's token_count.  Merged text
    adds to token_count; places never change.  With prefix and merge, each chunk
    sees its predecessor as that was already merged.  A share that comes to no
    token gives nothing from the next chunk, but all of the one before.

    Suffix, justified and unmerged prefix by tokens are windows over the
    document's chunks; the rest passes each document's chunks through Python.
    """
    checked(context_size, mode, method)
    if mode == "token" and tokenizer_ in EXPRESSIBLE and (method != "prefix" or not merge):
        return _by_window(chunks, tokenizer_, context_size, method, merge)
    own = rules or Rules()
    fields = chunks.schema.names
    if "context" not in fields:
        chunks = chunks.withColumn("context", F.lit(None).cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" if " " in f.name else f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema)

    def fold(rows: list[dict]) -> list[dict]:
        return _fold(rows, tokenizer(tokenizer_), context_size, mode, method, own, merge)

    return per_document(chunks, fold, schema)


def _by_window(chunks: DataFrame, name: str, size: int | float, method: str, merge: bool) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("pos")

    def of(n: Column) -> Column:
        return F.floor(n * size).cast("int") if isinstance(size, float) else F.lit(size)

    after, after_n = F.lead("text").over(w), F.lead("token_count").over(w)
    before, before_n = F.lag("text").over(w), F.lag("token_count").over(w)
    near = chunks.withColumns({"_an": after_n, "_a": after, "_bn": before_n, "_b": before})
    head, tail = head_column(F.col("_a"), of(F.col("_an")), name), tail_column(F.col("_b"), of(F.col("_bn")), name)
    if method == "justified":
        front, back = F.coalesce(tail, F.lit("")), F.coalesce(head, F.lit(""))
        context = F.concat(front, back)
    else:
        front, back = (F.lit(""), F.coalesce(head, F.lit(""))) if method == "suffix" else (F.coalesce(tail, F.lit("")), F.lit(""))
        old = F.col("context") if "context" in chunks.columns else F.lit(None).cast("string")
        context = F.coalesce(head if method == "suffix" else tail, old)
    out = near.withColumns({"_front": front, "_back": back, "context": context})
    if merge:
        added = F.concat("_front", "_back")
        out = out.withColumns({
            "text": F.concat("_front", "text", "_back"),
            "token_count": F.when(added == "", F.col("token_count")).otherwise(F.col("token_count") + count_column(added, name)),
        })
    return out.select(*chunks.columns, *([] if "context" in chunks.columns else ["context"]))


def _fold(rows: list[dict], t: Tokenizer, size: int | float, mode: str, method: str, rules: Rules, merge: bool) -> list[dict]:
    def of(r: dict) -> int:
        return int(size * r["token_count"]) if isinstance(size, float) else size

    def take(text: str, n: int, tail: bool) -> str:
        if mode == "recursive":
            return nearest(text, rules, t, n, tail)
        tokens = t.encode(text)
        if n > len(tokens):
            return text
        return t.decode(tokens[-n:] if tail else tokens[:n])

    def apply(r: dict, front: str, back: str) -> None:
        r["context"] = front + back
        if merge and r["context"]:
            r["text"] = front + r["text"] + back
            r["token_count"] += t.count(r["context"])

    if method == "justified":
        found = [(take(rows[i - 1]["text"], of(rows[i - 1]), True) if i else "", take(rows[i + 1]["text"], of(rows[i + 1]), False) if i + 1 < len(rows) else "") for i in range(len(rows))]
        for r, (front, back) in zip(rows, found, strict=True):
            apply(r, front, back)
    elif method == "suffix":
        for r, after in zip(rows, rows[1:], strict=False):
            apply(r, "", take(after["text"], of(after), False))
    else:
        for before, r in zip(rows, rows[1:], strict=False):
            apply(r, take(before["text"], of(before), True), "")
    return rows


def _pieces(text: str, level: Level, t: Tokenizer, n: int) -> list[str]:
    """Pieces at one level, delimiters and spaces dropped unless the level says where they go."""
    if level.whitespace:
        return text.split(" ")
    if level.delimiters:
        return split_text(text, level.delimiters, level.include)
    tokens = t.encode(text)
    return t.decode_batch([tokens[i : i + max(1, n)] for i in range(0, len(tokens), max(1, n))])


def nearest(text: str, rules: Rules, t: Tokenizer, n: int, tail: bool, level: int = 0) -> str:
    """Whole pieces at the near end with fewer than n tokens in all; if none fits, of the nearest piece by the next level."""
    if not text or level >= len(rules.levels):
        return text
    pieces = _pieces(text, rules.levels[level], t, n)
    if not pieces:
        return ""
    order = pieces[::-1] if tail else pieces
    kept, total = [], 0
    for p in order:
        total += t.count(p)
        if total >= n:
            break
        kept.append(p)
    if not kept:
        return nearest(order[0], rules, t, n, tail, level + 1)
    return "".join(kept[::-1] if tail else kept)
