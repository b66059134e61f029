"""Tokenizers: the built-in ones as column expressions, all of them as Python objects for Arrow functions."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BUILT_IN = ("character", "word", "byte", "row")


class InvalidTokenizerError(ValueError):
    """A name that no backend knows; errors holds what each of them said."""

    def __init__(self, name: Any, errors: dict[str, str] | None = None):
        self.errors = errors or {}
        super().__init__(f"no tokenizer {name!r}" + "".join(f"; {k}: {v}" for k, v in self.errors.items()))


class Tokenizer:
    """Splits text into pieces that join to it again; encode gives pieces, not numbers, so no state is shared."""

    def encode(self, text: str) -> Sequence:
        raise NotImplementedError

    def decode(self, tokens: Sequence) -> str:
        raise NotImplementedError

    def count(self, text: str) -> int:
        return len(self.encode(text))

    def encode_batch(self, texts: Sequence[str]) -> list[Sequence]:
        return [self.encode(t) for t in texts]

    def decode_batch(self, lists: Sequence[Sequence]) -> list[str]:
        return [self.decode(t) for t in lists]

    def count_batch(self, texts: Sequence[str]) -> list[int]:
        return [self.count(t) for t in texts]


class Character(Tokenizer):
    def encode(self, text):
        return list(text)

    def decode(self, tokens):
        return "".join(tokens)

    def count(self, text):
        return len(text)


class Word(Tokenizer):
    """Parts between single spaces, empty ones too."""

    def encode(self, text):
        return text.split(" ")

    def decode(self, tokens):
        return " ".join(tokens)


class Byte(Tokenizer):
    def encode(self, text):
        return list(text.encode())

    def decode(self, tokens):
        try:
            return bytes(tokens).decode()
        except UnicodeDecodeError as e:
            raise ValueError("bytes end inside a character") from e

    def count(self, text):
        return len(text.encode())


class Row(Tokenizer):
    """Lines; an empty text has none."""

    def encode(self, text):
        return text.split("\n") if text else []

    def decode(self, tokens):
        return "\n".join(tokens)


class Wrapped(Tokenizer):
    """An object of another library with encode and decode, called without special tokens where it takes that."""

    def __init__(self, inner: Any):
        self.inner = inner

    def encode(self, text):
        f = getattr(self.inner, "encode_ordinary", None)
        if f is not None:
            return f(text)
        try:
            out = self.inner.encode(text, add_special_tokens=False)
        except TypeError:
            out = self.inner.encode(text)
        return getattr(out, "ids", out)

    def decode(self, tokens):
        return self.inner.decode(list(tokens))


class Counter(Tokenizer):
    """A function from text to a number: it can only count."""

    def __init__(self, f: Callable[[str], int]):
        self.f = f

    def count(self, text):
        return self.f(text)


@functools.cache
def _from_file(path: str) -> Tokenizer:
    errors = {}
    try:
        from tokenizers import Tokenizer as Fast

        return Wrapped(Fast.from_file(path))
    except Exception as e:  # noqa: BLE001 - every backend's reason is reported
        errors["tokenizers"] = str(e)
    try:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return Wrapped(tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))
    except Exception as e:  # noqa: BLE001
        errors["tiktoken"] = str(e)
    try:
        import sentencepiece

        return Wrapped(sentencepiece.SentencePieceProcessor(model_file=path))
    except Exception as e:  # noqa: BLE001
        errors["sentencepiece"] = str(e)
    raise InvalidTokenizerError(path, errors)


def tokenizer(x: Any) -> Tokenizer:
    """The tokenizer meant by x: one already, a built-in name, a vocabulary file, another library's object, or a counting function."""
    if isinstance(x, Tokenizer):
        return x
    if isinstance(x, str):
        kind = {"character": Character, "word": Word, "byte": Byte, "row": Row}.get(x)
        return kind() if kind else _from_file(x)
    if hasattr(x, "encode") and hasattr(x, "decode"):
        return Wrapped(x)
    if callable(x):
        return Counter(x)
    raise InvalidTokenizerError(x)


def count_column(text: Column, name: Any = "character") -> Column:
    """Number of tokens as an expression; an Arrow function only for tokenizers that aren't built in."""
    if name == "character":
        return F.length(text).cast("int")
    if name == "word":
        return F.size(F.split(text, " ", -1)).cast("int")
    if name == "byte":
        return F.octet_length(text).cast("int")
    if name == "row":
        return F.when(text == "", 0).otherwise(F.size(F.split(text, "\n", -1))).cast("int")

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        own = tokenizer(name)
        return pa.array([None if t is None else own.count(t) for t in texts.to_pylist()], pa.int32())

    return count(text)


def encode_column(text: Column, name: Any = "character") -> Column:
    """Tokens: strings of the built-in tokenizers (numbers for bytes), ids of others."""
    if name == "character":
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))
    if name == "word":
        return F.split(text, " ", -1)
    if name == "row":
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        own = tokenizer(name)
        return pa.array([None if t is None else list(own.encode(t)) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return encode(text)


def decode_column(tokens: Column, name: Any = "character") -> Column:
    """The text of tokens made by encode_column."""
    if name in ("character", "word", "row"):
        return F.array_join(tokens, {"character": "", "word": " ", "row": "\n"}[name])

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        own = tokenizer(name)
        return pa.array([None if t is None else own.decode(t) for t in lists.to_pylist()], pa.string())

    return decode(tokens)


def head_column(text: Column, n: Column, name: str = "character") -> Column:
    """The first n tokens as text; the whole text if it has fewer."""
    if name == "character":
        return F.substr(text, F.lit(1), F.greatest(n, F.lit(0)))
    sep = {"word": " ", "row": "\n"}[name]
    return F.array_join(F.slice(F.split(text, sep, -1), F.lit(1), F.greatest(n, F.lit(0))), sep)


def tail_column(text: Column, n: Column, name: str = "character") -> Column:
    """The last n tokens as text; the whole text if it has fewer, and for n = 0."""
    if name == "character":
        size = F.length(text)
        return F.when((n <= 0) | (n >= size), text).otherwise(F.substr(text, size - n + 1, n))
    sep = {"word": " ", "row": "\n"}[name]
    parts = F.split(text, sep, -1)
    size = F.size(parts)
    return F.when((n <= 0) | (n >= size), text).otherwise(F.array_join(F.slice(parts, size - n + 1, n), sep))
