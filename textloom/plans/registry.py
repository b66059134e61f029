"""Components by kind and alias, the built-in ones and those of users."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession

from textloom.functions.embeddings import with_embeddings
from textloom.operators import chunkers as c
from textloom.operators import parsers, sinks, vectors
from textloom.operators.base import table_function
from textloom.operators.overlap import refine_overlap
from textloom.operators.rules import Recipe, Rules, recipe_path
from textloom.sources import files

KINDS = ("fetcher", "vision", "chef", "chunker", "refinery", "porter", "handshake")
#: Options as users state them, and the parameters that they mean.
NAMES = {"tokenizer": "tokenizer_", "delim": "delimiters", "include_delim": "include"}


class Component(NamedTuple):
    kind: str
    alias: str
    run: Callable[..., Any]

    def options(self) -> set[str]:
        """What may be stated: the parameters of run but for its table."""
        names = list(inspect.signature(self.run).parameters)[1:]
        back = {v: k for k, v in NAMES.items()}
        return {back.get(n, n) for n in names} - {"id_col", "text_col"}

    def checked(self, options: dict[str, Any]) -> dict[str, Any]:
        """The parameters that options mean, recipes read; ValueError for what run doesn't know."""
        given = dict(options)
        if self.kind == "chunker" and "recipe" in given:
            path = given.pop("path", None)
            name, lang = given.pop("recipe"), given.pop("lang", "en")
            r = Recipe.load(path or recipe_path(name, lang))
            if "rules" in self.options() and r.rules:
                given.setdefault("rules", r.rules)
            if "delim" in self.options() and r.delimiters:
                given.setdefault("delim", list(r.delimiters))
                given.setdefault("include_delim", r.include)
        if unknown := given.keys() - self.options():
            raise ValueError(f"{self.kind} {self.alias} doesn't know {', '.join(sorted(unknown))}")
        if isinstance(given.get("rules"), dict):
            given["rules"] = Rules.from_dict(given["rules"])
        return {NAMES.get(k, k): v for k, v in given.items()}


_known: dict[tuple[str, str], Component] = {}


def register(kind: str, alias: str, run: Callable[..., Any]) -> Component:
    """Add a component; the same one again changes nothing, another one of that name is an error."""
    if kind not in KINDS:
        raise ValueError(f"no kind of component {kind!r}")
    if not callable(run) or not inspect.signature(run).parameters:
        raise ValueError(f"a {kind} is a function of at least its table")
    have = _known.get((kind, alias))
    if have is not None and have.run is not run:
        raise ValueError(f"there is a {kind} {alias!r} already")
    return _known.setdefault((kind, alias), Component(kind, alias, run))


def component(alias: str, kind: str | None = None) -> Component:
    found = [x for x in _known.values() if x.alias == alias and kind in (None, x.kind)]
    if not found:
        raise ValueError(f"no {kind or 'component'} {alias!r}; there are {', '.join(aliases(kind))}")
    if len(found) > 1:
        raise ValueError(f"{alias!r} is a {' and a '.join(x.kind for x in found)}: say which")
    return found[0]


def aliases(kind: str | None = None) -> list[str]:
    return sorted(x.alias for x in _known.values() if kind in (None, x.kind))


def unregister(kind: str, alias: str) -> None:
    _known.pop((kind, alias), None)


def decorator(kind: str) -> Callable[[str], Callable]:
    def named(alias: str) -> Callable:
        def keep(run: Callable) -> Callable:
            register(kind, alias, run)
            return run

        return keep

    return named


fetcher, vision, chef, chunker, refinery, porter, handshake = map(decorator, KINDS)


def text_chunker(alias: str) -> Callable:
    """Register a function from a text to pieces (text, start, end, tokens) as a chunker."""

    def keep(f: Callable) -> Callable:
        def run(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
            return table_function(df, id_col, text_col, f)

        register("chunker", alias, run)
        return f

    return keep


def sql_function(spark: SparkSession, name: str, pieces: Callable) -> None:
    """Make a function from a text to pieces callable in SQL: SELECT ... FROM t, LATERAL name(t.text)."""
    from pyspark.sql.functions import udtf

    class Cut:
        def eval(self, text: str):
            if text is not None:
                yield from ((i, *p) for i, p in enumerate(pieces(text)))

    spark.udtf.register(name, udtf(Cut, returnType="pos int, text string, start_index int, end_index int, token_count int"))


def _embeddings(chunks: DataFrame, embedding_model: Any = "hashing") -> DataFrame:
    return with_embeddings(chunks, embedding_model)


def _handshake(kind: str) -> Callable:
    def run(chunks: DataFrame, path: str, model: Any = "hashing", collection: str = "chunks") -> DataFrame:
        return vectors.store(chunks, path, kind, model, collection)

    return run


for _kind, _alias, _run in [
    ("fetcher", "file", files.read_files),
    ("chef", "text", parsers.parse_text),
    ("chef", "markdown", parsers.parse_markdown),
    ("chef", "table", parsers.parse_tables),
    ("chunker", "token", c.chunk_tokens),
    ("chunker", "sentence", c.chunk_sentences),
    ("chunker", "recursive", c.chunk_recursive),
    ("chunker", "fast", c.chunk_bytes),
    ("chunker", "semantic", c.chunk_semantic),
    ("chunker", "late", c.chunk_late),
    ("chunker", "code", c.chunk_code),
    ("chunker", "table", c.chunk_tables),
    ("chunker", "neural", c.chunk_spans),
    ("chunker", "slumber", c.chunk_guided),
    ("chunker", "teraflopai", c.chunk_segments),
    ("refinery", "overlap", refine_overlap),
    ("refinery", "embeddings", _embeddings),
    ("porter", "json", sinks.write_json),
    ("porter", "datasets", sinks.write_parquet),
    *[("handshake", k, _handshake(k)) for k in vectors.STORES],
]:
    register(_kind, _alias, _run)
