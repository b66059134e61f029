"""Pipelines: named steps from fetching to storing, run as one lazy plan up to the sinks."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators.base import rechunked
from textloom.operators.chunkers import chunk_inner
from textloom.operators.parsers import gap_chunks
from textloom.plans.registry import Component, component
from textloom.schema import full_chunks, with_document_metadata
from textloom.sources.files import text_documents

ORDER = {"fetch": "fetcher", "vision": "vision", "process": "chef", "chunk": "chunker", "refine": "refinery", "export": "porter", "write": "handshake"}


class Pipeline:
    """Steps in any order; they run as fetch, vision, process, chunk, refine, export, write."""

    def __init__(self, spark: SparkSession | None = None):
        self._spark = spark
        self._steps: list[tuple[str, Component, dict[str, Any]]] = []

    def add(self, step: str, alias: str, **options: Any) -> Pipeline:
        if step not in ORDER:
            raise ValueError(f"no step {step!r}")
        found = component(alias, ORDER[step])
        found.checked(options)
        self._steps.append((step, found, options))
        return self

    def fetch_from(self, alias: str = "file", **options: Any) -> Pipeline:
        return self.add("fetch", alias, **options)

    def see_with(self, alias: str, **options: Any) -> Pipeline:
        return self.add("vision", alias, **options)

    def process_with(self, alias: str, **options: Any) -> Pipeline:
        return self.add("process", alias, **options)

    def chunk_with(self, alias: str, **options: Any) -> Pipeline:
        return self.add("chunk", alias, **options)

    def refine_with(self, alias: str, **options: Any) -> Pipeline:
        return self.add("refine", alias, **options)

    def export_with(self, alias: str, **options: Any) -> Pipeline:
        return self.add("export", alias, **options)

    def store_in(self, alias: str, **options: Any) -> Pipeline:
        return self.add("write", alias, **options)

    def ordered(self) -> list[tuple[str, Component, dict[str, Any]]]:
        """The steps as they run; without a chef, texts are taken as they are. Of several vision steps the last counts."""
        steps = self._steps if any(s == "process" for s, _, _ in self._steps) else [*self._steps, ("process", component("text", "chef"), {})]
        out = []
        for name in ORDER:
            own = [x for x in steps if x[0] == name]
            out += own[-1:] if name in ("process", "vision") else own
        return out

    def _checked(self, has_input: bool) -> None:
        names = [s for s, _, _ in self._steps]
        if "chunk" not in names:
            raise ValueError("a pipeline needs a chunker")
        if not has_input and "fetch" not in names:
            raise ValueError("a pipeline needs a fetcher or texts")
        if names.count("process") > 1:
            raise ValueError("a pipeline has one chef at most")

    def run(self, texts: str | list[str] | DataFrame | None = None) -> DataFrame:
        """The chunks of texts, or of what is fetched, with their documents' metadata; sinks are written before it returns.

        texts may be a table of documents (doc_id, content, metadata). A step
        that fails raises RuntimeError with its number.
        """
        self._checked(texts is not None)
        spark = self._spark or (texts.sparkSession if isinstance(texts, DataFrame) else SparkSession.active())
        docs = texts if isinstance(texts, DataFrame) else text_documents(spark, texts) if texts is not None else None
        chunks: DataFrame | None = None
        for number, (step, c, options) in enumerate(self.ordered(), 1):
            try:
                given = c.checked(options)
                if step == "fetch":
                    if texts is None:
                        got = c.run(spark, **given)
                        docs = got if docs is None else docs.unionByName(got)
                elif step in ("vision", "process"):
                    docs = c.run(docs, **given)
                    if "chunks" in docs.columns:
                        chunks = gap_chunks(docs)
                elif step == "chunk":
                    chunks = self._chunk(docs, chunks, c, given)
                else:
                    if step in ("export", "write") or "id" not in chunks.columns:
                        chunks = with_document_metadata(full_chunks(chunks), docs) if "id" not in chunks.columns else chunks
                    got = c.run(chunks, **given)
                    chunks = got if step == "refine" else chunks
            except Exception as e:
                raise RuntimeError(f"step {number}, {step} with {c.alias}: {e}") from e
        return chunks if "id" in chunks.columns else with_document_metadata(full_chunks(chunks), docs)

    @staticmethod
    def _chunk(docs: DataFrame, chunks: DataFrame | None, c: Component, given: dict[str, Any]) -> DataFrame:
        inner = {"table": "tables", "code": "code"}.get(c.alias)
        if inner in docs.columns:
            parts = chunk_inner(docs, inner, c.alias, **given)
            if chunks is None:
                return parts
            place = F.row_number().over(Window.partitionBy("doc_id").orderBy("start_index", "pos")) - 1
            return chunks.select(*parts.columns).unionByName(parts).withColumn("pos", place.cast("int"))
        if chunks is None:
            return c.run(docs, id_col="doc_id", text_col="content", **given)
        return rechunked(chunks, c.run, **given)

    def to_config(self, path: str | None = None) -> list[dict[str, Any]]:
        """The steps as plain dictionaries, written as JSON if a path is given."""
        out = [{"type": s, "component": c.alias, **o} for s, c, o in self._steps]
        if path is not None:
            Path(path).write_text(json.dumps(out, indent=2), encoding="utf-8")
        return out

    @classmethod
    def from_config(cls, config: str | Path | list, spark: SparkSession | None = None) -> Pipeline:
        """A pipeline of steps: dictionaries as of to_config(), tuples (type, component) or (type, component, options), or a JSON file of them."""
        steps = json.loads(Path(config).read_text(encoding="utf-8")) if isinstance(config, (str, Path)) else config
        out = cls(spark)
        for x in steps:
            if isinstance(x, dict):
                if not {"type", "component"} <= x.keys():
                    raise ValueError("a step states type and component")
                out.add(x["type"], x["component"], **{k: v for k, v in x.items() if k not in ("type", "component")})
            elif len(x) in (2, 3):
                out.add(x[0], x[1], **(x[2] if len(x) == 3 else {}))
            else:
                raise ValueError("a step is a dictionary or a tuple of 2 or 3")
        return out

    @classmethod
    def from_recipe(cls, path: str | Path, spark: SparkSession | None = None) -> Pipeline:
        """The pipeline of a local recipe, a JSON object with steps."""
        steps = json.loads(Path(path).read_text(encoding="utf-8")).get("steps")
        if not steps:
            raise ValueError("the recipe has no steps")
        return cls.from_config(steps, spark)

    def describe(self) -> str:
        return " -> ".join(f"{s}({c.alias})" for s, c, _ in self.ordered()) if self._steps else "Empty pipeline"

    def reset(self) -> Pipeline:
        self._steps.clear()
        return self

    def __repr__(self) -> str:
        return f"Pipeline({self.describe()})"
