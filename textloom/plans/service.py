"""What a service answers to requests: dictionaries in, lists of dictionaries out, and a table of stored pipelines.

Requests have defaults of their own (chunks of 512 tokens, threshold 0.5).  A
request is small; a table of texts goes through Pipeline instead.
"""

from __future__ import annotations

import json
import time
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from textloom.plans.registry import component

DEFAULTS: dict[str, dict[str, Any]] = {
    "token": {"chunk_size": 512, "chunk_overlap": 0},
    "sentence": {"chunk_size": 512, "chunk_overlap": 0, "min_sentences_per_chunk": 1, "min_characters_per_sentence": 12},
    "recursive": {"chunk_size": 512, "min_characters_per_chunk": 12},
    "semantic": {"chunk_size": 512, "threshold": 0.5},
    "code": {"chunk_size": 512},
}
_ESCAPES = {"\\n": "\n", "\\t": "\t", "\\r": "\r"}


def request_text(text: str) -> str:
    """A request's text with escaped line feeds, tabs and returns made whole, and lone surrogates as question marks."""
    for escaped, plain in _ESCAPES.items():
        text = text.replace(escaped, plain)
    return text.encode("utf-8", "replace").decode()


def chunk_request(spark: SparkSession, chunker: str, request: dict[str, Any]) -> list[list[dict]] | list[dict]:
    """The chunks of the request's text, a list for each where it has several."""
    if chunker not in DEFAULTS:
        raise ValueError(f"no endpoint for the chunker {chunker!r}")
    options = DEFAULTS[chunker] | {k: v for k, v in request.items() if k != "text"}
    given = request.get("text")
    texts = [given] if isinstance(given, str) else list(given or ())
    if not texts or not all(isinstance(t, str) and t.strip() for t in texts):
        raise ValueError("text is a string or a list of strings that aren't blank")
    found = component(chunker, "chunker")
    docs = spark.createDataFrame([(i, request_text(t)) for i, t in enumerate(texts)], "doc_id bigint, content string")
    rows = found.run(docs, id_col="doc_id", text_col="content", **found.checked(options)).orderBy("doc_id", "pos").collect()
    out: list[list[dict]] = [[] for _ in texts]
    for r in rows:
        out[r["doc_id"]].append({k: v for k, v in r.asDict().items() if k not in ("doc_id", "pos")})
    return out[0] if isinstance(given, str) else out


def refine_request(spark: SparkSession, refinery: str, request: dict[str, Any]) -> list[dict]:
    """The request's chunks refined; they themselves aren't changed."""
    chunks = request.get("chunks")
    if not chunks:
        raise ValueError("a request for refining has chunks")
    found = component(refinery, "refinery")
    rows = [(0, i, c["text"], c["start_index"], c["end_index"], c["token_count"]) for i, c in enumerate(chunks)]
    df = spark.createDataFrame(rows, "doc_id bigint, pos int, text string, start_index int, end_index int, token_count int")
    got = found.run(df, **found.checked({k: v for k, v in request.items() if k != "chunks"})).orderBy("pos").collect()
    return [c | {k: v for k, v in r.asDict().items() if k not in ("doc_id", "pos")} for c, r in zip(chunks, got, strict=True)]


class PipelineStore:
    """Pipelines kept in a JSON file, newest first."""

    def __init__(self, path: str | Path):
        self._path = Path(path)

    def _rows(self) -> dict[str, dict]:
        return json.loads(self._path.read_text(encoding="utf-8")) if self._path.exists() else {}

    def _save(self, rows: dict[str, dict]) -> None:
        fresh = self._path.with_suffix(".new")
        fresh.write_text(json.dumps(rows, indent=1), encoding="utf-8")
        fresh.replace(self._path)

    def create(self, name: str, steps: list[dict], description: str | None = None) -> dict:
        rows = self._rows()
        if any(r["name"] == name for r in rows.values()):
            raise ValueError(f"there is a pipeline {name!r} already")
        self._check(steps)
        now = time.time()
        row = {"id": str(uuid.uuid4()), "name": name, "description": description, "steps": steps, "created_at": now, "updated_at": now}
        self._save(rows | {row["id"]: row})
        return row

    @staticmethod
    def _check(steps: list[dict]) -> None:
        if not steps or any({"type", "component"} - s.keys() for s in steps):
            raise ValueError("a pipeline is a list of steps that state type and component")
        kinds = {"chunk": "chunker", "refine": "refinery"}
        for s in steps:
            if s["type"] not in kinds:
                raise ValueError(f"a stored pipeline has no step {s['type']!r}")
            component(s["component"], kinds[s["type"]]).checked({k: v for k, v in s.items() if k not in ("type", "component")})

    def list(self) -> list[dict]:
        return sorted(self._rows().values(), key=lambda r: -r["created_at"])

    def get(self, id_: str) -> dict:
        if id_ not in (rows := self._rows()):
            raise KeyError(id_)
        return rows[id_]

    def update(self, id_: str, **changes: Any) -> dict:
        row = self.get(id_)
        if unknown := changes.keys() - {"name", "description", "steps"}:
            raise ValueError(f"a pipeline has no {', '.join(sorted(unknown))}")
        self._check(changes.get("steps", row["steps"]))
        row |= changes | {"updated_at": time.time()}
        self._save(self._rows() | {id_: row})
        return row

    def delete(self, id_: str) -> None:
        row = self.get(id_)
        self._save({k: v for k, v in self._rows().items() if k != row["id"]})

    def execute(self, spark: SparkSession, id_: str, texts: DataFrame | str) -> DataFrame:
        """The chunks of texts(doc_id, content). A chunker after another one gets the chunks' texts joined by spaces."""
        from pyspark.sql import functions as F

        docs = texts if isinstance(texts, DataFrame) else spark.createDataFrame([(0, request_text(texts))], "doc_id bigint, content string")
        chunks: DataFrame | None = None
        for s in self.get(id_)["steps"]:
            kind = {"chunk": "chunker", "refine": "refinery"}[s["type"]]
            found = component(s["component"], kind)
            options = found.checked({k: v for k, v in s.items() if k not in ("type", "component")})
            if kind == "chunker":
                if chunks is not None:
                    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
                    docs = chunks.groupBy("doc_id").agg(F.array_join(parts["text"], " ").alias("content"))
                chunks = found.run(docs, id_col="doc_id", text_col="content", **options)
            elif chunks is None:
                raise ValueError("chunks are refined after chunking")
            else:
                chunks = found.run(chunks, **options)
        return chunks
