"""Command line: ``python -m textloom.plans.cli chunk|pipeline``, with options as key=value."""

from __future__ import annotations

import argparse
import json
import re
import sys
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from textloom.plans.pipeline import Pipeline

_WORDS = {"true": True, "false": False, "none": None, "null": None}


def typed(text: str) -> Any:
    """The value meant by an option's text: true, false, none, a whole number, another number, or the text itself."""
    if text.lower() in _WORDS:
        return _WORDS[text.lower()]
    try:
        number = float(text)
    except ValueError:
        return text
    whole = not re.search(r"[.e]", text, re.IGNORECASE) and number.is_integer()
    return int(number) if whole else number


def parsed_options(given: Sequence[str] | None) -> dict[str, Any]:
    """Options of key=value each; a key alone is true, and the last of a key counts."""
    pairs = [x.partition("=") for x in given or ()]
    return {k.strip(): typed(v.strip()) if eq else True for k, eq, v in pairs}


def merged_options(stated: dict[str, Any], parsed: dict[str, Any]) -> dict[str, Any]:
    """Both; an option that is stated and not None wins."""
    return parsed | {k: v for k, v in stated.items() if v is not None}


def _arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="textloom")
    sub = top.add_subparsers(dest="command", required=True)
    chunk = sub.add_parser("chunk", help="chunks of a text, a file or a folder")
    chunk.add_argument("text")
    chunk.add_argument("--chunker", default="recursive")
    chunk.add_argument("--chunk-size", type=int)
    chunk.add_argument("--option", action="append", metavar="KEY=VALUE")
    chunk.add_argument("--output", help="folder for JSON lines; else they are printed")
    line = sub.add_parser("pipeline", help="the chunks of a pipeline")
    line.add_argument("text", nargs="?")
    line.add_argument("--config", help="JSON file of steps")
    line.add_argument("--step", action="append", metavar="TYPE:COMPONENT[,KEY=VALUE...]", help="a step, in any order")
    line.add_argument("--output", help="folder for JSON lines; else they are printed")
    return top


def _step(text: str) -> tuple[str, str, dict[str, Any]]:
    head, *options = text.split(",")
    kind, colon, name = head.partition(":")
    if not colon:
        raise ValueError(f"{text!r} isn't type:component")
    return kind, name, parsed_options(options)


def _sources(pipeline: Pipeline, text: str | None) -> str | None:
    """The text, or nothing where it names files, which become the first step."""
    if text is not None and len(text) < 4096 and "\n" not in text and Path(text).exists():
        pipeline.fetch_from("file", path=text)
        return None
    return text


def run(arguments: Sequence[str], spark: SparkSession) -> DataFrame:
    """The chunks that a command line asks for."""
    a = _arguments().parse_args(arguments)
    if a.command == "chunk":
        options = merged_options({"chunk_size": a.chunk_size}, parsed_options(a.option))
        pipeline = Pipeline(spark).chunk_with(a.chunker, **options)
    else:
        steps = [_step(x) for x in a.step or ()]
        pipeline = Pipeline.from_config(a.config if a.config else steps, spark)
        for kind, name, options in steps if a.config else ():
            pipeline.add(kind, name, **options)
    chunks = pipeline.run(_sources(pipeline, a.text))
    if a.output:
        chunks.write.mode("overwrite").json(a.output)
    return chunks


def main(arguments: Sequence[str] | None = None) -> int:
    given = list(sys.argv[1:] if arguments is None else arguments)
    spark = SparkSession.builder.getOrCreate()
    chunks = run(given, spark)
    if "--output" not in given:
        for row in chunks.select("doc_id", "pos", "text", "start_index", "end_index", "token_count").orderBy("doc_id", "pos").toLocalIterator():
            print(json.dumps(row.asDict(), ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
