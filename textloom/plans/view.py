"""Chunks to look at, in a terminal or as a page of HTML, and the library's log."""

from __future__ import annotations

import html
import logging
import os
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from textloom.schema import reconstructed

LIGHT = ("#fde2e2", "#e2f0fd", "#e4f8e4", "#fdf6d8", "#efe4fb", "#fbe8d8")
DARK = ("#5b2a2a", "#24425c", "#28502a", "#5a4d17", "#46305e", "#5c3b1f")
_ANSI = (41, 44, 42, 43, 45, 46)


def spans(chunks: list[dict], text: str) -> list[tuple[int, int, tuple[int, ...]]]:
    """Ranges of the text with the numbers of the chunks that cover them: none, one, or several where they overlap."""
    cuts = sorted({0, len(text), *(min(len(text), max(0, c[k])) for c in chunks for k in ("start_index", "end_index"))})
    ranges = [(a, z) for a, z in zip(cuts, cuts[1:], strict=False) if z > a]
    return [(a, z, tuple(i for i, c in enumerate(chunks) if c["start_index"] <= a and z <= c["end_index"])) for a, z in ranges]


def _document(chunks: DataFrame, doc_id: Any, text: str | None) -> tuple[list[dict], str]:
    own = chunks.where(chunks["doc_id"].eqNullSafe(doc_id))
    rows = [r.asDict() for r in own.select("doc_id", "start_index", "end_index", "text", "token_count").orderBy("start_index", "end_index").collect()]
    if text is None:
        found = reconstructed(own).first()
        text = found["content"] if found else ""
    return rows, text


def printed(chunks: DataFrame, doc_id: Any, text: str | None = None) -> str:
    """One document's text with its chunks on backgrounds of different colours."""
    rows, text = _document(chunks, doc_id, text)
    return "".join(f"\033[{_ANSI[of[0] % 6]}m{text[a:z]}\033[0m" if of else text[a:z] for a, z, of in spans(rows, text))


def page(chunks: DataFrame, doc_id: Any, text: str | None = None, dark: bool = False, title: str = "Chunks") -> str:
    """One document as HTML; what several chunks cover is underlined, each range says which cover it."""
    rows, text = _document(chunks, doc_id, text)
    colours = DARK if dark else LIGHT
    parts = []
    for a, z, of in spans(rows, text):
        shown = html.escape(text[a:z])
        if of:
            about = ", ".join(f"{i + 1}: {rows[i]['start_index']}-{rows[i]['end_index']}, {rows[i]['token_count']} tokens" for i in of)
            line = ";text-decoration:underline" if len(of) > 1 else ""
            shown = f'<span style="background:{colours[of[0] % len(colours)]}{line}" title="{about}">{shown}</span>'
        parts.append(shown)
    back, front = ("#1b1b1b", "#eeeeee") if dark else ("#ffffff", "#111111")
    body = f'<h1>{html.escape(title)}</h1><p>{len(rows)} chunks, {len(text)} characters</p><pre style="white-space:pre-wrap">{"".join(parts)}</pre>'
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><body style="background:{back};color:{front};font-family:sans-serif">{body}</body>\n'


def save_page(path: str | Path, chunks: DataFrame, doc_id: Any, **options: Any) -> Path:
    """page() written to a file, which ends in .html whatever is stated."""
    to = Path(path)
    to = to if to.suffix == ".html" else to.with_name(to.name + ".html")
    to.write_text(page(chunks, doc_id, **options), encoding="utf-8")
    return to


_LEVELS = {"0": None, "off": None, "false": None, "1": "ERROR", "error": "ERROR", "2": "WARNING", "warning": "WARNING", "3": "INFO", "info": "INFO", "on": "INFO", "true": "INFO", "4": "DEBUG", "debug": "DEBUG"}


def logger(name: str = "") -> logging.Logger:
    """The library's logger, or the one below it with that name."""
    return logging.getLogger(f"textloom.{name}" if name else "textloom")


def configure_log(level: str | int | None = None, variable: str = "TEXTLOOM_LOG") -> bool:
    """Set the log's level by a name or a number from 0 (off) to 4, by the environment if none is stated; whether it is on."""
    stated = str(level if level is not None else os.environ.get(variable, "warning")).lower()
    if stated not in _LEVELS:
        raise ValueError(f"no log level {stated!r}")
    own, wanted = logger(), _LEVELS[stated]
    own.disabled = wanted is None
    own.setLevel(wanted or logging.CRITICAL + 1)
    if not own.handlers:
        own.addHandler(logging.StreamHandler())
        own.handlers[0].setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
    return wanted is not None
