"""Rules of the recursive chunker, and recipes that state delimiters or rules as JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Level:
    """One level: delimiters, white space, a pattern, or nothing, which means windows of tokens."""

    delimiters: tuple[str, ...] | None = None
    whitespace: bool = False
    include: str | None = "prev"
    pattern: str | None = None
    pattern_mode: str = "split"

    def __post_init__(self) -> None:
        if isinstance(self.delimiters, str):
            object.__setattr__(self, "delimiters", (self.delimiters,))
        elif self.delimiters is not None:
            object.__setattr__(self, "delimiters", tuple(self.delimiters))
        if sum(map(bool, (self.delimiters, self.whitespace, self.pattern))) > 1:
            raise ValueError("a level has delimiters, white space or a pattern, not several of them")
        if self.delimiters is not None and any(d == "" for d in self.delimiters):
            raise ValueError("a delimiter is empty")
        if self.delimiters is not None and any(d == " " for d in self.delimiters):
            raise ValueError("state white space by whitespace=True")
        if self.include not in ("prev", "next", None) or self.pattern_mode not in ("split", "extract"):
            raise ValueError("include is prev, next or None, pattern_mode split or extract")


def _default() -> tuple[Level, ...]:
    quotes = "“”‘’\"'`"
    return (
        Level(("\n\n", "\r\n", "\n", "\r")),
        Level((". ", "! ", "? ")),
        Level(tuple("{}[]()<>|~:;,-" + quotes[:4]) + ("...",)),
        Level(whitespace=True),
        Level(),
    )


@dataclass(frozen=True)
class Rules:
    levels: tuple[Level, ...] = field(default_factory=_default)

    def __post_init__(self) -> None:
        object.__setattr__(self, "levels", tuple(x if isinstance(x, Level) else Level(**x) for x in self.levels))

    def to_dict(self) -> dict:
        return {"levels": [asdict(x) for x in self.levels]}

    @classmethod
    def from_dict(cls, data: dict) -> Rules:
        return cls(tuple(_level(x) for x in data["levels"]))


def _level(x: dict) -> Level:
    return Level(x.get("delimiters"), bool(x.get("whitespace")), x.get("include", x.get("include_delim", "prev")), x.get("pattern"), x.get("pattern_mode", "split"))


@dataclass(frozen=True)
class Recipe:
    """Delimiters and rules of one language, read from a local JSON file."""

    name: str
    language: str
    delimiters: tuple[str, ...] | None
    include: str | None
    rules: Rules | None
    metadata: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | Path) -> Recipe:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
        return cls.checked(data)

    @classmethod
    def checked(cls, data: dict) -> Recipe:
        """The recipe of a parsed file; ValueError says what is missing or of the wrong kind."""
        if not isinstance(data, dict):
            raise ValueError("a recipe is an object")
        for key in ("name", "language", "recipe"):
            if key not in data:
                raise ValueError(f"the recipe has no {key}")
        if data.get("schema", "v1") != "v1":
            raise ValueError("the recipe's schema is not v1")
        body = data["recipe"]
        if not isinstance(body, dict) or not ({"delimiters", "recursive_rules"} & body.keys()):
            raise ValueError("a recipe states delimiters or recursive_rules")
        delimiters = body.get("delimiters")
        if delimiters is not None and not (isinstance(delimiters, list) and all(isinstance(d, str) and d for d in delimiters)):
            raise ValueError("delimiters is a list of strings that aren't empty")
        rules = body.get("recursive_rules")
        return cls(data["name"], data["language"], tuple(delimiters) if delimiters else None, body.get("include_delim", "prev"), Rules.from_dict(rules) if rules else None, data.get("metadata", {}))


def recipe_path(name: str, lang: str = "en", folder: str | Path = "recipes") -> Path:
    """Where a named recipe lies in a folder of recipes."""
    path = Path(folder) / f"{name}_{lang}.json"
    if not path.exists():
        raise ValueError(f"no recipe {name} for {lang} in {folder}")
    return path
