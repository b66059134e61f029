"""Language models behind one interface, called with retries, one prompt or a column of them."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class Genie:
    """A model: client(prompt) gives text. A call that fails is made again after a wait that doubles, up to max_wait seconds."""

    def __init__(self, client: Callable[[str], str], attempts: int = 5, wait: float = 1.0, max_wait: float = 60.0):
        if attempts < 1:
            raise ValueError("attempts must be positive")
        self.client, self.attempts, self.wait, self.max_wait = client, attempts, wait, max_wait

    def generate(self, prompt: str) -> str:
        for n in range(self.attempts):
            try:
                return self.client(prompt)
            except Exception:
                if n + 1 == self.attempts:
                    raise
                time.sleep(min(self.max_wait, self.wait * 2**n))
        raise AssertionError

    def generate_batch(self, prompts: Sequence[str], concurrency: int = 1) -> list[str]:
        if concurrency <= 1:
            return [self.generate(p) for p in prompts]
        with ThreadPoolExecutor(concurrency) as pool:
            return list(pool.map(self.generate, prompts))

    def generate_json(self, prompt: str, fields: Sequence[str] = ()) -> Any:
        """The answer as JSON; ValueError if it isn't, or lacks one of the fields."""
        got = json.loads(self.generate(prompt))
        if lacking := [f for f in fields if not isinstance(got, dict) or f not in got]:
            raise ValueError(f"the answer lacks {', '.join(lacking)}")
        return got

    def generate_json_batch(self, prompts: Sequence[str], fields: Sequence[str] = ()) -> list[Any]:
        return [self.generate_json(p, fields) for p in prompts]

    def __call__(self, prompt: str) -> str:
        return self.generate(prompt)


def generate_column(prompt: Column, genie: Genie, concurrency: int = 10) -> Column:
    """Answers to a column of prompts, so many at once in each task; null prompts give null."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for prompts in batches:
            rows = prompts.to_pylist()
            at = [i for i, p in enumerate(rows) if p is not None]
            for i, answer in zip(at, genie.generate_batch([rows[i] for i in at], concurrency), strict=True):
                rows[i] = answer
            yield pa.array(rows, pa.string())

    return run(prompt)
