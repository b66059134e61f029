"""Embedding models behind one interface, their registry, and vector arithmetic as expressions.

No model is downloaded.  ``hashing`` is a deterministic stand-in: a bag of
hashed words, normalised.  Remote and local models come in as objects or
functions, registered under a name, a pattern or a provider.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of one matrix with that of the other; 0 where one of them is 0."""
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    n = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    return np.divide((a * b).sum(axis=1), n, out=np.zeros(len(n)), where=n > 0).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.float32:
    """Cosine of two vectors; 0 if one of them is 0."""
    n = float(np.linalg.norm(a)) * float(np.linalg.norm(b))
    return np.float32(float(np.dot(a, b)) / n if n else 0.0)


class Embedder:
    """A model: subclasses give embed, and the dimension unless one call may find it out."""

    def embed(self, text: str) -> np.ndarray:
        raise NotImplementedError

    def embed_batch(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [self.embed(t) for t in texts]

    def runs(self, parts: Sequence[str]) -> Callable[[Sequence[tuple[int, int]]], Sequence[np.ndarray]]:
        """A function that gives the vectors of parts[a:z] joined, for each (a, z) it gets."""
        return lambda bounds: self.embed_batch(["".join(parts[a:z]) for a, z in bounds])

    def embed_tokens(self, text: str) -> np.ndarray:
        """A vector for each word; each distinct one is embedded once."""
        place: dict[str, int] = {}
        at = [place.setdefault(w, len(place)) for w in text.split(" ")]
        return np.asarray(self.embed_batch(list(place)))[at]

    def similarity(self, a: np.ndarray, b: np.ndarray) -> np.float32:
        return cosine(a, b)

    @property
    def dimension(self) -> int:
        return len(self.embed("a"))

    def __call__(self, x: str | Sequence[str]) -> Any:
        return self.embed(x) if isinstance(x, str) else self.embed_batch(list(x))


class _Slots(dict):
    """Twice the slot of a word, one more if its sign is positive; filled as words come, emptied when it is large."""

    def __init__(self, dimension: int):
        super().__init__()
        self.dimension = dimension

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        h = int(hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()[:9], 16)
        self[word] = slot = 2 * ((h >> 4) % self.dimension) + (h >> 3 & 1)
        return slot


class Hashing(Embedder):
    """Words hashed into a fixed number of signed slots, normalised; the same everywhere, without any model."""

    _words = re.compile(r"\w+")

    def __init__(self, dimension: int = 64):
        self._dimension = dimension
        self._slots = _Slots(dimension)

    @property
    def dimension(self) -> int:
        return self._dimension

    def embed(self, text: str) -> np.ndarray:
        return self.embed_batch([text])[0]

    def embed_batch(self, texts: Sequence[str]) -> list[np.ndarray]:
        return list(self._normal(self._totals(texts)))

    def runs(self, parts):
        """Sums of the parts' counts where no word goes on from one to the next, that is, where each ends in white space."""
        if not all(p[-1:].isspace() for p in parts[:-1]):
            return super().runs(parts)
        upto = np.concatenate([np.zeros((1, self._dimension), np.int32), np.cumsum(self._totals(parts).astype(np.int32), axis=0, dtype=np.int32)])

        def vectors(bounds):
            a, z = np.array(bounds, np.int64).reshape(-1, 2).T
            return self._normal(upto[z] - upto[a])

        return vectors

    def _totals(self, texts: Sequence[str]) -> np.ndarray:
        """Signed counts of each text's words by slot."""
        flat: list[int] = []
        ends = [0]
        get, find = self._slots.__getitem__, self._words.findall
        for text in texts:
            flat += map(get, find(text.lower()))
            ends.append(len(flat))
        code = np.array(flat, np.int64)
        row = np.repeat(np.arange(len(texts)), np.diff(ends))
        total = np.bincount(row * self._dimension + (code >> 1), (code & 1) * 2.0 - 1, len(texts) * self._dimension)
        return total.reshape(len(texts), self._dimension)

    @staticmethod
    def _normal(total: np.ndarray) -> np.ndarray:
        v = total.astype(np.float32)
        n = np.sqrt((v * v).sum(axis=1, keepdims=True))
        return np.divide(v, n, out=v, where=n > 0)


class Static(Embedder):
    """A matrix with a vector for each token of a vocabulary: a text is the mean of its tokens' vectors.

    folder holds ``tokenizer.json`` and ``model.safetensors`` with a matrix
    ``embeddings``; ``config.json`` may say normalize. Tokens that the
    tokenizer doesn't know are left out; a text without any is the zero vector.
    """

    def __init__(self, folder: str):
        from tokenizers import Tokenizer as Fast

        place = Path(folder)
        self.tokenizer = Fast.from_file(str(place / "tokenizer.json"))
        self.matrix = self._matrix(place / "model.safetensors")
        config = json.loads((place / "config.json").read_text()) if (place / "config.json").exists() else {}
        self.normalize = bool(config.get("normalize", True))
        unknown = json.loads(self.tokenizer.to_str())["model"].get("unk_token")
        self.unknown = self.tokenizer.token_to_id(unknown) if unknown else None

    @staticmethod
    def _matrix(path: Path) -> np.ndarray:
        with open(path, "rb") as data:
            size = int.from_bytes(data.read(8), "little")
            about = json.loads(data.read(size))["embeddings"]
            kinds = {"F32": np.float32, "F16": np.float16, "F64": np.float64}
            if about["dtype"] not in kinds:
                raise ValueError(f"embeddings of kind {about['dtype']} can't be read")
            begin, end = about["data_offsets"]
            data.seek(8 + size + begin)
            return np.frombuffer(data.read(end - begin), kinds[about["dtype"]]).reshape(about["shape"]).astype(np.float32)

    @property
    def dimension(self) -> int:
        return self.matrix.shape[1]

    def _ids(self, texts: Sequence[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch(list(texts), add_special_tokens=False)
        return [np.array([i for i in e.ids if i != self.unknown], np.int64) for e in found]

    def embed(self, text: str) -> np.ndarray:
        return self.embed_batch([text])[0]

    def embed_batch(self, texts: Sequence[str]) -> list[np.ndarray]:
        out = []
        for ids in self._ids(texts):
            v = self.matrix[ids].mean(axis=0) if len(ids) else np.zeros(self.dimension, np.float32)
            n = float(np.linalg.norm(v))
            out.append(v / n if self.normalize and n else v)
        return out

    def embed_tokens(self, text: str) -> np.ndarray:
        """A vector for each token of its own tokenizer."""
        return self.matrix[self._ids([text])[0]]


class Function(Embedder):
    """A function from text, or from a list of texts, to vectors."""

    def __init__(self, f: Callable, batch: bool = False):
        self.f, self.batch = f, batch

    def embed(self, text: str) -> np.ndarray:
        return np.asarray(self.f([text])[0] if self.batch else self.f(text), np.float32)

    def embed_batch(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [np.asarray(v, np.float32) for v in self.f(list(texts))] if self.batch and texts else [self.embed(t) for t in texts]


class Remote(Embedder):
    """A service called in batches; a batch that fails is sent again one text at a time, each up to max_retries times.

    client(texts, model) gives vectors, in order or as (index, vector) pairs.
    """

    def __init__(self, client: Callable[[list[str], str], Sequence], model: str, batch_size: int = 128, max_retries: int = 3):
        self.client, self.model, self.batch_size, self.max_retries = client, model, batch_size, max_retries

    def _call(self, texts: list[str]) -> list[np.ndarray]:
        out = list(self.client(texts, self.model))
        if out and isinstance(out[0], tuple):
            out = [v for _, v in sorted(out, key=lambda x: x[0])]
        if len(out) != len(texts):
            raise ValueError("the service gave another number of vectors than texts")
        return [np.asarray(v, np.float32) for v in out]

    def embed(self, text: str) -> np.ndarray:
        for left in range(self.max_retries, 0, -1):
            try:
                return self._call([text])[0]
            except Exception:
                if left == 1:
                    raise
        raise ValueError("max_retries must be positive")

    def embed_batch(self, texts: Sequence[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for i in range(0, len(texts), self.batch_size):
            part = list(texts[i : i + self.batch_size])
            try:
                out += self._call(part)
            except Exception:  # noqa: BLE001 - one bad text must not lose the batch
                out += [self.embed(t) for t in part]
        return out


#: Providers whose clients can be registered; each is reached as provider://model.
PROVIDERS = ("azure_openai", "cloudflare", "cohere", "deepinfra", "gemini", "jina", "litellm", "mistral", "mixedbread", "model2vec", "nomic", "openai", "sentence-transformers", "together", "voyageai")
_models: dict[str, Callable[[], Embedder]] = {"hashing": Hashing}
_patterns: list[tuple[re.Pattern, Callable[[str], Embedder]]] = [(re.compile(r"hashing-(\d+)"), lambda name: Hashing(int(name.split("-")[1])))]
_providers: dict[str, Callable[[str], Embedder]] = {"model2vec": Static}
_types: list[tuple[type, Callable[[Any], Embedder]]] = []


def register_model(name: str, make: Callable[[], Embedder]) -> None:
    _models[name] = make


def register_pattern(pattern: str, make: Callable[[str], Embedder]) -> None:
    _patterns.append((re.compile(pattern), make))


def register_provider(name: str, make: Callable[[str], Embedder]) -> None:
    _providers[name] = make


def register_type(kind: type, wrap: Callable[[Any], Embedder]) -> None:
    _types.append((kind, wrap))


_made: dict[Any, Embedder] = {}


def embedder(x: Any = "hashing") -> Embedder:
    """The model meant by x: one already, ``provider://model``, a name, a name that fits a pattern, an object of a registered type, or a function.

    Named models are made once per worker.
    """
    if isinstance(x, Embedder):
        return x
    if isinstance(x, str):
        if x not in _made:
            _made[x] = _named(x)
        return _made[x]
    for kind, wrap in _types:
        if isinstance(x, kind):
            return wrap(x)
    if hasattr(x, "encode"):
        return Function(x.encode, batch=True)
    if callable(x):
        return Function(x)
    raise ValueError(f"no embedding model {x!r}")


def _named(name: str) -> Embedder:
    if "://" in name:
        provider, _, model = name.partition("://")
        if provider in _providers:
            return _providers[provider](model)
        raise ValueError(f"provider {provider} is {'known but has no client registered' if provider in PROVIDERS else 'unknown'}")
    if name in _models:
        return _models[name]()
    for pattern, make in _patterns:
        if pattern.fullmatch(name):
            return make(name)
    raise ValueError(f"no embedding model {name!r} is registered")


def embed_column(text: Column, model: Any = "hashing") -> Column:
    """Vectors of texts, one batch call per Arrow batch; null text gives null."""

    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = embedder(model)
        for texts in batches:
            rows = texts.to_pylist()
            at = [i for i, t in enumerate(rows) if t is not None]
            out: list = [None] * len(rows)
            for i, v in zip(at, e.embed_batch([rows[i] for i in at]), strict=True):
                out[i] = np.asarray(v, np.float32)
            yield pa.array(out, pa.list_(pa.float32()))

    return embed(text)


def with_embeddings(chunks: DataFrame, model: Any = "hashing", text_col: str = "text") -> DataFrame:
    """chunks with the column embedding made anew."""
    return chunks.withColumn("embedding", embed_column(F.col(text_col), model))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_column(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one of them is 0, null if the lengths differ."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(n == 0, 0.0).otherwise(dot(a, b) / n))


def squared_distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x * x)
