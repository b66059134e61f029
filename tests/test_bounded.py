import re
import time

import pyarrow as pa
import pytest

from textloom import catalog
from textloom.functions.embeddings import Embedder, embedder
from textloom.memory import ARROW_BYTES
from textloom.operators import base, chunkers
from textloom.operators.overlap import refine_overlap


@pytest.fixture
def worker(spark, monkeypatch):
    """Makes a query's function over Arrow batches, as a worker gets it, the query's result."""
    spark.conf.unset(ARROW_BYTES)
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, schema: f)


def test_late_chunks_leave_in_small_batches(spark, worker):
    df = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    run = chunkers.chunk_late(df, chunk_size=1, tokenizer_="word", min_characters_per_chunk=1)
    texts = [" ".join(f"w{i}" for i in range(20_000)), "b c", None]
    got = list(run(iter([pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(texts)], ["doc_id", "_text"])])))
    assert len(got) > 1 and max(b.nbytes for b in got) < 2 * base.OUT_BYTES
    assert sum(b.num_rows for b in got) == 40_002 and spark.conf.get(ARROW_BYTES) == "8388608b"
    assert got[0].column(6).type == pa.list_(pa.float32()) and got[-1].column(1).to_pylist()[-3:] == [0, 1, 2]


def test_documents_leave_in_small_batches(spark, worker):
    df = spark.createDataFrame([(1, 0, "x", 0, 1, 1)], "doc_id bigint, pos int, text string, start_index int, end_index int, token_count int")
    run = refine_overlap(df, mode="recursive", method="justified")
    rows = [{"doc_id": i // 3, "pos": i % 3, "text": "a b", "start_index": 0, "end_index": 3, "token_count": 3, "context": None} for i in range(10_000)]
    got = list(run(iter([pa.RecordBatch.from_pylist(rows)])))
    assert sum(b.num_rows for b in got) == 10_000 and max(b.num_rows for b in got) <= 4097
    assert spark.conf.get(ARROW_BYTES) == "8388608b"


@pytest.mark.parametrize("text", ["", "...", " . a", "One. Two!  Three", "a.\n\n.b ?! c. \t", "?a", "x" * 99 + ".", "no mark", ". . a b"])
def test_sentence_spans(text):
    assert catalog._sentence_spans(text) == [{"start": m.start(), "end": m.end()} for m in re.finditer(r"[^.!?]+[.!?]+\s*", text)]


def test_sentence_spans_without_marks_are_linear():
    began = time.process_time()
    assert len(catalog._sentence_spans("One. " + "word " * 40_000)) == 1
    assert time.process_time() - began < 1


@pytest.mark.parametrize("parts", [["One two. ", "ΟΔΟΣ\n", "Three's it. ", "É 🙂 end"], ["ab", "cd ", "e"], ["ΑΣ. ", "ΣΑ"], ["x"]])
def test_runs_are_vectors_of_joined_parts(parts):
    e = embedder("hashing")
    bounds = [(a, z) for a in range(len(parts)) for z in range(a + 1, len(parts) + 1)]
    assert [v.tolist() for v in e.runs(parts)(bounds)] == [v.tolist() for v in Embedder.runs(e, parts)(bounds)]


def test_parts_are_embedded_once(monkeypatch):
    e = embedder("hashing")
    seen = []
    real = type(e)._totals
    monkeypatch.setattr(type(e), "_totals", lambda self, texts: seen.append(sum(map(len, texts))) or real(self, texts))
    parts = [f"Sentence {i} tells of thing {i % 7} and more. " for i in range(200)]
    chunkers.semantic_groups(parts, [len(p) for p in parts], e, 3, 0.8, 1024, 1, 1, 5, 3, 0.2)
    assert sum(seen) == sum(map(len, parts))


def test_code_is_spread_and_parsed_once(spark, sf, monkeypatch):
    assert catalog._sources(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    parsed = []
    real = chunkers.ast.parse
    monkeypatch.setattr(chunkers.ast, "parse", lambda text: parsed.append(text) or real(text))
    text = "@cached\ndef f(x):\n    return x\n\n\nclass A:\n    key = 1234\n"
    t = chunkers.tokenizer("character")
    assert [p[0] for p in chunkers.code_pieces(text, t, 30)] == ["@cached\ndef f(x):\n", "    return x\n\n\n", "class A:\n    key = 1234\n"]
    assert len(parsed) == 1 and chunkers.code_pieces(text, t, 100) == [(text, 0, len(text), len(text))] and len(parsed) == 1
