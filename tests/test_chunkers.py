import random

import pytest

from textloom.functions.tokenizers import tokenizer
from textloom.operators import chunkers as c
from textloom.operators.kernels import merged, split_text
from textloom.operators.overlap import refine_overlap
from textloom.operators.rules import Level, Rules
from textloom.schema import CHUNK, chunk_ids

TEXTS = ["", "   \n", "x", "abcdefghij", "One two. Three four! Five? Six.\n\nSeven eight nine.", "no delimiters here at all", "a..b..c\n\n\n\nd", "é ü 🙂 日本語。テスト！ " * 20, "line one\r\nline two\r\n", "w" * 500 + " tail", "word " * 3000]
CUTTERS = {
    "sentence": (c.chunk_sentences, {"chunk_size": 40, "min_characters_per_sentence": 5}),
    "recursive": (c.chunk_recursive, {"chunk_size": 40, "min_characters_per_chunk": 5}),
    "fast": (c.chunk_bytes, {"chunk_size": 40}),
    "fast_next": (c.chunk_bytes, {"chunk_size": 40, "prefix": True, "consecutive": True, "forward_fallback": True}),
    "semantic": (c.chunk_semantic, {"chunk_size": 60, "min_characters_per_sentence": 5}),
    "neural": (c.chunk_spans, {"model": lambda t: [{"start": i, "end": i + 7} for i in range(0, len(t) - 7, 13)], "min_characters_per_chunk": 3}),
    "segments": (c.chunk_segments, {"segment": lambda t: t.split(" ")}),
    "guided": (c.chunk_guided, {"ask": lambda prompt: "no number", "chunk_size": 60, "candidate_size": 30}),
}


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id bigint, text string")


@pytest.mark.parametrize("name", CUTTERS)
def test_chunks_join_to_the_text(spark, name):
    cut, options = CUTTERS[name]
    rows = sorted(cut(frame(spark), **options).collect(), key=lambda r: (r["doc_id"], r["pos"]))
    for i, text in enumerate(TEXTS):
        own = [r for r in rows if r["doc_id"] == i]
        if own:
            assert "".join(r["text"] for r in own) == text
            assert all(text[r["start_index"] : r["end_index"]] == r["text"] for r in own)
            assert [r["pos"] for r in own] == list(range(len(own)))
        else:
            assert not text.strip()
        if name == "recursive":
            assert all(r["token_count"] == len(r["text"]) <= 40 for r in own)
        if name == "fast":
            assert all(len(r["text"].encode()) <= 40 and r["token_count"] == 0 for r in own)
    assert not [r for r in rows if r["doc_id"] == 99]


@pytest.mark.parametrize("size, overlap", [(4, 1), (4, 0), (3, 2), (5, 0.5)])
@pytest.mark.parametrize("name", ["character", "word"])
def test_windows_by_columns_and_by_tokens_agree(spark, name, size, overlap):
    df = frame(spark, TEXTS[:-1])
    got = sorted(tuple(r) for r in c.chunk_tokens(df, tokenizer_=name, chunk_size=size, chunk_overlap=overlap).collect())
    t = tokenizer(name)
    want = [(i, p, *w) for i, text in enumerate(TEXTS[:-1]) if text.strip() for p, w in enumerate(c.token_windows(t.encode(text), t, size, size - int(overlap * size if isinstance(overlap, float) else overlap)))]
    assert got == sorted(want)


def test_worked_examples(spark):
    def chunks(cut, text, **options):
        return [(r["text"], r["start_index"], r["end_index"]) for r in cut(spark.createDataFrame([(1, text)], "doc_id int, text string"), **options).orderBy("pos").collect()]

    assert chunks(c.chunk_tokens, "abcdefghij", chunk_size=4, chunk_overlap=1) == [("abcd", 0, 4), ("defg", 3, 7), ("ghij", 6, 10)]
    assert chunks(c.chunk_tokens, "a b c d", tokenizer_="word", chunk_size=2) == [("a b", 0, 3), ("c d", 3, 6)]
    table = "| a | b |\n| - | - |\n" + "".join(f"| {i} | x |\n" for i in range(10))
    rows = c.chunk_tables(spark.createDataFrame([(1, table)], "doc_id int, text string")).orderBy("pos").collect()
    assert [r["token_count"] for r in rows] == [3, 3, 3, 1] and rows[0]["start_index"] == 20
    assert all(r["text"].startswith("| a | b |\n| - | - |\n") for r in rows)


@pytest.mark.parametrize("method, texts, counts", [("suffix", ["aaaaaaaaaabb", "bbbbbbbbbbcc", "c" * 10], [12, 12, 10]), ("prefix", ["a" * 10, "aabbbbbbbbbb", "bbbcccccccccc"], [10, 12, 13]), ("justified", ["aaaaaaaaaabb", "aabbbbbbbbbbcc", "bbcccccccccc"], [12, 14, 12])])
def test_overlap_examples(spark, method, texts, counts):
    df = spark.createDataFrame([(1, i, x * 10, 10 * i, 10 * i + 10, 10) for i, x in enumerate("abc")], "doc_id bigint, pos int, text string, start_index int, end_index int, token_count int")
    rows = refine_overlap(df, method=method).orderBy("pos").collect()
    assert [r["text"] for r in rows] == texts and [r["token_count"] for r in rows] == counts and [r["start_index"] for r in rows] == [0, 10, 20]


def test_split_and_merge():
    rng = random.Random(0)
    for _ in range(200):
        text = "".join(rng.choice("ab.\n ") for _ in range(rng.randint(0, 40)))
        for include in ("prev", "next"):
            for least in (1, 4):
                parts = split_text(text, (". ", "\n", "\n\n"), include, least)
                assert "".join(parts) == text and all(len(p) >= least for p in parts[:-1])
    assert merged(["a", "bb", "c"], [1, 2, 1], 3) == [("abb", 3), ("c", 1)]
    with pytest.raises(ValueError):
        Level((" ",))
    assert len(Rules().levels) == 5


def test_wrong_options(spark):
    df = frame(spark)
    for cut, options in [(c.chunk_tokens, {"chunk_size": 0}), (c.chunk_tokens, {"chunk_size": 4, "chunk_overlap": 4}), (c.chunk_semantic, {"threshold": 1.5}), (c.chunk_sentences, {"chunk_overlap": -1})]:
        with pytest.raises(ValueError):
            cut(df, **options)


def test_ids_are_version_5(spark):
    import uuid

    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "ü", ""])], "doc_id bigint, pos int, text string")
    got = {r["text"]: r["id"] for r in chunk_ids(df).collect()}
    assert all(got[t] == str(uuid.uuid5(uuid.NAMESPACE_OID, f"chunks::chunk-1-{i}:{t}")) for i, t in enumerate(["a", "ü", ""]))
    assert CHUNK.startswith("id string")
