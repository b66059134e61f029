import random
import re

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm.sentences import dedup_sentences, runs, sentence_bounds
from textloom.llm.words import buffer, lowered, words


def split(text):
    """Sentences by the written rule, character by character."""
    cuts, i = [], 0
    while i < len(text):
        end = None
        if text[i] == "\n" or text[i] in "。！？":
            end = i + 1
        elif text[i] in ".!?":
            j = i + 1
            for _ in range(2):
                if j < len(text) and text[j] in "\"')]":
                    j += 1
            if j < len(text) and text[j] in " \t\n\v\f\r":
                end = j
        if end is not None:
            while end < len(text) and text[end] in " \t\n\v\f\r":
                end += 1
            cuts.append(end)
        i += 1
    if not text:
        return []
    cuts = sorted({0, *[c for c in cuts if c < len(text)]})
    parts = [text[a:z] for a, z in zip(cuts, [*cuts[1:], len(text)], strict=True)]
    out = []
    for p in parts:
        if out and (not re.search(r"\w", p) or not re.search(r"\w", out[-1])):
            out[-1] += p
        else:
            out.append(p)
    return out


def brute(docs, sentences, min_words):
    seen, removed = {}, []
    for text in docs:
        parts = split(text)
        size = [len(re.findall(r"\w+", p)) for p in parts]
        gone = set()
        spans = set()
        for i in range(len(parts)):
            for j in range(i + sentences, len(parts) + 1):
                if sum(size[i:j]) >= min_words:
                    spans.add((i, j))
                    break
        for j in range(len(parts) + 1):
            for i in range(j - sentences, -1, -1):
                if sum(size[i:j]) >= min_words:
                    spans.add((i, j))
                    break
        for i, j in sorted(spans):
            key = tuple(tuple(re.findall(r"\w+", p)) for p in parts[i:j])
            if key in seen:
                gone |= set(range(i, j))
            else:
                seen[key] = True
        removed.append("".join(p for k, p in enumerate(parts) if k not in gone))
    return removed


def texts(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["a", "bb", "Ccc", "dé", "e1", "x"]
    pool = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 6))) + rng.choice([". ", "! ", "\n", '." ', "? \n", "。", " "]) for _ in range(25)]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(5))
def test_split(seed):
    docs = [*texts(seed), "", " ", "...", ". a", "a", "!!! b. !!\n\n c"]
    b = buffer(pa.array(docs))
    cut, bounds = sentence_bounds(b, words(b))
    ends = np.append(cut, len(b.data))
    for i, t in enumerate(docs):
        got = [bytes(b.data[a : min(z, b.offsets[i + 1])]).decode() for a, z in zip(ends[bounds[i] : bounds[i + 1]], ends[bounds[i] + 1 : bounds[i + 1] + 1], strict=True)]
        assert got == split(t), t


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    docs = texts(seed)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: r["text"] for r in dedup_sentences(df, sentences=2, min_words=6).collect()}
    want = brute(docs, 2, 6)
    assert [got[i] for i in range(len(docs))] == want


def test_edge_cases(spark):
    one = "First sentence with a good number of words here. Second one follows with a few more words in it. "
    rows = [(1, one, 1), (1, one, 2), (2, None, 3), (3, "", 4), (None, one + "Own words.", 5), (4, "short. text.", 6), (5, "word " * 50000, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, removed_bytes int")
    out = dedup_sentences(df)
    assert out.columns == ["doc_id", "text", "removed_bytes", "_removed_bytes", "removed_runs"]
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(1, one), (1, ""), (2, None), (3, ""), (None, "Own words."), (4, "short. text."), (5, "word " * 50000)], key=str)
    assert dedup_sentences(df.limit(0)).collect() == []


def test_words_and_runs():
    b = lowered(pa.array(["Ab «cd» 'ef'—gh, É1", None, "x"]))
    w = words(b)
    assert [bytes(b.data[a:z]).decode() for a, z in zip(w.start, w.end, strict=True)] == ["ab", "cd", "ef", "gh", "é1", "x"]
    assert list(w.bounds) == [0, 5, 5, 6]
    assert len(runs(b, w, 2, 3)[0]) == 0
