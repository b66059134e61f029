import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from textloom.llm.retrieval_packing import FREQUENCY, TERM, TURNS, Queries, Shard, first_fit, retrieval_packed


def brute_score(query, doc, idf, mean):
    c = Counter(doc)
    return sum(idf[t] * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(doc) / mean)) for t in set(query) if t in c)


def brute_seeds(docs, width, most):
    """The seed of each document (names to words), round by round; near ties in score are left to chance."""
    n = len(docs)
    frequency = Counter(w for d in docs.values() for w in set(d))
    idf = {w: math.log(1 + (n - c + 0.5) / (c + 0.5)) for w, c in frequency.items()}
    mean = sum(map(len, docs.values())) / n
    left = {k for k, d in docs.items() if len(d) % width}
    out = {}
    for turn in range(max(TURNS) + 1):
        seeds = sorted(k for k in left if TURNS[k % 20] == turn)
        left -= set(seeds)
        left = {k for k in left if TURNS[k % 20] > turn}
        wanted = defaultdict(list)
        for s in seeds:
            out[s] = (s, 0.0)
            scored = sorted(((brute_score(docs[s], docs[k], idf, mean), k) for k in left), reverse=True)
            for rank, (score, k) in enumerate(scored[:most]):
                if score > 0:
                    wanted[k].append((rank, -score, s))
        for k, lists in wanted.items():
            rank, less, s = min(lists)
            out[k] = (s, -less)
        left -= set(wanted)
    return out


@pytest.mark.parametrize("seed, dense", [(0, 512), (1, 2), (2, 0), (3, 10)])
def test_shard_against_brute_force(seed, dense):
    rng = random.Random(seed)
    docs = [[rng.choice(range(rng.choice([5, 50]))) for _ in range(rng.randint(1, 30))] for _ in range(40)]
    shift = TERM - FREQUENCY
    term, count, ptr = [], [], [0]
    for d in docs:
        c = sorted(Counter(d).items())
        term += [t << shift for t, _ in c]
        count += [n for _, n in c]
        ptr.append(len(term))
    idf = np.random.default_rng(seed).random(64).astype(np.float32) + 0.1
    length = np.array([len(d) for d in docs])
    ptr, term = np.array(ptr), np.array(term, np.int32)
    shard = Shard(ptr, term, np.array(count), length, idf, length.mean(), dense)
    got = np.concatenate([shard.scores(Queries.of(ptr[a : a + 9] - ptr[a], term[ptr[a] : ptr[min(a + 8, 40)]])) for a in range(0, 40, 8)])
    want = [[brute_score(q, d, idf, length.mean()) for d in docs] for q in docs]
    assert np.allclose(got, want, rtol=1e-4)


def test_first_fit():
    assert first_fit([5, 6, 3, 2, 4], 10) == [[0, 2, 3], [1, 4]]
    assert first_fit([], 10) == []


@pytest.mark.parametrize("shard_docs, query_bytes", [(4096, 1 << 25), (7, 1 << 12)])
def test_seeds_against_brute_force(spark, shard_docs, query_bytes):
    rng = random.Random(3)
    docs = {i: [f"w{int(rng.paretovariate(0.7)) % 500}" for _ in range(rng.randint(3, 70))] for i in rng.sample(range(1000), 150)}
    docs[0], docs[1000] = ["alone", "here"], [f"w{k}" for k in range(120)]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in docs.items()], "doc_id bigint, text string").repartition(3)
    rows = retrieval_packed(df, width=100, list_docs=5, shard_docs=shard_docs, query_bytes=query_bytes).collect()
    found = {d: (s, x) for r in rows for d, k, s, x in zip(r["doc_ids"], r["starts"], r["seed_ids"], r["scores"], strict=True) if k or len(docs[d]) < 100}
    want = brute_seeds(docs, 100, 5)
    assert found.keys() == want.keys()
    assert sum(found[d][0] == s for d, (s, _) in want.items()) >= 0.97 * len(want)  # rounding may turn near ties
    assert all(abs(found[d][1] - x) < 0.02 for d, (s, x) in want.items() if found[d][0] == s)
    assert found[0] == (0, 0.0)


def test_packing(spark):
    rng = random.Random(5)
    texts = {i: " ".join(f"w{rng.randint(0, 40 if i % 2 else 400)}" for _ in range(rng.randint(1, 60))) for i in range(120)}
    texts |= {200: None, 201: "", 202: "... !", 203: "long " * 1000, 204: texts[3], None: "no id here", 205: "w1 " * 100}
    rows = [(i, t, "clash", 1) for i, t in texts.items()] + [(7, texts[7], "clash", 2)] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard string, `a.b` int")
    want = Counter((i, k) for i, t, *_ in rows for k in range(len(re.findall(r"\w+", t or ""))))
    for options in ({}, {"shard_docs": 16, "list_docs": 3}):
        got = retrieval_packed(df, width=100, **options).collect()
        assert all(r["n_words"] == sum(r["lengths"]) <= 100 for r in got)
        assert Counter((d, s + k) for r in got for d, s, n in zip(r["doc_ids"], r["starts"], r["lengths"], strict=True) for k in range(n)) == want
        assert len({(r["shard"], r["window"]) for r in got}) == len(got)
        assert len(got) < 1.3 * sum(want.values()) / 100  # windows are well filled
        assert all(x == 0 for r in got for d, s, x in zip(r["doc_ids"], r["seed_ids"], r["scores"], strict=True) if d == s)
    assert retrieval_packed(df.limit(0)).collect() == []
    assert retrieval_packed(df.where("doc_id in (200, 201, 202)")).collect() == []
    names = df.selectExpr("concat('id', doc_id) AS `the.id`", "text AS `the text`")
    assert sum(r["n_words"] for r in retrieval_packed(names, "the.id", "the text", width=100).collect()) == sum(want.values())


def test_copies_spread_over_their_seeds(spark):
    df = spark.createDataFrame([(i, "the same words in every text of this group") for i in range(600)], "doc_id bigint, text string")
    got = retrieval_packed(df, width=64, list_docs=4).collect()
    assert sorted(d for r in got for d in r["doc_ids"]) == list(range(600))
    taken = Counter(s for r in got for d, s in zip(r["doc_ids"], r["seed_ids"], strict=True) if s % 20 == 0 and d != s)
    assert sum(taken.values()) >= 0.6 * 4 * 30  # no few documents are in all lists
    assert max(taken.values()) <= 4


def test_neighbours_come_from_all_shards(spark):
    # each seed has its one partner with the same rare words in another shard
    rng = random.Random(7)
    texts = {}
    for k in range(60):
        rare = [f"{a}{k}" for a in "abcdef"]
        texts[20 * k] = " ".join(rare + [f"w{rng.randint(0, 60)}" for _ in range(14)])
        texts[20 * ((k + 30) % 60) + 7] = " ".join(rare + [f"w{rng.randint(0, 60)}" for _ in range(14)])
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rows = retrieval_packed(df, width=40, shard_docs=8, list_docs=4).collect()
    pairs = {tuple(sorted(r["doc_ids"])) for r in rows}
    assert len(rows) == 60 and all(tuple(sorted((20 * k, 20 * ((k + 30) % 60) + 7))) in pairs for k in range(60))
