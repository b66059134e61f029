import random

import numpy as np
import pytest

from textloom.llm.decontaminate import KINDS, Wanted, decontaminated, leaks, match_block


def brute(docs, item, phrase, share, slop):
    """The same matches, read off the texts word by word."""
    m, out = len(item), []
    need, quorum = min(phrase, m), int(np.ceil(share * m - 1e-9))
    for d, words in enumerate(docs):
        best = 0
        for p in range(-m, len(words)):
            run = 0
            for k in range(m):
                run = run + 1 if 0 <= p + k < len(words) and words[p + k] == item[k] else 0
                best = max(best, run)
        if best >= need:
            out.append((d, "exact" if best == m else "phrase", best))
            continue
        top = 0
        for p in range(-m - slop, len(words) + slop):
            if any(0 <= p + k < len(words) and words[p + k] == item[k] for k in range(m)):
                top = max(top, sum(item[k] in words[max(0, p + k - slop) : max(0, p + k + slop + 1)] for k in range(m)))
        if top >= quorum:
            out.append((d, "proximity", top))
    return out


def block(docs):
    flat = np.array([w for d in docs for w in d], np.uint64)
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    order = np.argsort(flat, kind="stable")
    terms, counts = np.unique(flat, return_counts=True)
    return first, terms, np.cumsum(counts).astype(np.int64), order.astype(np.uint32)


@pytest.mark.parametrize("seed", range(60))
def test_block_against_brute_force(seed):
    rng = random.Random(seed)
    vocabulary = range(1, rng.choice([3, 8, 60]))
    item = [rng.choice(vocabulary) for _ in range(rng.randint(3, 14))]
    docs = []
    for _ in range(6):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 25))]
        if rng.random() < 0.6:
            copy = list(item)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
                copy = copy or [1]
            at = rng.randint(0, len(words))
            words[at:at] = copy
        docs.append(words)
    got = [(d, KINDS[k], n) for d, k, _, n in match_block(*block(docs), np.array(item, np.uint64), 6, 0.8, 2)]
    assert got == brute(docs, item, 6, 0.8, 2)


def test_edge_cases(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    docs = [
        (1, f"before {item.upper()}, after", "x"),
        (2, None, "x"),
        (3, "", None),
        (None, item, None),
        (4, "nothing of it here at all", "x"),
        (5, "alpha beta gamma and delta epsilon zeta eta theta", "x"),
        (1, f"before {item.upper()}, after", "x"),
        (6, "word " * 30000 + item, "x"),
    ]
    schema = "doc_id bigint, text string, item_id string"
    bench = spark.createDataFrame([(7, item), (8, None), (None, "too short")], "item_id int, text string")
    rows = sorted((r["doc_id"] is None, r["doc_id"], r["item_id"], r["kind"]) for r in leaks(spark.createDataFrame(docs, schema), bench).collect())
    assert rows == [(False, 1, 7, "exact"), (False, 1, 7, "exact"), (False, 5, 7, "proximity"), (False, 6, 7, "exact"), (True, None, 7, "exact")]
    assert leaks(spark.createDataFrame([], schema), bench).collect() == []
    assert leaks(spark.createDataFrame(docs, schema), bench.limit(0)).collect() == []
    parts = leaks(spark.createDataFrame(docs, schema), bench.union(bench), query_bytes=16)
    assert parts.count() == 10


@pytest.mark.parametrize("seed", range(10))
def test_no_wanted_item_is_passed_over(seed):
    rng = random.Random(seed)
    items = [np.array([rng.randrange(40) for _ in range(rng.randint(1, 20))], np.uint64) for _ in range(30)]
    docs = [[rng.randrange(20) for _ in range(rng.randint(0, 30))] for _ in range(5)] + [[int(x) for x in items[3]] * 2]
    parts = block(docs)
    wanted = Wanted.of(items, 6, 0.8, 5)
    among = wanted.among(parts[1])
    assert 3 in among and among == sorted(among)
    for i, q in enumerate(items):
        near = len(q) >= 5
        if match_block(*parts, q, 6 if near else len(q), 0.8 if near else 1.0, 2 if near else 0):
            assert i in among
    assert Wanted.of([], 6, 0.8, 5).among(parts[1]) == []


def test_short_items_match_exactly(spark):
    docs = spark.createDataFrame([(1, "Say: open sesame!", "k"), (2, "open the sesame", "k"), (3, "sesame", "k"), (4, None, "k")], "doc_id bigint, text string, row_key string")
    bench = spark.createDataFrame([(1, "Open Sesame"), (2, "sesame"), (3, ""), (4, None)], "item_id int, text string")
    got = sorted((r["doc_id"], r["item_id"], r["kind"]) for r in leaks(docs, bench).collect())
    assert got == [(1, 1, "exact"), (1, 2, "exact"), (2, 2, "exact"), (3, 2, "exact")]
    assert decontaminated(docs, bench).count() == 4
    assert [r["doc_id"] for r in decontaminated(docs, bench, least_words=2).orderBy("doc_id").collect()] == [2, 3, 4]
