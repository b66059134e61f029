import random
import re

import numpy as np
import pytest

from textloom.llm.simhash import CHECK_WORDS, _seed, check_code, deduplicated, search_codes, shingles, simhash_groups, trie_join
from textloom.llm.words import lowered, mix, words


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("budget", [0, 1, 3])
def test_trie_against_brute_force(seed, budget):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (400, 3)).astype(np.uint64)
    codes = base[rng.integers(0, 40, 400)] ^ np.where(rng.random((400, 3)) < 0.5, flips, np.uint64(0)).sum(axis=1, dtype=np.uint64)
    a, b = np.sort(codes[:250]), np.sort(codes[250:])
    own = {(int(i), int(j)) for x, y in trie_join(a, None, 0, 0, budget, chunk=64) for i, j in zip(x, y, strict=True)}
    assert own == {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if int(a[i] ^ a[j]).bit_count() <= budget}
    both = {(int(i), int(j)) for x, y in trie_join(a, b, 0, 0, budget, chunk=64) for i, j in zip(x, y, strict=True)}
    assert both == {(i, j) for i in range(len(a)) for j in range(len(b)) if int(a[i] ^ b[j]).bit_count() <= budget}


@pytest.mark.parametrize("n", [1, 31, 500])
def test_codes_against_plain_sums(n):
    features = mix(np.arange(n, dtype=np.uint64) * np.uint64(77) + np.uint64(n))
    for k, code in enumerate(search_codes(features, 3, block=64).tolist()):
        total = [0.0] * 64
        for u in mix(features + _seed(k)).tolist():
            sign = int(mix(np.array([u], np.uint64))[0])
            for bit in range(64):
                total[bit] += ((u >> 11) + 1.0) ** -1.5 * (1 if sign >> bit & 1 else -1)
        assert code == sum(1 << bit for bit in range(64) if total[bit] > 0)


def edited(rng, words_, n):
    out = list(words_)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def brute_groups(texts, budget=1, check_bits=48, share=0.7):
    """(class, links) of each text by comparison of all pairs."""
    w = words(lowered(__import__("pyarrow").array(texts)))
    lists = [w.hash[a:z] for a, z in zip(w.bounds, w.bounds[1:], strict=False)]
    codes = [[int(c) for c in search_codes(shingles(x, 3), 8)] for x in lists]
    checks = [[int(c) for c in check_code(x)] for x in lists]
    n = len(texts)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            close = any((a ^ b).bit_count() <= budget for a, b in zip(codes[i], codes[j], strict=True))
            sure = sum((a ^ b).bit_count() for a, b in zip(checks[i], checks[j], strict=True)) <= check_bits
            size = len(lists[i]), len(lists[j])
            near[i, j] = near[j, i] = texts[i] == texts[j] or (min(size) > 0 and close and sure and min(size) >= share * max(size))
    label = np.arange(n)
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(n)])
        if (new == label).all():
            return label, near.sum(axis=1)
        label = new


def test_groups_against_brute_force(spark):
    rng = random.Random(1)
    texts, group = [], []
    for g in range(60):
        own = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 200))]
        for m in range(rng.choice([1, 2, 3, 6])):
            group.append(g)
            texts.append(" ".join(edited(rng, own, m and len(own) // 40)))
    texts += [texts[5]] * 4 + ["", "", "..."]
    group += [group[5]] * 4 + [-1, -1, -2]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, kept string").repartition(5)
    label, links = brute_groups(texts)
    want = {i: (label[i], (label == label[i]).sum(), links[i], label[i] == i) for i in range(len(texts))}
    for options in ({}, {"bucket": 16}):
        assert {r["doc_id"]: tuple(r)[1:] for r in simhash_groups(df, **options).collect()} == want
    true = [(i, j) for i in range(len(texts)) for j in range(i) if group[i] == group[j]]
    assert sum(label[i] == label[j] for i, j in true) >= 0.95 * len(true)
    assert all(group[i] == group[j] for i in range(len(texts)) for j in range(i) if label[i] == label[j])
    assert CHECK_WORDS == 4


def test_edge_cases(spark):
    text = " ".join(f"word{i}" for i in range(50))
    rows = [(3, text, 1), (1, text, 2), (None, text, 3), (1, text, 4), (4, None, 5), (5, "", 6), (6, "", 7), (7, "...", 8), (8, "a " * 200000, 9), (9, "entirely other words stand here", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, `group.id` int")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["group_id"], r["group_size"], r["n_links"], r["kept"]) for r in simhash_groups(df).collect())
    assert got == [
        *[(False, 1, 1, 4, 3, False), (False, 1, 1, 4, 3, True), (False, 3, 1, 4, 3, False), (False, 4, None, 0, 0, True), (False, 5, 5, 2, 1, True), (False, 6, 5, 2, 1, False)],
        *[(False, k, k, 1, 0, True) for k in (7, 8, 9)],
        (True, 0, 1, 4, 3, False),
    ]
    assert simhash_groups(df.limit(0)).collect() == []
    kept = sorted(tuple(r) for r in deduplicated(df).collect())
    assert [r[0] for r in kept] == [1, 4, 5, 7, 8, 9] and re.fullmatch("[24]", str(kept[0][2]))
    assert sorted(tuple(r) for r in deduplicated(df.repartition(7)).collect()) == kept
