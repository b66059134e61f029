import math
import random

import numpy as np
import pytest

from textloom.llm.ppm import Table, adaptive_bits, codes_of, compiled, costs, expanded, inner, levels_of, lm_scores, outer, scored, squeezed, summed, trained


def brute(texts, order, min_count):
    """Code lengths from plain dictionaries of counts, exclusion by sets."""
    trie = {}
    for t in texts:
        past = bytes(order) + t
        for i, byte in enumerate(t):
            for j in range(order + 1):
                seen = trie.setdefault(past[i + order - j : i + order], {})
                seen[byte] = seen.get(byte, 0) + 1
    trie = {c: left for c, seen in trie.items() if (left := {b: n for b, n in seen.items() if n >= min_count})}
    # contexts of another length never collide: the bytes of a key say its order
    out = []
    for t in texts:
        past, bits = bytes(order) + t, 0.0
        for i, byte in enumerate(t):
            excluded = set()
            for j in range(order, -1, -1):
                seen = trie.get(past[i + order - j : i + order])
                left = {b: n for b, n in (seen or {}).items() if b not in excluded}
                if not left:
                    continue
                total = sum(left.values()) + len(left)
                if byte in left:
                    bits += math.log2(total / left[byte])
                    break
                bits += math.log2(total / len(left))
                excluded |= left.keys()
            else:
                bits += math.log2(256 - len(excluded))
        out.append(bits)
    return out


@pytest.mark.parametrize("seed", range(30))
def test_costs_against_brute_force(seed):
    rng = random.Random(seed)
    order, min_count = rng.randint(0, 4), rng.randint(1, 4)
    texts = [bytes(rng.choice(b"abcd\xc3") for _ in range(rng.randint(0, 60))) for _ in range(8)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    code = codes_of(data, offsets, order)
    model = compiled(levels_of(*summed(code, np.ones(len(code), np.int64)), order, min_count))
    got = costs(model, code)
    want = brute(texts, order, min_count)
    assert np.allclose([got[a:b].sum() for a, b in zip(offsets, offsets[1:], strict=False)], want)


def test_table():
    rng = np.random.default_rng(0)
    code = np.unique(rng.integers(0, 1 << 40, 5000).astype(np.uint64))
    table = Table(code[::2], np.arange(len(code[::2]), dtype=float))
    value, missing = table.get(code)
    assert sorted(missing) == list(range(1, len(code), 2))
    assert (value[::2] == np.arange(len(code[::2]))).all()


def test_codes_survive_packing():
    rng = np.random.default_rng(0)
    for order in (2, 5, 7):
        code = np.unique(rng.integers(0, 1 << (8 * (order + 1)), 999, np.uint64))
        shard = int(code[7] >> np.uint64(8)) & 0xFFFF
        own = code[(code >> np.uint64(8)) & np.uint64(0xFFFF) == shard]
        packed = squeezed(inner(own, order))
        assert (outer(expanded(packed, inner(own, order).dtype.type), shard) == own).all()
    assert len(expanded(squeezed(np.zeros(0, np.uint32)), np.uint32)) == 0


TEXTS = ["the cat sat on the mat", None, "", "the cat sat on the hat", "zq" * 5, "é und ü", "the cat sat on the mat", "long text " * 20000]


@pytest.mark.parametrize("order, block_bytes", [(5, 1 << 24), (2, 20), (3, 1), (7, 50)])
def test_scores(spark, order, block_bytes):
    df = spark.createDataFrame([(i if i else None, t, "clash") for i, t in enumerate(TEXTS)], "`a.b` bigint, text string, bits string").repartition(3)
    rows = {r["doc_id"]: r for r in lm_scores(df, "a.b", order=order, block_bytes=block_bytes).collect()}
    want = brute([(t or "").encode() for t in TEXTS], order, 1)
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r = rows[i if i else None]
        if t is None:
            assert r["bits"] is None and r["n_bytes"] is None
        else:
            assert r["n_bytes"] == len(t.encode())
            assert math.isclose(r["bits"], want[i], rel_tol=1e-5)
            assert (r["bits_per_byte"] is None) == (t == "")
    assert lm_scores(df.limit(0), "a.b").collect() == []


def test_many_blocks(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcde ") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r["doc_id"]: r["bits"] for r in lm_scores(df, block_bytes=1).collect()}  # a block for each text
    want = brute([t.encode() for t in texts], 5, 1)
    assert np.allclose([rows[i] for i in range(300)], want)


def test_scores_of_another_table(spark):
    """A trie of one table codes another, with contexts that it has never seen."""
    one = spark.createDataFrame([("abracadabra abba",), ("barbara",)], "text string")
    other = spark.createDataFrame([(1, "abba"), (2, "xyzzy"), (3, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["bits"] for r in scored(other, trained(one, order=3)).collect()}
    texts = [b"abracadabra abba", b"barbara"]
    code = [codes_of(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 3) for t in texts]
    model = compiled(levels_of(*summed(np.concatenate(code), np.ones(sum(map(len, code)), np.int64)), 3, 1))
    for i, t in ((1, b"abba"), (2, b"xyzzy")):
        assert math.isclose(got[i], costs(model, codes_of(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 3)).sum(), rel_tol=1e-5)
    assert got[3] is None


def test_adaptive(spark):
    df = spark.createDataFrame([(4, "zq" * 5), (5, None), (6, "")], "doc_id bigint, text string")
    own = {r["doc_id"]: r["bits"] for r in lm_scores(df, order=3, adaptive=True).collect()}
    assert math.isclose(own[4], adaptive_bits(b"zq" * 5, 3)) and own[5] is None and own[6] == 0
    assert adaptive_bits(b"abababababababab", 3) < adaptive_bits(b"abcdefghijklmnop", 3)


def test_adaptive_is_a_code():
    """The lengths of all continuations of one byte satisfy Kraft's inequality."""
    base = adaptive_bits(b"abracadabra", 2)
    assert sum(2 ** (base - adaptive_bits(b"abracadabra" + bytes([b]), 2)) for b in range(256)) == pytest.approx(1)
