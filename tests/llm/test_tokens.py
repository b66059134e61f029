import random

import numpy as np
import pytest

from textloom.llm.common import TOKENIZERS
from textloom.llm.tokens import RANKS, best_fit_decreasing, encoder, encoded, pack_tokens, read_packed, safe_pieces, token_counts, unpacked, write_packed


def brute(lengths, width):
    free, rows = [], []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [r for r in range(len(rows)) if free[r] >= lengths[item]]
        if fits:
            r = min(fits, key=lambda r: free[r])
            rows[r].append(item)
            free[r] -= lengths[item]
        else:
            rows.append([item])
            free.append(width - lengths[item])
    return sorted(free)


@pytest.mark.parametrize("seed", range(20))
def test_best_fit_against_brute_force(seed):
    rng = random.Random(seed)
    width = rng.choice([7, 8, 50, 100])
    lengths = [rng.randint(1, width) for _ in range(rng.randint(0, 120))]
    rows = best_fit_decreasing(np.array(lengths, np.int64), width)
    assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
    assert sorted(width - sum(lengths[i] for i in r) for r in rows) == brute(lengths, width)


TEXTS = {1: "Hello world, it's a test.", 2: None, 3: "", 4: "word and more words " * 9000, 5: "x" * 70000, 6: "é ü  ß\n\n日本語 123 " * 50, 7: " lead and trail ", None: "no id", 8: "Hello world, it's a test."}


def table(spark):
    return spark.createDataFrame([(k, v, "clash") for k, v in TEXTS.items()], "doc_id bigint, text string, n_tokens string")


def test_counts(spark):
    encode = encoder(f"{TOKENIZERS}/{RANKS}").encode_ordinary
    got = {r["doc_id"]: (r["n_tokens"], r["n_bytes"]) for r in token_counts(table(spark), batch_bytes=100, piece_chars=64).collect()}
    assert got == {k: (None, None) if v is None else (len(encode(v)), len(v.encode())) for k, v in TEXTS.items()}
    assert token_counts(table(spark).limit(0)).collect() == []


@pytest.mark.parametrize("limit", [1, 5, 40])
def test_pieces_encode_alone(limit):
    encode = encoder(f"{TOKENIZERS}/{RANKS}").encode_ordinary
    for text in filter(None, TEXTS.values()):
        text = text[:3000]
        pieces = safe_pieces(text, limit)
        assert "".join(pieces) == text and sum((encode(p) for p in pieces), []) == encode(text)


@pytest.mark.parametrize("end_id", [50256, None])
def test_packing_round_trip(spark, end_id):
    encode = encoder(f"{TOKENIZERS}/{RANKS}").encode_ordinary
    rows = pack_tokens(table(spark), width=64, end_id=end_id, pad_id=0).collect()
    tail = [] if end_id is None else [end_id]
    want = {k: encode(v) + tail for k, v in TEXTS.items() if v is not None}
    assert unpacked(rows) == {k: v for k, v in want.items() if v}
    for r in rows:
        place, cuts = np.frombuffer(bytes(r["position_ids"]), np.uint16), r["cu_seqlens"]
        assert len(r["input_ids"]) == 256 and len(place) == 64 and cuts[-1] == r["n_tokens"]
        assert all((place[a:b] == np.arange(b - a)).all() for a, b in zip(cuts, [*cuts[1:], 64], strict=False))
    assert pack_tokens(table(spark).limit(0)).collect() == []


LONG = {
    "blanks": " " * 5_000_000,
    "blanks between": "word" + "\n \t" * 500_000 + "word " * 3 + " " * 4096,
    "letter": "x" * 1_000_000,
    "cjk": "中文字符。" * 200_000,
    "base64": "aGVsbG8gd29ybGQ9+/" * 100_000,
}


def test_very_long_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(LONG.values())], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["n_bytes"]) for r in token_counts(df).collect()}
    encoding = encoder(f"{TOKENIZERS}/{RANKS}")
    for i, t in enumerate(LONG.values()):
        want = len(t) if i == 0 else sum(map(len, encoded(encoding, safe_pieces(t, 1 << 15))))
        assert got[i] == (want, len(t.encode()))
    rows = pack_tokens(df.where("doc_id < 2"), width=4096).collect()
    assert sum(r["n_tokens"] for r in rows) == got[0][0] + got[1][0] + 2


@pytest.mark.parametrize("text", ["a" + " " * 5000 + "b's  c", " " * 4500, "x.\n" * 3000 + "\t" * 6000, "日本。語" * 3000, " \u3000" * 3000 + "\x1c" * 5])
@pytest.mark.parametrize("limit", [1, 50, 1000])
def test_long_runs_encode_alone(text, limit):
    encoding = encoder(f"{TOKENIZERS}/{RANKS}")
    pieces = safe_pieces(text, limit)
    assert "".join(pieces) == text and sum(encoded(encoding, pieces), []) == encoding.encode_ordinary(text)


def test_written_matrices(spark, tmp_path):
    packed = pack_tokens(table(spark), width=64, pad_id=0)
    uri = f"file://{tmp_path}/packed"
    write_packed(packed, uri, max_rows=50)
    rows = {bytes(r["input_ids"]): r for r in packed.collect()}
    seen = []
    for m in read_packed(uri):
        cu, docs, at = m["cu_seqlens"], m["docs"].to_pylist(), 0
        assert cu[0] == 0 and cu[-1] == m["ids"].size and len(m["ids"]) <= 50
        assert sorted(set((m["positions"].ravel() == 0).nonzero()[0])) == cu[:-1].tolist()
        for k, line in enumerate(m["ids"]):
            r = rows[line.tobytes()]
            n = len(r["doc_ids"])
            assert [d["doc_id"] for d in docs[at : at + n]] == r["doc_ids"] and {d["row"] for d in docs[at : at + n]} == {k}
            at += n
            seen.append(line.tobytes())
        assert at == len(docs)
    assert sorted(seen) == sorted(bytes(r["input_ids"]) for r in packed.collect())
    assert write_packed(packed.limit(0), uri) == [] and list(read_packed(uri)) == []
