import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm.langid import SCALE, document_frequencies, filtered, fit, ftrl, grams, language_id, predict, temperature


def brute_grams(text):
    import re

    t = " " + re.sub(r"[\t-\r ]+", " ", re.sub(r"\d+", "0", text.lower())) + " "
    t = re.sub(" +", " ", t)
    return sum(max(0, len(t) - n + 1) for n in (1, 2, 3)), t


@pytest.mark.parametrize("texts", [["ab", "", "Ab  12 3"], ["\x00x", "y"], ["é" * 100]])
def test_gram_counts(texts):
    for a, z, slot, ends in grams(pa.array(texts), 16):
        for k in range(z - a):
            assert ends[k + 1] - ends[k] == brute_grams(texts[a + k].replace("\x00", " "))[0]


def test_frequencies(spark):
    texts = ["abc", "abd", None, "", "xyz abc"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    total, n = document_frequencies(df, "text", 12)
    want = Counter(s for t in texts if t is not None for _, _, slot, _ in grams(pa.array([t]), 12) for s in set(slot.tolist()))
    assert n == 4 and {i: int(c) for i, c in enumerate(total) if c} == want


def test_ftrl_and_temperature():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(300):
        y = int(rng.integers(0, 3))
        slots = np.unique(np.append(rng.integers(3, 40, 6), y))
        rows.append((slots, np.ones(len(slots)), y))
    w, b = ftrl(rows, 40, 3, 3, 0.5, 1.0, 0.5, 1e-3)
    assert np.mean([np.argmax(v @ w[s] + b) == y for s, v, y in rows]) > 0.97
    assert (w[3:] == 0).mean() > 0.2  # the l1 penalty leaves weights out
    scores = rng.standard_normal((4000, 3)) * 4
    p = np.exp(scores / 2)
    drawn = (rng.random((4000, 1)) > np.cumsum(p / p.sum(axis=1, keepdims=True), axis=1)).sum(axis=1)
    assert temperature(scores, drawn) == pytest.approx(2, rel=0.1)


def plain_ftrl(rows, slots, classes, epochs, alpha, beta, l1, l2):
    """FTRL-proximal of the softmax, one weight at a time from its z and n; slot number slots is the bias."""
    z = [[0.0] * classes for _ in range(slots + 1)]
    n = [[0.0] * classes for _ in range(slots + 1)]

    def weight(i, c):
        penalty = 0.0 if i == slots else l1
        if abs(z[i][c]) <= penalty:
            return 0.0
        return -(z[i][c] - math.copysign(penalty, z[i][c])) / ((beta + math.sqrt(n[i][c])) / alpha + l2)

    for _ in range(epochs):
        for slot, value, label in rows:
            x = dict(zip([int(i) for i in slot], [float(v) for v in value], strict=True)) | {slots: 1.0}
            w = {i: [weight(i, c) for c in range(classes)] for i in x}
            score = [sum(x[i] * w[i][c] for i in x) for c in range(classes)]
            p = [math.exp(s - max(score)) for s in score]
            for i in x:
                for c in range(classes):
                    g = x[i] * (p[c] / sum(p) - (c == label))
                    sigma = (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / alpha
                    z[i][c] += g - sigma * w[i][c]
                    n[i][c] += g * g
    return [[weight(i, c) for c in range(classes)] for i in range(slots + 1)]


@pytest.mark.parametrize("seed", range(4))
def test_ftrl_against_a_plain_one(seed):
    rng = np.random.default_rng(seed)
    rows = [(np.sort(rng.choice(12, 5, replace=False)), rng.random(5), int(rng.integers(0, 3))) for _ in range(40)]
    w, b = ftrl(rows, 12, 3, 2, 0.5, 1.0, 0.3, 1e-2)
    want = plain_ftrl(rows, 12, 3, 2, 0.5, 1.0, 0.3, 1e-2)
    assert np.allclose(np.vstack([w, b]), want) and (w == 0).any()


def plain_slots(text, bits):
    """The slots of all 1- to 3-grams of a text."""
    t = brute_grams(text)[1]
    out = []
    for n in (1, 2, 3):
        for i in range(len(t) - n + 1):
            h = 0
            for c in t[i : i + n]:
                h = ((h ^ ord(c)) * 0x9E3779B1) & 0xFFFFFFFF
            out.append((((h ^ (h >> 15)) * 0x85EBCA77) & 0xFFFFFFFF) >> (32 - bits))
    return out


def test_whole_model_against_a_plain_one(spark):
    """TF-IDF, fit, scores and calibrated probabilities of a small table, each from its definition."""
    rng = random.Random(3)
    words = {"aa": ["kato", "miru", "sole", "an"], "bb": ["thrwq", "xyzzy", "an"], "cc": ["öä 12", "ßü", "an"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randint(1, 12))), k) for i, k in enumerate(["aa", "bb", "cc"] * 12)]
    rows = list({t: (i, t, k) for i, t, k in rows}.values())
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    bits = 12
    model = fit(df, max_train_rows=1000, bits=bits)
    frequency = Counter(s for _, t, _ in rows for s in set(plain_slots(t, bits)))
    idf = {s: math.log((1 + len(rows)) / (1 + n)) + 1 for s, n in frequency.items()}
    drawn = df.selectExpr("doc_id", "pmod(xxhash64(lang, text), 1L << 30) AS draw").orderBy("draw", "lang").collect()
    sample = [next(r for r in rows if r[0] == d["doc_id"]) for d in drawn]

    def features(text):
        c = Counter(plain_slots(text, bits))
        return [(s, n / sum(c.values()) * idf[s] * SCALE) for s, n in sorted(c.items())]

    data = [([s for s, _ in f], [v for _, v in f], sorted(words).index(k)) for _, t, k in sample for f in [features(t)]]
    fitted, held = [r for i, r in enumerate(data) if i % 5 != 4], data[4::5]
    order = np.random.default_rng(0).permutation(len(fitted))
    w = plain_ftrl([fitted[i] for i in order], 1 << bits, 3, 3, 0.5, 1.0, 1e-3, 1e-4)

    def scores(slot, value):
        return [sum(v * w[s][c] for s, v in zip(slot, value, strict=True)) + w[-1][c] for c in range(3)]

    heat = temperature(np.array([scores(s, v) for s, v, _ in held]), np.array([k for *_, k in held]))
    assert model.temperature == pytest.approx(heat, rel=1e-3) and model.rows == len(fitted)
    which, prob, _ = predict(pa.array([t for _, t, _ in rows]), model)
    for k, (_, t, _) in enumerate(rows):
        f = features(t)
        e = [math.exp(s / heat) for s in scores([s for s, _ in f], [v for _, v in f])]
        assert which[k] == int(np.argmax(e)) and prob[k] == pytest.approx(max(e) / sum(e), rel=1e-3)


def test_column_names_never_clash(spark):
    df = spark.createDataFrame([(1, "kato miru", "aa", 1.0, 2, 3)], "`doc.id` bigint, text string, lang string, language_guess double, pred_prob int, `_guess_pred_prob` int")
    assert filtered(df).columns == df.columns
    assert language_id(df, "doc.id").columns == ["doc_id", "pred_lang", "pred_prob", "accepted"]


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit(docs)
    assert model.held_out >= 0.97
    got = language_id(docs).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("pred_lang = lang").count() >= 0.97 * docs.count()
    assert filtered(docs).count() >= 0.98 * docs.where("length(trim(text)) > 0").count()


def test_edge_cases(spark):
    rng = random.Random(0)
    words = {"aa": ["kato", "miru", "sole"], "bb": ["thrwq", "xyzzy", "plugh"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(20)), k, "c") for i, k in enumerate(["aa", "bb"] * 30)]
    rows += [(100, None, "aa", "c"), (101, "", None, None), (102, " \t", "aa", "c"), (None, "kato miru " * 50000, None, "c"), (0, rows[0][1], "aa", "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, pred_lang string")
    got = [(r["doc_id"], r["pred_lang"], r["accepted"]) for r in language_id(df).collect()]
    assert len(got) == len(rows)
    assert {x for x in got if x[0] in (100, 101, 102)} == {(100, None, False), (101, None, False), (102, None, False)}
    assert (None, "aa", True) in got and got.count((0, "aa", True)) == 2
    assert language_id(df.limit(0)).collect() == []
    none = language_id(df.withColumn("lang", df["lang"].substr(1, 0)).where("doc_id > 90").drop("lang").withColumnRenamed("pred_lang", "lang").where("false"))
    assert none.collect() == []
    assert filtered(df).columns == df.columns


UNKNOWN = {
    "ru": "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему.",
    "el": "Όλες οι ευτυχισμένες οικογένειες μοιάζουν μεταξύ τους, κάθε δυστυχισμένη είναι διαφορετική.",
    "zh": "幸福的家庭都是相似的,不幸的家庭各有各的不幸。我们今天去学校读书。",
    "fi": "Kaikki onnelliset perheet ovat toistensa kaltaisia, mutta jokainen onneton perhe on onneton omalla tavallaan.",
    "symbols": "@@## $$%% ^^&& **(( ))__ ++== ~~`` || \\\\ // <<>> {}[] " * 5,
    "letters": "xqzjv kwpfq zzxvk qjwhx vbnmq wxkzj qpfgv jxqkz vwqzx kjhqv " * 5,
    "digits": "123 456 7890 12 3456 789 " * 10,
}


def test_unknown_languages_and_junk_are_rejected(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(UNKNOWN.values())], docs.schema)
    got = {r["doc_id"]: r for r in language_id(docs.unionByName(odd)).collect()}
    assert [k for i, k in enumerate(UNKNOWN) if got[-1 - i]["accepted"]] == []
    clean = [r for k, r in got.items() if k >= 0]
    assert sum(r["accepted"] for r in clean) >= 0.98 * len(clean)
    assert filtered(docs.unionByName(odd)).where("doc_id < 0").count() == 0
