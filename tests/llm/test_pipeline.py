import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tests.llm import test_decontaminate, test_retrieval_packing, test_sentences, test_simhash
from textloom.llm.langid import filtered, fit, predict
from textloom.llm.sentences import shortened
from textloom.llm.simhash import deduplicated


def test_all_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == columns, name
        assert kept.dtypes == docs.dtypes, name
    out = corpus_pipeline.run(spark, sf)
    ids = {d for r in out.collect() for d in r["doc_ids"]}
    assert ids == {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert len(ids) > 0.5 * docs.count()


def plain_words(text):
    return re.findall(r"[^\W]+", text.lower())


def test_run_against_brute_force(spark, tmp_path):
    """All five stages over a small table, each recomputed by plain code on what the one before kept."""
    rng = np.random.default_rng(5)
    vocabulary = {k: [a + b + c for a in x for b in y for c in x] for k, x, y in (("en", ["th", "wh", "sk"], "aeio"), ("de", ["sch", "pf", "zw"], "uäöe"))}

    def prose(lang, n):
        out = [" ".join(rng.choice(vocabulary[lang], 7)).capitalize() + "." for _ in range(n)]
        return " ".join(out)

    passage, item = prose("en", 6), " ".join(rng.choice(vocabulary["en"], 20))
    texts = [(prose(k, 14), k) for k in ["en", "de"] * 40]
    for i in (3, 7, 11):
        texts[i] = (texts[i][0] + " " + passage, texts[i][1])
    texts[20] = (f"{texts[20][0]} {item}. {prose('en', 3)}", "en")
    texts += [(texts[0][0], "en"), (texts[5][0].replace(texts[5][0].split()[30], "neu", 1), "de"), ("12 34 " * 9, "en"), (None, "en"), ("", "de"), ("Ёжик и лиса идут домой через тёмный лес. " * 4, "en")]
    rows = [(i, t, k, "s", len(t or "")) for i, (t, k) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, "of")], "item_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = {i: t for i, t, *_ in rows if t and t.strip()}
    model = fit(spark.read.parquet(str(tmp_path / "documents.parquet")))
    _, prob, share = predict(pa.array(list(left.values())), model)
    left = {i: t for (i, t), p, c in zip(left.items(), prob, share, strict=True) if p >= model.min_prob and c >= model.min_common and re.search(r"[^\W\d_]", t)}
    assert len(left) >= 70 and max(left) <= 81  # without digits, nothing, and an unknown language
    label, _ = test_simhash.brute_groups(list(left.values()))
    left = {i: t for k, (i, t) in enumerate(left.items()) if label[k] == k}
    assert (80 not in left or 0 not in left) and (81 not in left or 5 not in left)
    left = {i: t for i, t in zip(left, test_sentences.brute(list(left.values()), 2, 15), strict=True) if t.strip()}
    number = {w: k + 1 for k, w in enumerate(sorted({w for t in [*left.values(), item] for w in plain_words(t)}))}
    ids, docs = list(left), [[number[w] for w in plain_words(t)] for t in left.values()]
    bad = {ids[d] for d, *_ in test_decontaminate.brute(docs, [number[w] for w in plain_words(item)], 13, 0.8, 4)}
    assert bad == {20} & left.keys()
    docs = {i: plain_words(t) for i, t in left.items() if i not in bad}
    want = test_retrieval_packing.brute_seeds(docs, 2048, 128)
    found = {d: s for r in got for d, s in zip(r["doc_ids"], r["seed_ids"], strict=True)}
    assert found.keys() == docs.keys() == want.keys()
    assert sum(r["n_words"] for r in got) == sum(map(len, docs.values()))
    assert sum(found[d] == s for d, (s, _) in want.items()) >= 0.95 * len(want)


def test_stages_on_odd_tables(spark, sf):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row_key string, pred_prob double"
    empty = spark.createDataFrame([], schema)
    odd = spark.createDataFrame(
        [(1, None, None, None, None, "a", 0.1), (None, "some words of a text", "en", None, 5, "b", 0.2), (2, "", "en", "s", 0, None, None), (3, "x " * 60000, "en", "s", 1, "c", 0.3)]
        + [(4, "one two three four five six seven. eight nine ten eleven twelve thirteen fourteen fifteen sixteen.", "en", "s", 9, "d", 0.4)] * 2,
        schema,
    )
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name
        out = stage(spark, odd, sf)
        if name != "pack":
            assert out.columns == odd.columns, name
        n = {"identify": (0, 4), "deduplicate": (5, 5), "shorten": (5, 6), "protect": (6, 6), "pack": (1, 100)}[name]
        assert n[0] <= out.count() <= n[1], name


def test_one_of_each_group_stays(spark):
    base = [" ".join(f"w{(i * 37 + j * (i + 3)) % 997}" for j in range(120)) for i in range(20)]
    rows = [(i, t, "x") for i, t in enumerate(base)]
    rows += [(100 + i, t, "x") for i, t in enumerate(base[:5])]  # exact copies
    rows += [(200 + i, t.replace(t.split()[60], "changed", 1) + " more", "x") for i, t in enumerate(base[5:10])]
    rows += [(3, base[3], "x"), (3, base[3], "y"), (50, None, "x"), (51, "", "x"), (52, "", "x"), (None, base[9], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = sorted((r["doc_id"] for r in deduplicated(df).collect()), key=lambda x: (x is None, x))
    assert kept == [*range(20), 50, 51]


def test_language_filter_keeps_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert filtered(docs).count() >= 0.98 * docs.count()


def test_shortened_updates_length(spark):
    passage = "It was the first of many words here. Then came several others that nobody had seen before. They all repeat."
    rows = [(1, f"Alpha beta. {passage} Own ending one.", 0), (2, f"Gamma delta. {passage} Own ending two.", 0), (3, passage, 0), (4, "Clean text of its own.", 7), (5, None, None)]
    out = {r["doc_id"]: r for r in shortened(spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")).collect()}
    assert out[1]["text"] == rows[0][1] and out[4]["n_chars"] == 7 and out[5]["text"] is None
    assert out[2]["text"] == "Gamma delta. Own ending two." and out[2]["n_chars"] == len(out[2]["text"])
    assert 3 not in out
