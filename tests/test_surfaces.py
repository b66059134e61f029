import json
import struct

import numpy as np
import pytest

from textloom.functions.embeddings import Static, cosines, embedder
from textloom.operators.chunkers import character_windows, chunk_tokens, token_windows
from textloom.operators.kernels import window_similarity
from textloom.functions.tokenizers import tokenizer
from textloom.plans import cli, service, view

TEXT = "One sentence is here. Another one follows it! And a third, does it end? The last one ends."


def test_options():
    given = ["chunk_size=512", "threshold=0.8", "verbose", "a=1e3", "b=TRUE", "c=none", "d=x=y", " e = 7 ", "f=-2", "g="]
    assert cli.parsed_options(given) == {"chunk_size": 512, "threshold": 0.8, "verbose": True, "a": 1000.0, "b": True, "c": None, "d": "x=y", "e": 7, "f": -2, "g": ""}
    assert cli.parsed_options(None) == {}
    assert cli.merged_options({"a": 1, "b": None}, {"a": 2, "b": 3, "c": 4}) == {"a": 1, "b": 3, "c": 4}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text(TEXT)
    rows = cli.run(["chunk", str(tmp_path / "a.txt"), "--chunker", "token", "--chunk-size", "30", "--option", "chunk_overlap=5", "--option", "chunk_size=99"], spark).orderBy("pos").collect()
    assert [r["text"] for r in rows] == [p[0] for p in character_windows(TEXT, 30, 25)]
    steps = ["pipeline", TEXT, "--step", "refine:overlap,context_size=3", "--step", "chunk:sentence,chunk_size=30"]
    rows = cli.run([*steps, "--output", str(tmp_path / "out")], spark).collect()
    assert len(rows) > 1 and any(r["context"] for r in rows) and list((tmp_path / "out").glob("*.json"))
    assert cli.main(["chunk", TEXT, "--chunker", "token", "--chunk-size", "50"]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert "".join(x["text"] for x in lines) == TEXT
    with pytest.raises(ValueError):
        cli.run(["pipeline", "x", "--step", "chunk"], spark)


def test_chunk_requests(spark):
    one = service.chunk_request(spark, "token", {"text": "a\\nb" * 5, "chunk_size": 4})
    assert "".join(c["text"] for c in one) == "a\nb" * 5 and one[0]["token_count"] == 4
    several = service.chunk_request(spark, "sentence", {"text": [TEXT, "Short."], "chunk_size": 40})
    assert len(several) == 2 and "".join(c["text"] for c in several[0]) == TEXT
    for bad in ({}, {"text": " "}, {"text": ["x", ""]}, {"text": "x", "colour": 1}):
        with pytest.raises(ValueError):
            service.chunk_request(spark, "token", bad)
    with pytest.raises(ValueError):
        service.chunk_request(spark, "late", {"text": "x"})
    got = service.refine_request(spark, "overlap", {"chunks": one, "context_size": 2, "method": "suffix"})
    assert got[0]["text"].startswith(one[0]["text"]) and one[0]["token_count"] == 4
    assert len(service.refine_request(spark, "embeddings", {"chunks": one})[0]["embedding"]) == 64
    with pytest.raises(ValueError):
        service.refine_request(spark, "overlap", {"chunks": []})
    assert service.request_text("x\ud800y") == "x?y"


def test_stored_pipelines(spark, tmp_path):
    store = service.PipelineStore(tmp_path / "pipelines.json")
    steps = [{"type": "chunk", "component": "token", "chunk_size": 10}, {"type": "chunk", "component": "token", "chunk_size": 7}]
    row = store.create("two", steps)
    second = store.create("three", [*steps, {"type": "refine", "component": "overlap", "context_size": 1}])
    assert [r["name"] for r in store.list()] == ["three", "two"] and service.PipelineStore(tmp_path / "pipelines.json").get(row["id"]) == row
    text = "abcdefghijklmnopqrstuvwxyz"
    joined = " ".join(text[i : i + 10] for i in range(0, 26, 10))
    got = [r["text"] for r in store.execute(spark, row["id"], text).orderBy("pos").collect()]
    assert got == [joined[i : i + 7] for i in range(0, len(joined), 7)]
    assert store.execute(spark, second["id"], text).where("context is not null").count() == len(got) - 1
    assert store.update(row["id"], name="other")["name"] == "other"
    for bad in ([], [{"type": "chunk"}], [{"type": "fetch", "component": "file"}], [{"type": "chunk", "component": "token", "x": 1}]):
        with pytest.raises(ValueError):
            store.create("bad", bad)
    with pytest.raises(ValueError):
        store.create("three", steps)
    store.delete(row["id"])
    with pytest.raises(KeyError):
        store.get(row["id"])


def test_views(spark, tmp_path):
    df = spark.createDataFrame([(1, TEXT), (2, "<b> & other")], "doc_id bigint, text string")
    chunks = chunk_tokens(df, chunk_size=20, chunk_overlap=5)
    shown = view.printed(chunks, 1)
    assert shown.count("\033[0m") >= 4 and __import__("re").sub("\033\\[\\d+m", "", shown) == TEXT
    made = view.save_page(tmp_path / "page", chunks, 2, title="A & B").read_text()
    assert "&lt;b&gt; &amp; other" in made and "<h1>A &amp; B</h1>" in made and (tmp_path / "page.html").exists()
    assert "underline" in view.page(chunks, 1, dark=True)
    assert view.spans([], "abc") == [(0, 3, ())] and view.printed(chunks, 99) == ""


def test_log(monkeypatch):
    assert view.logger("x").name == "textloom.x"
    for level, on in (("off", False), (0, False), ("debug", True), (3, True), ("INFO", True)):
        assert view.configure_log(level) is on and view.logger().disabled is not on
    monkeypatch.setenv("TEXTLOOM_LOG", "false")
    assert not view.configure_log() and view.configure_log("warning")
    with pytest.raises(ValueError):
        view.configure_log("loud")


def test_window_similarity():
    x = np.random.default_rng(0).standard_normal((9, 4))
    got = window_similarity(x, 5)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for g in range(1, 9):
        before, after = unit[max(0, g - 2) : g], unit[g : g + 2]
        assert got[g - 1] == pytest.approx((before @ after.T).mean())
    assert len(window_similarity(x[:1], 3)) == 0
    with pytest.raises(ValueError):
        window_similarity(x, 4)


def test_static_embeddings(tmp_path):
    from tokenizers import Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import Whitespace

    t = Tokenizer(WordLevel({"[UNK]": 0, "red": 1, "green": 2}, unk_token="[UNK]"))
    t.pre_tokenizer = Whitespace()
    t.save(str(tmp_path / "tokenizer.json"))
    matrix = np.array([[9, 9], [1, 0], [0, 3]], np.float32)
    head = json.dumps({"__metadata__": {}, "embeddings": {"dtype": "F32", "shape": [3, 2], "data_offsets": [0, 24]}}).encode()
    (tmp_path / "model.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + matrix.tobytes())
    e = embedder(f"model2vec://{tmp_path}")
    assert isinstance(e, Static) and e.dimension == 2
    assert np.allclose(e.embed("red green blue"), np.array([0.5, 1.5]) / np.hypot(0.5, 1.5)) and not e.embed("blue").any() and not e.embed("").any()
    assert e.embed_tokens("green red x").tolist() == [[0, 3], [1, 0]]
    (tmp_path / "config.json").write_text('{"normalize": false}')
    assert Static(str(tmp_path)).embed("red green").tolist() == [0.5, 1.5]
    assert cosines([[1, 0], [0, 0]], [[2, 0], [1, 1]]).tolist() == [1, 0]


@pytest.mark.parametrize("size, step", [(10, 10), (10, 7), (10, 1), (3, 2)])
def test_character_windows(size, step):
    t = tokenizer("character")
    for n in range(1, 45):
        text = ("abc déf" * 7)[:n]
        assert character_windows(text, size, step) == token_windows(t.encode(text), t, size, step)


@pytest.mark.parametrize("megabytes", [0.1, 1, 4])
def test_windows_of_a_long_text_are_linear(spark, megabytes):
    import time

    text = "word " * int(megabytes * 200_000)
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    for name, size in (("character", 512), ("word", 128)):
        began = time.time()
        rows = chunk_tokens(df, tokenizer_=name, chunk_size=size, chunk_overlap=size // 8).count()
        assert rows > len(text) / 700 and time.time() - began < 10
