import pytest

from textloom.llm import tokens
from textloom.llm.common import TOKENIZERS


@pytest.mark.parametrize("text", ["", "plain words, and more", "<|endoftext|> stays text", " " * 9000 + "x", "x" + " " * 5000, "é中\U0001f600  " * 50, "it's 12345\n\n\tend "])
def test_ids_without_python_integers(monkeypatch, text):
    encoding = tokens.encoder(f"{TOKENIZERS}/{tokens.RANKS}")
    want = sum(tokens.encoded(encoding, tokens.safe_pieces(text, 100)), [])
    monkeypatch.setattr(type(encoding), "encode_ordinary_batch", None)  # a thread pool and a list for each text
    got = tokens.token_ids(encoding, text, 100, [50256])
    assert got.dtype == "int32" and got.tolist() == [*want, 50256]
