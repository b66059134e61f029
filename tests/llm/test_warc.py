import gzip

import pytest

from tests.oracle import same
from textloom.llm import queries
from textloom.llm.warc import RECORDS, FramingError, assembled, chunked, dechunked, formatted, parsed, read_warc, reassembled, segmented


def rec(number, block, kind=None, total=None, origin="o"):
    kind = kind or ("response" if number in (None, 1) else "continuation")
    return {"record_id": "o" if kind == "response" else f"o{number}", "warc_type": kind, "origin_id": None if kind == "response" else origin, "segment_number": number, "total_length": total, "target_uri": "u" if kind == "response" else None, "block": block}


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_chunked_round_trip(size):
    for body in (b"", b"x", bytes(range(256)) * 5):
        assert dechunked(chunked(body, size)) == body
    assert dechunked(b"3;name=x\r\nabc\r\n0\r\nTrailer: y\r\n\r\n") == b"abc"


@pytest.mark.parametrize("bad", [b"", b"3\r\nab", b"g\r\nabc\r\n0\r\n\r\n", b"-1\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"0\r\n", b"0\r\n\r\nmore", b"3\r\nabc\r\n"])
def test_bad_framing(bad):
    with pytest.raises(FramingError):
        dechunked(bad)


@pytest.mark.parametrize(
    "parts, status, body",
    [
        ([rec(1, b"ab"), rec(2, b"cd", total=4)], "ok", b"abcd"),
        ([rec(2, b"cd", total=4), rec(1, b"ab")], "ok", b"abcd"),
        ([rec(None, b"ab")], "ok", b"ab"),
        ([rec(None, b"")], "ok", b""),
        ([rec(1, b"ab"), rec(1, b"ab"), rec(2, b"cd", total=4)], "ok", b"abcd"),
        ([rec(1, b"ab"), rec(1, b"xy"), rec(2, b"cd", total=4)], "conflict", None),
        ([rec(1, b"ab"), rec(3, b"cd", total=4)], "missing_segment", None),
        ([rec(1, b"ab"), rec(2, None, total=2)], "missing_segment", None),
        ([rec(2, b"cd", total=4)], "no_first", None),
        ([rec(1, b"ab"), rec(2, b"cd")], "unterminated", None),
        ([rec(1, b"ab"), rec(2, b"cd", total=5)], "length_mismatch", None),
        ([rec(None, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n9\r\nshort")], "bad_framing", None),
        ([rec(None, b"x", kind="continuation")], "bad_number", None),
    ],
)
def test_assembled(parts, status, body):
    got = assembled("o", parts)
    assert (got["status"], got["body"]) == (status, body)


def test_reassembly(spark, tmp_path):
    pages = [(1, "u1", "é" * 5000), (2, "u2", ""), (3, None, "x"), (4, "u4", None), (5, "u5", "long " * 100000), (None, "u6", "no id")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumnRenamed("url", "url")
    records = segmented(df)
    rows = {r["record_id"].rpartition(":")[0]: r for r in reassembled(records.orderBy("block")).collect()}
    assert {k: bytes(r["body"]).decode() for k, r in rows.items()} == {f"urn:page:{'' if i is None else i}": h for i, _, h in pages if h is not None}
    assert all(r["status"] == "ok" and r["http_status"] == 200 for r in rows.values())
    assert rows["urn:page:5"]["segments"] > 200
    assert reassembled(records.limit(0)).collect() == []
    data = b"".join(formatted(r.asDict()) for r in records.collect())
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(formatted(r)) for r in parsed(data)))
    for name in ("a.warc", "b.warc.gz"):
        again = reassembled(read_warc(spark, str(tmp_path / name)))
        assert {r["record_id"].rpartition(":")[0]: r["body"] for r in again.collect()} == {k: r["body"] for k, r in rows.items()}
    none = spark.createDataFrame([(None, None, None, None, None, None, None, "x"), (None, "continuation", None, 2, None, None, bytearray(b"x"), "y")], RECORDS + ", status string")
    assert [r["status"] for r in reassembled(none).collect()] == ["no_id", "no_id"]


def test_query(spark, sf):
    same(queries.op6_warc_reassembly(spark, sf), queries.oracle_sql()["op6_warc_reassembly"], sf)


def test_query_on_odd_pages(spark, tmp_path):
    pages = [(1, "u", "one"), (1, "v", "two"), (2, "u", "same"), (2, "u", "same"), (None, "u", "x"), (None, "w", ""), (-3, None, "y" * 9000), (4, "u", None)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(2).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in queries.op6_warc_reassembly(spark, str(tmp_path)).fillna(-9, "page_id").fillna("").collect())
    assert got == sorted((-9 if i is None else i, u or "", "ok", h) for i, u, h in pages if h is not None)


GOOD = formatted(rec(None, b"ab"))


@pytest.mark.parametrize(
    "data, want",
    [
        (GOOD.replace(b"Content-Length: 2", b"Content-Length: two") + GOOD, [("damaged", None), ("response", b"ab")]),
        (GOOD.replace(b"Content-Length: 2\r\n", b"") + GOOD, [("damaged", None), ("response", b"ab")]),
        (b"junk\r\nmore junk\r\n" + GOOD, [("damaged", None), ("response", b"ab")]),
        (GOOD + GOOD[:-6], [("response", b"ab"), ("damaged", None)]),
        (GOOD.replace(b"Content", b"WARC-Segment-Number: x\r\nContent") + GOOD, [("damaged", None), ("response", b"ab")]),
        (gzip.compress(GOOD) + gzip.compress(GOOD)[:-12], [("response", b"ab"), ("damaged", None)]),
        (b"", []),
    ],
)
def test_damaged_files(spark, tmp_path, data, want):
    assert [(r["warc_type"], r["block"]) for r in parsed(data)] == want
    (tmp_path / "a b.warc").write_bytes(data)
    rows = read_warc(spark, str(tmp_path))
    assert sorted((r["warc_type"], r["block"] and bytes(r["block"])) for r in rows.collect()) == sorted(want)
    assert all(r["status"] in ("ok", "bad_record") for r in reassembled(rows).collect())
