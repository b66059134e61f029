import pytest

from tests.oracle import same
from textloom import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, sf, name):
    same(catalog.queries()[name](spark, sf), catalog.oracle_sql()[name], sf)


@pytest.mark.parametrize("name", sorted(catalog.queries().keys() - catalog.oracle_sql().keys()))
def test_runs(spark, sf, name):
    df = catalog.queries()[name](spark, sf)
    rows = df.collect()
    assert rows
    if {"text", "start_index", "end_index"} <= set(df.columns) and "overlap" not in name and "table" not in name and "code" not in name:
        texts = {r["doc_id"]: r["text"] for r in catalog.load(spark, sf, "documents").collect()}
        assert all(texts[r["doc_id"]][r["start_index"] : r["end_index"]] == r["text"] for r in rows)
