"""Comparison of a query's rows with those of its SQL in DuckDB."""

from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if path.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def plain(v):
    if isinstance(v, list):
        return tuple(map(plain, v))
    return bytes(v) if isinstance(v, bytearray) else v


def same(df, sql: str, sf_dir: str) -> None:
    names, want = sql_rows(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    a = Counter(tuple(map(plain, r)) for r in df.collect())
    b = Counter(tuple(plain(r[i]) for i in order) for r in want)
    assert a == b, (list((a - b).items())[:2], list((b - a).items())[:2], sum(a.values()), sum(b.values()))
