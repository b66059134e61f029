import numpy as np
import pytest

from tests.oracle import same
from textloom.llm import queries
from textloom.llm.nndescent import duplicate_classes


def brute(rows, threshold):
    """(id, class, links) of rows(id, vector)."""
    x = np.array([np.float32(v) for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = [i for i, _ in rows]
    while True:
        new = [min([label[i], *(label[j] for j in np.flatnonzero(near[i]))]) for i in range(len(rows))]
        if new == label:
            return {rows[i][0]: (label[i], int(near[i].sum())) for i in range(len(rows))}
        label = new


@pytest.mark.parametrize("k", [4, 8])
def test_against_brute_force(spark, k):
    rng = np.random.default_rng(k)
    base = rng.standard_normal((400, 24))
    rows = [(i, v) for i, v in enumerate(base)]
    for c in range(12):  # groups from 2 to over k, some chained
        for m in range(1 + 2 * c):
            rows.append((1000 + 100 * c + m, base[c] + 0.1 * rng.standard_normal(24)))
    rows += [(5000 + i, base[11]) for i in range(30)]  # copies
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id bigint, embedding array<float>")
    got = duplicate_classes(df, threshold=0.9, k=k, audit=500)
    found = {r["id"]: (r["class_id"], r["n_links"]) for r in got.classes.collect()}
    want = brute(rows, 0.9)
    assert found.keys() == want.keys()
    assert sum(n for _, n in found.values()) >= 0.99 * sum(n for _, n in want.values())
    assert all(found[i][1] <= want[i][1] for i in want)
    assert sum(found[i] == want[i] for i in want) >= 0.98 * len(want)
    assert got.recall >= 0.95 and got.audited > 0


def test_large_group_is_exact(spark):
    rng = np.random.default_rng(1)
    core = rng.standard_normal(16)
    rows = [(i, core + 0.25 * rng.standard_normal(16)) for i in range(1500)] + [(2000 + i, rng.standard_normal(16)) for i in range(500)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id bigint, embedding array<float>")
    found = {r["id"]: (r["class_id"], r["n_links"]) for r in duplicate_classes(df, k=8).classes.collect()}
    want = brute(rows, 0.9)
    hot = [i for i, (_, n) in want.items() if n >= 8]
    assert len(hot) > 1000
    assert sum(found[i] == want[i] for i in hot) >= 0.98 * len(hot)


def test_edge_cases(spark):
    e = [[1.0, 0.0, 0.0], [2.0, 0.0, 0.0], [1.0, 0.01, 0.0], [0.0, 1.0, 0.0]]
    rows = [(1, e[0], 0.5), (2, e[1], 0.5), (3, e[2], None), (4, e[3], 0.5), (None, e[0], 0.5), (5, None, 0.5), (6, [], 0.5), (7, [1.0, None, 0.0], 0.5)]
    rows += [(8, [0.0, 0.0, 0.0], 0.5), (9, [1.0, 0.0], 0.5), (10, [float("nan"), 0.0, 1.0], 0.5), (11, [float("inf"), 0.0, 1.0], 0.5), (1, e[0], 0.5), (12, [3.0, 0.0], 0.5)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, node double")
    got = sorted(tuple(r) for r in duplicate_classes(df).classes.collect())
    unusable = [(i, None, 0) for i in (5, 6, 7, 8, 10, 11)]
    assert [r for r in got if r[1] is None] == unusable
    assert [r for r in got if r[1] is not None] == [(1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 4, 0), (9, 9, 1), (12, 9, 1)]
    none = duplicate_classes(df.limit(0))
    assert none.classes.collect() == [] and none.recall == 1
    assert [tuple(r) for r in duplicate_classes(df.where("vec_id = 4")).classes.collect()] == [(4, 4, 0)]


def test_query(spark, sf):
    same(queries.op1_embedding_near_dedup(spark, sf), queries.oracle_sql()["op1_embedding_near_dedup"], sf)
