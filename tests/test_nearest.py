import numpy as np
import pyarrow as pa
import pytest

from textloom.operators import vectors
from textloom.operators.vectors import METRICS, nearest


def wanted(x, ids, q, limit, metric):
    """Plain scores of all pairs, best first, equal ones by id."""
    out = []
    for n, v in q:
        rows = sorted((float(-s if METRICS[metric] else s), i) for s, i in zip(vectors._scores(x, np.tile(v, (len(x), 1)), metric), ids))
        out += [(n, i, r + 1) for r, (_, i) in enumerate(rows[:limit])]
    return sorted(out)


def made(n, dim=6, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, dim)).astype(np.float32).astype(float)
    x[n // 2 :] = x[: n - n // 2]  # every vector twice: equal scores go by id
    x[3] = 0
    return x


@pytest.mark.parametrize("metric", METRICS)
def test_blocks_and_groups(spark, metric, monkeypatch):
    x = made(400)
    ids = [f"{(i * 7919) % 400:03}é" for i in range(400)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)] + [("none", None), ("short", [1.0])], "id string, embedding array<double>")
    monkeypatch.setattr(type(df), "toArrow", lambda self: pytest.fail("queries come to the driver"))
    got = nearest(df, df, 3, metric, query_id="id", query_bytes=4096).collect()
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in got) == wanted(x, ids, list(zip(ids, x)), 3, metric)


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("far", [1.0, 1e3, 1e152])
def test_few_pairs_are_scored_singly(metric, far, monkeypatch):
    x = made(4000, 8, 1) * np.where(np.arange(4000) == 9, far, 1)[:, None] + (1e4 if metric == "l2" else 0)
    scored = []
    real = vectors._scores
    monkeypatch.setattr(vectors, "_scores", lambda a, b, m: scored.append(len(a)) or real(a, b, m))
    best = vectors._Best(pa.array(range(50)), x[:50], 4, metric, True)
    for a in range(0, 4000, 500):
        best.show(pa.array(range(a, a + 500)), x[a : a + 500])
    got = [(n, i) for b in best.rows() for n, i in zip(b[0].to_pylist(), b[1].to_pylist())]
    assert far > 1e100 or sum(scored) < 50 * 4000 / 10
    assert sorted(got) == sorted((n, i) for n, i, _ in wanted(x, range(4000), list(enumerate(x[:50])), 4, metric))


def test_cosines_of_equal_vectors_are_at_most_one():
    x = made(300, 64, 2)[10:]
    s = vectors._scores(x, x.copy(), "cosine")
    assert s.max() == 1 and s.min() > 1 - 1e-12 and np.array_equal(s[:140], s[150:])


def test_a_filtered_table_in_blocks(spark):
    x = made(200)
    df = spark.createDataFrame([(i, v.tolist(), i % 5) for i, v in enumerate(x)], "id int, embedding array<float>, label int")
    got = nearest(df.where("label > 2"), df, 2, "cosine_distance", query_id="id", query_bytes=2048).collect()
    kept = [i for i in range(200) if i % 5 > 2]
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in got) == wanted(x[kept], kept, list(enumerate(x)), 2, "cosine_distance")


def test_candidates_are_bounded_where_all_are_equal():
    best = vectors._Best(pa.array(range(40)), np.ones((40, 4)), 3, "ip", True)
    for a in range(9000, 0, -1000):
        best.show(pa.array(range(a, a + 1000)), np.ones((1000, 4)))
        assert sum(t.num_rows for t in best.found) <= 1 << 19
    assert [b.column(1).to_pylist() for b in best.rows()] == [[1000, 1001, 1002] * 40]
