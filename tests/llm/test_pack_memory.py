import tracemalloc
from types import SimpleNamespace

import numpy as np

import corpus_pipeline
from textloom.llm import retrieval_packing as rp


class Captured:
    """Stands for a table of pieces; keeps the function that neighbours() would run over it."""

    def __init__(self):
        self.sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x), defaultParallelism=2))

    def __getattr__(self, name):
        return lambda *args: self

    def mapInArrow(self, f, schema):
        self.search = f
        return self


def test_search_fits_beside_the_jvm(spark, monkeypatch):
    # one task over 6,000 documents of 150 words and as many queries
    monkeypatch.setattr(rp.Shard, "scores", lambda self, q: np.zeros((q.n, self.n), np.float32))  # what it holds, not what it adds up
    df = spark.range(6000).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 150), k -> concat('w', pmod(xxhash64(id, k), 40000))), ' ') AS text")
    pieces = rp.index_pieces(df, "doc_id", "text").selectExpr("*", "cast(null AS array<bigint>) AS taken").drop("ids")
    batches = pieces.toArrow().to_batches(max_chunksize=4)
    ends, terms = ([np.frombuffer(x, t) for b in batches for x in b.column(c).to_pylist()] for c, t in (("ends", np.int64), ("terms", np.int32)))
    ptr, terms = np.append(0, np.cumsum(np.concatenate([np.diff(x, prepend=0) for x in ends]))), np.concatenate(terms)
    number = np.arange(len(ptr) - 1)
    seeds = (number, number, ptr, *rp.numbered(terms))
    like = rp.Likeness(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)))
    state = Captured()
    rp.neighbours(state, seeds, SimpleNamespace(value=np.ones(1 << rp.FREQUENCY, np.float32)), 150.0, 2048, -1, 128, 4096, like)
    tracemalloc.start()
    list(state.search(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 34 * len(terms)  # 29 bytes a term when written, 41 with all blocks of queries held and counts of four bytes


def test_numbered_and_narrow():
    rng = np.random.default_rng(0)
    for n in (0, 5, 40000):
        terms = rng.integers(0, 9000, n).astype(np.int32)
        distinct, which = rp.numbered(terms)
        assert distinct.dtype == which.dtype == np.int32 and (np.diff(distinct) > 0).all() and (distinct[which] == terms).all()
    for most, size in ((0, 1), (255, 1), (256, 2), (70000, 4)):
        x = np.array([0, most], np.int32)
        assert rp.narrow(x).itemsize == size and (rp.narrow(x) == x).all()
    assert len(rp.narrow(np.zeros(0, np.int32))) == 0
    assert np.concatenate([rp.narrow(np.array([255])), rp.narrow(np.array([70000]))]).tolist() == [255, 70000]


def test_stages_begin_with_small_heaps(spark, sf):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = next(b for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    for name, stage in corpus_pipeline.STAGES:
        before = whole.getCollectionCount()
        stage(spark, docs, sf)
        assert whole.getCollectionCount() > before, name
