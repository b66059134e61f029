import numpy as np

from textloom.llm import retrieval_packing as rp


def test_terms_of_many_queries_are_multiplied(monkeypatch):
    # 900 terms, each in about half of 256 documents and of 200 queries, and one rare term in each document
    rng = np.random.default_rng(0)
    docs = [np.append(np.flatnonzero(rng.random(900) < 0.5), 1000 + k) for k in range(256)]
    shift = rp.TERM - rp.FREQUENCY
    term, ptr = (np.concatenate(docs) << shift).astype(np.int32), np.append(0, np.cumsum([len(d) for d in docs]))
    length = np.array([len(d) for d in docs])
    idf = rng.random(2000).astype(np.float32) + 0.1
    shard = rp.Shard(ptr, term, np.ones(len(term), np.int32), length, idf, length.mean())
    entries, spans = [], rp.spans
    monkeypatch.setattr(rp, "spans", lambda first, last: entries.append(int((last - first).sum())) or spans(first, last))
    got = shard.scores(rp.Queries.of(ptr[:201], term[: ptr[200]]))
    assert sum(entries) <= 200  # of rare terms alone; each takes its own document
    have = np.zeros((256, 2000))
    for k, d in enumerate(docs):
        have[k, d] = 1
    impact = have * idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length / length.mean()))[:, None]
    assert np.allclose(got, have[:200] @ impact.T, rtol=1e-4)


def test_order_of_candidates():
    rng = np.random.default_rng(1)
    for most in (3, 1 << 15):  # in 64 bits and beyond them
        for places in (5, 1 << 40):  # with copies and without
            query, far, place = (rng.integers(0, n, 5000).astype(t) for n, t in ((9, np.int32), (4 if places == 5 else 1 << 32, np.uint32), (places, np.int64)))
            score = (np.rint(rng.random(5000) * most * 256) / 256).astype(np.float32)
            got, want = rp._ranked(query, place, far, score), np.lexsort((place, far, -score, query))
            assert all((x[got] == x[want]).all() for x in (query, place, far, score))


def test_blocks_share_terms():
    ptr, terms = np.array([0, 2, 2, 5, 6]), np.array([7, 9, 1, 7, 8, 9], np.int32)
    blocks = rp.Queries.blocks(ptr, terms, 3)
    assert [b.n for b in blocks] == [3, 1] and blocks[0].terms is blocks[1].terms
    assert [(b.row.tolist(), b.terms[b.term].tolist()) for b in blocks] == [([0, 0, 2, 2, 2], [7, 9, 1, 7, 8]), ([0], [9])]
