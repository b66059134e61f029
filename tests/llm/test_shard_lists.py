import numpy as np

from textloom.llm import retrieval_packing as rp


def of(docs, idf, dense):
    shift = rp.TERM - rp.FREQUENCY
    term, ptr = (np.concatenate(docs) << shift).astype(np.int32), np.append(0, np.cumsum([len(d) for d in docs]))
    count = 1 + np.arange(len(term), dtype=np.int32) % 3
    length = np.array([len(d) for d in docs])
    shard = rp.Shard(ptr, term, count, length, idf, length.mean(), dense)
    impact = np.zeros((len(docs), len(idf)))
    for k, d in enumerate(docs):
        c = count[ptr[k] : ptr[k + 1]]
        impact[k, d] = idf[d] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(d) / length.mean()))
    return shard, ptr, term, impact


def test_lists_are_copied_by_rows(monkeypatch):
    # term t is in about t of 300 documents, so that lists have all lengths
    rng = np.random.default_rng(0)
    docs = [np.append(np.flatnonzero(rng.random(290) < np.arange(290) / 300), 300 + k) for k in range(300)]
    shard, ptr, term, impact = of(docs, rng.random(1000).astype(np.float32) + 0.1, 0)
    monkeypatch.setattr(rp, "CELLS", 1 << 17)  # some scores and entries at a time
    monkeypatch.setattr(rp, "spans", None)  # no number is made for each entry
    made, listed = [], shard._listed
    monkeypatch.setattr(shard, "_listed", lambda base, at: made.append((listed(base, at), int(shard.size[at].sum()))) or made[-1][0])
    got = shard.scores(rp.Queries.of(ptr[:101], term[: ptr[100]]))
    have = (impact[:100] > 0).astype(float)
    assert np.allclose(got, have @ impact.T, rtol=1e-5)
    assert max(n for _, n in made) <= 1 << 17 and sum(n for _, n in made) == int((have @ (impact > 0).T).sum())
    assert all(len(cell) == len(x) <= 1.5 * n and np.count_nonzero(x) == n for (cell, x), n in made)


def test_common_terms_are_in_no_list(monkeypatch):
    rng = np.random.default_rng(1)
    docs = [np.append(np.flatnonzero(rng.random(900) < 0.5), 1000 + k) for k in range(256)]
    shard, ptr, term, impact = of(docs, rng.random(2000).astype(np.float32) + 0.1, 1024)
    entries, listed = [], shard._listed
    monkeypatch.setattr(shard, "_listed", lambda base, at: entries.append(int(shard.size[at].sum())) or listed(base, at))
    got = shard.scores(rp.Queries.of(ptr[:201], term[: ptr[200]]))
    assert sum(entries) <= 200  # of rare terms alone; each takes its own document
    assert np.allclose(got, (impact[:200] > 0) @ impact.T, rtol=1e-4)
