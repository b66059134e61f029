"""Near-duplicate embeddings by NN-descent.

The graph starts from random-hyperplane buckets and is refined by joins of
neighbours' neighbours: each node brings the vectors of its neighbours and
reverse neighbours together, and the pairs among them that improve a list are
kept.  Where a list is full of near duplicates, it is enlarged to the node's
whole component of the threshold graph.  An audit compares a sample of nodes
with every vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import blobs, quoted
from textloom.llm.common import components as components_of
from textloom.llm.graph import connected_components
from textloom.llm.words import mix
from textloom.storage import dropped, written

STATE = "node bigint, nbrs binary, sims binary, fresh binary"


class NearDuplicates(NamedTuple):
    classes: DataFrame  # id, class_id, n_links
    recall: float  # share of the audited nodes' links that were found
    audited: int  # their true links
    rounds: int


def _floats(column: pa.ChunkedArray, dim: int, kind=np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def _grouped(df: DataFrame, key: str, parts: int, f: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """f over the rows of each of parts hash partitions, sorted by key; all rows of a key are in one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            yield from f(table.take(pa.array(np.argsort(table.column(key).to_numpy(), kind="stable"))).combine_chunks())

    return df.repartition(parts, key).mapInArrow(run, schema)


def _spans(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return first, np.append(first[1:], len(key))


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows with an id and a vector of numbers, vec as floats."""
    rows = df.select(quoted(id_col).alias("id"), quoted(vec_col).cast("array<float>").alias("vec"))
    return rows.where("id is not null and vec is not null and size(vec) > 0").where(~F.exists("vec", lambda x: x.isNull()))


def prepared(rows: DataFrame, dim: int) -> DataFrame:
    """(node, id, vec) of the vectors of dim numbers that have a length, vec normalised float32. node is a hash of vec."""

    def unit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            with np.errstate(over="ignore", invalid="ignore"):
                norm = np.sqrt((values * values).sum(axis=1))
            good = np.isfinite(norm) & (norm > 0)
            vecs = [v.tobytes() for v in (values[good] / norm[good, None]).astype(np.float32) + np.float32(0)]
            node = np.array([xxhash.xxh3_64_intdigest(v) for v in vecs], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), batch.column(0).filter(pa.array(good)), blobs(vecs)], ["node", "id", "vec"])

    return rows.where(F.size("vec") == dim).mapInArrow(unit, f"node bigint, id {rows.schema['id'].dataType.simpleString()}, vec binary")


def _best(node: np.ndarray, nbr: np.ndarray, sim: np.ndarray, fresh: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each node, positions of its k most similar distinct neighbours; of equal ones the one marked old counts."""
    order = np.lexsort((fresh, nbr, node))
    n, b = node[order], nbr[order]
    once = np.append(True, (n[1:] != n[:-1]) | (b[1:] != b[:-1])) if len(n) else np.zeros(0, bool)
    order = order[once & (n != b)]
    order = order[np.lexsort((nbr[order], -sim[order], node[order]))]
    n = node[order]
    first, end = _spans(n)
    for a, z in zip(first.tolist(), end.tolist(), strict=True):
        yield int(n[a]), order[a : min(z, a + k)]


def _state(found: Iterator[tuple[int, np.ndarray]], nbr: np.ndarray, sim: np.ndarray, fresh: np.ndarray) -> pa.RecordBatch:
    rows = list(found)
    return pa.RecordBatch.from_arrays(
        [pa.array([n for n, _ in rows], pa.int64()), blobs([nbr[o] for _, o in rows]), blobs([sim[o] for _, o in rows]), blobs([fresh[o] for _, o in rows])],
        ["node", "nbrs", "sims", "fresh"],
    )


def _flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lists = table.column("nbrs").to_pylist()
    size = np.array([len(x) // 8 for x in lists], np.int64)
    nbr = np.frombuffer(b"".join(lists), np.int64)
    sim = np.frombuffer(b"".join(table.column("sims").to_pylist()), np.float32)
    fresh = np.frombuffer(b"".join(table.column("fresh").to_pylist()), bool)
    return np.repeat(table.column("node").to_numpy(), size), nbr, sim, fresh


def _merged(lists: DataFrame, k: int, parts: int) -> DataFrame:
    """Lists of the same node put together, the k best kept."""

    def merge(table: pa.Table) -> Iterator[pa.RecordBatch]:
        node, nbr, sim, fresh = _flat(table)
        yield _state(_best(node, nbr, sim, fresh, k), nbr, sim, fresh)

    return _grouped(lists, "node", parts, merge, STATE)


def bucket_lists(vectors: DataFrame, dim: int, bits: int, tables: range, k: int, parts: int, block: int = 512) -> DataFrame:
    """Lists of the nearest vectors within buckets of equal signs on random hyperplanes, several tables of them."""

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = {t: np.random.default_rng(1000 + t).standard_normal((dim, max(1, bits))).astype(np.float32) for t in tables}
        for batch in batches:
            x = _floats(batch.column(1), dim)
            short = blobs([v.tobytes() for v in x.astype(np.float16)])
            for t in tables:
                code = ((x @ planes[t]) > 0) @ (1 << np.arange(max(1, bits), dtype=np.int64))
                code = code if bits else np.zeros_like(code)
                key = mix(code.astype(np.uint64) + np.uint64(t << 48)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0), short], ["key", "node", "vec"])

    def near(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, node, x = table.column("key").to_numpy(), table.column("node").to_numpy(), _floats(table.column("vec"), dim, np.float16)
        out: list[list[np.ndarray]] = [[], [], []]
        for a, z in zip(*_spans(key), strict=True):
            order = a + np.argsort(mix(node[a:z].view(np.uint64) + key[a : a + 1].view(np.uint64)), kind="stable")
            pieces = max(1, -(-(z - a) // block))
            for own in np.array_split(order, pieces):
                if len(own) < 2:
                    continue
                y = x[own].astype(np.float32)
                s = y @ y.T
                np.fill_diagonal(s, -2)
                m = min(k, len(own) - 1)
                top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                out[0].append(np.repeat(node[own], m))
                out[1].append(node[own][top].ravel())
                out[2].append(np.take_along_axis(s, top, 1).ravel())
        if out[0]:
            n, b, s = (np.concatenate(v) for v in out)
            new = np.ones(len(n), bool)
            yield _state(_best(n, b, s, new, k), b, s, new)

    rows = vectors.select("node", "vec").mapInArrow(spread, "key bigint, node bigint, vec binary")
    return _grouped(rows, "key", parts, near, STATE)


def descended(state: DataFrame, vectors: DataFrame, dim: int, k: int, parts: int) -> DataFrame:
    """One round: lists improved by pairs among each node's neighbours and reverse neighbours.

    A pair is compared if one of its two edges to the node is new; a list's
    worst similarity goes along with its vector, so that only improvements are
    sent on. Of the reverse neighbours at most k, new ones first, take part.
    """

    def reverse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, nbr, _, fresh = _flat(pa.Table.from_batches([batch]))
            yield pa.RecordBatch.from_arrays([pa.array(nbr), pa.array(node), pa.array(fresh)], ["node", "of", "new"])

    def send(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Rows of a node: one with its vector and list, and one for each reverse neighbour."""
        node, kind = table.column("node").to_numpy(), table.column("vec").is_valid().to_numpy()
        of, new = table.column("of").fill_null(0).to_numpy(), table.column("new").fill_null(False).to_numpy(zero_copy_only=False)
        vecs, lists, sims, marks = (table.column(c).to_pylist() for c in ("vec", "nbrs", "sims", "fresh"))
        to, mark, sender = [], [], []
        worst: dict[int, float] = {}
        for a, z in zip(*_spans(node), strict=True):
            own = a + np.flatnonzero(kind[a:z])
            if not len(own):
                continue
            at = int(own[0])
            forward = np.frombuffer(lists[at] or b"", np.int64)
            s = np.frombuffer(sims[at] or b"", np.float32)
            worst[at] = float(s.min()) if len(s) >= k else -2.0
            back = a + np.flatnonzero(~kind[a:z])
            if len(back) > k:
                back = back[np.lexsort((mix(of[back].view(np.uint64) ^ np.uint64(len(back))), ~new[back]))[:k]]
            targets = np.concatenate([forward, of[back]])
            flags = np.concatenate([np.frombuffer(marks[at] or b"", bool), new[back]])
            order = np.lexsort((~flags, targets))
            targets, flags = targets[order], flags[order]
            first = np.append(True, targets[1:] != targets[:-1]) if len(targets) else np.zeros(0, bool)
            to.append(targets[first])
            mark.append(flags[first])
            sender += [at] * int(first.sum())
        if sender:
            to, mark, sender = np.concatenate(to), np.concatenate(mark), np.array(sender)
            for i in range(0, len(to), 1 << 16):
                part = sender[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[i : i + (1 << 16)]), pa.array(node[part]), pa.array(mark[i : i + (1 << 16)]), pa.array([worst[j] for j in part.tolist()], pa.float32()), pa.array([vecs[j] for j in part.tolist()], pa.binary())],
                    ["hub", "node", "new", "worst", "vec"],
                )

    def local(table: pa.Table) -> Iterator[pa.RecordBatch]:
        hub, node = table.column("hub").to_numpy(), table.column("node").to_numpy()
        new, worst = table.column("new").to_numpy(zero_copy_only=False), table.column("worst").to_numpy()
        x = _floats(table.column("vec"), dim, np.float16)
        first, end = _spans(hub)
        size = end - first
        order = np.argsort(size, kind="stable")
        a, b, s = [], [], []
        at = 0
        while at < len(order):
            m = int(size[order[at]])
            to = int(np.searchsorted(size[order], m, "right"))
            to = min(to, at + max(1, (1 << 20) // max(1, m * max(m, dim))))
            if m > 1:
                rows = first[order[at:to]][:, None] + np.arange(m)
                y = x[rows].astype(np.float32)
                sim = y @ y.transpose(0, 2, 1)
                ok = (new[rows][:, :, None] | new[rows][:, None, :]) & (sim > np.minimum(worst[rows][:, :, None], worst[rows][:, None, :]))
                g, i, j = np.nonzero(np.triu(ok, 1))
                a.append(node[rows[g, i]])
                b.append(node[rows[g, j]])
                s.append(sim[g, i, j])
                # each direction only where it improves that list
                w = np.stack([s[-1] > worst[rows[g, i]], s[-1] > worst[rows[g, j]]])
                a[-1], b[-1], s[-1] = np.concatenate([a[-1][w[0]], b[-1][w[1]]]), np.concatenate([b[-1][w[0]], a[-1][w[1]]]), np.concatenate([s[-1][w[0]], s[-1][w[1]]])
            at = to
        if a:
            n, m_, s_ = np.concatenate(a), np.concatenate(b), np.concatenate(s)
            mark = np.ones(len(n), bool)
            yield _state(_best(n, m_, s_, mark, k), m_, s_, mark)

    short = vectors.select("node", "vec")

    def halve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _floats(batch.column(1), dim).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0), blobs([v.tobytes() for v in x])], ["node", "vec"])

    own = short.mapInArrow(halve, "node bigint, vec binary").join(state, "node", "left").select("node", "vec", "nbrs", "sims", "fresh", F.lit(None).cast("bigint").alias("of"), F.lit(None).cast("boolean").alias("new"))
    back = state.mapInArrow(reverse, "node bigint, of bigint, new boolean").select("node", *[F.lit(None).cast("binary").alias(c) for c in ("vec", "nbrs", "sims", "fresh")], "of", "new")
    messages = _grouped(own.unionByName(back), "node", parts, send, "hub bigint, node bigint, new boolean, worst float, vec binary")
    better = _grouped(messages, "hub", parts, local, STATE)
    old = state.withColumn("fresh", F.expr("cast(repeat(char(0), cast(length(nbrs) / 8 as int)) as binary)"))
    return _merged(old.unionByName(better), k, parts)


def _edges(state: DataFrame, least: float) -> DataFrame:
    """(a, b) of the listed pairs of at least the given similarity, a < b."""

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, nbr, sim, _ = _flat(pa.Table.from_batches([batch]))
            ok = sim >= least
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node, nbr)[ok]), pa.array(np.maximum(node, nbr)[ok])], ["a", "b"])

    return state.mapInArrow(pick, "a bigint, b bigint").distinct()


def _saturated(state: DataFrame, least: float, k: int) -> DataFrame:
    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [len(s) == 4 * k and bool((np.frombuffer(s, np.float32) >= least).all()) for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_()))], ["node"])

    return state.mapInArrow(pick, "node bigint")


def _confirmed(edges: DataFrame, nodes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """The edges whose similarity in full precision reaches the threshold, with the numbers of ids at either end."""
    v = nodes.select("node", "vec", "m")
    both = edges.join(v.select(F.col("node").alias("a"), F.col("vec").alias("va"), F.col("m").alias("ma")), "a")
    both = both.join(v.select(F.col("node").alias("b"), F.col("vec").alias("vb"), F.col("m").alias("mb")), "b")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sim = np.einsum("ij,ij->i", _floats(batch.column(2), dim), _floats(batch.column(3), dim), dtype=np.float64)
            ok = pa.array(sim >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(ok) for k in (0, 1, 4, 5)], ["a", "b", "ma", "mb"])

    return both.select("a", "b", "va", "vb", "ma", "mb").mapInArrow(compare, "a bigint, b bigint, ma bigint, mb bigint")


LINKS = "node bigint, links bigint, root bigint"


def _enlarged(components: DataFrame, nodes: DataFrame, dim: int, threshold: float, block: int = 1024) -> DataFrame:
    """(node, links, root): the links of saturated nodes within components(node, component, full).

    The list of a saturated node is enlarged to all of its component: it is
    compared with every other node there, block by block. A task returns for
    its pair of blocks the number of ids that each node is linked to, and a
    forest that connects the same nodes as its links, but no pairs.
    """
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    rows = components.join(sizes, "component").join(nodes.select("node", "vec", "m"), "node")
    rows = rows.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).withColumn("own", F.pmod(F.hash("node"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "vec", "m", "full")
    rows = rows.withColumn("key", F.xxhash64("component", "low", "high")).select("key", "low", "high", "own", "node", "vec", "m", "full")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        key, node, own, low, high, m = (table.column(c).to_numpy() for c in ("key", "node", "own", "low", "high", "m"))
        full = table.column("full").to_numpy()
        order = np.argsort(key, kind="stable")
        x = _floats(table.column("vec"), dim)
        for a, z in zip(*_spans(key[order]), strict=True):
            rows = order[a:z]
            place = np.empty(len(rows), np.int64)  # rows of the two sides, numbered from 0
            place[:] = np.arange(len(rows))
            same = low[rows[0]] == high[rows[0]]
            left, right = place[own[rows] == low[rows]], place[own[rows] == high[rows]]
            links, label = np.zeros(len(rows), np.int64), np.arange(len(rows))
            f = full[rows]
            # every pair with a saturated node, once
            for i, j in ((left[f[left]], right), (left[~f[left]], right[f[right]])):
                for part in np.array_split(i, max(1, -(-len(i) // block))):
                    p, q = np.nonzero(x[rows[part]] @ x[rows[j]].T >= threshold - 1e-4)
                    p, q = part[p], j[q]
                    if same:
                        keep = (p != q) & (~(f[p] & f[q]) | (p < q)) & (f[p] | ~f[q])
                        p, q = p[keep], q[keep]
                    for k in range(0, len(p), 1 << 17):
                        u, v = p[k : k + (1 << 17)], q[k : k + (1 << 17)]
                        # float64 sums decide the pairs close to the threshold
                        ok = np.einsum("ij,ij->i", x[rows[u]], x[rows[v]], dtype=np.float64) >= threshold
                        u, v = u[ok], v[ok]
                        links += np.bincount(u, m[rows[v]], len(rows)).astype(np.int64) + np.bincount(v, m[rows[u]], len(rows)).astype(np.int64)
                        label = components_of(np.append(u, np.arange(len(rows))), np.append(v, label), len(rows))
            some = np.flatnonzero(links)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(node[rows[some]]), pa.array(links[some]), pa.array(node[rows[label[some]]])], ["node", "links", "root"])

    return rows.repartition("key").mapInArrow(compare, LINKS)


def _audit(nodes: DataFrame, found: DataFrame, dim: int, threshold: float, sample: int, enough: int = 200, most: int = 4096) -> tuple[int, int]:
    """(true links of the sampled nodes, those that were found).

    The sample is taken by hash and grows fourfold, to most nodes, until it has
    enough links; its nodes are compared with every other.
    """
    while True:
        picked = nodes.orderBy(F.xxhash64("node", F.lit(1)), "node").limit(sample).select("node", "vec")
        rows = picked.collect()
        if not rows:
            return 0, 0
        names = np.array([r["node"] for r in rows])
        y = np.frombuffer(b"".join(bytes(r["vec"]) for r in rows), np.float32).reshape(-1, dim)

        def find(batches: Iterable[pa.RecordBatch], names: np.ndarray = names, y: np.ndarray = y) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(names), np.int64)
            for batch in batches:
                node, x, m = batch.column(0).to_numpy(), _floats(batch.column(1), dim), batch.column(2).to_numpy()
                i, j = np.nonzero(x @ y.T >= threshold - 1e-4)
                ok = (np.einsum("ij,ij->i", x[i], y[j], dtype=np.float64) >= threshold) & (node[i] != names[j])
                total += np.bincount(j[ok], m[i[ok]], len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total)], ["node", "links"])

        true = nodes.select("node", "vec", "m").mapInArrow(find, "node bigint, links bigint").groupBy("node").agg(F.sum("links").alias("links"))
        got = true.join(found.select("node", F.col("links").alias("hit")), "node", "left").agg(F.sum("links").alias("n"), F.sum("hit").alias("hits")).first()
        if (got["n"] or 0) >= enough or sample >= most or len(rows) < sample:
            return got["n"] or 0, got["hits"] or 0
        sample *= 4


def _linked(nodes: DataFrame, dim: int, threshold: float, k: int, tables: int, max_rounds: int, settled: float, audit: int, least_recall: float, more_tables: int) -> tuple[DataFrame, int, int, int]:
    """((node, links, component) of the nodes with links, true and found links of the audit, rounds)."""
    spark = nodes.sparkSession
    n = nodes.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * 2 * k * (2 * dim + 32) // (32 << 20)))
    least = threshold - 0.005  # lists hold half-precision similarities
    bits = max(0, int(np.log2(max(1, n / 128))))
    state = written(_merged(bucket_lists(nodes, dim, bits, range(tables), k, parts), k, parts), "lists")
    rounds, more = 0, 0
    while True:
        for _ in range(max_rounds):
            fresh = state.agg(F.sum(F.length(F.translate(F.hex("fresh"), "0", ""))).alias("new"), F.sum(F.length("fresh")).alias("all")).first()
            if not fresh["all"] or fresh["new"] <= settled * fresh["all"]:
                break
            after = written(descended(state, nodes, dim, k, parts), "lists")
            dropped(state)
            state, rounds = after, rounds + 1
        full = written(_saturated(state, least, k), "full")
        near = written(_edges(state, least), "near")
        hot = full.limit(1).count() > 0
        rest = near if not hot else near.join(full.withColumnRenamed("node", "a"), "a", "left_anti").join(full.withColumnRenamed("node", "b"), "b", "left_anti")
        pairs = written(_confirmed(rest, nodes, dim, threshold), "pairs")
        both = pairs.select(F.col("a").alias("node"), F.col("mb").alias("links"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("ma").alias("links"), F.col("a").alias("root")))
        if hot:
            labels = written(connected_components(near), "components")
            marked = labels.join(full.withColumn("full", F.lit(True)), "node", "left").withColumn("full", F.coalesce("full", F.lit(False)))
            of_hot = marked.where("full").select("component").distinct()
            both = both.unionByName(_enlarged(marked.join(of_hot, "component"), nodes, dim, threshold))
            both = written(both, "links")
            dropped(labels)
        links = written(both.groupBy("node").agg(F.sum("links").alias("links")), "counts")
        true, hits = _audit(nodes, links, dim, threshold, audit)
        done = not true or hits >= least_recall * true or more == more_tables
        if done:
            edges = both.select(F.col("node").alias("a"), F.col("root").alias("b"))
            found = written(links.join(connected_components(edges), "node"), "linked")
        for x in (full, near, pairs, links, both):
            dropped(x)
        if done:
            dropped(state)
            return found, true, hits, rounds
        more += 1
        extra = bucket_lists(nodes, dim, bits, range(tables * more, tables * (more + 1)), k, parts)
        after = written(_merged(state.unionByName(extra), k, parts), "lists")
        dropped(state)
        state = after


def duplicate_classes(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    threshold: float = 0.9,
    k: int = 16,
    tables: int = 4,
    max_rounds: int = 8,
    settled: float = 0.02,
    audit: int = 256,
    least_recall: float = 0.95,
    more_tables: int = 4,
) -> NearDuplicates:
    """(id, class_id, n_links) of every row with an id, and the audit's recall.

    Two vectors are linked if their cosine is at least threshold; n_links is
    the number of other ids linked to the row's, class_id the least id that is
    reached from it by links, its own if it has none.

    Vectors equal after normalisation are one node, so that copies don't fill
    the lists: they are links of each other, and a link of their node is one to
    each of them.  Lists start from sign buckets and descend until a round
    renews less than settled of all entries or max_rounds are done.  The list
    of a node that is full of near duplicates is enlarged to its whole
    component.  While the audit finds less than least_recall of the true links
    of its sample, bucket tables are added and the descent goes on, more_tables
    times at most.  Links are counted, never stated pair by pair for a group.

    A row with an unusable vector (null, empty, with null or infinite entries,
    or zero) has class_id null and no links.  Vectors of different lengths are
    never linked; each length is treated on its own.  Rows with a null id are
    left out.  Repeated rows give one row; an id with several vectors gives one
    for each, and counts as several.  Ties in similarity go to the lower node.
    Empty table: no rows, recall 1.  Other columns are ignored.
    """
    kind = df.select(quoted(id_col).alias("id")).schema["id"].dataType.simpleString()
    rows = usable(df, id_col, vec_col)
    dims = sorted(r[0] for r in rows.select(F.size("vec")).distinct().collect())
    out, good = None, None
    true = hits = rounds = 0
    for dim in dims:
        own = written(prepared(rows, dim).dropDuplicates(["node", "id"]), "embeddings")
        nodes = written(own.groupBy("node").agg(F.first("vec").alias("vec"), F.count("*").alias("m"), F.min("id").alias("least")), "nodes")
        linked, t, h, r = _linked(nodes, dim, threshold, k, tables, max_rounds, settled, audit, least_recall, more_tables)
        true, hits, rounds = true + t, hits + h, max(rounds, r)
        names = nodes.select("node", "m", "least").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
        class_id = names.groupBy("component").agg(F.min("least").alias("class_id"))
        names = names.join(class_id, "component").select("node", "class_id", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"))
        part = own.select("id", "node").join(names, "node").select("id", "class_id", "n_links")
        out = part if out is None else out.unionByName(part)
        ids = own.select("id")
        good = ids if good is None else good.unionByName(ids)
    every = df.select(quoted(id_col).alias("id")).where("id is not null").distinct()
    bad = every if good is None else every.join(good.distinct(), "id", "left_anti")
    bad = bad.select("id", F.lit(None).cast(kind).alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return NearDuplicates(bad if out is None else out.unionByName(bad), hits / true if true else 1.0, true, rounds)
