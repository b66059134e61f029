"""Packing of documents with their nearest neighbours under BM25.

An inverted index of all documents is kept in shards.  In each of a few rounds
a fixed share of the documents that are still unused are seeds: every seed
queries all shards and gets a list of its best unused documents, a document in
several lists goes to the one it stands highest in, and each seed fills its
windows greedily in the order of what is left of its list.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from textloom.llm.common import blobs, quoted, trim, trimming
from textloom.llm.sentences import row_key
from textloom.llm.tokens import best_fit_decreasing
from textloom.llm.words import Buffer, lowered, slices, words
from textloom.storage import dropped, written

PART = 1 << 14
K1, B = 1.2, 0.75
#: Bits of a term's hash, of the bucket its document frequency is counted in, and of a place within a piece.
TERM, FREQUENCY, PLACE = 31, 20, 8
#: The round in which the ids of each residue modulo 20 are seeds: one in 20 at first, more as fewer documents are left.
TURNS = [0, 1, 2, 2, 3, 3, 3, 4, 4, 4, 4, 4, 4, 5, 5, 5, 5, 5, 5, 5]
#: An entry of a list of documents costs as much as so many cells of the matrix product (measured).
LISTED = 250
STEP = np.float32(256)  # scores are compared in steps of 1/256, so that sums in another order rank alike
PIECE = "piece bigint, ids array<{id}>, keys binary, lengths binary, turns binary, terms binary, ends binary, counts binary"


def index_pieces(df: DataFrame, id_col: str, text_col: str, piece_terms: int = 1 << 16) -> DataFrame:
    """The documents with words, in pieces of at most 2**PLACE of them, each formed where its documents lie.

    Document i of a piece has the distinct terms terms[ends[i - 1]:ends[i]],
    ascending, each counts times, and lengths[i] words in all.  turns[i] is
    the round in which it is a seed, keys[i] a hash of its id and text.
    """
    names = [x.split()[0] for x in PIECE.split(", ")]

    @trimming
    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        for batch in batches:
            text = lowered(batch.column(1))
            o = text.offsets
            batch_keys, turn = batch.column(2).to_numpy(), batch.column(3).to_numpy().astype(np.uint8)
            for i, j in slices(batch.num_rows, np.diff(o), 1 << 17):
                w = words(Buffer(text.data[o[i] : o[j]], o[i : j + 1] - o[i]))
                size = np.diff(w.bounds)
                of = np.repeat(np.arange(j - i, dtype=np.uint64), size)
                pair = np.sort((of << np.uint64(TERM)) | (w.hash >> np.uint64(64 - TERM)))
                first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
                count = np.diff(np.append(first, len(pair))).astype(np.int32)
                pair = pair[first]
                some = np.flatnonzero(size)
                distinct = np.bincount((pair >> np.uint64(TERM)).astype(np.int64), minlength=j - i)[some]
                term = (pair & np.uint64((1 << TERM) - 1)).astype(np.int32)
                total = np.append(0, np.cumsum(distinct))
                for a, z in slices(len(some), distinct, piece_terms):
                    for a, z in ((k, min(k + (1 << PLACE), z)) for k in range(a, z, 1 << PLACE)):
                        own = i + some[a:z]
                        t0, t1 = total[a], total[z]
                        columns = (batch_keys[own], size[own - i].astype(np.int32), turn[own], term[t0:t1], total[a + 1 : z + 1] - t0, count[t0:t1])
                        ids = pa.ListArray.from_arrays(pa.array([0, z - a], pa.int32()), batch.column(0).take(pa.array(own)))
                        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids, *(blobs([c]) for c in columns)], names)
                        number += 1

    id_, text = quoted(id_col), quoted(text_col).cast("string")
    kind = df.select(id_.alias("id")).schema["id"].dataType
    key = row_key(id_, text)
    residue = F.coalesce(F.pmod(id_ if isinstance(kind, IntegralType) else F.xxhash64(id_), F.lit(20)), F.pmod(key, F.lit(20)))
    rows = df.select(id_.alias("id"), text.alias("text"), key.alias("key"), F.element_at(F.array(*[F.lit(t) for t in TURNS]), residue.cast("int") + 1).alias("turn")).where("text is not null")
    return rows.mapInArrow(build, PIECE.format(id=kind.simpleString()))


def statistics(pieces: DataFrame) -> tuple[np.ndarray, int, int]:
    """Document frequency of each bucket of terms, number of documents and of words, over all of them."""
    schema = "part int, counts binary, n bigint, size bigint"

    @trimming
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, size = np.zeros(1 << FREQUENCY, np.int64), 0, 0
        for batch in batches:
            for k in range(0, batch.num_rows, 64):  # a few MB at a time
                length, terms = (np.frombuffer(b"".join(batch.column(c).slice(k, 64).to_pylist()), np.int32) for c in (0, 1))
                total += np.bincount(terms >> (TERM - FREQUENCY), minlength=1 << FREQUENCY)
                n, size = n + len(length), size + int(length.sum())
        parts = np.arange(len(total) // PART)
        yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), blobs(list(total.reshape(-1, PART))), pa.array(np.where(parts == 0, n, 0)), pa.array(np.where(parts == 0, size, 0))], ["part", "counts", "n", "size"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, size = np.zeros(PART, np.int64), 0, 0
        for batch in batches:
            for x in batch.column("counts").to_pylist():
                total += np.frombuffer(x, np.int64)
            n += pc.sum(batch.column("n")).as_py()
            size += pc.sum(batch.column("size")).as_py()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), blobs([total]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["part", "counts", "n", "size"])

    total, n, size = np.zeros(1 << FREQUENCY, np.int64), 0, 0
    for part, counts, k, s in pieces.select("lengths", "terms").mapInArrow(count, schema).groupBy("part").applyInArrow(add, schema).toLocalIterator():
        total[part * PART : (part + 1) * PART] = np.frombuffer(bytes(counts), np.int64)
        n, size = n + k, size + s
    return total, n, size


def spans(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the ranges first[i]:last[i], one after the other."""
    size = last - first
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(first - end + size, size)


class Likeness(NamedTuple):
    """Groups documents by the common terms they have. It decides only which are compared together, never the scores."""

    buckets: np.ndarray
    mean: np.ndarray
    axes: np.ndarray

    def presence(self, size: np.ndarray, terms: np.ndarray) -> np.ndarray:
        bucket = terms >> (TERM - FREQUENCY)
        at = np.searchsorted(self.buckets, bucket)
        at[at == len(self.buckets)] = 0
        there = self.buckets[at] == bucket
        out = np.zeros((len(size), len(self.buckets)), np.float32)
        out[np.repeat(np.arange(len(size)), size)[there], at[there]] = 1
        return out

    def group(self, size: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """A small number for each document, of the signs of its principal components."""
        if not len(self.mean):
            return np.zeros(len(size), np.int64)
        return ((self.presence(size, terms) - self.mean) @ self.axes > 0) @ (1 << np.arange(self.axes.shape[1], dtype=np.int64)[::-1])


def likeness(pieces: DataFrame, frequency: np.ndarray, n: int, terms: int = 256, axes: int = 4, sample: int = 16) -> Likeness:
    """Fitted on about sample pieces, chosen by a hash."""
    top = np.argsort(-frequency, kind="stable")[:terms]
    raw = Likeness(np.sort(top[frequency[top] > 0]), np.zeros(0), np.zeros((0, 0)))
    picked = pieces.where(F.pmod(F.xxhash64("piece"), F.lit(max(1, (n >> PLACE) // sample))) == 0).limit(4 * sample).select("ends", "terms").collect()
    if not picked:
        return raw
    x = np.concatenate([raw.presence(np.diff(np.frombuffer(bytes(r["ends"]), np.int64), prepend=0), np.frombuffer(bytes(r["terms"]), np.int32)) for r in picked])
    mean = x.mean(axis=0)
    _, vectors = np.linalg.eigh((x - mean).T @ (x - mean))
    return Likeness(raw.buckets, mean, np.ascontiguousarray(vectors[:, ::-1][:, :axes]))


def numbered(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms, ascending, and the number of each of the terms among them."""
    distinct, which = np.unique(terms), np.empty(len(terms), np.int32)
    for a in range(0, len(terms), PART):
        which[a : a + PART] = np.searchsorted(distinct, terms[a : a + PART])
    return distinct, which


class Queries(NamedTuple):
    """A block of queries: query row[i] has the term terms[term[i]]. Rows ascend."""

    n: int
    terms: np.ndarray  # distinct, ascending
    term: np.ndarray
    row: np.ndarray

    @classmethod
    def of(cls, ptr: np.ndarray, terms: np.ndarray) -> Queries:
        return cls.blocks(ptr, terms, max(1, len(ptr) - 1))[0]

    @classmethod
    def blocks(cls, ptr: np.ndarray, terms: np.ndarray, block: int) -> list[Queries]:
        """Blocks of at most so many queries, which share their terms."""
        distinct, which = numbered(terms)
        n = len(ptr) - 1
        return [cls.part(ptr, distinct, which, a, min(a + block, n)) for a in range(0, max(n, 1), block)]

    @classmethod
    def part(cls, ptr: np.ndarray, distinct: np.ndarray, which: np.ndarray, a: int, z: int) -> Queries:
        """The queries a to z of those whose terms numbered() has told apart."""
        return cls(z - a, distinct, which[ptr[a] : ptr[z]], np.repeat(np.arange(z - a, dtype=np.int32), np.diff(ptr[a : z + 1])))


class Shard:
    """The inverted index of some documents, which scores them by BM25 for blocks of queries.

    Document i has the distinct terms term[ptr[i]:ptr[i + 1]], each count
    times. The dense commonest terms are also the columns of a matrix. For a
    block of queries, those of them that many of its queries have are
    multiplied as a matrix, all other terms are lists of documents that are
    added up, some queries at a time. Lists of about the same length are the
    rows of one table, filled up with entries of no impact, so that whole rows
    are copied.
    """

    def __init__(self, ptr: np.ndarray, term: np.ndarray, count: np.ndarray, length: np.ndarray, idf: np.ndarray, mean: float, dense: int = 1024):
        self.n = len(ptr) - 1
        doc = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(ptr))
        norm = (K1 * (1 - B + B * length / max(mean, 1e-9))).astype(np.float32)
        impact = count.astype(np.float32)
        impact *= idf[term >> (TERM - FREQUENCY)] * np.float32(K1 + 1) / (impact + norm[doc])
        key = term.astype(np.uint64) << np.uint64(32) | np.arange(len(term), dtype=np.uint64)
        key.sort()
        order, term = (key & np.uint64(0xFFFFFFFF)).astype(np.int64), (key >> np.uint64(32)).astype(np.int32)
        doc, impact = doc[order], impact[order]
        del key, order
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        self.size = np.diff(np.append(first, len(term)))
        self.terms = term[first]
        common = np.sort(np.argpartition(-self.size, dense)[:dense]) if len(self.size) > dense else np.arange(len(self.size))
        self.column = np.full(len(self.size), -1)
        self.column[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), self.n), np.float32)
        entry = spans(first[common], first[common] + self.size[common])
        self.matrix[np.repeat(np.arange(len(common)), self.size[common]), doc[entry]] = impact[entry]
        widths = np.unique([k << b for b in range(int(self.size.max(initial=1)).bit_length() + 1) for k in (2, 3)] + [1])
        self.kind, self.slot = np.searchsorted(widths, self.size).astype(np.uint8), np.empty(len(self.size), np.int64)
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        for k, width in enumerate(widths.tolist()):
            own = np.flatnonzero(self.kind == k)
            self.slot[own] = np.arange(len(own))
            there = np.arange(width) < self.size[own, None]
            entry = spans(first[own], first[own] + self.size[own])
            docs, impacts = np.tile(np.arange(width) % max(self.n, 1), (len(own), 1)), np.zeros((len(own), width))
            docs[there], impacts[there] = doc[entry], impact[entry]
            self.tables.append((docs, impacts))
        self.asked, self.at = None, np.zeros(0, np.int32)

    def _find(self, terms: np.ndarray) -> np.ndarray:
        """The number here of each of the terms, -1 for others; kept for the next block of the same queries."""
        if self.asked is not terms:
            place = np.searchsorted(terms, self.terms)
            place[place == len(terms)] = 0
            there = np.flatnonzero(terms[place] == self.terms) if len(terms) else np.zeros(0, np.int64)
            self.asked, self.at = terms, np.full(len(terms), -1, np.int32)
            self.at[place[there]] = there
        return self.at

    def scores(self, q: Queries) -> np.ndarray:
        """Scores of all documents (columns) for each query."""
        at = self._find(q.terms)[q.term]
        here = np.flatnonzero(at >= 0)
        row, at = q.row[here], at[here]
        pay = (self.column >= 0) & (LISTED * self.size * np.bincount(at, minlength=len(self.size)) > self.n * q.n)
        dense = np.flatnonzero(pay)
        asked = np.zeros((q.n, len(dense)), np.float32)
        number = np.full(len(pay), -1, np.int32)
        number[dense] = np.arange(len(dense))
        column = number[at]
        common = np.flatnonzero(column >= 0)
        asked.reshape(-1)[row[common].astype(np.int64) * len(dense) + column[common]] = 1
        out = asked @ self.matrix[self.column[dense]]
        rest = np.flatnonzero(column < 0)
        row, at = row[rest], at[rest]
        a = 0
        for i, j in slices(q.n, np.bincount(row, self.size[at], q.n) + self.n, CELLS):
            z = a + int(np.searchsorted(row[a:], j))
            if z > a:
                cell, impact = self._listed((row[a:z] - i).astype(np.int64) * self.n, at[a:z])
                out[i:j] += np.bincount(cell, impact, (j - i) * self.n).reshape(j - i, self.n)
            a = z
        return out

    def _listed(self, base: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of the lists of terms at: base plus the number of the document, and its impact."""
        kind = self.kind[at]
        order, number = np.argsort(kind, kind="stable"), np.bincount(kind, minlength=len(self.tables)).tolist()
        base, slot = base[order], self.slot[at[order]]
        total = sum(n * docs.shape[1] for n, (docs, _) in zip(number, self.tables, strict=True))
        cell, impact = np.empty(total, np.int64), np.empty(total)
        a = to = 0
        for n, (docs, impacts) in zip(number, self.tables, strict=True):
            if n:
                own, part = slot[a : a + n], slice(to, to + n * docs.shape[1])
                cells = cell[part].reshape(n, -1)
                docs.take(own, axis=0, out=cells, mode="clip")
                cells += base[a : a + n, None]
                impacts.take(own, axis=0, out=impact[part].reshape(n, -1), mode="clip")
                a, to = a + n, part.stop
        return cell, impact


def _ranked(query: np.ndarray, place: np.ndarray, far: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The order by query, then falling score, then far, then place."""
    step = np.rint(score.astype(np.float64) * STEP)
    if len(step) and 0 <= step.min() and step.max() < 1 << 22 and 0 <= query.min() and query.max() < 1 << 10:  # all in 64 bits
        key = query.astype(np.uint64) << np.uint64(54) | ((1 << 22) - 1 - step).astype(np.uint64) << np.uint64(32) | far.astype(np.uint64)
        order = np.argsort(key)
        key = key[order]
        if not (key[1:] == key[:-1]).any():
            return order
    return np.lexsort((place, far, -score, query))


def best(query: np.ndarray, place: np.ndarray, far: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """The most best entries of each query, best first; ties go to the nearest by far, then to the lower place."""
    order = _ranked(query, place, far, score)
    query = query[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < most
    order = order[keep]
    return query[keep], place[order], far[order], score[order]


def _free(row: dict, width: int, turn: int) -> np.ndarray:
    """Which documents of a piece are unused, have a rest to be placed, and whose turn is later."""
    length = np.frombuffer(row["lengths"], np.int32)
    free = (length % width > 0) & (np.frombuffer(row["turns"], np.uint8) > turn)
    if row["taken"] is not None:
        free &= ~np.unpackbits(np.array(row["taken"], np.int64).view(np.uint8), bitorder="little")[: len(free)].astype(bool)
    return free


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def narrow(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 in as few bytes as they need, which is one for nearly all counts."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _places(piece: int, n: int) -> np.ndarray:
    return (piece << PLACE) + np.arange(n)


def seeds_of(state: DataFrame, width: int, turn: int) -> DataFrame:
    """(place, key, terms) of the unused documents whose turn it is."""

    @trimming
    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                own = np.flatnonzero(_free(row, width, turn - 1) & (np.frombuffer(row["turns"], np.uint8) == turn))
                ends, terms = np.frombuffer(row["ends"], np.int64), np.frombuffer(row["terms"], np.int32)
                begin = np.append(0, ends)
                if len(own):
                    lists = blobs([terms[begin[k] : ends[k]] for k in own.tolist()])
                    yield pa.RecordBatch.from_arrays([pa.array(_places(row["piece"], len(ends))[own]), pa.array(np.frombuffer(row["keys"], np.int64)[own]), lists], ["place", "key", "terms"])

    return state.select("piece", "keys", "lengths", "turns", "terms", "ends", "taken").mapInArrow(pick, "place bigint, key bigint, terms binary")


def neighbours(state: DataFrame, seeds: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], idf: Broadcast, mean: float, width: int, turn: int, most: int, shard_docs: int, like: Likeness, block: int = 512) -> DataFrame:
    """(place, seed, key, rank, score): for each seed its most best documents over all shards, ranks from 1.

    seeds: their places, keys, ptr, distinct terms and the numbers of each
    one's terms among these. Documents that are used, that are seeds of this
    round or before, or that score 0 are in no list.
    """
    sc = state.sparkSession.sparkContext
    named, shared = sc.broadcast(seeds[:2]), sc.broadcast(seeds[1:])
    leaf = min(shard_docs, LEAF)

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Shard, np.ndarray, np.ndarray]]:
        """The free documents of the pieces, like ones of like size together, leaf at a time: index, places and keys."""
        held: list[tuple[np.ndarray, ...]] = []
        docs = terms = 0

        def out() -> Iterator[tuple[Shard, np.ndarray, np.ndarray]]:
            columns = [list(x) for x in zip(*held, strict=True)]
            held.clear()
            term, count, size, length, place, key, group = (np.concatenate(columns.pop(0)) for _ in range(len(columns)))  # each column's parts go at once
            order = np.lexsort((-size, group >> 1))
            last = np.cumsum(size)
            parts = np.array_split(order, max(1, -(-len(order) // leaf)))
            for part in sorted(parts, key=lambda x: -int(size[x].sum())):  # large documents have most of the high scores: floors rise at once
                entry = spans(last[part] - size[part], last[part])
                yield Shard(np.append(0, np.cumsum(size[part])), term[entry], count[entry], length[part], idf.value, mean), place[part], key[part]

        for batch in batches:
            for row in rows_of(batch):
                free = _free(row, width, turn)
                if not free.any():
                    continue
                size = np.diff(np.frombuffer(row["ends"], np.int64), prepend=0)
                entries = np.repeat(free, size)
                term, size = np.frombuffer(row["terms"], np.int32)[entries], size[free]
                held.append((term, narrow(np.frombuffer(row["counts"], np.int32)[entries]), size, np.frombuffer(row["lengths"], np.int32)[free], _places(row["piece"], len(free))[free], np.frombuffer(row["keys"], np.uint64)[free], like.group(size, term)))
                docs, terms = docs + len(size), terms + len(term)
                if docs >= 3 * shard_docs or terms >= 768 * shard_docs:
                    yield from out()
                    docs = terms = 0
        if held:
            yield from out()

    @trimming
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, *queries = shared.value
        keys = keys.view(np.uint64)
        cuts = [(a, min(a + block, len(keys))) for a in range(0, len(keys), block)]
        held: list[list[tuple[np.ndarray, ...]]] = [[] for _ in cuts]
        floor = np.full(len(keys), 0.5 / STEP, np.float32)

        def settle(k: int) -> None:
            """Leave the best of what block k holds, and raise its floors to the last of full lists."""
            a, z = cuts[k]
            now = best(*(np.concatenate(x) for x in zip(*held[k], strict=True)), most)
            held[k] = [now]
            first, number = np.searchsorted(now[0], np.arange(z - a)), np.bincount(now[0], minlength=z - a)
            full = np.flatnonzero(number == most)
            floor[a + full] = np.maximum(floor[a + full], now[3][first[full] + most - 1] - np.float32(0.5) / STEP)

        for shard, docs, names in shards(batches):
            for k, (a, z) in enumerate(cuts):
                out = shard.scores(Queries.part(*queries, a, z))
                good = out >= floor[a:z, None]
                if shard.n > most and np.count_nonzero(good) > 2 * most * (z - a):
                    top = np.partition(out, shard.n - most, axis=1)[:, shard.n - most]
                    floor[a:z] = np.maximum(floor[a:z], top - 1 / STEP)
                    good = out >= floor[a:z, None]
                cell = np.flatnonzero(good)
                found = _candidates(*np.divmod(cell, shard.n), np.rint(out.reshape(-1)[cell] * STEP) / STEP, keys[a:z], names, most)
                held[k].append((found[0].astype(np.int32), docs[found[1]], *found[2:]))
                if sum(len(x[0]) for x in held[k][1:]) > most * (z - a) // 2 or len(held[k]) == 1:
                    settle(k)
        for k in range(len(cuts)):
            if held[k]:
                settle(k)
                (now,) = held[k]
                held[k] = []
                for part in range(0, block, LIST):  # rows of some 100 KB
                    of = slice(*np.searchsorted(now[0], (part, part + LIST)))
                    lists = ((x[of] - (part if n == 0 else 0)).astype(t) for n, (x, t) in enumerate(zip(now, TYPES, strict=True)))
                    yield pa.RecordBatch.from_arrays([pa.array([(k * block + part) // LIST], pa.int32()), *(blobs([x]) for x in lists)], ["block", "query", "place", "far", "score"])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            for k, t in enumerate(TYPES):
                parts[k] += [np.frombuffer(x, t) for x in batch.column(1 + k).to_pylist()]
        query, place, _, score = best(*map(np.concatenate, parts), most)
        rank = np.arange(len(query)) - np.searchsorted(query, query) + 1
        at = key[0].as_py() * LIST + query
        parts.clear()
        trim()
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(named.value[0][at]), pa.array(named.value[1][at]), pa.array(rank.astype(np.int32)), pa.array(score)], ["place", "seed", "key", "rank", "score"])

    # few tasks, so that each brings the lists of many shards together before they are sent on
    found = state.drop("ids").coalesce(sc.defaultParallelism).mapInArrow(search, "block int, query binary, place binary, far binary, score binary")
    return found.groupBy("block").applyInArrow(merge, "place bigint, seed bigint, key bigint, rank int, score float")


LEAF = 1024  # documents that are indexed together at most
CELLS = 1 << 17  # scores and entries of lists that are added up at once
LIST = 64  # queries whose lists are sent on together
TYPES = (np.int32, np.int64, np.uint32, np.float32)


def _candidates(i: np.ndarray, j: np.ndarray, score: np.ndarray, asked: np.ndarray, names: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """(query, document, far, score) of the entries that may be among the most best of their query.

    far is how far the document's key follows the query's, so that of many
    copies each seed prefers other ones.
    """
    far = ((names[j] - asked[i]) >> np.uint64(32)).astype(np.uint32)
    number = np.bincount(i, minlength=len(asked))
    if (many := np.flatnonzero(number > 4 * most)).size:  # ties without end: the best of each such query first
        bounds = np.append(0, np.cumsum(number))
        keep = np.repeat(number <= 4 * most, number)
        for q in many.tolist():
            own = np.arange(bounds[q], bounds[q + 1])
            keep[own[np.lexsort((far[own], -score[own]))[:most]]] = True
        i, j, far, score = i[keep], j[keep], far[keep], score[keep]
    return i, j, far, score


def _used(taken: list[DataFrame], pieces: int) -> DataFrame:
    """(piece, taken): which of each piece's documents are used, bit by bit; broadcast up to 64 MB at 64 bytes a piece."""
    every = reduce(DataFrame.unionByName, [t.select("place") for t in taken])
    word = (1 << PLACE) // 64
    bits = [F.coalesce(F.bit_or(F.expr(f"CASE WHEN shiftright(place, 6) % {word} = {k} THEN shiftleft(1L, cast(place & 63 AS int)) END")), F.lit(0).cast("bigint")) for k in range(word)]
    used = every.groupBy(F.shiftright("place", PLACE).alias("piece")).agg(F.array(*bits).alias("taken"))
    return F.broadcast(used) if 64 * pieces <= 64 << 20 else used


def assigned(pieces: DataFrame, idf: Broadcast, mean: float, width: int, list_docs: int, shard_docs: int, query_bytes: int, like: Likeness) -> list[DataFrame]:
    """(place, seed, rank, score) of every document with a rest to be placed, a written table for each round."""
    taken: list[DataFrame] = []
    number = pieces.count()
    for turn in range(max(TURNS) + 1):
        state = pieces.join(_used(taken, number), "piece", "left") if taken else pieces.withColumn("taken", F.lit(None).cast("array<bigint>"))
        seeds = written(seeds_of(state, width, turn), "seeds")
        size = seeds.agg(F.sum(F.length("terms") + 16).alias("bytes")).first()["bytes"]
        if not size:
            dropped(seeds)
            continue
        parts = -(-size // query_bytes)
        lists = []
        for part in range(parts):
            own = seeds.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).toArrow()
            place, key, terms = own.column(0).to_numpy(), own.column(1).to_numpy(), [np.frombuffer(x, np.int32) for x in own.column(2).to_pylist()]
            size = np.array([len(x) for x in terms])
            order = np.lexsort((place, size, like.group(size, np.concatenate(terms)) >> 1))
            queries = (place[order], key[order], np.append(0, np.cumsum([len(terms[k]) for k in order])), *numbered(np.concatenate([terms[k] for k in order])))
            lists.append(neighbours(state, queries, idf, mean, width, turn, list_docs, shard_docs, like))
        one = reduce(DataFrame.unionByName, lists).groupBy("place").agg(F.min(F.struct("rank", (-F.col("score")).alias("less"), "key", "seed")).alias("of"))
        one = one.select("place", "of.seed", "of.rank", (-F.col("of.less")).alias("score"))
        own = seeds.select("place", F.col("place").alias("seed"), F.lit(0).alias("rank"), F.lit(0).cast("float").alias("score"))
        taken.append(written(one.unionByName(own), "taken"))
        dropped(seeds)
    return taken


def retrieval_packed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2048, list_docs: int = 128, shard_docs: int = 4096, query_bytes: int = 8 << 20) -> DataFrame:
    """(shard, window, doc_ids, starts, lengths, scores, seed_ids, n_words): every word of every document in exactly one window.

    A window holds at most width words. A longer document gives windows of its
    own for each full width and takes part with the rest of its words; starts
    are the places of the pieces' first words in their documents.

    In the first round the documents whose id is divisible by 20 are seeds
    (of ids that aren't integers, a hash), in five more rounds those left of
    the other residues, see TURNS.  Every seed queries all shards of the index
    (made of the pieces of up to shard_docs documents that are left)
    exactly and gets its list_docs best unused documents that aren't seeds
    themselves.  A document in several lists goes to the one where its rank is
    lowest, then its score highest.  What a seed has got fills its windows
    greedily: in the order of ranks each goes to the first window of the seed
    that has room.  Windows that aren't full are then brought together by best
    fit, so a window may hold several seeds, each followed by its neighbours:
    seed_ids names the seed of each piece, scores are the BM25 scores for it,
    0 for the seed.

    The mean length is that of all documents.  Document frequencies are those
    of all documents, counted in 2**20 buckets of hashed terms; terms are told
    apart by 31 bits.  Scores are compared in steps of 1/256.  Seeds go to the
    shards in parts of at most query_bytes.

    Null and wordless texts are in no window.  Null ids are kept.  Repeated
    rows are packed each.  Ties in a list go to the document whose hash of id
    and text follows the seed's most closely.  Empty table: no rows.  Other
    columns are ignored.
    """
    sc = df.sparkSession.sparkContext
    kind = df.select(quoted(id_col).alias("id")).schema["id"].dataType.simpleString()
    pieces = written(index_pieces(df, id_col, text_col), "pieces")
    frequency, n, size = statistics(pieces)
    # of a bucket with several terms, more documents may be counted than there are
    idf = sc.broadcast(np.log1p((np.maximum(n - frequency, 0) + 0.5) / (frequency + 0.5)).astype(np.float32))
    taken = assigned(pieces, idf, size / max(1, n), width, list_docs, shard_docs, query_bytes, likeness(pieces, frequency, n))

    @trimming
    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column(1)[k].values
                yield pa.RecordBatch.from_arrays([pa.array(_places(batch.column(0)[k].as_py(), len(ids))), ids, *(pa.array(np.frombuffer(batch.column(c)[k].as_buffer(), t)) for c, t in ((2, np.int32), (3, np.int64)))], ["place", "id", "n_words", "key"])

    docs = pieces.select("piece", "ids", "lengths", "keys").mapInArrow(placed, f"place bigint, id {kind}, n_words int, key bigint")
    if taken:
        docs = docs.join(reduce(DataFrame.unionByName, taken), "place", "left")
    else:
        docs = docs.withColumns({"seed": F.lit(None).cast("bigint"), "rank": F.lit(None).cast("int"), "score": F.lit(None).cast("float")})
    docs = docs.select("id", "n_words", F.coalesce("seed", "place").alias("seed"), F.coalesce("rank", F.lit(0)).alias("rank"), F.coalesce("score", F.lit(0).cast("float")).alias("score"), "place")
    rows = docs.repartition("seed").sortWithinPartitions("seed", "rank", "place")
    schema = f"shard int, window int, doc_ids array<{kind}>, starts array<int>, lengths array<int>, scores array<float>, seed_ids array<{kind}>, n_words int"
    return rows.mapInArrow(trimming(lambda batches: _filled(batches, width)), schema)


def first_fit(lengths: list[int], width: int) -> list[list[int]]:
    """Windows of the numbers of pieces: each piece in the first window that has room for it."""
    out: list[list[int]] = []
    room: list[int] = []
    for k, n in enumerate(lengths):
        at = next((w for w, left in enumerate(room) if left >= n), None)
        if at is None:
            out.append([])
            room.append(width)
            at = len(room) - 1
        out[at].append(k)
        room[at] -= n
    return out


def _filled(batches: Iterable[pa.RecordBatch], width: int, block: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Windows of rows(id, n_words, seed, rank, score) sorted by seed and rank."""
    context = TaskContext.get()
    number, part = 0, context.partitionId() if context else 0

    def out(ids: pa.Array, doc: list[int], start: list[int], length: list[int], score: list[float], seed: list[int], wins: list[list[int]]) -> pa.RecordBatch:
        """Windows of numbers of pieces, whose properties are listed."""
        nonlocal number
        flat = np.array([p for w in wins for p in w], np.int64)
        ends = pa.array(np.append(0, np.cumsum([len(w) for w in wins])).astype(np.int32))
        size = np.array(length, np.int32)[flat]
        columns = [ids.take(pa.array(np.array(doc)[flat])), pa.array(np.array(start, np.int32)[flat]), pa.array(size), pa.array(np.array(score, np.float32)[flat]), ids.take(pa.array(np.array(seed)[flat]))]
        total = np.add.reduceat(size, np.append(0, np.cumsum([len(w) for w in wins]))[:-1])
        window = np.arange(number, number + len(wins), dtype=np.int32)
        number += len(wins)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(wins), part, np.int32)), pa.array(window), *(pa.ListArray.from_arrays(ends, c) for c in columns), pa.array(total.astype(np.int32))], ["shard", "window", "doc_ids", "starts", "lengths", "scores", "seed_ids", "n_words"])

    def windows(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """All windows of whole groups of rows."""
        ids = table.column("id").combine_chunks()
        size, group, scores = (table.column(c).to_numpy() for c in ("n_words", "seed", "score"))
        cuts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group)).tolist()
        doc: list[int] = []
        start: list[int] = []
        length: list[int] = []
        score: list[float] = []
        seed: list[int] = []
        full: list[list[int]] = []
        open_: list[list[int]] = []
        for a, z in zip(cuts, cuts[1:], strict=False):
            rest = []
            for k in range(a, z):
                n = int(size[k])
                for at in range(0, n - n % width, width):
                    full.append([len(doc)])
                    doc.append(k), start.append(at), length.append(width), score.append(0.0), seed.append(k)
                if n % width:
                    rest.append(len(doc))
                    doc.append(k), start.append(n - n % width), length.append(n % width), score.append(float(scores[k])), seed.append(a)
            for w in first_fit([length[p] for p in rest], width):
                own = [rest[k] for k in w]
                (full if sum(length[p] for p in own) == width else open_).append(own)
        together = best_fit_decreasing(np.array([sum(length[p] for p in w) for w in open_], np.int64), width)
        wins = full + [[p for w in row for p in open_[w]] for row in together]
        for k in range(0, len(wins), 4096):
            yield out(ids, doc, start, length, score, seed, wins[k : k + 4096])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column("seed").to_numpy()
        if rows >= block:  # up to the end of the group that the rows held end in
            last = held[-1].column("seed")[held[-1].num_rows - 1].as_py()
            cut = int(np.searchsorted(group, last, "right"))
            if cut:
                held.append(batch.slice(0, cut))
            if cut < len(group):
                yield from windows(pa.Table.from_batches(held))
                held, rows = [], 0
                batch = batch.slice(cut)
            else:
                rows += cut
                continue
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield from windows(pa.Table.from_batches(held))
