"""Benchmark decontamination with a distributed positional inverted index."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import quoted, trimming, unused, whole
from textloom.llm.sentences import row_key
from textloom.llm.words import Buffer, lowered, slices, words
from textloom.storage import dropped, written

KINDS = ("exact", "phrase", "proximity")
MATCHES = "key bigint, item_id {item}, kind string, place int, matched int, item_words int"


def positional_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """One row per block of documents: the postings of every term that occurs in it.

    * ``docs``: the documents' (id, key), ``first``: uint32 place of each one's
      first word in the block, and the number of words at the end;
    * ``terms``: sorted uint64 hashes of words, ``bounds``: uint32 ends of their
      lists, ``places``: uint32 places of all occurrences, ascending in a list.

    The blocks are the shards of the index: a list is never longer than its
    block, whatever the corpus, and the index can be kept and queried again.
    """

    @trimming
    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole(batches, block_bytes):
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for a, z in slices(batch.num_rows, sizes, block_bytes):
                part = batch.slice(a, z - a)
                text = lowered(part.column(1))
                o, hashes, first = text.offsets, [], [0]
                for i, j in slices(part.num_rows, np.diff(o), 1 << 17):
                    w = words(Buffer(text.data[o[i] : o[j]], o[i : j + 1] - o[i]))
                    hashes.append(w.hash)
                    first += (w.bounds[1:] + first[-1]).tolist()
                h = np.concatenate(hashes)
                order = np.argsort(h, kind="stable").astype(np.uint32)
                h = h[order]
                cut = np.flatnonzero(np.append(h[1:] != h[:-1], True)) if len(h) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type)),
                        *(pa.array([x.tobytes()], pa.binary()) for x in (np.array(first, np.uint32), h[cut], (cut + 1).astype(np.uint32), order)),
                    ],
                    ["docs", "first", "terms", "bounds", "places"],
                )

    rows = df.select(quoted(id_col).alias("key"), quoted(text_col).cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(build, f"docs array<{rows.schema['key'].dataType.simpleString()}>, first binary, terms binary, bounds binary, places binary")


class Wanted(NamedTuple):
    """The words of a part of the items, to tell which items a block may hold."""

    terms: np.ndarray  # distinct, ascending
    word: np.ndarray  # of every item one after the other, its place in terms
    first: np.ndarray  # where each item begins
    need: np.ndarray  # words in a row that a phrase takes
    quorum: np.ndarray  # words that a proximity match takes

    @classmethod
    def of(cls, items: list[np.ndarray], phrase: int, share: float, near_words: int) -> Wanted:
        size = np.array([len(x) for x in items], np.int64)
        terms, word = np.unique(np.concatenate(items or [np.zeros(0, np.uint64)]), return_inverse=True)
        short = size < near_words
        return cls(terms, word, np.cumsum(size) - size, np.where(short, size, np.minimum(phrase, size)), np.where(short, size, np.ceil(share * size - 1e-9)).astype(np.int64))

    def among(self, terms: np.ndarray) -> list[int]:
        """The items of which the sorted terms have a long enough run of words, or enough words."""
        if not len(self.first):
            return []
        there = _among(terms, self.terms)[self.word]
        at = np.arange(len(there))
        gap = np.where(there, -1, at)
        gap[self.first] = np.maximum(gap[self.first], self.first - 1)
        run = at - np.maximum.accumulate(gap)
        longest, number = np.maximum.reduceat(run, self.first), np.add.reduceat(there.astype(np.int64), self.first)
        return np.flatnonzero((longest >= self.need) | (number >= self.quorum)).tolist()


def _among(lists: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Whether each wanted place is in the ascending list."""
    at = np.searchsorted(lists, want)
    at[at == len(lists)] = 0
    return lists[at] == want if len(lists) else np.zeros(len(want), bool)


def _longest(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length and start of the longest run of True in each row."""
    best, start, now = np.zeros(len(hit), np.int64), np.zeros(len(hit), np.int64), np.zeros(len(hit), np.int64)
    for k in range(hit.shape[1]):
        now = np.where(hit[:, k], now + 1, 0)
        longer = now > best
        best[longer] = now[longer]
        start[longer] = k + 1 - now[longer]
    return best, start


def match_block(first: np.ndarray, terms: np.ndarray, bounds: np.ndarray, places: np.ndarray, item: np.ndarray, phrase: int, share: float, slop: int) -> list[tuple[int, int, int, int]]:
    """(document, kind, place in it, words matched) of the documents of a block that hold an item.

    Lists are intersected from the rarest words of the item: every run of
    ``phrase`` words holds the rarest of its words, and a proximity match of q
    of the m words holds one of the m - q + 1 rarest, so no other list has to
    be read to find the candidates.
    """
    m = len(item)
    at = np.searchsorted(terms, item)
    at[at == len(terms)] = 0
    there = terms[at] == item if len(terms) else np.zeros(m, bool)
    need, quorum = min(phrase, m), int(np.ceil(share * m - 1e-9))
    if there.sum() < min(need, quorum):
        return []
    low = np.where(at > 0, bounds[at - 1], 0)
    lists = [places[low[k] : bounds[at[k]]].astype(np.int64) if there[k] else np.zeros(0, np.int64) for k in range(m)]
    size = np.array([len(x) for x in lists])
    rarest = np.argsort(size, kind="stable")
    anchors = {a + int(np.argmin(size[a : a + need])) for a in range(m - need + 1)}
    found: dict[int, tuple[int, int, int]] = {}

    def keep(doc: int, kind: int, place: int, matched: int) -> None:
        if doc not in found or (kind, -matched, place) < (found[doc][0], -found[doc][2], found[doc][1]):
            found[doc] = (kind, place, matched)

    start = np.unique(np.concatenate([lists[k] - k for k in anchors]))
    if len(start):
        hit = np.stack([_among(lists[k], start + k) for k in range(m)], axis=1)
        run, offset = _runs_inside(hit, start, first)
        for c in np.flatnonzero(run >= need):
            place = int(start[c] + offset[c])
            doc = int(np.searchsorted(first, place, "right")) - 1
            keep(doc, 0 if run[c] == m else 1, place - int(first[doc]), int(run[c]))
    near = np.unique(np.concatenate([lists[k] - k for k in rarest[: m - quorum + 1]]))
    if len(near):
        count = np.zeros(len(near), np.int64)
        for k in range(m):
            if size[k]:
                count += np.searchsorted(lists[k], near + k + 2 * slop, "right") > np.searchsorted(lists[k], near + k - 2 * slop, "left")
        near = near[count >= quorum]
    if len(near):
        # the anchor of a match may be any word of it: all words about the candidates are tried
        tried = [near]
        for k in range(m):
            a, z = np.searchsorted(lists[k], near + k - slop, "left"), np.searchsorted(lists[k], near + k + slop, "right")
            tried += [lists[k][i:j] - k for i, j in zip(a, z, strict=True) if j > i]
        tried = np.unique(np.concatenate(tried))
        got = np.zeros((len(tried), m), np.int64) - 1
        for k in range(m):
            if size[k]:
                a = np.searchsorted(lists[k], tried + k - slop, "left")
                z = np.searchsorted(lists[k], tried + k + slop, "right")
                ok = z > a
                got[ok, k] = lists[k][a[ok]]
        for row, p in zip(got, tried, strict=True):
            hits = row[row >= 0]
            if len(hits) < quorum:
                continue
            docs = np.searchsorted(first, hits, "right") - 1
            if docs[0] != docs[-1] or (docs != docs[0]).any():
                # the places straddle documents: count each document's own
                for d in np.unique(docs):
                    inside = _own_hits(lists, p, slop, int(first[d]), int(first[d + 1]))
                    if len(inside) >= quorum:
                        keep(int(d), 2, int(inside.min() - first[d]), len(inside))
            else:
                keep(int(docs[0]), 2, int(hits.min() - first[docs[0]]), len(hits))
    return [(d, *v) for d, v in sorted(found.items())]


def _own_hits(lists: list[np.ndarray], p: int, slop: int, low: int, high: int) -> np.ndarray:
    """The first place of each word within slop of its own, inside one document."""
    out = []
    for k, places in enumerate(lists):
        a = np.searchsorted(places, max(p + k - slop, low), "left")
        if a < len(places) and places[a] <= min(p + k + slop, high - 1):
            out.append(int(places[a]))
    return np.array(out, np.int64)


def _runs_inside(hit: np.ndarray, start: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_longest, but a run ends where a document does."""
    m = hit.shape[1]
    best, offset = _longest(hit)
    doc_a = np.searchsorted(first, start + offset, "right") - 1
    over = (best > 0) & (start + offset + best > first[np.minimum(doc_a + 1, len(first) - 1)])
    for c in np.flatnonzero(over):
        place = start[c] + np.arange(m)
        doc = np.searchsorted(first, place, "right") - 1
        top = (0, 0)
        at = 0
        for k in range(m):
            if not hit[c, k]:
                at = k + 1
                continue
            if k > at and doc[k] != doc[k - 1]:
                at = k
            top = max(top, (k + 1 - at, -at))
        best[c], offset[c] = top[0], -top[1]
    return best, offset


def search_index(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", phrase: int = 13, share: float = 0.8, slop: int = 4, near_words: int = 5, query_bytes: int = 32 << 20) -> DataFrame:
    """(key, item_id, kind, place, matched, item_words): the best match of each item in each document.

    * exact: all the item's words in a row;
    * phrase: some ``phrase`` of its words in a row (all, if it has fewer);
    * proximity: at least share of its words, each within slop places of where
      it would stand if the item began at the same place.

    Items with fewer than near_words words match exactly or not at all; those
    without words match nothing.  The items go to the shards in parts of at
    most query_bytes, one search for each part; of a part, only items whose
    words a block has are looked up in it.
    """
    rows = items.select(quoted(item_col).alias("item"), quoted(text_col).cast("string").alias("text")).where("text is not null")
    kind = rows.schema["item"].dataType
    parts = max(1, -(-int(rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]) // query_bytes))
    type_ = MATCHES.format(item=kind.simpleString())
    rows = rows.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(parts)))

    def search(part: int) -> DataFrame:
        own = rows.where(F.col("part") == part).toArrow()
        text = lowered(own.column("text").combine_chunks()) if own.num_rows else None
        w = words(text) if text is not None else None
        queries = [(i, w.hash[w.bounds[i] : w.bounds[i + 1]]) for i in range(own.num_rows) if w.bounds[i + 1] > w.bounds[i]]
        wanted = Wanted.of([q for _, q in queries], phrase, share, near_words)
        names = own.column("item").combine_chunks() if own.num_rows else pa.array([], own.schema.field("item").type)

        def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in range(batch.num_rows):
                    first, terms, bounds, places = (np.frombuffer(batch.column(k)[b].as_py(), t) for k, t in ((1, np.uint32), (2, np.uint64), (3, np.uint32), (4, np.uint32)))
                    first, bounds = first.astype(np.int64), bounds.astype(np.int64)
                    doc, item, kinds, place, matched, size = [], [], [], [], [], []
                    for i, q in (queries[c] for c in wanted.among(terms)):
                        near = len(q) >= near_words
                        for d, k, p, n in match_block(first, terms, bounds, places, q, phrase if near else len(q), share if near else 1.0, slop if near else 0):
                            doc.append(d)
                            item.append(i)
                            kinds.append(KINDS[k])
                            place.append(p)
                            matched.append(n)
                            size.append(len(q))
                    if doc:
                        keys = batch.column(0)[b].values.take(pa.array(doc))
                        yield pa.RecordBatch.from_arrays(
                            [keys, names.take(pa.array(item)), pa.array(kinds), *(pa.array(x, pa.int32()) for x in (place, matched, size))],
                            ["key", "item_id", "kind", "place", "matched", "item_words"],
                        )

        return index.mapInArrow(look, type_.replace("key bigint", f"key {index.schema['docs'].dataType.elementType.simpleString()}"))

    return reduce(DataFrame.unionByName, [search(p) for p in range(parts)])


def leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", **options) -> DataFrame:
    """(doc_id, item_id, kind, place, matched, item_words) of documents that hold benchmark items.

    Builds the index of all documents, keeps it as a table in the shared
    folder, and searches every item in it; see search_index for the matches.

    Null texts hold nothing and null items are not searched.  Null ids are
    returned as null.  Empty texts match nothing.  Repeated rows each give
    their rows, repeated items too.  Of several matches of an item in a document
    the best kind is returned, then the longest, then the first.  Empty tables:
    no rows.  Other columns are ignored.
    """
    index = written(positional_index(df, id_col, text_col), "postings")
    return search_index(index, benchmark, item_col, item_text, **options).withColumnRenamed("key", "doc_id")


def decontaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least_words: int = 5, **options) -> DataFrame:
    """df without the rows that hold a benchmark item by leaks().

    An item of fewer than least_words words, such as a single common word, is
    reported by leaks() but is no reason to drop a document.  Null and empty
    texts stay, null ids and repeated rows are judged by their texts, very long
    texts are searched whole.  Empty tables: df as it is.  Columns of any name
    are kept.
    """
    (key,) = unused(df, "row_key")
    keyed = df.withColumn(key, row_key(quoted(id_col), quoted(text_col).cast("string")))
    index = written(positional_index(keyed, key, text_col), "postings")
    found = search_index(index, benchmark, item_col, item_text, **options).where(F.col("item_words") >= least_words)
    found = written(found.select("key").distinct(), "leaks")
    dropped(index)
    return keyed.join(found.select(F.col("key").alias(key)), key, "left_anti").select(*[quoted(c) for c in df.columns])
