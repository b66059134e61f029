"""Substring deduplication over runs of consecutive sentences."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import quoted, trimming, unused
from textloom.llm.words import Buffer, Words, buffer, range_hash, slices, words

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[[34, 39, 41, 93]] = True


def sentence_bounds(text: Buffer, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(start byte of every sentence in the batch, first sentence of every text).

    A sentence ends after ``. ! ?`` (and closing quotes or brackets) before
    white space, after a full-width stop, or at a line feed, and includes the
    white space after it; one without any word belongs to the sentence before
    it. The sentences of a text, joined, are the text.
    """
    data, offsets = text
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    end = data == 10
    stop = np.flatnonzero(_STOP[data])
    after = stop + 1
    for _ in range(2):
        inside = after < n
        after[inside] += _CLOSE[data[after[inside]]]
    good = after < n
    good[good] = space[after[good]]
    cut = np.concatenate([np.flatnonzero(end) + 1, after[good]])
    for lead, second, last in ((0xE3, 0x80, (0x82,)), (0xEF, 0xBC, (0x81, 0x9F))):
        at = np.flatnonzero(data == lead)
        at = at[at + 2 < n]
        at = at[(data[at + 1] == second) & np.isin(data[at + 2], last)]
        cut = np.concatenate([cut, at + 3])
    solid = np.flatnonzero(~space)
    k = np.searchsorted(solid, cut)
    cut = np.concatenate([solid[k[k < len(solid)]], offsets[:-1][np.diff(offsets) > 0]])
    cut = np.unique(cut[cut < n])
    # keep a boundary only where a word starts between it and the next one, and at the start of each text
    has = np.diff(np.append(np.searchsorted(w.start, cut), len(w.start))) > 0
    first = np.isin(cut, offsets[:-1])
    # a wordless beginning takes in the sentence after it
    lead = first & ~has
    keep = has | first
    follow = np.flatnonzero(lead) + 1
    follow = follow[follow < len(cut)]
    while len(follow):
        follow = follow[~first[follow]]
        keep[follow] = False
        follow = follow[~has[follow]] + 1
        follow = follow[follow < len(cut)]
    cut = cut[keep]
    return cut, np.searchsorted(cut, offsets)


def runs(text: Buffer, w: Words, sentences: int, min_words: int, single_words: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, start byte, end byte in the batch) of the runs that start and that end at each sentence.

    A run is the shortest one of at least the given numbers of sentences and
    words from where it starts, or back from where it ends, so that a passage
    is covered up to both its ends; where the text has less, there is none.
    A sentence of at least single_words words is a run by itself too.  The hash
    is of the sequence of words and of the sentence ends.
    """
    cut, bounds = sentence_bounds(text, w)
    m = len(cut)
    none = np.zeros(0, np.int64)
    if not m:
        return np.zeros(0, np.uint64), none, none, none
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    first_word = np.append(np.searchsorted(w.start, cut), len(w.hash))
    h = range_hash(w.hash, first_word[:-1], first_word[1:])
    i = np.arange(m)
    to = np.maximum(i + sentences, np.searchsorted(first_word, first_word[:-1] + min_words))
    ok = to <= bounds[1:][of]
    end = np.arange(1, m + 1)
    begin = np.minimum(end - sentences, np.searchsorted(first_word, first_word[1:] - min_words, "right") - 1)
    back = begin >= bounds[:-1][of]
    long = i[np.diff(first_word) >= single_words]
    pair = np.unique(np.concatenate([i[ok] * (m + 1) + to[ok], begin[back] * (m + 1) + end[back], long * (m + 1) + long + 1]))
    i, to = pair // (m + 1), pair % (m + 1)
    stops = np.append(cut, len(text.data))
    return range_hash(h, i, to), of[i], cut[i], stops[to]


def _cut(texts: pa.Array, ranges: pa.Array, again: pa.Array, sentences: int, min_words: int) -> pa.Array:
    out = []
    for text, spans, whole in zip(texts.to_pylist(), ranges.to_pylist(), again.to_pylist(), strict=True):
        if text is not None and whole:
            b = buffer(pa.array([text]))
            _, _, a, z = runs(b, words(b), sentences, min_words)
            spans = list(zip(a.tolist(), z.tolist(), strict=True))
        elif spans:
            spans = [(s["start"], s["end"]) for s in spans]
        if text is None or not spans:
            out.append(text)
            continue
        raw, kept, at = text.encode(), [], 0
        for a, z in sorted(spans):
            if a > at:
                kept.append(raw[at:a])
            at = max(at, z)
        kept.append(raw[at:])
        out.append(b"".join(kept).decode())
    return pa.array(out, pa.string())


def row_key(id_col: Column, text: Column) -> Column:
    """A row's name: hash of text and id, the same for rows equal in both."""
    return F.xxhash64(text, F.coalesce(id_col.cast("string"), F.lit("\0")))


def repeated_runs(df: DataFrame, key: str, id_col: str, text_col: str, sentences: int = 2, min_words: int = 15) -> DataFrame:
    """(key, spans) of the rows with runs that occur before: by id (nulls last), then key, then place in the text.

    Of the occurrences of a run in one Arrow batch only the first may be the
    first of all; the others are known as later ones and go past the window
    that compares the candidates, however often a run occurs.
    """

    @trimming
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = buffer(batch.column(2))
            o = b.offsets
            found: list[tuple[np.ndarray, ...]] = []
            for i, j in slices(batch.num_rows, np.diff(o), 1 << 17):
                part = Buffer(b.data[o[i] : o[j]], o[i : j + 1] - o[i])
                h, of, a, z = runs(part, words(part), sentences, min_words)
                base = part.offsets[of]
                found.append((h, of + i, (a - base).astype(np.int32), (z - base).astype(np.int32)))
            h, of, a, z = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
            if not len(h):
                continue
            key = batch.column(0).to_numpy()
            order = pc.sort_indices(pa.table({"id": batch.column(1), "key": key}), sort_keys=[("id", "ascending"), ("key", "ascending")], null_placement="at_end").to_numpy()
            rank = np.empty(len(key), np.int64)
            rank[order] = np.cumsum(np.append(0, key[order][1:] != key[order][:-1]))  # equal rows have one
            order = np.lexsort((a, rank[of], h))
            h, of, a, z = h[order], of[order], a[order], z[order]
            first = np.append(True, h[1:] != h[:-1])
            salt = np.where(first, 0, (key[of] & 0x3FFFFFFF) + 1).astype(np.int32)
            new = first | np.append(True, (rank[of][1:] != rank[of][:-1]) | (a[1:] != a[:-1]))
            at = pa.array(of[new])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[new].view(np.int64)), pa.array(salt[new]), batch.column(1).take(at), batch.column(0).take(at), pa.array(a[new]), pa.array(z[new])],
                ["h", "salt", "id", "key", "start", "end"],
            )

    rows = df.select(quoted(key).alias("key"), quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text")).where("text is not null")
    found = rows.mapInArrow(find, f"h bigint, salt int, id {rows.schema['id'].dataType.simpleString()}, key bigint, start int, end int")
    order = Window.partitionBy("h", "salt").orderBy(F.col("id").asc_nulls_last(), "key", "start")
    later = found.withColumn("place", F.dense_rank().over(order)).where("place > 1 or salt > 0")
    return later.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))


def dedup_sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: int = 2, min_words: int = 15, report: bool = True) -> DataFrame:
    """df with all sentences removed that a non-first repeated run covers.

    Runs of at least the given numbers of consecutive sentences and words are
    hashed and compared over the whole table, within a document too.  The first
    occurrence by id, then text hash, then place stays.  With report, the
    columns removed_bytes and removed_runs are added (prefixed with _ where df
    has such columns already).

    Null text stays null.  Null ids come after all others.  An empty text and
    one too short for a run stay as they are.  Of rows equal in id and text the
    first is treated as the document and each further one as a copy of it: all
    sentences covered by runs go.  A text that is removed altogether becomes
    empty.  Of rows equal in id and text, the one with the least hash of all its
    columns is the first.  Very long texts are compared whole.  Empty table: no
    rows.  Other columns are kept.

    min_words keeps chance repeats of a few short sentences apart from copied
    passages: of two or more sentences of any length, the synthetic texts
    repeat so many by chance that a third of the documents without a shared
    passage would lose some.
    """
    key, removed, number, again, spans = unused(df, "row_key", "removed_bytes", "removed_runs", "row_again", "row_spans")
    text = quoted(text_col).cast("string")
    keyed = df.withColumn(key, row_key(quoted(id_col), text))
    repeats = repeated_runs(keyed, key, id_col, text_col, sentences, min_words)
    repeats = repeats.select(F.col("key").alias(key), F.col("spans").alias(spans))
    both = keyed.join(repeats.hint("shuffle_merge"), key, "left")
    both = both.withColumn(again, F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*[quoted(c) for c in df.columns]))) > 1)

    @F.arrow_udf("string")
    def cut(texts: pa.Array, ranges: pa.Array, copy: pa.Array) -> pa.Array:
        return _cut(texts, ranges, copy, sentences, min_words)

    out = both.withColumns({number: F.coalesce(F.size(F.when(F.col(spans).isNotNull(), F.col(spans))), F.lit(0)), text_col: F.struct(text.alias("old"), cut(text, F.col(spans), F.col(again)).alias("new"))})
    out = out.withColumns({removed: F.octet_length(quoted(text_col)["old"]) - F.octet_length(quoted(text_col)["new"]), text_col: quoted(text_col)["new"]})
    return out.select(*[quoted(c) for c in df.columns], *([removed, number] if report else []))


def shortened(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", sentences: int = 2, min_words: int = 15) -> DataFrame:
    """dedup_sentences() in the columns of df, with length_col brought up to date if df has it.

    A row whose text lost everything is dropped; rows without text, with an
    empty one and those of null ids stay.  Ties, repeated rows and very long
    texts are as in dedup_sentences().  Empty table: no rows.
    """
    (removed, _) = unused(df, "removed_bytes", "removed_runs")
    out = dedup_sentences(df, id_col, text_col, sentences, min_words)
    text = quoted(text_col)
    out = out.where((F.coalesce(quoted(removed), F.lit(0)) == 0) | (F.length(F.trim(text)) > 0))
    if length_col and length_col in df.columns:
        kind = df.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(quoted(removed) > 0, F.length(text).cast(kind)).otherwise(quoted(length_col)))
    return out.select(*[quoted(c) for c in df.columns])
