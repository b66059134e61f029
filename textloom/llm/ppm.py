"""Scoring of documents by the code length of prediction by partial matching.

The model is a trie of byte contexts up to a fixed order, the latest byte
first, with the counts of the bytes that followed.  A byte is coded in the
longest context of the trie; where it hasn't followed that, an escape is coded
(method C: as many escapes as distinct bytes) and the next shorter context is
tried with all bytes of the longer one excluded, down to the uniform code.

Pretrained: counts come from all documents.  The trie is kept as a table of
shards, one for each pair of latest context bytes, in which a node is the run
of sorted entries with its context; only the levels with at most one byte of
context, 65,792 entries at most, are sent to every task.  Documents meet it in
blocks: a block asks each shard for the costs of its distinct contexts.
Adaptive: each document starts from an empty trie and updates it as it goes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import blobs, quoted, trimming
from textloom.llm.words import buffer, slices
from textloom.storage import dropped, written

U8 = np.uint64(8)


class Level(NamedTuple):
    """Entries of one order: context bytes, then the following byte, in one sorted code."""

    code: np.ndarray
    count: np.ndarray
    context: np.ndarray  # sorted codes of the contexts
    total: np.ndarray  # of a context: occurrences
    kinds: np.ndarray  # of a context: distinct following bytes
    below_total: np.ndarray  # of the next shorter context, without this one's bytes
    below_kinds: np.ndarray


class Model(NamedTuple):
    order: int
    levels: list[Level]  # by order from 0


class Trie(NamedTuple):
    """A trained trie: the level with one byte of context, and the shards of the rest."""

    order: int
    code: np.ndarray
    count: np.ndarray
    shards: DataFrame  # shard, codes, counts


def codes_of(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """Code of every byte with the order bytes before it; before a text stand zero bytes."""
    code = data.astype(np.uint64)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, order + 1):
        before = np.zeros(len(data), np.uint64)
        before[k:] = data[:-k] if k <= len(data) else 0
        before[place < k] = 0
        code |= before << np.uint64(8 * k)
    return code


def summed(code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes with their counts added up."""
    if not len(code):
        return code, count
    order = np.argsort(code, kind="stable")
    code, count = code[order], count[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    return code[first], np.add.reduceat(count, first)


def levels_of(code: np.ndarray, count: np.ndarray, order: int, min_count: int, lowest: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Entries of each order from lowest up, those seen less than min_count times left out."""
    out = []
    for j in range(order, lowest - 1, -1):
        mask = np.uint64((1 << (8 * (j + 1))) - 1)
        code, count = summed(code & mask, count)
        keep = count >= min_count
        out.append((code[keep], count[keep]))
    return out[::-1]


def _find(sorted_: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(sorted_, want)
    at[at == len(sorted_)] = 0
    return (sorted_[at] == want if len(sorted_) else np.zeros(len(want), bool)), at


def compiled(entries: list[tuple[np.ndarray, np.ndarray]], base: list[Level] | None = None) -> Model:
    """The trie of the given entries by order, with what remains below each context after exclusion.

    base, if given, has the lowest levels; the entries are those of the next orders.
    """
    levels: list[Level] = list(base or [])
    for j, (code, count) in enumerate(entries, len(levels)):
        first = np.flatnonzero(np.append(True, (code[1:] >> U8) != (code[:-1] >> U8))) if len(code) else np.zeros(0, np.int64)
        context = code[first] >> U8
        total = np.add.reduceat(count, first) if len(first) else np.zeros(0, np.int64)
        kinds = np.diff(np.append(first, len(code)))
        if j == 0:
            below_total, below_kinds = np.zeros(len(context), np.int64), 256 - kinds
        else:
            low = levels[j - 1]
            shorter = code & np.uint64((1 << (8 * j)) - 1)
            _, at = _find(low.code, shorter)
            same = np.add.reduceat(low.count[at], first) if len(first) else total
            _, up = _find(low.context, context & np.uint64((1 << (8 * (j - 1))) - 1))
            below_total, below_kinds = low.total[up] - same, low.kinds[up] - kinds
        levels.append(Level(code, count, context, total, kinds, below_total, below_kinds))
    return Model(len(levels) - 1, levels)


def costs(model: Model, code: np.ndarray) -> np.ndarray:
    """Bits to code each byte in its context."""
    n = len(code)
    bits, open_ = np.zeros(n), np.ones(n, bool)
    inside = np.zeros(n, bool)  # whether a longer context has been left
    total, kinds = np.zeros(n), np.zeros(n)
    for j in range(model.order, -1, -1):
        level = model.levels[j]
        short = code & np.uint64((1 << (8 * (j + 1))) - 1)
        is_context, at = _find(level.context, short >> U8)
        fresh = open_ & is_context & ~inside
        total[fresh], kinds[fresh] = level.total[at[fresh]], level.kinds[at[fresh]]
        here = open_ & is_context
        hit, entry = _find(level.code, short)
        hit &= here
        bits[hit] += np.log2((total[hit] + kinds[hit]) / level.count[entry[hit]])
        open_ &= ~hit
        left = here & open_ & (kinds > 0)
        bits[left] += np.log2((total[left] + kinds[left]) / kinds[left])
        gone = here & open_
        inside |= gone
        total[gone], kinds[gone] = level.below_total[at[gone]], level.below_kinds[at[gone]]
    # after order 0, kinds is the number of bytes never seen; an empty model knows none
    bits[open_] += np.log2(np.where(inside[open_], kinds[open_], 256))
    return bits


class Table:
    """Open-addressing table from codes to costs; one or two gathers find nearly every code."""

    EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, code: np.ndarray, cost: np.ndarray):
        self.bits = max(4, (2 * len(code)).bit_length())
        self.keys = np.full(1 << self.bits, self.EMPTY)
        self.values = np.zeros(1 << self.bits, np.float32)
        left = np.arange(len(code))
        slot = self._slot(code)
        while len(left):
            free = left[self.keys[slot[left]] == self.EMPTY]
            self.keys[slot[free]] = code[free]
            mine = free[self.keys[slot[free]] == code[free]]
            self.values[slot[mine]] = cost[mine]
            left = left[self.keys[slot[left]] != code[left]]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(costs, which codes aren't in the table)."""
        slot = self._slot(code)
        have = np.take(self.keys, slot)
        out = np.take(self.values, slot)
        unsure = np.flatnonzero(have != code)
        missing = []
        while len(unsure):
            empty = have[unsure] == self.EMPTY
            missing.append(unsure[empty])
            unsure = unsure[~empty]
            slot[unsure] = (slot[unsure] + 1) & (len(self.keys) - 1)
            have[unsure] = self.keys[slot[unsure]]
            out[unsure] = self.values[slot[unsure]]
            unsure = unsure[have[unsure] != code[unsure]]
        return out, np.concatenate(missing) if missing else unsure


def squeezed(values: np.ndarray) -> bytes:
    """Ascending numbers as the bytes of their differences, the like ones together, which compress well."""
    return np.diff(values, prepend=values.dtype.type(0)).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def expanded(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel(), dtype=kind)


def _planes(values: np.ndarray) -> bytes:
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _unplaned(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def inner_kind(order: int) -> type:
    return np.uint32 if order <= 5 else np.uint64


def inner(code: np.ndarray, order: int) -> np.ndarray:
    """Codes without the two latest context bytes, which name the shard."""
    return ((code & np.uint64(255)) | (code >> np.uint64(24) << U8)).astype(inner_kind(order))


def outer(code: np.ndarray, shard: int) -> np.ndarray:
    code = code.astype(np.uint64)
    return (code & np.uint64(255)) | np.uint64(shard << 8) | (code >> U8 << np.uint64(24))


BLOCKS = "block bigint, doc_id {id}, text string, shard int, codes binary, counts binary"


def blocks_of(df: DataFrame, id_col: str, text_col: str, order: int, block_bytes: int) -> DataFrame:
    """Blocks of about block_bytes of text, formed where the texts lie, each with the counts of its distinct codes.

    A row is a text (shard null), the codes of a shard, or (shard -1) those
    with one byte of context.
    """
    names = [x.split()[0] for x in BLOCKS.split(", ")]

    @trimming
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << 32
        code, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = taken = 0

        def add() -> None:
            nonlocal code, n, size
            code, n = summed(np.concatenate([code, *[x for x, _ in held]]), np.concatenate([n, *[y for _, y in held]]))
            held.clear()
            size = 0

        def out(id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            nonlocal code, n, block, taken
            add()
            if len(code):
                low, m = summed(code & np.uint64(0xFFFF), n)
                shard = ((code >> U8) & np.uint64(0xFFFF)).astype(np.int64)
                by = np.lexsort((code, shard))
                shard, code, n = shard[by], code[by], n[by]
                first = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(code)).tolist()
                parts = list(zip(first, first[1:], strict=False))
                shards = [-1, *shard[first[:-1]].tolist()]
                codes = [squeezed(low.astype(np.uint32)), *(squeezed(inner(code[a:z], order)) for a, z in parts)]
                counts = [_planes(m), *(_planes(n[a:z]) for a, z in parts)]
                k = len(shards)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, block)), pa.nulls(k, id_type), pa.nulls(k, pa.string()), pa.array(shards, pa.int32()), pa.array(codes, pa.binary()), pa.array(counts, pa.binary())], names)
            code, n, taken, block = code[:0], n[:0], 0, block + 1

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            b = buffer(batch.column(1))
            o = b.offsets
            for i, j in slices(batch.num_rows, np.diff(o), 1 << 20):
                found = np.sort(codes_of(b.data[o[i] : o[j]], o[i : j + 1] - o[i], order))
                if len(found):
                    first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
                    held.append((found[first], np.diff(np.append(first, len(found)))))
                    size += len(first)
                if size > max(1 << 20, len(code)):
                    add()
                k = j - i
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, block)), batch.column(0).slice(i, k), batch.column(1).slice(i, k), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], names)
                taken += int(o[j] - o[i])
                if taken >= block_bytes:
                    yield from out(id_type)
        if id_type is not None:
            yield from out(id_type)

    rows = _select(df, id_col, text_col)
    return rows.mapInArrow(count, BLOCKS.format(id=rows.schema["doc_id"].dataType.simpleString()))


def _merged(batches: Iterable[pa.RecordBatch], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Inner codes and counts of rows of one shard, added up."""
    kind = inner_kind(order)
    code, n = np.zeros(0, kind), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        for x, y in zip(batch.column("codes").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            held.append((expanded(x, kind), _unplaned(y, np.int64)))
            size += len(held[-1][0])
            if size > max(1 << 20, 2 * len(code)):
                code, n = summed(np.concatenate([code, *[c for c, _ in held]]), np.concatenate([n, *[m for _, m in held]]))
                held, size = [], 0
    return summed(np.concatenate([code, *[c for c, _ in held]]), np.concatenate([n, *[m for _, m in held]]))


SHARDS = "shard int, codes binary, counts binary"


def _trie(blocks: DataFrame, order: int, salts: int) -> Trie:
    """The trie of the counts of all blocks, which are added up in two steps."""

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[expanded(x, np.uint32)] += _unplaned(y, np.int64)
        rows = total.reshape(256, 256)
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), blobs([rows[k] for k in some.tolist()])], ["context", "counts"])

    def sum_(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            total += np.frombuffer(b"".join(batch.column("counts").to_pylist()), np.int64).reshape(-1, 256).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), blobs([total])], ["context", "counts"])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n = _merged(batches, order)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([squeezed(code)], pa.binary()), pa.array([_planes(n)], pa.binary())], ["shard", "codes", "counts"])

    schema = "context int, counts binary"
    low = np.zeros((256, 256), np.int64)
    for r in blocks.where("shard = -1").select("codes", "counts").mapInArrow(spread, schema).groupBy("context").applyInArrow(sum_, schema).toLocalIterator():
        low[r["context"]] = np.frombuffer(bytes(r["counts"]), np.int64)
    code = np.flatnonzero(low.ravel())
    parts = blocks.where("shard >= 0").select("shard", "codes", "counts", "block")
    if salts > 1:
        parts = parts.groupBy("shard", (F.col("block") % salts).alias("salt")).applyInArrow(merge, SHARDS)
    shards = written(parts.select("shard", "codes", "counts").groupBy("shard").applyInArrow(merge, SHARDS), "trie")
    return Trie(order, code.astype(np.uint64), low.ravel()[code], shards)


def _salts(blocks: DataFrame) -> int:
    """One for every 64 blocks: into so many groups a shard's rows are spread."""
    return max(1, -(-blocks.where("shard = -1").count() // 64))


def trained(df: DataFrame, text_col: str = "text", order: int = 5, block_bytes: int = 16 << 20) -> Trie:
    """The trie of all texts of df, all counts kept."""
    _check(order)
    blocks = written(blocks_of(df, text_col, text_col, order, block_bytes), "blocks")
    trie = _trie(blocks, order, _salts(blocks))
    dropped(blocks)
    return trie


def scored(df: DataFrame, trie: Trie, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte) of every row under a trained trie."""
    blocks = written(blocks_of(df, id_col, text_col, trie.order, block_bytes), "blocks")
    return _scored(blocks, trie, _salts(blocks))


def _scored(blocks: DataFrame, trie: Trie, salts: int) -> DataFrame:
    order, kind = trie.order, inner_kind(trie.order)
    low = blocks.sparkSession.sparkContext.broadcast((trie.code, trie.count))

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by shard and salt, the shard's trie first: the costs that each block asks for."""
        code, n = low.value
        base = compiled([summed(code & np.uint64(255), n), (code, n)]).levels
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        now, model = None, None
        asked: list[tuple[int, bytes]] = []

        def out() -> pa.RecordBatch:
            codes = [expanded(c, kind) for _, c in asked]
            distinct, back = np.unique(np.concatenate(codes), return_inverse=True)
            cost = costs(model, outer(distinct, now[0])).astype(np.float32)[back]
            ends = np.cumsum([len(c) for c in codes])
            row = pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in asked], pa.int64()), pa.array([now[0]] * len(asked), pa.int32()), pa.array([c for _, c in asked], pa.binary()), blobs(np.split(cost, ends[:-1]))],
                ["block", "shard", "codes", "costs"],
            )
            asked.clear()
            return row

        for batch in batches:
            for shard, salt, block, c, y in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (shard, salt) != now:
                    if asked:
                        yield out()
                    now = (shard, salt)
                    model = compiled([none] * (order - 1), base)  # for a trie without these two bytes of context
                if block is None:
                    model = compiled(levels_of(outer(expanded(c, kind), shard), _unplaned(y, np.int64), order, 1, 2), base)
                    continue
                asked.append((block, c))
                if len(asked) >= 64:
                    yield out()
        if asked:
            yield out()

    asks = blocks.where("shard >= 0").select("shard", (F.col("block") % salts).cast("int").alias("salt"), "block", "codes", F.lit(None).cast("binary").alias("counts"))
    tries = trie.shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(None).cast("bigint").alias("block"), "codes", "counts")
    both = asks.unionByName(tries).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("block").asc_nulls_first())
    answers = both.mapInArrow(answer, "block bigint, shard int, codes binary, costs binary")

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by block, the costs before the texts."""
        block, table, codes, values = None, None, [], []
        for batch in batches:
            own, shards = batch.column("block").to_numpy(), batch.column("shard")
            cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1])).tolist()
            for a, z in zip(cuts, [*cuts[1:], len(own)], strict=True):
                if own[a] != block:
                    block, table, codes, values = own[a], None, [], []
                part = batch.slice(a, z - a)
                m = part.num_rows - part.column("shard").null_count  # nulls, the texts, come last
                for shard, c, y in zip(*(part.column(k).slice(0, m).to_pylist() for k in ("shard", "codes", "costs")), strict=True):
                    codes.append(outer(expanded(c, kind), shard))
                    values.append(np.frombuffer(y, np.float32))
                texts = part.slice(m)
                if not texts.num_rows:
                    continue
                if table is None:
                    none = np.zeros(0, np.uint64), np.zeros(0, np.float32)
                    table = Table(np.concatenate([none[0], *codes]), np.concatenate([none[1], *values]))
                    codes, values = [], []
                yield _bits(pa.RecordBatch.from_arrays([texts.column("doc_id"), texts.column("text")], ["doc_id", "text"]), table, order)

    texts = blocks.where("shard is null").select("block", "doc_id", "text", "shard", "codes", F.lit(None).cast("binary").alias("costs"))
    kinds = blocks.schema["doc_id"].dataType.simpleString()
    replies = answers.select("block", F.lit(None).cast(kinds).alias("doc_id"), F.lit(None).cast("string").alias("text"), "shard", "codes", "costs")
    rows = texts.unionByName(replies).repartition("block").sortWithinPartitions("block", F.col("shard").asc_nulls_last())
    return rows.mapInArrow(score, f"doc_id {kinds}, n_bytes bigint, bits double, bits_per_byte double")


def _bits(batch: pa.RecordBatch, table: Table, order: int) -> pa.RecordBatch:
    b = buffer(batch.column(1))
    o = b.offsets
    bits = np.zeros(batch.num_rows)
    for i, j in slices(batch.num_rows, np.diff(o), 1 << 18):
        part = o[i : j + 1] - o[i]
        cost, missing = table.get(codes_of(b.data[o[i] : o[j]], part, order))
        if len(missing):
            raise RuntimeError("a block's texts have codes that it didn't count")
        some = np.flatnonzero(np.diff(part))
        if len(some):
            bits[i + some] = np.add.reduceat(cost.astype(np.float64), part[:-1][some])
    return _row(batch, bits, np.diff(o))


def _select(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))


def _row(batch: pa.RecordBatch, bits: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    null = pc.is_null(batch.column(1))
    n, b = pa.array(size.astype(np.int64)), pa.array(bits)
    each = pa.array(np.divide(bits, size, out=np.zeros(len(bits)), where=size > 0), mask=size == 0)
    return pa.RecordBatch.from_arrays([batch.column(0), *(pc.if_else(null, None, x) for x in (n, b, each))], ["doc_id", "n_bytes", "bits", "bits_per_byte"])


def adaptive_bits(data: bytes, order: int) -> float:
    """Code length of data under a trie that starts empty and counts each byte after coding it."""
    trie: dict[bytes, dict[int, int]] = {}
    bits = 0.0
    past = bytes(order) + data
    for i, byte in enumerate(data):
        excluded: set[int] = set()
        done = False
        for j in range(order, -1, -1):
            seen = trie.get(past[i + order - j : i + order])
            if seen is None:
                continue
            left = {b: n for b, n in seen.items() if b not in excluded}
            if not left:
                continue
            total = sum(left.values()) + len(left)
            if byte in left:
                bits += math.log2(total / left[byte])
                done = True
                break
            bits += math.log2(total / len(left))
            excluded |= left.keys()
        if not done:
            bits += math.log2(256 - len(excluded))
        for j in range(order + 1):
            seen = trie.setdefault(past[i + order - j : i + order], {})
            seen[byte] = seen.get(byte, 0) + 1
    return bits


def _check(order: int) -> None:
    if not 2 <= order <= 7:
        raise ValueError("order must be from 2 to 7")


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 5, adaptive: bool = False, block_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte): the code length of every document.

    By default the trie is trained on all documents of df, a document's own
    bytes and everything seen only once included; with adaptive, each document
    is coded on its own.  order is from 2 to 7.

    Null text: nulls.  Empty text: 0 bytes, 0 bits and null bits per byte.  Null
    ids and repeated rows are kept.  Texts are scored over all their bytes,
    however long.  Empty table: no rows.  Other columns are ignored.
    """
    _check(order)
    if not adaptive:
        blocks = written(blocks_of(df, id_col, text_col, order, block_bytes), "blocks")
        salts = _salts(blocks)
        return _scored(blocks, _trie(blocks, order, salts), salts)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            yield _row(batch, np.array([adaptive_bits(t, order) for t in texts], float), np.array([len(t) for t in texts], np.int64))

    rows = _select(df, id_col, text_col)
    return rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, bits double, bits_per_byte double")
