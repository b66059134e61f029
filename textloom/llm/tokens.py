"""Token counts without token ids, and token-id packing into fixed-width rows.

Both run inside one Arrow function per partition and move no text between
executors.  The vocabulary is a rank file of a byte-level BPE read on each
worker from ``tokenizer_dir``; nothing is trained and no file is copied here.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from textloom.llm.common import TOKENIZERS, blobs, quoted, whole

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RANKS = "byte_bpe_50k.tiktoken"


@functools.cache
def encoder(path: str):
    """The tokenizer of a rank file, built once per worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: A match of PATTERN ends at each of these places, whatever follows, and the next begins there.
_SAFE = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})|(?<=\p{L})(?=[^\p{White_Space}\p{L}\p{N}'])")
_BLANK = regex.compile(r"\p{White_Space}{4096,}")
_BLANKS = regex.compile(r"\p{White_Space}*+")


def safe_pieces(text: str, limit: int) -> list[str]:
    """text cut into pieces of about limit characters that encode independently.

    A cut lies before white space that follows something else, or between a
    letter and a mark other than an apostrophe.  A long run of white space but
    its last character is a piece of its own: PATTERN matches it as one, while
    the last character belongs to what follows.  Where no such place exists,
    as in a run of letters, the piece is longer.
    """
    if len(text) <= limit:
        return [text]
    out: list[str] = []

    def cut(at: int, end: int) -> None:
        while end - at > limit:
            place = _SAFE.search(text, at + limit, end)
            if place is None or place.start() >= end:
                break
            out.append(text[at : place.start()])
            at = place.start()
        if end > at:
            out.append(text[at:end])

    at = 0
    for run in _BLANK.finditer(text):
        cut(at, run.start())
        at = run.end() if run.end() == len(text) else run.end() - 1
        out.append(text[run.start() : at])
    cut(at, len(text))
    return out


def encoded(encoding, pieces: list[str]) -> list[list[int]]:
    """Token ids of each piece; a long run of white space is one match, which the pattern's engine can't hold."""
    blank = [len(p) >= 4095 and _BLANKS.fullmatch(p) is not None for p in pieces]
    rest = iter(encoding.encode_ordinary_batch([p for p, b in zip(pieces, blank, strict=True) if not b], num_threads=1))
    return [encoding._core_bpe.encode_single_piece(p.encode()) if b else next(rest) for p, b in zip(pieces, blank, strict=True)]


def token_ids(encoding, text: str, limit: int, tail: list[int]) -> np.ndarray:
    """The ids of encoded() for all pieces of a text, then tail; no Python object is made for an id."""
    pieces = [np.array(encoding._core_bpe.encode_single_piece(p.encode()) if len(p) >= 4095 and _BLANKS.fullmatch(p) else encoding.encode_to_numpy(p, disallowed_special=()), np.int32) for p in safe_pieces(text, limit)]
    return np.concatenate([*pieces, np.array(tail, np.int32)])


def token_counts(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_dir: str = TOKENIZERS,
    ranks: str = RANKS,
    batch_bytes: int = 1 << 20,
    piece_chars: int = 1 << 15,
) -> DataFrame:
    """(doc_id, n_tokens, n_bytes) of every row; the ids never leave the encoder.

    Texts longer than piece_chars are split at safe boundaries.  The pieces of
    a partition, over the bounds of Arrow batches, go to the encoder in batches
    of about batch_bytes of UTF-8 each, so that none is a single giant text
    beside many empty ones.  Equal texts of an Arrow batch are encoded once.

    Null text: null counts.  Empty text: 0.  Of very long texts all is counted;
    one without any safe boundary is one piece.  A null id is kept.  Repeated
    rows each give a row.  Empty table: no rows.  Other columns are ignored.
    """
    path = f"{tokenizer_dir}/{ranks}"

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(path)
        held: list[tuple[np.ndarray, int, str]] = []  # where to add the count of a piece
        waiting: list[tuple[pa.RecordBatch, pa.Array, np.ndarray]] = []
        size = 0

        def flush() -> None:
            for (total, k, _), ids in zip(held, encoded(encoding, [p for _, _, p in held]), strict=True):
                total[k] += len(ids)
            held.clear()

        def out(done: list[tuple[pa.RecordBatch, pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for batch, indices, total in done:
                yield pa.RecordBatch.from_arrays([batch.column(0), pc.take(pa.array(total), indices), pc.binary_length(batch.column(1)).cast(pa.int64())], ["doc_id", "n_tokens", "n_bytes"])

        for batch in batches:
            distinct = batch.column(1).dictionary_encode()
            total = np.zeros(len(distinct.dictionary), np.int64)
            lengths = pc.binary_length(distinct.dictionary).to_pylist()
            for k, (text, n) in enumerate(zip(distinct.dictionary.to_pylist(), lengths, strict=True)):
                for piece in safe_pieces(text, piece_chars):
                    held.append((total, k, piece))
                    size += n if len(piece) == len(text) else len(piece.encode())
                    if size >= batch_bytes:
                        flush()
                        size = 0
            waiting.append((batch, distinct.indices, total))
            first = next((i for i, w in enumerate(waiting) if held and w[2] is held[0][0]), len(waiting))
            done, waiting[:] = waiting[:first], waiting[first:]  # pieces are held in order: what lies before the first is counted
            yield from out(done)
        flush()
        yield from out(waiting)

    rows = df.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, n_bytes bigint")


class BestFit:
    """Open rows by free space, with a segment tree over the space from 1 to width.

    take(need) is a row with the least free space that still holds need tokens:
    the leftmost non-empty leaf at or after need, found in O(log width).
    """

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.width = width
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def put(self, row: int, free: int) -> None:
        if not free:
            return
        self.rows[free].append(row)
        at = free + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        at = self._first(need)
        if at is None:
            return None
        row, free = self.rows[at].pop(), at
        at += self.size
        while at:
            self.count[at] -= 1
            at >>= 1
        return row, free

    def _first(self, need: int) -> int | None:
        count, at = self.count, need + self.size
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):  # up until a right sibling holds something
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        return at - self.size


def best_fit_decreasing(lengths: np.ndarray, width: int) -> list[list[int]]:
    """Items put into rows of width, longest first (ties by position), each into the fullest row that holds it."""
    tree, rows = BestFit(width), []
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        found = tree.take(need)
        if found is None:
            rows.append([item])
            tree.put(len(rows) - 1, width - need)
        else:
            rows[found[0]].append(item)
            tree.put(found[0], found[1] - need)
    return rows


PACKED = "shard int, block int, row int, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<{id}>, segments array<int>"


def pack_tokens(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 2048,
    end_id: int | None = 50256,
    pad_id: int = 50256,
    tokenizer_dir: str = TOKENIZERS,
    ranks: str = RANKS,
    piece_chars: int = 1 << 15,
    block_bytes: int = 32 << 20,
) -> DataFrame:
    """Token ids of all documents packed into rows of exactly width ids.

    Every document is encoded, end_id is appended, and a document longer than
    width is cut into segments of width and one remainder, none of it lost.
    Within each block of about block_bytes of text of one partition, segments
    go into rows by best-fit decreasing.  A row holds

    * ``input_ids``: width little-endian int32, filled up with pad_id;
    * ``position_ids``: width little-endian uint16 (int32 if width > 65536)
      that start again at 0 with each segment, and over the padding;
    * ``cu_seqlens``: where segments begin, and the end of the last one;
    * ``doc_ids`` and ``segments``: each segment's document and its number in it.

    Rows of one block form the block's id matrix, numbered by ``row``.  The
    documents' tokens are found again by ordering segments, see unpacked().

    Null text: no tokens, the document isn't packed.  Empty text: end_id alone
    (nothing if end_id is None).  A null id is kept as null.  Repeated rows are
    packed each.  Ties in length keep the order of the rows.  Empty table: no
    rows.  Other columns are ignored.
    """
    path = f"{tokenizer_dir}/{ranks}"
    kind = np.uint16 if width <= 1 << 16 else np.int32

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(path)
        context = TaskContext.get()
        shard = context.partitionId() if context else 0
        steps = np.arange(width, dtype=kind)
        for block, batch in enumerate(whole(batches, block_bytes)):
            batch = batch.filter(pc.is_valid(batch.column(1)))
            distinct = batch.column(1).dictionary_encode()
            tail = [] if end_id is None else [end_id]
            ids = [token_ids(encoding, text, piece_chars, tail) for text in distinct.dictionary.to_pylist()]
            which = distinct.indices.to_numpy()
            sizes = np.array([len(x) for x in ids], np.int64)[which] if len(which) else np.zeros(0, np.int64)
            parts = -(-sizes // width)
            doc = np.repeat(np.arange(len(which)), parts)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
            length = np.minimum(sizes[doc] - number * width, width)
            rows = best_fit_decreasing(length, width)
            out_ids, out_positions, out_cuts = [], [], []
            for row in rows:
                line, place = np.full(width, pad_id, np.int32), np.empty(width, kind)
                at, cuts = 0, [0]
                for item in row:
                    n, first = int(length[item]), int(number[item]) * width
                    line[at : at + n] = ids[which[doc[item]]][first : first + n]
                    place[at : at + n] = steps[:n]
                    at += n
                    cuts.append(at)
                place[at:] = steps[: width - at]
                out_ids.append(line)
                out_positions.append(place)
                out_cuts.append(cuts)
            flat = np.array([i for row in rows for i in row], np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32))
            n = len(rows)
            for a in range(0, n, 1024):
                b = min(n, a + 1024)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(b - a, shard, np.int32)),
                        pa.array(np.full(b - a, block, np.int32)),
                        pa.array(np.arange(a, b, dtype=np.int32)),
                        pa.array([c[-1] for c in out_cuts[a:b]], pa.int32()),
                        blobs(out_ids[a:b]),
                        blobs(out_positions[a:b]),
                        pa.array(out_cuts[a:b], pa.list_(pa.int32())),
                        pa.ListArray.from_arrays(offsets[a : b + 1], batch.column(0).take(pa.array(doc[flat]))),
                        pa.ListArray.from_arrays(offsets[a : b + 1], pa.array(number[flat].astype(np.int32))),
                    ],
                    ["shard", "block", "row", "n_tokens", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "segments"],
                )

    rows = df.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    return rows.mapInArrow(pack, PACKED.format(id=rows.schema["doc_id"].dataType.simpleString()))


MATRICES = "name string, rows int, width int, segments bigint, position_bytes int"


def write_packed(packed: DataFrame, uri: str, max_rows: int = 1 << 15) -> list[dict]:
    """Rows of pack_tokens() as binary files in the folder uri, and the list of them.

    A name of the list stands for four little-endian files: ``.ids`` the int32
    matrix of token ids, row after row, ``.pos`` the matrix of position ids,
    ``.cu`` int64 lengths of segments added up over the file's rows, where
    each row begins a new one and padding counts as one, ``.docs`` the doc_ids
    of the segments as a Parquet table.  A matrix has at most max_rows rows.

    Every attempt of a task writes files of its own; ``index.json``, written
    last, names only those of the attempts that counted, so that lost and
    repeated tasks leave files that nothing reads.  Empty table: an empty list.
    """
    import json
    import uuid

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        store, folder = pa.fs.FileSystem.from_uri(uri)
        for batch in (b.slice(a, max_rows) for b in whole(batches, 64 << 20) for a in range(0, b.num_rows, max_rows)):
            name = uuid.uuid4().hex
            ids, places = (batch.column(c).to_pylist() for c in ("input_ids", "position_ids"))
            width = len(ids[0]) // 4
            cuts = [c if c[-1] == width else [*c, width] for c in batch.column("cu_seqlens").to_pylist()]
            ends = np.concatenate([np.array(c[1:] if k else c, np.int64) + k * width for k, c in enumerate(cuts)])
            for kind, data in (("ids", b"".join(ids)), ("pos", b"".join(places)), ("cu", ends.tobytes())):
                with store.open_output_stream(f"{folder}/{name}.{kind}") as out:
                    out.write(data)
            number = np.repeat(np.arange(batch.num_rows, dtype=np.int32), pc.list_value_length(batch.column("doc_ids")).to_numpy())
            docs = pa.table({"row": pa.array(number), "doc_id": batch.column("doc_ids").flatten(), "segment": batch.column("segments").flatten()})
            pq.write_table(docs, f"{folder}/{name}.docs", filesystem=store)
            yield pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([x], t) for x, t in ((batch.num_rows, pa.int32()), (width, pa.int32()), (len(ends) - 1, pa.int64()), (len(places[0]) // width, pa.int32())))], [x.split()[0] for x in MATRICES.split(", ")])

    store, folder = pa.fs.FileSystem.from_uri(uri)
    store.create_dir(folder, recursive=True)
    names = sorted((r.asDict() for r in packed.mapInArrow(write, MATRICES).toLocalIterator()), key=lambda r: r["name"])
    with store.open_output_stream(f"{folder}/index.json") as out:
        out.write(json.dumps(names).encode())
    return names


def read_packed(uri: str) -> Iterator[dict]:
    """The matrices of write_packed(): ids, positions, cu_seqlens and the table of documents of each file."""
    import json

    import pyarrow.parquet as pq

    store, folder = pa.fs.FileSystem.from_uri(uri)
    with store.open_input_stream(f"{folder}/index.json") as source:
        names = json.loads(source.read())
    for r in names:
        data = {}
        for kind, t in (("ids", np.int32), ("pos", np.uint16 if r["position_bytes"] == 2 else np.int32), ("cu", np.int64)):
            with store.open_input_stream(f"{folder}/{r['name']}.{kind}") as source:
                data[kind] = np.frombuffer(source.read(), t)
        shape = (r["rows"], r["width"])
        yield {"ids": data["ids"].reshape(shape), "positions": data["pos"].reshape(shape), "cu_seqlens": data["cu"], "docs": pq.read_table(f"{folder}/{r['name']}.docs", filesystem=store)}


def unpacked(rows: list) -> dict:
    """Token ids by document of collected rows; a document with several rows of the table gets their tokens joined."""
    parts = []
    for r in rows:
        ids = np.frombuffer(bytes(r["input_ids"]), np.int32)
        for doc, number, a, b in zip(r["doc_ids"], r["segments"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            parts.append((doc, number, ids[a:b]))
    out: dict = {}
    for doc, _, ids in sorted(parts, key=lambda x: (x[0] is not None, x[0], x[1])):
        out.setdefault(doc, []).extend(ids.tolist())
    return out
