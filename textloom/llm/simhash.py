"""Near-duplicate documents by SimHash codes joined in a binary trie."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import components, quoted, trimming, unused
from textloom.llm.graph import connected_components
from textloom.llm.sentences import row_key
from textloom.llm.words import Buffer, lowered, mix, slices, words
from textloom.storage import dropped, written

K1 = np.uint64(0x9E3779B97F4A7C15)
ONE = np.uint64(1)
SHIFTS = np.arange(64, dtype=np.uint64)
CHECK_WORDS = 4  # 64-bit words of the code that confirms a pair


def _seed(k: int) -> np.uint64:
    return np.uint64((k * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF)


def shingles(w: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of runs of size words; of all words where there are fewer."""
    size = min(size, len(w))
    if not size:
        return np.zeros(0, np.uint64)
    last = len(w) - size + 1
    x = w[:last].copy()
    for j in range(1, size):
        x = x * K1 + w[j : last + j]
    return np.unique(mix(x))


def search_codes(features: np.ndarray, tables: int, power: float = 1.5, block: int = 1 << 15) -> np.ndarray:
    """One 64-bit SimHash per table, each with its own heavy-tailed feature weights.

    A feature's weight is u ** -power, u its hash in (0, 1): few features, other
    ones in each table, decide nearly all bits, so that copies whose edits miss
    those differ by few bits.  All features are summed.
    """
    out = np.zeros(tables, np.uint64)
    for k in range(tables):
        ones, total = np.zeros(64), 0.0
        for a in range(0, len(features), block):
            u = mix(features[a : a + block] + _seed(k))
            weight = (((u >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) ** -power
            bits = np.unpackbits(mix(u).view(np.uint8), bitorder="little").reshape(-1, 64)
            top = weight.max()
            ones += (weight / top).astype(np.float32) @ bits.astype(np.float32) * top
            total += weight.sum()
        out[k] = np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0]
    return out


def check_code(w: np.ndarray) -> np.ndarray:
    """Plain SimHash of the distinct words, 64 * CHECK_WORDS bits; its distances follow the angle between word sets."""
    u = np.unique(w)
    bits = np.empty((len(u), CHECK_WORDS), np.uint64)
    for j in range(CHECK_WORDS):
        bits[:, j] = mix(u + _seed(100 + j))
    ones = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")
    total = np.zeros(64 * CHECK_WORDS, np.int64)
    for a in range(0, len(u), 255):  # sums of 255 bits fit a byte
        total += ones[a : a + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(u), bitorder="little").view(np.uint64)


class Nodes(NamedTuple):
    """A level of a trie: node i holds codes start[i]:end[i]; child[i, bit] is its child in the next level or -1."""

    start: np.ndarray
    end: np.ndarray
    leaf: np.ndarray
    child: np.ndarray


def trie(codes: np.ndarray, depth: int, leaf: int) -> list[Nodes]:
    """Binary trie over sorted codes below a shared prefix of depth bits, level by level.

    A node of few codes, or of equal ones, is a leaf and has no nodes below,
    so that the trie has fewer nodes than there are codes.
    """
    out: list[Nodes] = []
    start, end = np.zeros(1, np.int64), np.full(1, len(codes))
    for d in range(depth, 65):
        ends = (end - start <= leaf) | (codes[start] == codes[end - 1])
        child = np.full((len(start), 2), -1, np.int32)
        out.append(Nodes(start, end, ends, child))
        if ends.all():
            break
        a, z = start[~ends], end[~ends]
        ones = np.concatenate([[0], np.cumsum((codes >> np.uint64(63 - d)) & ONE, dtype=np.int64)])
        middle = z - (ones[z] - ones[a])
        low, high = np.stack([a, middle], axis=1).ravel(), np.stack([middle, z], axis=1).ravel()
        there = high > low
        child[~ends] = np.where(there, np.cumsum(there) - 1, -1).reshape(-1, 2)
        start, end = low[there], high[there]
    return out


def trie_join(a: np.ndarray, b: np.ndarray | None, depth: int, used: int, budget: int, leaf: int = 4, chunk: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted codes a and b (of a with itself if b is None) within budget differing bits.

    Both tries are walked together from depth, where used bits already differ.
    A pair of nodes goes to its child pairs, one more error where the bits
    differ, and is given up as soon as the errors exceed the budget.  Where one
    node of a pair is a leaf, their codes are compared.  The frontier is worked
    off in chunks, deepest first, so memory stays bounded.
    """
    own = b is None
    ta = trie(a, depth, leaf)
    tb = ta if own else trie(b, depth, leaf)
    other = a if own else b
    stack = [(0, np.zeros(1, np.int32), np.zeros(1, np.int32), np.full(1, used, np.int8))]
    while stack:
        level, x, y, err = stack.pop()
        if len(x) > chunk:
            stack += [(level, x[i : i + chunk], y[i : i + chunk], err[i : i + chunk]) for i in range(0, len(x), chunk)]
            continue
        na, nb = ta[level], tb[level]
        done = na.leaf[x] | nb.leaf[y]
        if done.any():
            p, q = x[done], y[done]
            # of nodes of equal codes, one pair decides for all
            sure = (a[na.start[p]] == a[na.end[p] - 1]) & (other[nb.start[q]] == other[nb.end[q] - 1])
            keep = ~sure | (np.bitwise_count(a[na.start[p]] ^ other[nb.start[q]]) <= budget)
            p, q = p[keep], q[keep]
            yield from _leaves(a, other, na.start[p], na.end[p] - na.start[p], nb.start[q], nb.end[q] - nb.start[q], own & (p == q), budget)
        go = ~done
        if not go.any():
            continue
        x, y, err = x[go], y[go], err[go]
        cx, cy = na.child[x], nb.child[y]
        nx, ny, ne = [], [], []
        for i, j in itertools.product((0, 1), (0, 1)):
            e = err + np.int8(i != j)
            ok = (cx[:, i] >= 0) & (cy[:, j] >= 0) & (e <= budget)
            if own and (i, j) == (1, 0):
                ok &= x != y  # of a node with itself, each pair of children once
            if ok.any():
                nx.append(cx[ok, i])
                ny.append(cy[ok, j])
                ne.append(e[ok])
        if nx:
            stack.append((level + 1, np.concatenate(nx), np.concatenate(ny), np.concatenate(ne)))


def _leaves(a, b, xs, nx, ys, ny, same, budget, limit: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    count = nx * ny
    total = np.concatenate([[0], np.cumsum(count)])
    at = 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
        if count[at] > limit:  # one node pair with very many equal or near codes: by rows
            step = max(1, limit // int(ny[at]))
            for r in range(0, int(nx[at]), step):
                i = np.repeat(np.arange(xs[at] + r, xs[at] + min(r + step, int(nx[at]))), ny[at])
                j = np.tile(np.arange(ys[at], ys[at] + ny[at]), len(i) // int(ny[at]))
                ok = np.bitwise_count(a[i] ^ b[j]) <= budget
                if same[at]:
                    ok &= i < j
                yield i[ok], j[ok]
            at += 1
            continue
        k = np.repeat(np.arange(at, to), count[at:to])
        r = np.arange(total[to] - total[at]) - (total[k] - total[at])
        i, j = xs[k] + r // ny[k], ys[k] + r % ny[k]
        ok = np.bitwise_count(a[i] ^ b[j]) <= budget
        ok &= ~same[k] | (i < j)
        yield i[ok], j[ok]
        at = to


def _signed(df: DataFrame, tables: int, size: int) -> DataFrame:
    """(id, row, exact, n_words, codes, checks) of rows(id, text); exact is a hash of the whole text, row a number."""
    import xxhash

    @trimming
    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 40
        for batch in batches:
            text, raw = lowered(batch.column(1)), batch.column(1).to_pylist()
            exact = np.array([xxhash.xxh3_64_intdigest(t or "") for t in raw], np.uint64).view(np.int64)
            n = batch.num_rows
            codes, checks, count = np.zeros((n, tables), np.uint64), np.zeros((n, CHECK_WORDS), np.uint64), np.zeros(n, np.int64)
            for i, j in slices(n, np.diff(text.offsets), 1 << 17):
                o = text.offsets
                w = words(Buffer(text.data[o[i] : o[j]], o[i : j + 1] - o[i]))
                for k in range(i, j):
                    own = w.hash[w.bounds[k - i] : w.bounds[k - i + 1]]
                    count[k] = len(own)
                    if len(own):
                        codes[k] = search_codes(shingles(own, size), tables)
                        checks[k] = check_code(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.arange(number, number + n)), pa.array(exact), pa.array(count.astype(np.int32)), *(pa.array([r.tobytes() for r in m], pa.binary()) for m in (codes, checks))],
                ["id", "row", "exact", "n_words", "codes", "checks"],
            )
            number += n

    return df.mapInArrow(sign, f"id {df.schema['id'].dataType.simpleString()}, row bigint, exact bigint, n_words int, codes binary, checks binary")


def _prefix_bits(rows: int, budget: int, bucket: int) -> int:
    """Bits of the codes' prefix that names a bucket, so that one holds about bucket codes."""
    bits = 0
    while rows >> bits > bucket and bits < 40:
        bits += 1
    return bits


def near_links(texts: DataFrame, tables: int, budget: int, check_bits: int, least_share: float, bits: int) -> DataFrame:
    """(node, links, root) from the pairs within budget in some table that the check code confirms.

    texts has a unique integer column node and the number m of rows with it.
    Codes go to one task for each pair of buckets whose prefixes differ in at
    most budget bits; the two buckets' tries are joined there.  A task returns,
    instead of pairs, the number of rows that each node is linked to and a
    spanning forest, node to root, which connects the same nodes as its pairs.
    A pair found in several tables is counted in the first of them.
    """
    near = [m for m in range(1 << bits) if m.bit_count() <= budget] if bits <= 20 else [sum(1 << p for p in c) for k in range(budget + 1) for c in itertools.combinations(range(bits), k)]
    packed = np.dtype([("codes", "<u8", tables), ("node", "<i8"), ("n", "<i4"), ("m", "<i4"), ("check", "<u8", CHECK_WORDS)])

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[bytes]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            keys = list(held)
            batch = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64()), pa.array([b"".join(held[k]) for k in keys], pa.binary())], ["tab", "bucket", "rows"]
            )
            held.clear()
            return batch

        for batch in batches:
            n = batch.num_rows
            rows = np.empty(n, packed)
            rows["codes"] = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(n, tables)
            rows["check"] = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(n, CHECK_WORDS)
            rows["node"], rows["n"], rows["m"] = (batch.column(k).to_numpy() for k in (0, 3, 4))
            for k in range(tables):
                code = rows["codes"][:, k]
                bucket = (code >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(n, np.int64)
                order = np.argsort(bucket, kind="stable")
                cut = np.flatnonzero(np.diff(bucket[order])) + 1
                for part in np.split(order, cut):
                    if len(part):
                        held.setdefault((k, int(bucket[part[0]])), []).append(rows[part].tobytes())
            size += n * tables * packed.itemsize
            if size > 64 << 20:
                yield out()
                size = 0
        if held:
            yield out()

    def join(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab, low, high = (k.as_py() for k in key)
        sides: dict[bool, list[bytes]] = {True: [], False: []}
        for batch in batches:
            for first, blob in zip(batch.column("first").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                sides[first].append(blob)

        def sorted_(blobs_: list[bytes]) -> np.ndarray:
            rows = np.frombuffer(b"".join(blobs_), packed)
            return rows[np.argsort(rows["codes"][:, tab], kind="stable")]

        x = sorted_(sides[True])
        y = x if low == high else sorted_(sides[False])
        sides.clear()
        if not len(x) or not len(y):
            return
        code_x, code_y = np.ascontiguousarray(x["codes"][:, tab]), None if low == high else np.ascontiguousarray(y["codes"][:, tab])
        shift = 0 if low == high else len(x)  # of y's numbers among the nodes of both sides
        rows = np.concatenate([x["node"], y["node"]]) if shift else x["node"]
        links, label = np.zeros(len(rows), np.int64), np.arange(len(rows))
        a, b, size = [], [], 0
        nx, ny = x["n"].astype(np.int64), y["n"].astype(np.int64)
        for i, j in trie_join(code_x, code_y, bits, (low ^ high).bit_count(), budget):
            ok = np.minimum(nx[i], ny[j]) >= least_share * np.maximum(nx[i], ny[j])
            i, j = i[ok], j[ok]
            far = np.zeros(len(i), np.int16)
            for k in range(CHECK_WORDS):
                far += np.bitwise_count(x["check"][i, k] ^ y["check"][j, k])
            i, j = i[far <= check_bits], j[far <= check_bits]
            new = np.ones(len(i), bool)
            for k in range(tab):
                new &= np.bitwise_count(x["codes"][i, k] ^ y["codes"][j, k]) > budget
            u, v = i[new], j[new]
            links += (np.bincount(u, y["m"][v], len(rows)) + np.bincount(v + shift, x["m"][u], len(rows))).astype(np.int64)
            a.append(u)
            b.append(v + shift)
            size += len(u)
            if size > 1 << 20:
                label = components(np.concatenate([*a, np.arange(len(rows))]), np.concatenate([*b, label]), len(rows))
                a, b, size = [], [], 0
        if a:
            label = components(np.concatenate([*a, np.arange(len(rows))]), np.concatenate([*b, label]), len(rows))
        some = np.flatnonzero(links)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(rows[some]), pa.array(links[some]), pa.array(rows[label[some]])], ["node", "links", "root"])

    rows = texts.select("node", "codes", "checks", "n_words", "m").mapInArrow(place, "tab int, bucket bigint, rows binary")
    low, high = F.least("bucket", "other"), F.greatest("bucket", "other")
    pairs = rows.withColumn("other", F.explode(F.array(*[F.lit(m).cast("bigint") for m in near]))).withColumn("other", F.col("bucket").bitwiseXOR(F.col("other")))
    pairs = pairs.select("tab", low.alias("low"), high.alias("high"), (F.col("bucket") <= F.col("other")).alias("first"), "rows")
    return pairs.groupBy("tab", "low", "high").applyInArrow(join, "node bigint, links bigint, root bigint")


def simhash_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tables: int = 8,
    budget: int = 1,
    check_bits: int = 48,
    least_share: float = 0.7,
    shingle: int = 3,
    bucket: int = 1 << 19,
    order_col: str | None = None,
) -> DataFrame:
    """(doc_id, group_id, group_size, n_links, kept) of every row.

    Texts of equal 64-bit hash are linked; of distinct texts, those whose SimHash
    codes differ by at most budget of 64 bits in one of the tables, whose check
    codes differ by at most check_bits of 256 (an angle of about 0.6 between
    the word sets) and whose numbers of words are at least in the ratio
    least_share.  n_links is the number of other rows linked to the row's text.
    Groups are the connected components over all documents; group_id is the
    least doc_id of the group and its first row is kept.

    With heavy-tailed weights a copy's code is either equal or nearly so in a
    table, or far: eight tables at budget 1 find more of the copies with some
    4 % of their words edited than six at budget 2 (99.7 and 98.9 % of the pairs
    of Jaccard similarity 0.8 in a sample), and send each code to p + 1 pairs of
    buckets instead of about p * p / 2, p being the bits of the prefix.

    order_col, if given, orders the rows of a group instead of the id.

    Nulls: a row without text is in no group (group_id null, group_size 0) and
    kept; a null doc_id takes part and is never kept while the group has
    another id.  Empty texts, and texts without words, are linked only to texts
    equal to them.  Very long texts count with all their words.  Repeated rows
    are linked to each other; one is kept.  Ties go to the lower id, then to
    the lower hash of the text.  Empty table: no rows.  Other columns are
    ignored.
    """
    place, text = quoted(order_col or id_col), quoted(text_col).cast("string")
    rows = df.select(F.struct(place.isNull().alias("last"), place.alias("place"), quoted(id_col).alias("id")).alias("id"), text.alias("text"))
    signed = written(_signed(rows.where("text is not null"), tables, shingle), "signed")
    # a distinct text's node is its hash: the same on every machine, and links need no join to name it;
    # partial sums come before the shuffle, as a text or a group may hold a third of all rows
    first = F.first(F.struct("n_words", "codes", "checks")).alias("of")
    top = F.min(F.struct("id", "exact", "row")).alias("top")
    texts = written(signed.groupBy("exact").agg(first, F.count("*").cast("int").alias("m"), top), "texts")
    n = texts.count()
    nodes = texts.where("of.n_words > 0").select(F.col("exact").alias("node"), "m", "of.*")
    near = written(near_links(nodes, tables, budget, check_bits, least_share, _prefix_bits(n, budget, bucket)), "near")
    labels = connected_components(near.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = labels.join(near.groupBy("node").agg(F.sum("links").alias("links")), "node").withColumnRenamed("node", "exact")
    each = texts.select("exact", "m", "top").join(known, "exact", "left")
    each = each.select("exact", "m", "top", F.coalesce("component", "exact").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    groups = each.groupBy("component").agg(F.sum("m").alias("group_size"), F.min("top").alias("first"))
    each = each.join(groups, "component").select("exact", "n_links", "group_size", F.col("first.id.id").alias("group_id"), F.col("first.row").alias("first"))
    out = signed.select("id", "exact", "row").join(each, "exact")
    out = out.select(F.col("id.id").alias("doc_id"), "group_id", "group_size", "n_links", (F.col("row") == F.col("first")).alias("kept"))
    none = df.where(text.isNull()).select(quoted(id_col).alias("doc_id"))
    kind = none.schema["doc_id"].dataType
    return out.unionByName(none.select("doc_id", F.lit(None).cast(kind).alias("group_id"), F.lit(0).cast("bigint").alias("group_size"), F.lit(0).cast("bigint").alias("n_links"), F.lit(True).alias("kept")))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df with one row of each group of simhash_groups(), the one it names as kept.

    Rows without text stay, empty and wordless texts count as copies of texts
    equal to them.  Of rows equal in id and text the one with the least hash of
    all its columns stays.  Of very long texts all words count.  Empty table:
    no rows.  All columns of df are kept, whatever their names.
    """
    key, drop = unused(df, "row_key", "row_drop")
    text = quoted(text_col).cast("string")
    keyed = df.withColumn(key, F.when(text.isNotNull(), row_key(quoted(id_col), text)))
    groups = simhash_groups(keyed.select(quoted(key).alias("id"), quoted(id_col).alias("order"), quoted(text_col).alias("text")).where("id is not null"), "id", "text", order_col="order", **options)
    # the kept row's own repeats have its key: of them the first stays
    lost = written(groups.groupBy("doc_id").agg(F.max(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).where("kept = 0 or n > 1"), "lost")
    both = keyed.join(lost.select(F.col("doc_id").alias(key), (F.col("kept") == 0).alias(drop)), key, "left")
    columns = [quoted(c) for c in df.columns]
    row = F.struct(*[quoted(c).alias(f"c{k}") for k, c in enumerate(df.columns)])
    again = both.where(quoted(drop) == F.lit(False)).groupBy(quoted(key).alias("key")).agg(F.min_by(row, F.xxhash64(*columns)).alias("row"))
    again = again.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(df.columns)])
    return both.where(quoted(drop).isNull()).select(*columns).union(again)
