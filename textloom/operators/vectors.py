"""Tables of chunks with vectors: writing them batch by batch, and exact nearest neighbours."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.embeddings import embedder
from textloom.memory import small_batches, trim
from textloom.schema import chunk_ids

#: How each kind of store states its score, and whether writing an id again replaces it ("upsert"), fails ("unique") or adds a row ("append").
STORES = {
    "qdrant": ("cosine", "upsert"),
    "chroma": ("cosine", "upsert"),
    "pgvector": ("cosine_distance", "upsert"),
    "pinecone": ("cosine", "upsert"),
    "weaviate": ("cosine", "upsert"),
    "milvus": ("l2", "append"),
    "lancedb": ("cosine", "upsert"),
    "mongodb": ("cosine", "unique"),
    "elastic": ("cosine", "upsert"),
    "turbopuffer": ("cosine", "upsert"),
}
#: Types of ids that Arrow sorts as Spark does.
SORTABLE = {"tinyint", "smallint", "int", "bigint", "string", "binary", "date", "timestamp", "timestamp_ntz"}
#: Scores; of the distances less is better. l2_score is 1 - d * d / 2.
METRICS = {"cosine": True, "ip": True, "l2_score": True, "cosine_distance": False, "l2": False}


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of the rows, added from left to right: equal rows give equal sums wherever they stand, as in SQL."""
    return np.cumsum(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def _squares(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0), *[_sums(x[i : i + 8192] ** 2) for i in range(0, len(x), 8192)]])


def _scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Score of each row of x for the row of q beside it."""
    if metric == "ip":
        return _sums(x * q)
    if metric.startswith("cosine"):
        n = np.sqrt(_sums(x * x) * _sums(q * q))
        s = np.clip(np.divide(_sums(x * q), n, out=np.zeros(len(x)), where=n != 0), -1, 1)
        return 1 - s if metric == "cosine_distance" else s
    d = np.sqrt(_sums((x - q) ** 2))
    return 1 - d * d / 2 if metric == "l2_score" else d


class _Best:
    """The limit best rows for each of some queries, of all rows shown so far.

    A matrix product, with a margin for its rounding, tells which pairs may be
    among them; only these are scored, one by one, so that a score doesn't
    depend on what it was computed with. Equal scores go by id where ids can be
    sorted here, else all that are equal to the last one stay. Scores that are
    no number don't count.
    """

    cells = 1 << 20  # of a product at a time

    def __init__(self, names: pa.Array, q: np.ndarray, limit: int, metric: str, sortable: bool):
        self.names, self.q, self.limit, self.metric, self.sortable = names, q, limit, metric, sortable
        self.sign = -1.0 if METRICS[metric] else 1.0
        self.found: list[pa.Table] = []
        self.pending = 0
        self.last = np.full(len(q), np.inf)  # key of the last of limit rows; keys are scores or their negatives, less is better
        with np.errstate(all="ignore"):
            self.square = _squares(q)
            self.length = np.sqrt(self.square)
            self.own = self._unit(q, self.length) if metric.startswith("cosine") else q

    @staticmethod
    def _unit(x: np.ndarray, length: np.ndarray) -> np.ndarray:
        return np.divide(x, length[:, None], out=np.zeros_like(x), where=length[:, None] > 0)

    def _least(self, most: float, a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
        """What the product must come to, for the queries a to z, and the margin, if no row is longer than most."""
        eps = 4 * (self.q.shape[1] + 8) * np.finfo(float).eps
        score = self.sign * self.last[a:z]
        if self.metric == "ip":
            return score, eps * self.length[a:z] * most
        if self.metric.startswith("cosine"):
            return 1 - score if self.metric == "cosine_distance" else score, np.full(z - a, eps)
        far = 2 * (1 - score) if self.metric == "l2_score" else score**2
        return (self.square[a:z] - far) / 2, eps * (self.length[a:z] + most) ** 2

    def show(self, ids: pa.Array, x: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            square = _squares(x)
            # lengths whose squares are too large or too small for the margin: every pair is scored
            plain = np.isfinite(square) & (square < 1e300) & ((square > 1e-280) | ~x.any(axis=1))
            fine = np.isfinite(self.square) & (self.square < 1e300) & ((self.square > 1e-280) | ~self.q.any(axis=1))
            length = np.sqrt(square)
            most = float(length[plain].max(initial=0.0))
            own = self._unit(x, length) if self.metric.startswith("cosine") else x
            half = square / 2 if self.metric.startswith("l2") else None
            step = max(1, self.cells // max(1, len(x)))
            k = self.limit
            for a in range(0, len(self.q), step):
                z = min(a + step, len(self.q))
                c = self.own[a:z] @ own.T
                if half is not None:
                    c -= half
                least, margin = self._least(most, a, z)
                low = least - margin
                fresh = np.flatnonzero(~(self.last[a:z] < np.inf))
                if len(fresh):
                    near = np.where(plain, c[fresh], -np.inf)
                    low[fresh] = np.partition(near, len(x) - k, axis=1)[:, len(x) - k] - 2 * margin[fresh] if len(x) > k else -np.inf
                low[~fine[a:z]] = -np.inf
                maybe = ~(c < low[:, None])
                if not plain.all():
                    maybe[:, ~plain] = True
                i, j = np.nonzero(maybe)
                self._score(i + a, j, ids, x)

    def _score(self, i: np.ndarray, j: np.ndarray, ids: pa.Array, x: np.ndarray) -> None:
        step = max(1, self.cells // max(1, x.shape[1]))
        for at in range(0, len(i), step):
            a, b = i[at : at + step], j[at : at + step]
            key = self.sign * _scores(x[b], self.q[a], self.metric)
            good = np.flatnonzero(key <= self.last[a])
            if len(good):
                self.found.append(pa.table([pa.array(a[good]), pa.array(key[good]), ids.take(pa.array(b[good]))], ["q", "key", "id"]))
                self.pending += len(good)
            if self.pending > max(1 << 14, len(self.q) * self.limit):
                self.settle()

    def settle(self) -> None:
        """Let all but the best go."""
        self.pending = 0
        if not self.found:
            return
        every = pa.concat_tables(self.found).combine_chunks()
        q, key = (every[c].to_numpy() for c in ("q", "key"))
        keys = [("q", "ascending"), ("key", "ascending"), *[("id", "ascending")] * self.sortable]
        order = pc.sort_indices(every, sort_keys=keys, null_placement="at_start").to_numpy()
        q, key = q[order], key[order]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        place = np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q)))
        full = np.flatnonzero(place == self.limit - 1)
        self.last[q[full]] = key[full]
        keep = place < self.limit if self.sortable else key <= self.last[q]
        self.found = [every.take(pa.array(order[keep]))]

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        for t in self.found:
            for a in range(0, t.num_rows, 1 << 16):
                own = t.slice(a, 1 << 16).combine_chunks()
                columns = [self.names.take(own["q"].combine_chunks()), own["id"].combine_chunks(), pa.array(self.sign * own["key"].to_numpy())]
                yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], ["query_id", "id", "score"])


class _Shown:
    """Rows gathered until they are worth a product."""

    def __init__(self, best: _Best, dim: int):
        self.best, self.least, self.held = best, max(1, (1 << 19) // max(1, dim)), []

    def add(self, ids: pa.Array, x: np.ndarray) -> None:
        self.held.append((ids, x))
        if sum(len(v) for _, v in self.held) >= self.least:
            self.end()

    def end(self) -> None:
        if self.held:
            ids, x = pa.concat_arrays([i for i, _ in self.held]), np.concatenate([v for _, v in self.held])
            self.held = []
            for a in range(0, len(x), 2 * self.least):
                self.best.show(ids.slice(a, 2 * self.least), x[a : a + 2 * self.least])


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dim)


def _ranked(column: str, metric: str) -> Column:
    return F.col(column).desc() if METRICS[metric] else F.col(column).asc()


def nearest(
    table: DataFrame,
    queries: DataFrame,
    limit: int = 5,
    metric: str = "cosine",
    id_col: str = "id",
    vec_col: str = "embedding",
    query_id: str = "query_id",
    query_vec: str = "embedding",
    query_bytes: int = 32 << 20,
) -> DataFrame:
    """(query_id, id, score, rank): the limit best rows of table for every query, exactly; equal scores by id.

    Queries of query_bytes / 32 at most go to the tasks that read the table.
    More of them are cut into blocks of about query_bytes and the table into
    groups, and a task for each block and group holds the block, has the group
    pass by and sends on only the limit best rows of each query. So all pairs
    are compared, the work growing with their number, but no task and not the
    driver holds more than a block. Rows and queries without vector, or of
    another length than the first query's, are left out.
    """
    if metric not in METRICS or limit < 1:
        raise ValueError("metric must be one of " + ", ".join(METRICS) + " and limit at least 1")
    spark = table.sparkSession
    small_batches(spark)
    kept = "float" if all(d.schema[c].dataType.simpleString() == "array<float>" for d, c in ((table, vec_col), (queries, query_vec))) else "double"
    rows = table.select(table[id_col].alias("id"), table[vec_col].cast(f"array<{kept}>").alias("v"))
    asked = queries.select(queries[query_id].alias("q"), queries[query_vec].cast(f"array<{kept}>").alias("v"))
    kind, qkind = (d.schema[c].dataType.simpleString() for d, c in ((rows, "id"), (asked, "q")))
    sortable = kind in SORTABLE or kind.startswith("decimal")
    first = asked.where("size(v) > 0").select(F.size("v")).first()
    dim = first[0] if first else 0
    whole = (F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull())
    rows, asked = rows.where(whole), asked.where(whole)
    n = asked.count() if dim else 0
    if n * dim * 8 <= query_bytes // 32:
        own = asked.toArrow().combine_chunks() if n else asked.limit(0).toArrow()
        names = _plain(own.column("q"))
        q = _matrix(_plain(own.column("v")), dim).astype(float) if n else np.zeros((0, dim))

        def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(names, q, limit, metric, sortable)
            shown = _Shown(best, dim)
            for batch in batches:
                if batch.num_rows and len(q):
                    shown.add(batch.column(0), _matrix(batch.column(1), dim).astype(float))
            shown.end()
            yield from best.rows()
            trim()

        found = rows.mapInArrow(look, f"query_id {qkind}, id {kind}, score double")
    else:
        cores, m = spark.sparkContext.defaultParallelism, rows.count()
        blocks = max(-(-n * dim * 8 // query_bytes), min(cores, -(-n // 4096)))
        groups = max(1, min(-(-4 * cores // blocks), -(-m // 1024)), m * dim * 8 >> 28)
        found = _crossed(rows, asked, blocks, groups, dim, kept, limit, metric, sortable)
    place = Window.partitionBy("query_id").orderBy(_ranked("score", metric), "id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= limit)


def _plain(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _crossed(rows: DataFrame, asked: DataFrame, blocks: int, groups: int, dim: int, kept: str, limit: int, metric: str, sortable: bool) -> DataFrame:
    """The best rows of each query in each group: slices of rows and queries meet by the cell of their block and group, queries first."""
    kind, qkind = (d.schema[c].dataType.simpleString() for d, c in ((rows, "id"), (asked, "q")))
    number = np.float32 if kept == "float" else np.float64

    def sliced(df: DataFrame, name: str, parts: int) -> DataFrame:
        def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                part = batch.column(2).to_numpy()
                order = np.argsort(part, kind="stable")
                x = _matrix(batch.column(1), dim).astype(number, copy=False)
                for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []:
                    ids = batch.column(0).take(pa.array(at))
                    lists = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), ids)
                    yield pa.RecordBatch.from_arrays([pa.array([int(part[at[0]])], pa.int32()), lists, pa.array([x[at].tobytes()], pa.binary())], ["part", "names", "x"])

        own = df.select(name, "v", F.pmod(F.xxhash64(name, "v"), F.lit(parts)).cast("int").alias("part"))
        return own.mapInArrow(pack, f"part int, names array<{df.schema[name].dataType.simpleString()}>, x binary")

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other")

    q = sliced(asked, "q", blocks).select(all_of(groups), "part", "names", "x")
    r = sliced(rows, "id", groups).select(all_of(blocks), "part", "names", "x")
    q = q.select((F.col("part") * groups + F.col("other")).alias("cell"), F.lit(0).alias("side"), F.col("names").alias("q"), F.lit(None).cast(f"array<{kind}>").alias("id"), "x")
    r = r.select((F.col("other") * groups + F.col("part")).alias("cell"), F.lit(1).alias("side"), F.lit(None).cast(f"array<{qkind}>").alias("q"), F.col("names").alias("id"), "x")

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, shown = None, [], None

        def begun() -> _Shown:
            names, x = pa.concat_arrays([i for i, _ in held]), np.concatenate([v for _, v in held])
            return _Shown(_Best(names, x.astype(float), limit, metric, sortable), dim)

        for batch in batches:
            cells, sides = (batch.column(i).to_pylist() for i in (0, 1))
            for i in range(batch.num_rows):
                if cells[i] != cell:
                    if shown:
                        shown.end()
                        yield from shown.best.rows()
                    cell, held, shown = cells[i], [], None
                x = np.frombuffer(batch.column(4)[i].as_buffer(), number).reshape(-1, dim)
                if sides[i] == 0:
                    held.append((batch.column(2)[i].values, x))
                elif held or shown:
                    if not shown:
                        shown, held = begun(), []
                    shown.add(batch.column(3)[i].values, x.astype(float))
        if shown:
            shown.end()
            yield from shown.best.rows()
        trim()

    met = q.unionByName(r).repartitionById(blocks * groups, F.col("cell")).sortWithinPartitions("cell", "side")
    return met.mapInArrow(look, f"query_id {qkind}, id {kind}, score double")


def search(
    table: DataFrame, query: str | None = None, embedding: Sequence[float] | None = None, limit: int = 5, metric: str = "cosine", model: Any = "hashing", where: Column | str | None = None, vec_col: str = "embedding", id_col: str = "id"
) -> DataFrame:
    """The limit best rows of table for one text or vector, best first, with their score; where filters before the search.

    An embedding given beside a text is used instead of it.
    """
    if query is None and embedding is None:
        raise ValueError("give a query or an embedding")
    vector = [float(v) for v in (embedding if embedding is not None else embedder(model).embed(query))]
    rows = table if where is None else table.where(where)
    one = table.sparkSession.createDataFrame([(0, vector)], "query_id int, embedding array<double>")
    found = nearest(rows, one, limit, metric, id_col, vec_col)
    hits = found.select(F.col("id").alias("_hit"), "score")
    return rows.join(F.broadcast(hits), rows[id_col] == F.col("_hit")).drop("_hit").orderBy(_ranked("score", metric), id_col)


def flat_metadata(metadata: dict[str, Any], reserved: dict[str, Any]) -> dict[str, Any]:
    """One dictionary of plain values: null ones dropped, nested ones as JSON; reserved fields win."""
    both = {**metadata, **reserved}
    return {k: v if isinstance(v, (str, int, float, bool)) else json.dumps(v, sort_keys=True) for k, v in both.items() if v is not None}


def payload(chunks: DataFrame) -> DataFrame:
    """(id, embedding, payload): metadata with the reserved fields of the chunk over it, as a map of strings."""
    own = {c: F.col(c).cast("string") for c in ("doc_id", "text", "start_index", "end_index", "token_count", "context")}
    fields = F.map_filter(F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    meta = F.map_filter(F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & ~k.isin(*own))
    return chunks.select("id", "embedding", F.map_concat(meta, fields).alias("payload"))


class VectorTable:
    """A table of rows with an id, in a folder: every write adds a batch, and a read sees the newest row of each id.

    A write costs what its batch costs, whatever the table's size; compact()
    brings the batches together. Batches that weren't finished aren't read.
    kind is one of STORES.
    """

    def __init__(self, spark: SparkSession, path: str, kind: str = "qdrant", id_col: str = "id", vec_col: str = "embedding"):
        self.spark, self.path, self.id_col, self.vec_col = spark, path.rstrip("/"), id_col, vec_col
        self.metric, self.mode = STORES[kind]

    def _batches(self) -> list[str]:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(conf)
        if not fs.exists(root):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory())
        done = [n for n in names if n.startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        whole = [i for i, n in enumerate(done) if n.endswith("-all")]
        return done[whole[-1] :] if whole else done

    def _next(self) -> int:
        return max([int(n[6:16]) for n in self._batches()], default=0) + 1

    def write(self, rows: DataFrame) -> None:
        """Add rows. Of an id that is in them several times any one row counts, but in append mode all do."""
        if self.mode == "append":
            rows.write.parquet(f"{self.path}/batch={self._next():010d}")
            return
        rows = rows.dropDuplicates([self.id_col]) if self.mode == "upsert" else rows
        if self.mode == "unique":
            twice = rows.groupBy(self.id_col).count().where("count > 1").select(self.id_col)
            known = rows.join(self.read().select(self.id_col), self.id_col, "left_semi").select(self.id_col) if self._batches() else twice
            if twice.unionByName(known).limit(1).count():
                raise ValueError("an id is in the table already, or twice in what is written")
        rows.write.parquet(f"{self.path}/batch={self._next():010d}")

    def read(self) -> DataFrame:
        """All rows, the newest of each id."""
        names = self._batches()
        if not names:
            raise FileNotFoundError(self.path)
        parts = [self.spark.read.parquet(f"{self.path}/{n}").withColumn("_batch", F.lit(int(n[6:16]))) for n in names]
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        if self.mode != "upsert" or len(parts) == 1:
            return every.drop("_batch")
        newest = Window.partitionBy(self.id_col).orderBy(F.desc("_batch"))
        return every.withColumn("_place", F.row_number().over(newest)).where("_place = 1").drop("_batch", "_place")

    def compact(self) -> None:
        """Write what read() gives as one batch that takes the place of all before it."""
        self.read().write.parquet(f"{self.path}/batch={self._next():010d}-all")

    def search(self, query: str | None = None, embedding: Sequence[float] | None = None, limit: int = 5, where: Column | str | None = None, model: Any = "hashing") -> DataFrame:
        return search(self.read(), query, embedding, limit, self.metric, model, where, self.vec_col, self.id_col)

    def info(self) -> dict[str, Any]:
        return {"path": self.path, "rows": self.read().count(), "batches": len(self._batches()), "metric": self.metric}

    def delete(self) -> None:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def upserted(old: DataFrame, new: DataFrame, id_col: str = "id") -> DataFrame:
    """old with the rows of new in place of those of the same id."""
    return old.join(new.select(id_col), id_col, "left_anti").select(*old.columns).unionByName(new)


def store(chunks: DataFrame, path: str, kind: str = "qdrant", model: Any = "hashing", collection: str = "chunks") -> DataFrame:
    """Write chunks into a VectorTable, embedded if they aren't yet, under ids named after the collection; returns what was written."""
    from textloom.functions.embeddings import with_embeddings

    rows = chunk_ids(chunks, collection)
    if "embedding" not in rows.columns:
        rows = with_embeddings(rows, model)
    else:
        made = with_embeddings(rows.where("embedding is null"), model)
        rows = rows.where("embedding is not null").unionByName(made)
    VectorTable(chunks.sparkSession, path, kind).write(rows)
    return rows
