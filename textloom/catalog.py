"""Every query over the supplied tables, with the SQL that gives the same rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.embeddings import with_embeddings
from textloom.functions.tables import html_json, pipe_json
from textloom.functions.text import unescaped
from textloom.functions.tokenizers import count_column
from textloom.operators import chunkers as c
from textloom.operators.base import rechunked
from textloom.operators.overlap import refine_overlap
from textloom.operators.parsers import gap_chunks, parse_markdown, parse_tables
from textloom.operators.vectors import nearest, upserted
from textloom.plans.pipeline import Pipeline
from textloom.schema import chunk_ids, merged_metadata, reconstructed
from textloom.sources.files import joined_documents, table_documents
from textloom.storage import shared_folder
from textloom.streaming.chunks import document_stream, write_stream

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""

    def keep(f):
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return keep


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _integers(sql: str, *names: str) -> str:
    return ", ".join(f"({x})::INT AS {n}" for x, n in zip(sql.split(" ; "), names, strict=True))


def _windows(source: str, size: int, overlap: int, id_col: str = "doc_id", text_col: str = "text", what: str = "doc_id") -> str:
    """SQL of character windows over a table or subquery."""
    step = size - overlap
    return f"""SELECT {what}, pos::INT AS pos, substring(t, pos * {step} + 1, {size}) AS text, {_integers(f'pos * {step} ; least(pos * {step} + {size}, n) ; least({size}, n - pos * {step})', 'start_index', 'end_index', 'token_count')}
    FROM (SELECT *, unnest(range(0, CASE WHEN n <= {overlap} THEN 1 ELSE ceil((n - {overlap}) / {step}.0)::BIGINT END)) AS pos
          FROM (SELECT {id_col} AS doc_id, {text_col} AS t, length({text_col}) AS n FROM {source} WHERE regexp_matches({text_col}, '\\S')))"""


@query("SELECT doc_id, length(text)::INT AS characters, len(string_split(text, ' '))::INT AS words, octet_length(encode(text))::INT AS bytes, (CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END)::INT AS lines FROM documents")
def count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    names = {"characters": "character", "words": "word", "bytes": "byte", "lines": "row"}
    return load(spark, sf_dir, "documents").select("doc_id", *[count_column(text, v).alias(k) for k, v in names.items()])


@query(_windows("documents", 512, 64))
def chunk_token_character(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.chunk_tokens(load(spark, sf_dir, "documents"), chunk_size=512, chunk_overlap=64)


@query(
    """WITH d AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE regexp_matches(text, '\\S')),
    p AS (SELECT doc_id, w, len(w) AS n, unnest(range(0, CASE WHEN len(w) <= 16 THEN 1 ELSE ceil((len(w) - 16) / 112.0)::BIGINT END)) AS pos FROM d),
    t AS (SELECT doc_id, pos, array_to_string(w[pos * 112 + 1 : pos * 112 + 128], ' ') AS text, CASE WHEN pos = 0 THEN 0 ELSE length(array_to_string(w[1 : pos * 112], ' ')) + 1 END AS a, least(128, n - pos * 112) AS k FROM p)
    SELECT doc_id, pos::INT AS pos, text, a::INT AS start_index, (a + length(text))::INT AS end_index, k::INT AS token_count FROM t"""
)
def chunk_token_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.chunk_tokens(load(spark, sf_dir, "documents"), tokenizer_="word", chunk_size=128, chunk_overlap=16)


@query(
    """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents WHERE regexp_matches(text, '\\S')),
    p AS (SELECT doc_id, w, unnest(range(0, ceil(len(w) / 4.0)::BIGINT)) AS pos FROM d),
    t AS (SELECT doc_id, pos, array_to_string(w[pos * 4 + 1 : pos * 4 + 4], chr(10)) AS text, least(4, len(w) - pos * 4) AS k FROM p),
    s AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM t)
    SELECT doc_id, pos::INT AS pos, text, a::INT AS start_index, (a + length(text))::INT AS end_index, k::INT AS token_count FROM s"""
)
def chunk_token_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.chunk_tokens(load(spark, sf_dir, "documents"), tokenizer_="row", chunk_size=4)


SENTENCES = """WITH RECURSIVE s AS (SELECT doc_id, i::INT AS i, parts[i] AS x FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '(\\. |! |\\? |\\n)', '\\1' || chr(57344), 'g'), chr(57344)), lambda p: p <> '') AS parts FROM documents WHERE regexp_matches(text, '\\S')))),
    m AS (SELECT doc_id, i, length(x) AS n, 1 AS g FROM s WHERE i = 1 UNION ALL
        SELECT s.doc_id, s.i, CASE WHEN m.n >= 12 THEN length(s.x) ELSE m.n + length(s.x) END, CASE WHEN m.n >= 12 THEN m.g + 1 ELSE m.g END FROM m JOIN s ON s.doc_id = m.doc_id AND s.i = m.i + 1),
    t AS (SELECT s.doc_id, m.g::INT AS i, string_agg(s.x, '' ORDER BY s.i) AS x FROM s JOIN m ON s.doc_id = m.doc_id AND s.i = m.i GROUP BY s.doc_id, m.g),
    c AS (SELECT doc_id, i, length(x) AS n, 1 AS g FROM t WHERE i = 1 UNION ALL
        SELECT t.doc_id, t.i, CASE WHEN c.n + length(t.x) <= 512 THEN c.n + length(t.x) ELSE length(t.x) END, CASE WHEN c.n + length(t.x) <= 512 THEN c.g ELSE c.g + 1 END FROM c JOIN t ON t.doc_id = c.doc_id AND t.i = c.i + 1),
    u AS (SELECT t.doc_id, c.g, string_agg(t.x, '' ORDER BY t.i) AS text FROM t JOIN c ON t.doc_id = c.doc_id AND t.i = c.i GROUP BY t.doc_id, c.g),
    v AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM u)
    SELECT doc_id, (g - 1)::INT AS pos, text, a::INT AS start_index, (a + length(text))::INT AS end_index, length(text)::INT AS token_count FROM v"""


@query(SENTENCES)
def chunk_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.chunk_sentences(load(spark, sf_dir, "documents"), chunk_size=512)


@query(
    SENTENCES[: SENTENCES.index("c AS (SELECT doc_id, i, length(x)")]
    + """b AS (SELECT doc_id, list(x ORDER BY i) AS xs, len(list(x)) AS n, list_concat([0], list_transform(range(1, len(list(x)) + 1), lambda k: list_sum(list_transform(list_slice(list(x ORDER BY i), 1, k), lambda y: length(y)))::BIGINT)) AS cs FROM t GROUP BY doc_id),
    c AS (SELECT doc_id, 0 AS pos, 0::BIGINT AS i, least(n, greatest(2, coalesce(list_max(list_filter(range(1, n + 1), lambda k: cs[k + 1] <= 512)), 1))) AS j FROM b
        UNION ALL SELECT doc_id, pos + 1, i, least(n, greatest(i + 2, coalesce(list_max(list_filter(range(i + 1, n + 1), lambda k: cs[k + 1] - cs[i + 1] <= 512)), i + 1)))
        FROM (SELECT c.doc_id, c.pos, b.n, b.cs, list_min(list_filter(range(c.i + 1, c.j + 1), lambda k: b.cs[c.j + 1] - b.cs[k + 1] + c.j - k <= 128)) AS i FROM c JOIN b ON b.doc_id = c.doc_id WHERE c.j < b.n))
    SELECT c.doc_id, pos, array_to_string(list_slice(xs, i + 1, j), '') AS text, cs[i + 1]::INT AS start_index, cs[j + 1]::INT AS end_index, (cs[j + 1] - cs[i + 1])::INT AS token_count FROM c JOIN b ON b.doc_id = c.doc_id"""
)
def chunk_sentence_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.chunk_sentences(load(spark, sf_dir, "documents"), chunk_size=512, chunk_overlap=128, min_sentences_per_chunk=2)


def _recursive(size: int, least: int) -> str:
    """SQL of recursive chunks: for each level, texts above the size are split, short pieces joined, and pieces merged."""
    quotes = "".join(f"\\x{{{x}}}" for x in ("201C", "201D", "2018", "2019"))
    out = ["p0 AS (SELECT doc_id, 0::BIGINT AS a, text FROM documents WHERE text <> '')"]
    for k, ends in enumerate((r"\n\n|\r\n|\n|\r", r"\. |! |\? ", rf"\.\.\.|[{{}}\[\]()<>|~:;,{quotes}-]", " ")):
        out.append(
            f"""s{k} AS (SELECT doc_id, a, i, parts[i] AS x FROM (SELECT doc_id, a, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, a, list_filter(string_split(regexp_replace(text, '({ends})', '\\1' || chr(57344), 'g'), chr(57344)), lambda p: p <> '') AS parts FROM p{k}))),
    m{k} AS (SELECT doc_id, a, i, length(x) AS n, 1 AS g FROM s{k} WHERE i = 1 UNION ALL SELECT s.doc_id, s.a, s.i, CASE WHEN m.n >= {least} THEN 0 ELSE m.n END + length(s.x), CASE WHEN m.n >= {least} THEN m.g + 1 ELSE m.g END
        FROM m{k} AS m JOIN s{k} AS s ON s.doc_id = m.doc_id AND s.a = m.a AND s.i = m.i + 1),
    t{k} AS (SELECT s.doc_id, s.a, m.g::BIGINT AS i, string_agg(s.x, '' ORDER BY s.i) AS x FROM s{k} AS s JOIN m{k} AS m ON s.doc_id = m.doc_id AND s.a = m.a AND s.i = m.i GROUP BY ALL),
    b{k} AS (SELECT *, min(length(x)) OVER (PARTITION BY doc_id, a) > {size} AS large FROM t{k}),
    c{k} AS (SELECT doc_id, a, i, length(x) AS n, 1 AS g FROM b{k} WHERE i = 1 UNION ALL SELECT t.doc_id, t.a, t.i, CASE WHEN t.large OR c.n + length(t.x) > {size} THEN 0 ELSE c.n END + length(t.x), CASE WHEN t.large OR c.n + length(t.x) > {size} THEN c.g + 1 ELSE c.g END
        FROM c{k} AS c JOIN b{k} AS t ON t.doc_id = c.doc_id AND t.a = c.a AND t.i = c.i + 1),
    u{k} AS (SELECT t.doc_id, t.a, c.g, string_agg(t.x, '' ORDER BY t.i) AS text FROM b{k} AS t JOIN c{k} AS c ON t.doc_id = c.doc_id AND t.a = c.a AND t.i = c.i GROUP BY ALL),
    v{k} AS (SELECT doc_id, (a + sum(length(text)) OVER (PARTITION BY doc_id, a ORDER BY g) - length(text))::BIGINT AS a, text FROM u{k}),
    p{k + 1} AS (SELECT * FROM v{k} WHERE length(text) > {size})"""
        )
    pieces = " UNION ALL ".join(f"SELECT * FROM v{k} WHERE length(text) <= {size}" for k in range(4))
    windows = f"SELECT doc_id, a + w * {size}, text[w * {size} + 1 : w * {size} + {size}] FROM (SELECT *, unnest(range(0, (length(text) + {size - 1}) // {size})) AS w FROM p4)"
    return "WITH RECURSIVE " + ",\n    ".join(out) + f""", f AS ({pieces} UNION ALL {windows})
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INT AS pos, text, a::INT AS start_index, (a + length(text))::INT AS end_index, length(text)::INT AS token_count FROM f"""


@query(_recursive(512, 24))
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.chunk_recursive(load(spark, sf_dir, "documents"), chunk_size=512)


@query(
    """WITH RECURSIVE l AS (SELECT doc_id, string_split(text, '') AS xs FROM documents WHERE text <> ''),
    u AS (SELECT doc_id, unnest(range(1, len(xs) + 1)) AS i, unnest(xs) AS x FROM l),
    ch AS (SELECT doc_id, i, x IN (chr(10), '.', '?') AS stop, sum(octet_length(encode(x))) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM u),
    n AS (SELECT doc_id, max(e) AS n, max(i) AS chars FROM ch GROUP BY doc_id),
    c AS (SELECT doc_id, 0 AS pos, 0::BIGINT AS a, 0::HUGEINT AS b FROM n
        UNION ALL SELECT c.doc_id, c.pos + 1, coalesce(max(ch.i) FILTER (stop), max(ch.i)), coalesce(max(ch.e) FILTER (stop), max(ch.e))
        FROM c JOIN n ON n.doc_id = c.doc_id JOIN ch ON ch.doc_id = c.doc_id AND ch.e > c.b AND ch.e <= c.b + 1024 WHERE n.n - c.b > 1024 GROUP BY c.doc_id, c.pos),
    r AS (SELECT c.doc_id, pos, a, coalesce(lead(a) OVER (PARTITION BY c.doc_id ORDER BY pos), chars) AS z FROM c JOIN n ON n.doc_id = c.doc_id)
    SELECT r.doc_id, pos, text[a + 1 : z] AS text, a::INT AS start_index, z::INT AS end_index, 0 AS token_count FROM r JOIN documents AS d ON d.doc_id = r.doc_id"""
)
def chunk_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.chunk_bytes(load(spark, sf_dir, "documents"), chunk_size=1024)


@query()
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.chunk_semantic(load(spark, sf_dir, "documents"), chunk_size=1024, skip_window=1)


@query()
def chunk_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.chunk_late(load(spark, sf_dir, "documents"), chunk_size=256)


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source code made of the customers: one module each. A small file makes much text, so its rows are spread over all cores first."""
    part = F.format_string("@cached\ndef balance_%d(x):\n    # of %s\n    return x + %d\n\n\nclass Customer%d:\n    key = %d\n", "c_custkey", "c_name", "c_custkey", "c_custkey", "c_custkey")
    rows = load(spark, sf_dir, "customer").select("c_custkey", "c_name").repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey")
    return rows.select(F.col("c_custkey").alias("doc_id"), part.alias("text"))


@query()
def chunk_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.chunk_code(_sources(spark, sf_dir), chunk_size=60)


_SENTENCE, _SPACES = re.compile(r"[^.!?]+[.!?]+\s*"), re.compile(r"\s*")


def _sentence_spans(text: str) -> list[dict]:
    # beyond the last mark nothing can match: there each start would be tried up to the end
    end = _SPACES.match(text, 1 + max(map(text.rfind, ".!?"))).end()
    return [{"start": m.start(), "end": m.end()} for m in _SENTENCE.finditer(text, 0, end)]


@query(
    """WITH h AS (SELECT doc_id, text AS t, length(regexp_extract(text, '(?s)^.*[^.!?][.!?]+\\s*')) AS z FROM documents WHERE text <> '')
    SELECT doc_id, 0 AS pos, t[1:z] AS text, 0 AS start_index, z::INT AS end_index, z::INT AS token_count FROM h WHERE z > 0
    UNION ALL SELECT doc_id, CASE WHEN z > 0 THEN 1 ELSE 0 END, t[z + 1 :], z::INT, length(t)::INT, (length(t) - z)::INT FROM h WHERE z < length(t)"""
)
def chunk_neural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span model stands in: it predicts sentences."""
    return c.chunk_spans(load(spark, sf_dir, "documents"), _sentence_spans)


@query()
def chunk_guided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language model stands in: it names the last passage it is shown."""
    return c.chunk_guided(load(spark, sf_dir, "documents"), lambda prompt: int(re.findall(r"^ID (\d+):", prompt, re.MULTILINE)[-1]), chunk_size=512)


@query(
    """WITH s AS (SELECT doc_id, text AS t, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE regexp_matches(text, '\\S')),
    x AS (SELECT doc_id, t, i, parts[i] AS part, sum(length(parts[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS z FROM s),
    y AS (SELECT doc_id, t, row_number() OVER w AS k, coalesce(lag(z) OVER w, 0) AS a, CASE WHEN lead(z) OVER w IS NULL THEN length(t) ELSE z END AS z FROM x WHERE part <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i))
    SELECT doc_id, (k - 1)::INT AS pos, t[a + 1 : z] AS text, a::INT AS start_index, z::INT AS end_index, (z - a)::INT AS token_count FROM y"""
)
def chunk_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segmenting service stands in: it gives paragraphs without the line feeds between them."""
    return c.chunk_segments(load(spark, sf_dir, "documents"), lambda text: [p for p in text.split("\n") if p])


CONVERSATIONS = "(SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS t FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)"


@query(_windows(CONVERSATIONS, 256, 32, "conv_id", "t"))
def chunk_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = joined_documents(load(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return c.chunk_tokens(docs, text_col="content", chunk_size=256, chunk_overlap=32)


@query(_windows("documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)", 512, 0).replace("labels WHERE quality = 1) WHERE", "labels WHERE quality = 1) AND"))
def chunk_of_good_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = load(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return c.chunk_tokens(load(spark, sf_dir, "documents").join(good, "doc_id", "left_semi"), chunk_size=512)


PARENTS = _windows("documents", 512, 0)


@query(
    f"""WITH p AS ({PARENTS}), q AS (SELECT *, unnest(range(0, ceil(token_count / 200.0)::BIGINT)) AS k FROM p WHERE regexp_matches(text, '\\S'))
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) - 1)::INT AS pos, substring(text, k * 200 + 1, 200) AS text, (start_index + k * 200)::INT AS start_index, least(start_index + k * 200 + 200, end_index)::INT AS end_index, least(200, token_count - k * 200)::INT AS token_count FROM q"""
)
def rechunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rechunked(_parents(spark, sf_dir), c.chunk_tokens, chunk_size=200)


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.chunk_tokens(load(spark, sf_dir, "documents"), chunk_size=512)


def _overlap(context: str, front: str, back: str) -> str:
    return f"""WITH p AS ({PARENTS}), w AS (SELECT *, lag(text) OVER o AS b, lag(token_count) OVER o AS bn, lead(text) OVER o AS a, lead(token_count) OVER o AS an FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
    x AS (SELECT *, left(a, floor(an * 0.25)::INT) AS head, CASE WHEN floor(bn * 0.25) = 0 THEN b ELSE right(b, floor(bn * 0.25)::INT) END AS tail FROM w)
    SELECT doc_id, pos, {front} || text || {back} AS text, start_index, end_index, (token_count + length({front} || {back}))::INT AS token_count, {context} AS context FROM x"""


@query(_overlap("head", "''", "coalesce(head, '')"))
def overlap_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refine_overlap(_parents(spark, sf_dir))


@query(_overlap("coalesce(tail, '') || coalesce(head, '')", "coalesce(tail, '')", "coalesce(head, '')"))
def overlap_justified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refine_overlap(_parents(spark, sf_dir), method="justified")


@query(_overlap("tail", "''", "''"))
def overlap_prefix_unmerged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refine_overlap(_parents(spark, sf_dir), method="prefix", merge=False)


@query(
    f"""WITH RECURSIVE p AS ({PARENTS}), m AS (SELECT doc_id, pos, text, start_index, end_index, token_count, NULL::VARCHAR AS context FROM p WHERE pos = 0
    UNION ALL SELECT p.doc_id, p.pos, c || p.text, p.start_index, p.end_index, (p.token_count + length(c))::INT, c
    FROM (SELECT doc_id, pos, CASE WHEN floor(token_count * 0.25) = 0 THEN text ELSE right(text, floor(token_count * 0.25)::INT) END AS c FROM m) AS b JOIN p ON p.doc_id = b.doc_id AND p.pos = b.pos + 1)
    SELECT * FROM m"""
)
def overlap_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refine_overlap(_parents(spark, sf_dir), method="prefix")


@query()
def overlap_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refine_overlap(_parents(spark, sf_dir), mode="recursive", method="justified")


@query(
    f"""WITH p AS ({PARENTS}), w AS (SELECT doc_id, pos, unnest(regexp_extract_all(lower(text), '[\\pL\\pN_]+')) AS word FROM p),
    h AS (SELECT doc_id, pos, (('0x' || md5(word)[1:8])::BIGINT % 32) AS slot, CASE WHEN md5(word)[9:9] >= '8' THEN 1 ELSE -1 END AS sign FROM w),
    v AS (SELECT doc_id, pos, slot, sum(sign)::INT AS n FROM h GROUP BY ALL),
    f AS (SELECT doc_id, pos, sqrt(sum(n * n))::REAL AS norm FROM v GROUP BY ALL),
    a AS (SELECT p.doc_id, p.pos, k.range AS slot FROM p, range(32) AS k)
    SELECT a.doc_id, a.pos, list((coalesce(n, 0)::REAL / CASE WHEN coalesce(norm, 0) = 0 THEN 1 ELSE norm END)::REAL ORDER BY a.slot) AS embedding
    FROM a LEFT JOIN v ON a.doc_id = v.doc_id AND a.pos = v.pos AND a.slot = v.slot LEFT JOIN f ON a.doc_id = f.doc_id AND a.pos = f.pos GROUP BY ALL"""
)
def embed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_embeddings(_parents(spark, sf_dir), "hashing-32").select("doc_id", "pos", "embedding")


@query("SELECT doc_id, text AS content FROM documents WHERE regexp_matches(text, '\\S')")
def reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconstructed(chunk_token_character(spark, sf_dir))


@query(f"WITH p AS ({_windows('documents', 512, 64)}) SELECT lang, source, count(*) AS chunks, sum(token_count)::BIGINT AS tokens, max(token_count) AS most, count(DISTINCT p.doc_id) AS docs FROM p JOIN documents d ON p.doc_id = d.doc_id GROUP BY lang, source")
def chunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    chunks = chunk_token_character(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("token_count").alias("t"), F.max("token_count").alias("m"))
    return docs.join(chunks, "doc_id").groupBy("lang", "source").agg(F.sum("n").alias("chunks"), F.sum("t").alias("tokens"), F.max("m").alias("most"), F.count("*").alias("docs"))


UUID = """WITH p AS (%s), h AS (SELECT *, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode('chunks::chunk-' || doc_id || '-' || pos || ':' || text)) AS d FROM p)
    SELECT doc_id, pos, d[1:8] || '-' || d[9:12] || '-5' || d[14:16] || '-' || substring('89ab', instr('0123456789abcdef', d[17:17])::INT - 1 - 4 * ((instr('0123456789abcdef', d[17:17])::INT - 1) // 4) + 1, 1) || d[18:20] || '-' || d[21:32] AS id FROM h"""


@query(UUID % PARENTS)
def chunk_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_ids(_parents(spark, sf_dir)).select("doc_id", "pos", "id")


@query(f"WITH p AS ({PARENTS}) SELECT p.doc_id, pos, text, lang, 'chunk' AS source FROM p JOIN (SELECT doc_id, lang FROM documents) d ON p.doc_id = d.doc_id")
def pipeline_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks carry their documents' metadata; what a chunk states itself wins."""
    docs = table_documents(load(spark, sf_dir, "documents"), metadata_cols=("lang", "source"))
    own = F.create_map(F.lit("source"), F.lit("chunk"))
    chunks = Pipeline(spark).chunk_with("token", chunk_size=512).run(docs)
    merged = chunks.withColumn("metadata", merged_metadata(F.col("metadata"), own))
    return merged.select("doc_id", "pos", "text", F.col("metadata")["lang"].alias("lang"), F.col("metadata")["source"].alias("source"))


@query(_overlap("head", "''", "coalesce(head, '')"))
def pipeline_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table_documents(load(spark, sf_dir, "documents"))
    out = Pipeline(spark).refine_with("overlap", context_size=0.25).chunk_with("token", chunk_size=512).run(docs)
    return out.select("doc_id", "pos", "text", "start_index", "end_index", "token_count", "context")


def _neighbours(score: str, order: str, where: str = "true") -> str:
    return f"""SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, id) AS rank
    FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {score} AS score FROM embeddings q, embeddings e WHERE {where.replace('label', 'e.label')})) WHERE rank <= 5"""


def _nearest(spark: SparkSession, sf_dir: str, metric: str, where: str | None = None) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    out = nearest(vectors.where(where) if where else vectors, vectors, 5, metric, "vec_id", query_id="vec_id")
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_Q, _E = "q.embedding::DOUBLE[]", "e.embedding::DOUBLE[]"


@query(_neighbours(f"list_cosine_similarity({_Q}, {_E})", "DESC"))
def search_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, "cosine")


@query(_neighbours(f"list_distance({_Q}, {_E})", "ASC"))
def search_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, "l2")


@query(_neighbours(f"list_inner_product({_Q}, {_E})", "DESC"))
def search_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, "ip")


@query(_neighbours(f"1 - list_cosine_similarity({_Q}, {_E})", "ASC", "label > 2"))
def search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, "cosine_distance", "label > 2")


@query("SELECT c_custkey AS id, c_name AS name, 'old' AS state FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT c_custkey, upper(c_name), 'new' FROM customer WHERE c_acctbal < 0")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "customer")
    old = rows.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("old").alias("state"))
    new = rows.where("c_acctbal < 0").select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("name"), F.lit("new").alias("state"))
    return upserted(old, new)


# Markdown made of the orders: one document for each customer who has some
_ROW = "'| ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority || ' |' || chr(10)"
MARKDOWN = f"""SELECT k AS doc_id, 'Orders of ' || k || ':' || chr(10) || chr(10) AS pre, '| order | status | priority |' || chr(10) || '| --- | --- | --- |' || chr(10) AS head, rows, n,
    chr(10) || 'Query: ' AS mid, '```sql' || chr(10) || 'select * from orders where o_custkey = ' || k || chr(10) || '```' AS code, ' and ' AS gap, '![chart](img/' || k || '.png)' AS one, chr(10) AS sep, '[![](a/logo.png)](http://x.example/' || k || ')' AS two, chr(10) || 'End.' || chr(10) AS post
    FROM (SELECT o_custkey AS k, string_agg({_ROW}, '' ORDER BY o_orderkey) AS rows, count(*) AS n FROM orders GROUP BY o_custkey)"""
_AT = f"WITH m AS ({MARKDOWN}), d AS (SELECT *, length(pre) AS t0, length(pre) + length(head) + length(rows) AS t1, length(pre) + length(head) + length(rows) + length(mid) AS c0 FROM m), e AS (SELECT *, c0 + length(code) AS c1, c0 + length(code) + 5 AS i0, c0 + length(code) + 5 + length(one) AS i1 FROM d)"


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.format_string("| %d | %s | %s |\n", "o_orderkey", "o_orderstatus", "o_orderpriority")
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda r: r["line"]), "")
    k = F.col("o_custkey").cast("string")
    parts = [F.lit("Orders of "), k, F.lit(":\n\n| order | status | priority |\n| --- | --- | --- |\n"), F.col("rows"), F.lit("\nQuery: ```sql\nselect * from orders where o_custkey = "), k, F.lit("\n``` and ![chart](img/"), k, F.lit(".png)\n[![](a/logo.png)](http://x.example/"), k, F.lit(")\nEnd.\n")]
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(rows.alias("rows")).select(F.col("o_custkey").alias("doc_id"), F.concat(*parts).alias("content"))


def _parts(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return parse_markdown(_markdown(spark, sf_dir)).select("doc_id", F.explode(column).alias("p")).select("doc_id", "p.*")


@query(f"{_AT} SELECT doc_id, head || rows AS content, t0::INT AS start_index, t1::INT AS end_index FROM e")
def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, "tables")


@query(f"{_AT} SELECT doc_id, 'select * from orders where o_custkey = ' || doc_id AS content, 'sql' AS language, c0::INT AS start_index, c1::INT AS end_index FROM e")
def markdown_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, "code")


@query(
    f"""{_AT} SELECT doc_id, 'chart' AS alias, 'img/' || doc_id || '.png' AS content, i0::INT AS start_index, i1::INT AS end_index, NULL AS link FROM e
    UNION ALL SELECT doc_id, 'logo.png', 'a/logo.png', (i1 + 1)::INT, (i1 + 1 + length(two))::INT, 'http://x.example/' || doc_id FROM e"""
)
def markdown_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, "images")


@query(
    f"""{_AT} SELECT doc_id, 0 AS pos, pre AS text, 0 AS start_index, t0::INT AS end_index, length(pre)::INT AS token_count FROM e UNION ALL SELECT doc_id, 1, mid, t1::INT, c0::INT, length(mid)::INT FROM e
    UNION ALL SELECT doc_id, 2, gap, c1::INT, i0::INT, 5 FROM e UNION ALL SELECT doc_id, 3, post, (i1 + 1 + length(two))::INT, (i1 + 1 + length(two) + length(post))::INT, length(post)::INT FROM e"""
)
def markdown_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gap_chunks(parse_markdown(_markdown(spark, sf_dir)))


@query(
    f"""WITH o AS (SELECT o_custkey AS doc_id, o_orderkey, {_ROW} AS line, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
    g AS (SELECT doc_id, n, r // 3 AS pos, string_agg(line, '' ORDER BY r) AS body, count(*) AS k FROM o GROUP BY ALL),
    m AS ({MARKDOWN}), s AS (SELECT g.doc_id, g.n, g.pos, g.body, g.k, m.head, length(m.pre) AS t0, coalesce(sum(length(g.body)) OVER (PARTITION BY g.doc_id ORDER BY g.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g JOIN m ON g.doc_id = m.doc_id),
    x AS (SELECT *, max(pos) OVER (PARTITION BY doc_id) AS last FROM s)
    SELECT doc_id, pos::INT AS pos, CASE WHEN n > 3 AND pos = last THEN head || left(body, length(body) - 1) ELSE head || body END AS text, (CASE WHEN n <= 3 THEN t0 ELSE t0 + length(head) + before END)::INT AS start_index,
    (CASE WHEN n <= 3 THEN t0 + length(head) + length(body) ELSE t0 + length(head) + before + length(body) - CASE WHEN pos = last THEN 1 ELSE 0 END END)::INT AS end_index, k::INT AS token_count FROM x"""
)
def chunk_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of a table that is cut loses its line feed, as the table is taken without white space around it."""
    return c.chunk_inner(parse_tables(_markdown(spark, sf_dir)), "tables", "table", chunk_size=3)


@query(
    f"""WITH RECURSIVE m AS ({MARKDOWN}), o AS (SELECT o_custkey AS doc_id, {_ROW} AS line, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders),
    l AS (SELECT o.doc_id, r, CASE WHEN r = c THEN left(line, length(line) - 1) ELSE line END AS line, length(m.head) AS h FROM o JOIN m ON m.doc_id = o.doc_id WHERE length(m.head) + length(m.rows) - 1 > 200),
    g AS (SELECT doc_id, r, h + length(line) AS n, 0 AS pos FROM l WHERE r = 1 UNION ALL
        SELECT l.doc_id, l.r, CASE WHEN g.n + length(line) >= 200 THEN h ELSE g.n END + length(line), CASE WHEN g.n + length(line) >= 200 THEN g.pos + 1 ELSE g.pos END FROM g JOIN l ON l.doc_id = g.doc_id AND l.r = g.r + 1),
    p AS (SELECT g.doc_id, pos, string_agg(line, '' ORDER BY g.r) AS body FROM g JOIN l ON l.doc_id = g.doc_id AND l.r = g.r GROUP BY ALL),
    q AS (SELECT p.doc_id, pos, head || body AS text, length(pre) AS t0, length(head) AS h, sum(length(body)) OVER (PARTITION BY p.doc_id ORDER BY pos) AS z, length(body) AS w FROM p JOIN m ON m.doc_id = p.doc_id)
    SELECT doc_id, pos, text, (t0 + CASE WHEN pos = 0 THEN 0 ELSE h + z - w END)::INT AS start_index, (t0 + h + z)::INT AS end_index, (h + w)::INT AS token_count FROM q
    UNION ALL SELECT doc_id, 0, head || rows, length(pre)::INT, (length(pre) + length(head) + length(rows))::INT, (length(head) + length(rows) - 1)::INT FROM m WHERE length(head) + length(rows) - 1 <= 200"""
)
def chunk_table_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.chunk_inner(parse_tables(_markdown(spark, sf_dir)), "tables", "table", chunk_size=200, tokenizer_="character")


@query(
    f"""{_AT}, s AS (SELECT doc_id, 'select * from orders where o_custkey = ' AS x, doc_id::VARCHAR AS y, c0 + 7 AS a FROM e)
    SELECT doc_id, 0 AS pos, CASE WHEN length(y) = 1 THEN x || y ELSE x END AS text, a::INT AS start_index, (a + CASE WHEN length(y) = 1 THEN 40 ELSE 39 END)::INT AS end_index, (CASE WHEN length(y) = 1 THEN 40 ELSE 39 END)::INT AS token_count FROM s
    UNION ALL SELECT doc_id, 1, y, (a + 39)::INT, (a + 39 + length(y))::INT, length(y)::INT FROM s WHERE length(y) > 1"""
)
def chunk_markdown_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.chunk_inner(parse_markdown(_markdown(spark, sf_dir)), "code", "code", chunk_size=40)


def _record(json: Column) -> Column:
    return F.explode(F.from_json(json, "array<struct<`order`:bigint,status:string,priority:string>>"))


@query("SELECT o_custkey AS doc_id, o_orderkey AS order_key, o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def table_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = markdown_tables(spark, sf_dir).select("doc_id", _record(pipe_json(F.col("content"))).alias("r"))
    return tables.select("doc_id", F.col("r.order").alias("order_key"), "r.status", "r.priority")


def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.format_string("<tr><td>%d</td><td>%s</td><td>%s</td></tr>", "o_orderkey", "o_orderstatus", "o_orderpriority")
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda r: r["line"]), "")
    text = F.concat(F.lit("<p>x</p><TABLE class='o'><thead><tr><th>order</th><th>status</th><th>priority</th></tr></thead><tbody>"), F.col("rows"), F.lit("</tbody></TABLE><table>"))
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(rows.alias("rows")).select(F.col("o_custkey").alias("doc_id"), text.alias("content"))


@query(
    """SELECT o_custkey AS doc_id, 8 AS start_index, (8 + length(t))::INT AS end_index, t AS content FROM (SELECT o_custkey,
    '<TABLE class=''o''><thead><tr><th>order</th><th>status</th><th>priority</th></tr></thead><tbody>' || string_agg('<tr><td>' || o_orderkey || '</td><td>' || o_orderstatus || '</td><td>' || o_orderpriority || '</td></tr>', '' ORDER BY o_orderkey) || '</tbody></TABLE>' AS t FROM orders GROUP BY o_custkey)"""
)
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_tables(_html(spark, sf_dir)).select("doc_id", F.explode("tables").alias("t")).select("doc_id", "t.*")


@query("SELECT o_custkey AS doc_id, o_orderkey AS order_key, o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def html_table_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = html_tables(spark, sf_dir).select("doc_id", _record(html_json(F.col("content"))).alias("r"))
    return tables.select("doc_id", F.col("r.order").alias("order_key"), "r.status", "r.priority")


@query(_windows("documents", 512, 64))
def stream_token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows from a stream of the table's files, all that are there, written once."""
    schema = load(spark, sf_dir, "documents").schema
    out = f"{shared_folder(spark)}/textloom/stream-{uuid.uuid4().hex}"
    # a pattern, as a stream takes a plain path for a folder
    chunks = c.chunk_tokens(document_stream(spark, f"{sf_dir}/documents.parque[t]", schema), chunk_size=512, chunk_overlap=64)
    write_stream(chunks, f"{out}/rows", f"{out}/checkpoint", available_now=True).awaitTermination()
    return spark.read.schema(chunks.schema).parquet(f"{out}/rows")


@query("SELECT event_id, replace(replace(replace(props, '\\n', chr(10)), '\\t', chr(9)), '\\r', chr(13)) AS props FROM events")
def unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", unescaped(F.col("props")).alias("props"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
