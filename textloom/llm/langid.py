"""Language identification by multinomial logistic regression on character n-grams.

Features are the 1- to 3-grams of a text's characters, hashed into 2**bits
slots, weighted by TF-IDF: a slot's share of the text's n-grams times its
smoothed inverse document frequency over all documents.  As the score is
linear in the share, a text is scored by looking up one row of weights for each
n-gram and averaging: no vector is built, whatever the length of the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import blobs, quoted, unused
from textloom.llm.words import slices

ORDERS = (1, 2, 3)
M1, M2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
PART = 1 << 12
COMMON = 100


class Model(NamedTuple):
    classes: list[str]
    weights: np.ndarray  # slots x classes, inverse document frequency included
    bias: np.ndarray
    temperature: float
    bits: int
    rows: int  # rows fitted on
    held_out: float  # accuracy on the calibration rows, -1 without any
    common: np.ndarray  # slots that at least one in COMMON fitted rows has, and at least two
    min_prob: float  # below this the calibration rows give no ground for a label
    min_common: float  # least share of common n-grams of a text in a known language


def grams(texts: pa.Array, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, next text, slots of all n-grams, ends by text and order) of slices of the texts.

    Letter case is folded and every run of white space or digits counts as one
    space or one 0.  A text is taken with a space at either end.
    """
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    sizes = pc.binary_length(low).to_numpy(zero_copy_only=False)
    for a, z in slices(len(low), sizes, 1 << 16):
        part = low.slice(a, z - a).to_pylist()
        codes = np.frombuffer((" " + " \x00 ".join(part) + " ").encode("utf-32-le", "replace"), np.uint32)
        codes = np.where((codes >= 48) & (codes <= 57), np.uint32(48), codes)
        codes = np.where((codes >= 9) & (codes <= 13), np.uint32(32), codes)
        same = np.zeros(len(codes), bool)
        same[1:] = (codes[1:] == codes[:-1]) & ((codes[1:] == 32) | (codes[1:] == 48))
        codes = codes[~same]
        stop = np.flatnonzero(codes == 0)
        if len(stop) != z - a - 1:  # texts with NUL characters in them
            part = [t.replace("\x00", " ") for t in part]
            yield from ((a + i, a + j, s, e) for i, j, s, e in grams(pa.array(part), bits))
            continue
        of = np.cumsum(codes == 0)
        out, number = [], []
        h = np.zeros(len(codes), np.uint32)
        for n in ORDERS:
            if n > len(codes):
                break
            # hash of codes[i:i+n], for every i
            h = (h[: len(codes) - n + 1] ^ codes[n - 1 :]) * M1
            inside = (of[n - 1 :] == of[: len(codes) - n + 1]) & (codes[: len(codes) - n + 1] != 0)
            g = h[inside]
            out.append(((g ^ (g >> np.uint32(15))) * M2) >> np.uint32(32 - bits))
            number.append(of[: len(codes) - n + 1][inside])
        slot, text = np.concatenate(out), np.concatenate(number)
        order = np.argsort(text, kind="stable") if z - a > 1 else slice(None)
        yield a, z, slot[order], np.searchsorted(text[order], np.arange(z - a + 1))


def document_frequencies(df: DataFrame, text_col: str, bits: int) -> tuple[np.ndarray, int]:
    """Number of texts with each slot, over every row that has text, and number of such rows."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for a, z, slot, ends in grams(batch.column(0), bits):
                text = np.repeat(np.arange(z - a, dtype=np.uint64), np.diff(ends))
                pair = np.sort((text << np.uint64(bits)) | slot)
                first = np.append(True, pair[1:] != pair[:-1]) if len(pair) else np.zeros(0, bool)
                total += np.bincount((pair[first] & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
        parts = np.arange(len(total) // PART)
        yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), blobs(list(total.reshape(-1, PART))), pa.array(np.where(parts == 0, rows, 0))], ["part", "counts", "n"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(PART, np.int64), 0
        for batch in batches:
            for x in batch.column("counts").to_pylist():
                total += np.frombuffer(x, np.int64)
            n += pc.sum(batch.column("n")).as_py()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), blobs([total]), pa.array([n], pa.int64())], ["part", "counts", "n"])

    schema = "part int, counts binary, n bigint"
    rows = df.select(quoted(text_col).cast("string").alias("text")).where("text is not null").mapInArrow(count, schema)
    total, n = np.zeros(1 << bits, np.int64), 0
    for part, counts, k in rows.groupBy("part").applyInArrow(add, schema).collect():
        total[part * PART : (part + 1) * PART] = np.frombuffer(bytes(counts), np.int64)
        n += k
    return total, n


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], slots: int, classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights (slots x classes) and bias of the softmax, fitted one row at a time by follow-the-regularised-leader.

    z and n are kept per weight; a weight is 0 while |z| <= l1 and otherwise
    -(z - sign(z) l1) / ((beta + sqrt n) / alpha + l2), so l1 and l2 are the
    elastic net. The bias isn't penalised.
    """
    z, n = np.zeros((slots + 1, classes)), np.zeros((slots + 1, classes))

    def weights(zs: np.ndarray, ns: np.ndarray, penalty: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= penalty, 0.0, -(zs - np.sign(zs) * penalty) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(epochs):
        for slot, value, label in rows:
            at, x = np.append(slot, slots), np.append(value, 1.0)
            penalty = np.where(at == slots, 0.0, l1)[:, None]
            zs, ns = z[at], n[at]
            w = weights(zs, ns, penalty)
            score = x @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[label] -= 1
            g = x[:, None] * p
            step = (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha
            z[at] = zs + g - step * w
            n[at] = ns + g * g
    penalty = np.full((slots + 1, 1), l1)
    penalty[slots] = 0
    w = weights(z, n, penalty)
    return w[:-1], w[-1]


def temperature(scores: np.ndarray, label: np.ndarray) -> float:
    """The temperature of least cross-entropy, by golden section over its logarithm."""
    if not len(label):
        return 1.0

    def loss(t: float) -> float:
        s = scores / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(label)), label]).mean())

    a, b, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    c, d = b - r * (b - a), a + r * (b - a)
    for _ in range(40):
        if loss(c) <= loss(d):
            b, d = d, c
            c = b - r * (b - a)
        else:
            a, c = c, d
            d = a + r * (b - a)
    return float(np.exp((a + b) / 2))


def fit(
    df: DataFrame,
    text_col: str = "text",
    label_col: str = "lang",
    max_train_rows: int = 4000,
    bits: int = 16,
    epochs: int = 3,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 1e-3,
    l2: float = 1e-4,
) -> Model:
    """Fit on at most max_train_rows labelled rows; document frequencies come from all rows of df.

    The sample takes about equally many rows of each label: those whose hash of
    text and label is below the label's threshold.  Every fifth row by that
    hash calibrates the temperature and is not fitted on.  Rows without text or
    label are not sampled; repeated rows count once for all.
    """
    frequency, n = document_frequencies(df, text_col, bits)
    rows = df.select(quoted(text_col).cast("string").alias("text"), quoted(label_col).cast("string").alias("label")).where("text is not null and label is not null")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    classes = sorted(counts)
    share = {c: max_train_rows / len(classes) / counts[c] for c in classes}
    draw = (F.pmod(F.xxhash64("label", "text"), F.lit(1 << 30)) / float(1 << 30)).alias("draw")
    picked = rows.withColumn("draw", draw)
    limit = F.create_map(*[F.lit(v) for c in classes for v in (c, share[c])]) if classes else F.lit(None)
    sample = picked.where(F.col("draw") < limit[F.col("label")]) if classes else picked.limit(0)

    def featurise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, slot, ends in grams(batch.column(0), bits):
                slots, values = [], []
                for k in range(z - a):
                    u, c = np.unique(slot[ends[k] : ends[k + 1]], return_counts=True)
                    slots.append(u.astype(np.int32))
                    values.append((c / max(1, c.sum())).astype(np.float32))
                part = batch.slice(a, z - a)
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(1), blobs(slots), blobs(values)], ["draw", "label", "slots", "shares"])

    # equal rows draw the same number: the sample is cut to the bound in an order that doesn't depend on the plan
    got = sample.dropDuplicates(["draw", "label"]).mapInArrow(featurise, "draw double, label string, slots binary, shares binary") if classes else None
    table = got.orderBy("draw", "label").limit(max_train_rows).collect() if classes else []
    idf = np.log((1 + n) / (1 + frequency)) + 1
    place = {c: i for i, c in enumerate(classes)}
    seen = []
    for r in table:
        slots = np.frombuffer(bytes(r["slots"]), np.int32)
        seen.append((slots, np.frombuffer(bytes(r["shares"]), np.float32) * idf[slots] * SCALE, place[r["label"]]))
    held = seen[4::5]
    fitted = [r for i, r in enumerate(seen) if i % 5 != 4]
    order = np.random.default_rng(0).permutation(len(fitted))
    w, bias = ftrl([fitted[i] for i in order], 1 << bits, max(1, len(classes)), epochs, alpha, beta, l1, l2)
    scores = np.array([v @ w[s] + bias for s, v, _ in held]).reshape(len(held), max(1, len(classes)))
    label = np.array([c for _, _, c in held], np.int64)
    right = scores.argmax(axis=1) == label
    accuracy = float(right.mean()) if len(held) else -1.0
    heat = temperature(scores, label)
    common = np.bincount(np.concatenate([s for s, _, _ in fitted] or [np.zeros(0, np.int32)]), minlength=1 << bits) >= max(2, len(fitted) / COMMON)
    p = np.exp((scores - scores.max(axis=1, keepdims=True)) / heat)
    share = np.array([(v / (idf[s] * SCALE))[common[s]].sum() for s, v, _ in held])
    floors = level(1 / p.sum(axis=1), right, 1 / max(1, len(classes)), 0.75), level(share, right, 0.0, 0.95)
    return Model(classes, (w * idf[:, None] * SCALE).astype(np.float32), bias.astype(np.float32), heat, bits, len(fitted), accuracy, common, *floors)


def level(value: np.ndarray, right: np.ndarray, chance: float, margin: float) -> float:
    """The value, more being better, up to which calibration rows are wrong more often than right, or margin of the way from chance to their low end if that is more.

    The low end is the value that one row in 200 is under, and the most that is
    returned. Without rows it is chance.
    """
    if not len(value):
        return chance
    order = np.argsort(value, kind="stable")
    value, right = value[order], right[order]
    low = float(value[len(value) // 200])
    falls = np.flatnonzero(np.cumsum(right) * 2 < np.arange(1, len(right) + 1))
    fallen = min(float(np.nextafter(value[falls[-1]], 2)), low) if len(falls) else 0.0
    return max(fallen, chance + margin * max(0.0, low - chance))


SCALE = 10.0  # brings the shares, which sum to 1, to the scale that the step sizes suit


def predict(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class number, calibrated probability, share of common n-grams) of each text."""
    n = len(texts)
    scores, share = np.tile(model.bias.astype(np.float64), (n, 1)), np.zeros(n)
    for a, z, slot, ends in grams(texts, model.bits):
        rows = np.take(model.weights, slot, axis=0)
        k = np.diff(ends)
        some = np.flatnonzero(k)
        if len(some):
            scores[a + some] += np.add.reduceat(rows, ends[:-1][some], axis=0) / k[some][:, None]
            share[a + some] = np.add.reduceat(model.common[slot].astype(np.int64), ends[:-1][some]) / k[some]
    p = scores / model.temperature
    p = np.exp(p - p.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return p.argmax(axis=1), p.max(axis=1), share


def identified(df: DataFrame, model: Model, text_col: str = "text", lang_col: str = "pred_lang", prob_col: str = "pred_prob") -> DataFrame:
    """df with the language of each text and its calibrated probability.

    Both are null for a text that is null or blank, has no letters, or has too
    few n-grams that are common in the rows fitted on: its language is unknown.
    """

    @F.arrow_udf("struct<lang string, prob double>")
    def guess(texts: pa.Array) -> pa.Array:
        which, p, share = predict(texts, model)
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False)
        unknown = pc.invert(pc.and_(letters, pa.array(share >= model.min_common)))
        lang = pc.if_else(unknown, None, pa.array([model.classes[i] for i in which], pa.string()))
        prob = pc.if_else(unknown, None, pa.array(p))
        return pa.StructArray.from_arrays([lang, prob], ["lang", "prob"])

    (both,) = unused(df, "language_guess")
    text = quoted(text_col).cast("string")
    if not model.classes:
        return df.withColumns({lang_col: F.lit(None).cast("string"), prob_col: F.lit(None).cast("double")})
    out = df.withColumn(both, guess(text))
    return out.withColumns({lang_col: quoted(both)["lang"], prob_col: quoted(both)["prob"]}).drop(both)


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", min_prob: float | None = None, **options) -> DataFrame:
    """(doc_id, pred_lang, pred_prob, accepted) of every row.

    The model is fitted by fit(); a row is accepted if its language is known
    and its probability is at least min_prob, by default the model's, which
    comes from the calibration rows.

    A null, empty or blank text, one without letters and one whose n-grams are
    hardly known have no language and aren't accepted.  Null ids
    and repeated rows are kept.  Without any labelled row no text has a
    language.  Ties go to the first label in alphabetical order.  Empty table:
    no rows.  Other columns are ignored.
    """
    model = fit(df, text_col, label_col, **options)
    rows = df.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    out = identified(rows, model)
    return out.select("doc_id", "pred_lang", "pred_prob", F.coalesce(F.col("pred_prob") >= (model.min_prob if min_prob is None else min_prob), F.lit(False)).alias("accepted"))


def filtered(df: DataFrame, text_col: str = "text", label_col: str = "lang", min_prob: float | None = None, **options) -> DataFrame:
    """The rows of df that language_id() accepts, in its columns.

    Null, empty and blank texts go, as do those in no known language; very long
    texts are judged by all their n-grams.  Null ids and repeated rows are kept
    by their texts alone.  Empty table: no rows.  Columns of any name are kept.
    """
    lang, prob = unused(df, "pred_lang", "pred_prob")
    model = fit(df, text_col, label_col, **options)
    return identified(df, model, text_col, lang, prob).where(quoted(prob) >= (model.min_prob if min_prob is None else min_prob)).select(*[quoted(c) for c in df.columns])
