"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A feature is the presence of an n-gram (lower case, hashed) in a text. Its ratio is the log of how much likelier it
is in a toxic text than in another, from smoothed counts over a bounded sample of labelled rows. A logistic regression
over features times ratios is fitted on the same sample, with those features whose counts chance doesn't explain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

GRAMS, HASH_BITS = (3, 4, 5), 19
#: The features of the regression: all whose toxic count is so many standard deviations off its expectation.
SURE = 4.0
#: Labelled rows that the classifier is fitted on, at most, chosen by a hash of the id.
SAMPLE = 8000
SMOOTH, PENALTY, STEPS, BATCH, RATE = 1.0, 3e-3, 300, 512, 0.05
THRESHOLD = 0.3
#: Places that ids are hashed to.
PLACES = 1 << 40

_K = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def grams(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n the hashed n-grams of joined texts and the text that each is of."""
    lower = [" " + t.lower() + " " for t in texts]
    data = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum([len(t) for t in lower])
    owner = np.repeat(np.arange(len(lower), dtype=np.int32), [len(t) for t in lower])
    out = []
    for n in GRAMS:
        size = len(data) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n, np.uint64)
        for j in range(n):
            h += (data[j : j + size] + np.uint64(j)) * _K[j]
        h = (h ^ (h >> np.uint64(29))) * _K[0]
        within = np.ones(size, bool)
        for j in range(1, n):
            at = ends[:-1] - j
            within[at[(at >= 0) & (at < size)]] = False
        out.append(((h >> np.uint64(64 - HASH_BITS)).astype(np.int64)[within], owner[:size][within]))
    return out


def presence(texts: list[str], chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs, ordered by text; of chosen features only, if given as a mask."""
    parts = []
    for f, o in grams(texts):
        if chosen is not None:
            mine = chosen[f]
            f, o = f[mine], o[mine]
        parts.append(o.astype(np.int64) << HASH_BITS | f)
    both = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)
    return both >> HASH_BITS, both & ((1 << HASH_BITS) - 1)


def _groups(texts: list[str], most: int = 1 << 18):
    """Index ranges of texts of about so many characters together."""
    a = size = 0
    for b, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield a, b + 1
            a, size = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.chosen = weights, bias, weights != 0

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for a, b in _groups(texts):
            o, f = presence(texts[a:b], self.chosen)
            out[a:b] += np.bincount(o, self.weights[f], b - a)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def _regression(each: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, seed: int = 1) -> tuple[np.ndarray, float]:
    """Adam on batches of rows, a falling rate; ``each``: a row's features, whose values are their ratios."""
    w, b = np.zeros(len(ratio)), 0.0
    m, v, mb, vb = np.zeros(len(ratio)), np.zeros(len(ratio)), 0.0, 0.0
    rng, size, at = np.random.default_rng(seed), min(BATCH, len(y)), len(y)
    for t in range(1, STEPS + 1):
        if at + size > len(y):
            order, at = rng.permutation(len(y)), 0
        rows = order[at : at + size]
        at += size
        cols = np.concatenate([each[i] for i in rows])
        own = np.repeat(np.arange(size), [len(each[i]) for i in rows])
        z = np.bincount(own, (w * ratio)[cols], size) + b
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[rows]) / size
        g, gb = ratio * np.bincount(cols, e[own], len(ratio)) + PENALTY * w, e.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = RATE * (1 - t / (STEPS + 1))
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-9)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from labelled rows outside the held-out ids. Without labels every score is 0.5.

    SAMPLE labels are used at most, chosen by a hash of the id among all of them, so that they can be broadcast and
    no text is moved. Rows with a null label or text are left out; of repeated labels of one id the largest holds.
    """
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y IS NOT NULL AND doc_id IS NOT NULL").where(~common.held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(PLACES))
    # the expected number lies five standard deviations under the bound
    marks = marks.where(place < int(min(1.0, (SAMPLE - 5 * SAMPLE**0.5) / max(1, marks.count())) * PLACES))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL").where(~common.held_out()).join(F.broadcast(marks), "doc_id")
    rows = common.written(rows)
    size = 1 << HASH_BITS

    def count(batches):
        v = np.zeros(2 * size + 2, np.int64)
        for b in common.slices(batches):
            texts, y = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False) > 0
            for s, e in _groups(texts):
                o, f = presence(texts[s:e])
                v[: 2 * size] += np.bincount(f + y[s:e][o] * size, minlength=2 * size)
            v[-2:] += [(~y).sum(), y.sum()]
        return v

    total = common.vector_sum(rows.select("text", "y"), count, 2 * size + 2).astype(np.float64)
    n0, n1 = total[-2:]
    if not n0 + n1:
        return Model(np.zeros(size), 0.0)
    c0, c1 = total[:size], total[size : 2 * size]
    ratio = np.log((c1 + SMOOTH) / (n1 + 2 * SMOOTH)) - np.log((c0 + SMOOTH) / (n0 + 2 * SMOOTH))
    # how far the toxic count is from its expectation, in standard deviations
    share = (c0 + c1) / (n0 + n1)
    sure = np.abs(c1 - n1 * share) / np.sqrt(n1 * share * (1 - share) + 1)
    chosen = sure > SURE
    top = np.flatnonzero(chosen)
    kind = "<u2" if len(top) < 1 << 16 else "<u4"
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    def features(batches):
        place = np.cumsum(shared.value) - 1
        for b in common.slices(batches):
            texts, found = b.column(1).to_pylist(), []
            for s, e in _groups(texts):
                o, f = presence(texts[s:e], shared.value)
                cut, f = np.searchsorted(o, np.arange(e - s + 1)), place[f].astype(kind)
                found += [f[x:z].tobytes() for x, z in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary()), b.column(2)], ["doc_id", "f", "y"])

    got = rows.select(F.col("doc_id").cast("string"), "text", "y").mapInArrow(features, "doc_id string, f binary, y int").toArrow().sort_by("doc_id")
    each = [np.frombuffer(x, kind) for x in got.column("f").to_pylist()]
    w, bias = _regression(each, ratio[top], (got.column("y").to_numpy() > 0).astype(np.float64))
    weights = np.zeros(size)
    weights[top] = w * ratio[top]
    return Model(weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, score, predicted) per input row, from the whole text alone; null texts are empty texts.

    Repeated rows stay repeated; other columns aren't read."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in common.slices(batches):
            s = shared.value.scores([x or "" for x in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], ["id", "score", "predicted"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int")


def keep(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that aren't predicted toxic, with the columns of the input. Rows aren't moved."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in common.slices(batches):
            yield b.filter(pa.array(shared.value.scores([x or "" for x in b.column(at).to_pylist()]) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    found = score(docs, fit(docs, labels)).withColumnRenamed("id", "doc_id")
    return found.withColumn("held_out", common.held_out()).select("doc_id", "held_out", "score", "predicted")
