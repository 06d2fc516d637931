"""Language identification by a byte convolutional network, trained in numpy.

Filters of several widths run over the bytes of fixed-length windows; the maximum of each filter over a window, a
rectifier and a softmax layer give the window's log-odds, whose mean over all windows of a text decides. A filter
over one-hot bytes is a table look-up for each byte of its width.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

WIDTHS, FILTERS, WINDOW = (2, 3, 4), 16, 256
#: Bounds of the sample that the network is fitted on: documents of each language, windows of each document.
SAMPLE_DOCS, SAMPLE_WINDOWS = 1500, 3
STEPS, BATCH, RATE = 500, 96, 0.01
#: A document is rejected if it has no letter, or if its best language is less likely than this.
LEAST_SCORE = 0.4
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")


def windows(data: bytes) -> np.ndarray:
    """All bytes of a text in rows of WINDOW, the last filled with zeros."""
    rows = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(rows * WINDOW, b"\0"), np.uint8).reshape(rows, WINDOW)


class Net:
    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)
        self._pairs: list | None = None

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, self.bias, self.out, self.out_bias]

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        params = self.parameters()
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, STEPS + 1):
            k = rng.integers(0, len(x), BATCH)
            for p, g, m, v in zip(params, self._gradients(x[k], y[k]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n, peaks, tops = len(x), [], []
        for w, table in zip(WIDTHS, self.tables, strict=True):
            span = WINDOW - w + 1
            r = sum(table[j][x[:, j : j + span]] for j in range(w))
            at = r.argmax(1)
            peaks.append(at)
            tops.append(np.take_along_axis(r, at[:, None], 1)[:, 0])
        top = np.concatenate(tops, 1) + self.bias
        hidden = np.maximum(top, 0)
        z = hidden @ self.out + self.out_bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        back = (p @ self.out.T) * (top > 0)
        grads = []
        for i, (w, table) in enumerate(zip(WIDTHS, self.tables, strict=True)):
            g, own = np.zeros_like(table), back[:, i * FILTERS : (i + 1) * FILTERS]
            for j in range(w):
                np.add.at(g[j], (np.take_along_axis(x, peaks[i] + j, 1), np.arange(FILTERS)[None, :]), own)
            grads.append(g)
        return [*grads, back.sum(0), hidden.T @ p, p.sum(0)]

    def _lookups(self) -> list:
        """For each width the tables of byte pairs and single bytes whose sum is the filters' response."""
        if self._pairs is None:
            self._pairs = [[(j, (t[j][:, None] + t[j + 1][None]).reshape(65536, FILTERS) if j + 1 < w else t[j]) for j in range(0, w, 2)] for w, t in zip(WIDTHS, self.tables, strict=True)]
        return self._pairs

    def logits(self, x: np.ndarray) -> np.ndarray:
        """For each window, in small groups of windows."""
        out = np.empty((len(x), len(self.labels)), np.float32)
        for k in range(0, len(x), 64):
            b = x[k : k + 64].astype(np.int32)
            pair = b[:, :-1] * 256 + b[:, 1:]
            tops = []
            for w, parts in zip(WIDTHS, self._lookups(), strict=True):
                span, r = WINDOW - w + 1, None
                for j, t in parts:
                    got = t[(pair if len(t) > 256 else b)[:, j : j + span]]
                    r = got if r is None else np.add(r, got, out=r)
                tops.append(r.max(1))
            out[k : k + 64] = np.maximum(np.concatenate(tops, 1) + self.bias, 0) @ self.out + self.out_bias
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Net | None:
    """Learns from texts with a language outside the held-out ids; None if there are none.

    SAMPLE_DOCS documents of each language at most, chosen by a hash of the id, and SAMPLE_WINDOWS windows of each,
    cut on the executors: what reaches the driver has a fixed size for each language.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").where(~common.held_out())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, SAMPLE_DOCS / n))) for k, n in sorted(counts.items())))

    def cut(batches):
        for b in common.slices(batches):
            x, y = [], []
            for i, text, lang in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = windows(text.encode("utf-8", "replace"))
                for k in np.random.default_rng(abs(i or 0)).permutation(len(w))[:SAMPLE_WINDOWS].tolist():
                    x.append(w[k].tobytes())
                    y.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.string())], ["window", "lang"])

    picked = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < share * (1 << 20)).select(F.col("doc_id").cast("long"), "text", "lang")
    got = picked.mapInArrow(cut, "window binary, lang string").toArrow()
    order = np.argsort(np.array([hash_bytes(w) for w in got.column(0).to_pylist()], np.uint64), kind="stable")
    x = np.frombuffer(b"".join(got.column(0).to_pylist()), np.uint8).reshape(-1, WINDOW)[order]
    labels = sorted(counts)
    y = np.array([labels.index(v) for v in got.column(1).to_pylist()], np.int64)[order]
    net = Net(labels)
    # every language weighs the same
    per = [np.flatnonzero(y == k) for k in range(len(labels))]
    most = max(map(len, per))
    both = np.concatenate([np.resize(p, most) for p in per if len(p)])
    net.train(x[both], y[both])
    return net


def hash_bytes(w: bytes) -> int:
    import zlib

    return zlib.crc32(w)


def judge(model: Net | None, texts: list[str | None]) -> tuple[list[str], list[float], list[int]]:
    """lang_pred, score and windows of each text."""
    real = [bool(model and t and _LETTER.search(t)) for t in texts]
    rows = [windows(t.encode("utf-8", "replace")) if ok else np.zeros((0, WINDOW), np.uint8) for t, ok in zip(texts, real, strict=True)]
    lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if any(real):
        z = model.logits(np.concatenate(rows)).astype(np.float64)
        z -= np.log(np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)) + z.max(1, keepdims=True)
        at = 0
        for i, w in enumerate(rows):
            if len(w):
                p = np.exp(m := z[at : at + len(w)].mean(0))
                lang[i], score[i] = model.labels[int(m.argmax())], float(min(1.0, p.max() / p.sum()))
                at += len(w)
    return lang, score, [len(w) for w in rows]


def predict(docs: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, lang_pred, score, n_windows) per input row, from the whole text alone.

    Null texts and texts without a letter are ``und`` with score 0, as is every text if there is no network.
    Repeated rows stay repeated; other columns aren't read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for some in common.slices(batches, 64):
            lang, score, n = judge(shared.value, some.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(n, pa.int64())], ["id", "lang_pred", "score", "n_windows"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, n_windows bigint")


def keep(docs: DataFrame, net: Net | None, text_col: str = "text") -> DataFrame:
    """The rows whose language can be told, with the columns of the input. Rows aren't moved."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text_col)

    def run(batches):
        for some in common.slices(batches, 64):
            lang, score, _ = judge(shared.value, some.column(at).to_pylist())
            yield some.filter(pa.array([x != UNDETERMINED and s >= LEAST_SCORE for x, s in zip(lang, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs)).withColumnRenamed("id", "doc_id")
    return found.withColumn("held_out", common.held_out()).select("doc_id", "held_out", "lang_pred", "score", "n_windows")
