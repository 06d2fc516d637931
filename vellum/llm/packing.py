"""Order-preserving packing: dynamic programming chooses where a stream of documents is cut into sequences."""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common, tokens

#: Costs in padded tokens: of a cut between sentences of a document, of one within a sentence, of each sequence.
SENTENCE_CUT, INNER_CUT, PER_SEQUENCE = 2, 24, 64
#: Within longer sentences a cut may fall at each of so many tokens; at the end of a stream, anywhere.
INNER_STEP = 256
#: Tokens that are gathered before cuts are chosen; the last two sequences wait for the tokens that follow.
CHUNK = 1 << 19


def choose_cuts(pos: np.ndarray, penalty: np.ndarray, limit: int) -> list[int]:
    """Indices of the cuts with the least cost. ``pos``: places of possible cuts, from 0 to the end, no two further
    apart than ``limit``; ``penalty``: the cost of a cut there.

    A sequence of i..j costs limit - (pos[j] - pos[i]) padding, so the best i minimises cost[i] + pos[i] over a
    sliding window: a monotone queue gives it. A sequence of a power of two isn't padded; its one possible start is looked up.
    """
    m = len(pos)
    where = np.full(int(pos[-1]) + 1, -1, np.int64)
    where[pos] = np.arange(m)
    exact: dict[int, list[int]] = {}
    p = 1
    while p <= limit:
        j = np.flatnonzero(pos >= p)
        i = where[pos[j] - p]
        for a, b in zip(i[i >= 0].tolist(), j[i >= 0].tolist(), strict=True):
            exact.setdefault(b, []).append(a)
        p *= 2
    at, pen = pos.tolist(), penalty.tolist()
    cost, back = [0.0] * m, [0] * m
    key = [0.0] * m
    queue: deque[int] = deque([0])
    for j in range(1, m):
        x = at[j]
        while at[queue[0]] < x - limit:
            queue.popleft()
        i = queue[0]
        c = key[i] + limit - x
        if j in exact:
            for i2 in exact[j]:
                if cost[i2] < c:
                    c, i = cost[i2], i2
        c += pen[j] + PER_SEQUENCE
        cost[j], back[j] = c, i
        k = key[j] = c + x
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    out, j = [], m - 1
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


class Packer:
    """Packs one stream of documents, given in order, and yields pieces."""

    def __init__(self, limit: int, ends_sentence: np.ndarray, first_sequence: int):
        self.limit, self.ends_sentence, self.sequence = limit, ends_sentence, first_sequence
        self.ids = np.empty(0, np.uint32)
        self.docs: list[tuple] = []  # of what waits: id, ids of the document before what waits, ids that wait, ids in all

    def add(self, keys: list, ids: np.ndarray, ends: np.ndarray) -> list[tuple]:
        """Documents with the ids of each in a row; ``ends``: where each document's end."""
        self.ids = np.concatenate([self.ids, ids])
        self.docs += [(k, 0, n, n) for k, n in zip(keys, np.diff(ends, prepend=0).tolist(), strict=True)]
        return self.cut(False) if len(self.ids) >= CHUNK else []

    def cut(self, last: bool) -> list[tuple]:
        total = len(self.ids)
        if not total:
            return []
        ends = np.cumsum([n for _, _, n, _ in self.docs])
        kind = np.zeros(total + 1, np.uint8)  # 1: anywhere, 2: after a sentence, 3: after a document
        if last:
            kind[max(1, total - self.limit) :] = 1
        kind[1:][self.ends_sentence[self.ids]] = 2
        kind[0] = 2
        kind[ends] = 3
        pos = np.flatnonzero(kind > 1)
        step = min(INNER_STEP, self.limit)
        for g in np.flatnonzero(np.diff(pos) > step).tolist():
            inner = np.arange(pos[g] + step, pos[g + 1], step)
            kind[inner] = np.maximum(kind[inner], 1)
        both = np.flatnonzero(kind)
        penalty = np.array([0, INNER_CUT, SENTENCE_CUT, 0], float)[kind[both]]
        cuts = both[choose_cuts(both, penalty, self.limit)]
        if not last:
            cuts = cuts[:-2]
        if not len(cuts):
            return []
        done, out = int(cuts[-1]), []
        marks = np.union1d(cuts, ends[ends < done]).tolist()
        buffer, d, s, a, begin = self.ids.tobytes(), 0, 0, 0, 0
        edges, stops = ends.tolist(), cuts.tolist()
        for b in marks:
            doc, before, n, size = self.docs[d]
            out.append((doc, before + a - (edges[d] - n), b - a, zlib.crc32(buffer[4 * a : 4 * b]), size, self.sequence, a - begin))
            if b == edges[d]:
                d += 1
            if b == stops[s]:
                s, begin, self.sequence = s + 1, b, self.sequence + 1
            a = b
        rest = self.docs[d:]
        if rest and edges[d] - rest[0][2] < done:
            doc, before, n, size = rest[0]
            used = done - (edges[d] - n)
            rest[0] = (doc, before + used, n - used, size)
        self.docs, self.ids = rest, self.ids[done:]
        return out


def pack(docs: DataFrame, path: str, limit: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each task packs its rows as one stream, in their order, and numbers its sequences from task * 2^33 on. Null and
    empty texts are one piece, the end id alone. Repeated rows are packed again. An empty table has no pieces.
    """
    kind = docs.schema[id_col].dataType
    arrow = to_arrow_type(kind)

    def run(batches):
        from pyspark import TaskContext

        enc = tokens.encoder(path)
        ends = tokens.sentence_ends(path)
        packer = Packer(limit, ends, TaskContext.get().partitionId() << 33)

        def table(pieces):
            cols = list(zip(*pieces, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], arrow), *(pa.array(c, pa.int64()) for c in cols[1:])], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in common.slices(batches, name="tokens", drop=tokens.forget):
            for first, after, ids, ends in enc.rows(b.column(1)):
                keys = b.column(0).slice(first, after - first).to_pylist()
                if pieces := packer.add(keys, *tokens.with_end(ids, ends, end_id)):
                    yield table(pieces)
        if pieces := packer.cut(True):
            yield table(pieces)

    schema = f"id {kind.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), tokens.default_tokenizer()).withColumnRenamed("id", "doc_id")
