"""Binary token files: Simple-8b words in blocks, with offsets that let a block be decoded as whole arrays.

A block holds whole documents: a header (magic, documents, ids, frames, words), the documents' ids and ends, the
first word of each frame, then 64-bit words. A frame has FRAME ids; it is coded by itself. The top 4 bits of a word
select how many values of how many bits the other 60 hold. Fixed values of the format:

selector      0    1    2   3   4   5   6   7   8   9  10  11  12  13  14  15
values      240  (esc)  60  30  20  15  12  10   8   7   6   5   4   3   2   1
bits          0    -    1   2   3   4   5   6   7   8  10  12  15  20  30  60

Selector 1 is the escape: the low bits say how many raw 64-bit values follow.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from . import common, tokens

VALUES = (240, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE, MAGIC, FRAME, BLOCK = 1, b"VS8B", 1 << 14, 1 << 16


def _widths(v: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    out = np.zeros(len(v), np.uint8)
    rest = v.copy()
    for s in (32, 16, 8, 4, 2, 1):
        big = rest >> np.uint64(s) > 0
        out[big] += s
        rest[big] >>= np.uint64(s)
    return out + (v > 0)


def encode_frame(v: np.ndarray) -> np.ndarray:
    """uint64 values to words."""
    n = len(v)
    width = _widths(v) if n and v.max() >= 65536 else _WIDTH16[v]
    best, sel = np.zeros(n, np.int64), np.zeros(n, np.uint8)
    # widest[k]: of the k values from a place on; beyond the end a value takes no bits
    have = {1: width}

    def span(k: int) -> np.ndarray:
        if k not in have:
            a = max(x for x in have if x < k)
            other = span(k - a) if k - a not in have else have[k - a]
            moved = np.zeros(n, np.uint8)
            moved[: max(0, n - a)] = other[a:]
            have[k] = np.maximum(have[a], moved)
        return have[k]

    for s in range(15, -1, -1):
        if s != ESCAPE:
            ok = span(VALUES[s]) <= BITS[s]
            if s < 15 and not ok.any():
                break  # more values of fewer bits can't fit then
            best[ok], sel[ok] = VALUES[s], s
    step, starts, i = best.tolist(), [], 0
    while i < n:
        starts.append(i)
        i += step[i] or 1
    at = np.array(starts, np.int64)
    kind = sel[at]
    raw = best[at] == 0  # over 60 bits
    size = np.ones(len(at), np.int64) + raw
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    padded = np.concatenate([v, np.zeros(240, np.uint64)])
    for s in np.unique(kind[~raw]).tolist():
        mine = (kind == s) & ~raw
        word = np.full(int(mine.sum()), s << 60, np.uint64)
        if s:
            for k in range(VALUES[s]):
                word |= padded[at[mine] + k] << np.uint64(k * BITS[s])
        words[place[mine]] = word
    if raw.any():
        words[place[raw]] = (ESCAPE << 60) | 1
        words[place[raw] + 1] = v[at[raw]]
    return words


_WIDTH16 = _widths(np.arange(65536, dtype=np.uint64))
_COUNT = np.array(VALUES, np.int64)


def decode_frame(words: np.ndarray, n: int) -> np.ndarray:
    """The n values of a frame."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = _COUNT[sel]
    raw = np.zeros(len(words), bool)
    if (sel == ESCAPE).any():
        k = 0
        for e in np.flatnonzero(sel == ESCAPE).tolist():
            if e >= k:  # else it is a raw value that looks like an escape
                k = e + 1 + int(words[e] & np.uint64((1 << 60) - 1))
                raw[e + 1 : k] = True
                count[e], count[e + 1 : k] = 0, 1
    start = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in np.unique(sel[~raw]).tolist():
        if s > ESCAPE:
            mine = (sel == s) & ~raw
            w, at, mask = words[mine], start[mine], np.uint64((1 << BITS[s]) - 1)
            for k in range(VALUES[s]):
                out[at + k] = (w >> np.uint64(k * BITS[s])) & mask
    out[start[raw]] = words[raw]
    return out[:n]


def encode_block(doc_ids: list, ids: list[np.ndarray]) -> bytes:
    """doc_ids: integers or None."""
    flat = np.concatenate(ids).astype(np.uint64) if ids else np.empty(0, np.uint64)
    ends = np.cumsum([len(x) for x in ids]).astype("<u8")
    frames = [encode_frame(flat[k : k + FRAME]) for k in range(0, len(flat), FRAME)]
    first = np.cumsum([0, *map(len, frames)]).astype("<u8")
    words = np.concatenate(frames).astype("<u8") if frames else np.empty(0, "<u8")
    null = np.array([x is None for x in doc_ids], np.uint8)
    keys = np.array([0 if x is None else x for x in doc_ids], "<i8")
    return MAGIC + struct.pack("<QQQQ", len(doc_ids), len(flat), len(frames), len(words)) + keys.tobytes() + null.tobytes() + ends.tobytes() + first.tobytes() + words.tobytes()


def decode_block(block: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, the ends of the documents, and all ids."""
    if block[:4] != MAGIC:
        raise ValueError("not a token block")
    docs, n, frames, n_words = struct.unpack_from("<QQQQ", block, 4)
    at = 36

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(block, kind, count, at)
        at += got.nbytes
        return got

    keys, null, ends, first, words = take("<i8", docs), take("u1", docs), take("<u8", docs), take("<u8", frames + 1), take("<u8", n_words)
    parts = [decode_frame(words[int(first[k]) : int(first[k + 1])], min(FRAME, n - k * FRAME)) for k in range(frames)]
    return [None if z else int(k) for k, z in zip(keys, null, strict=True)], ends.astype(np.int64), np.concatenate(parts) if parts else np.empty(0, np.uint64)


def write(docs: DataFrame, path: str, target: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all texts, in ascending order of the documents' ids, as a table of blocks in ``target``.

    Null ids come first; rows of one id follow by their texts' hashes; null and empty texts are the end id alone.
    The blocks are rows (part, first, n_ids, block) of Parquet files, so Spark's commit protocol guards them when
    executors are lost: part is the range of ids that a task wrote, first counts the ids before the block in it.
    """

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = tokens.encoder(path)
        keys, ids, held, first = [], [], 0, 0

        def block():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([first], pa.int64()), pa.array([held], pa.int64()), pa.array([encode_block(keys, ids)], pa.binary())], ["part", "first", "n_ids", "block"])

        for b in common.slices(batches, name="tokens", drop=tokens.forget):
            for row, after, found, ends in enc.rows(b.column(1)):
                found, ends = tokens.with_end(found, ends, end_id)
                for key, x in zip(b.column(0).slice(row, after - row).to_pylist(), np.split(found, ends[:-1]), strict=True):
                    keys.append(key)
                    ids.append(x)
                    held += len(x)
                    if held >= BLOCK:
                        yield block()
                        first += held
                        keys, ids, held = [], [], 0
        if keys:
            yield block()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")
    rows.mapInArrow(run, "part bigint, first bigint, n_ids bigint, block binary").write.parquet(target)


def read(spark: SparkSession, target: str) -> DataFrame:
    """One row per document of the files: id, ids array<long>."""

    def run(batches):
        for b in common.slices(batches, name="tokens", drop=tokens.forget):
            for block in b.column(0).to_pylist():
                keys, ends, ids = decode_block(block)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int64)))], ["id", "ids"])

    return spark.read.parquet(target).select("block").mapInArrow(run, "id bigint, ids array<bigint>")


def digests(spark: SparkSession, target: str) -> DataFrame:
    """One row per document of the files: id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches):
        for b in common.slices(batches, name="tokens", drop=tokens.forget):
            for part, first, block in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                keys, ends, ids = decode_block(block)
                body, starts = ids.astype("<u4").tobytes(), [0, *ends.tolist()]
                crc = [zlib.crc32(body[4 * a : 4 * z]) for a, z in zip(starts, starts[1:], strict=False)]
                cols = ([part] * len(keys), keys, [first + x for x in starts[:-1]], np.diff(starts), crc)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["part", "id", "start", "n_tokens", "ids_crc32"])

    blocks = spark.read.parquet(target)
    rows = blocks.select("part", "first", "block").mapInArrow(run, "part bigint, id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    # One row per task that wrote: small by its nature, whatever the documents.
    parts = blocks.groupBy("part").agg(F.max(F.col("first") + F.col("n_ids")).alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "part").select("id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = common.work_dir(spark)
    write(common.table(spark, sf_dir, "documents"), tokens.default_tokenizer(), target)
    return digests(spark, target).withColumnRenamed("id", "doc_id")
