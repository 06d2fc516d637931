"""Byte-pair encoding and decoding of a text column (per-prefix dynamic programming, see ``tokens.PrefixBPE``)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, tokens


class Strings:
    """Joins the strings that stand for ids, for many ids at once."""

    def __init__(self, table: list[bytes]):
        self.size = np.array([len(x) for x in table], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.body = np.frombuffer(b"".join(table), np.uint8)

    def join(self, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The strings of all ids, and where those of each row end."""
        size = self.size[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.body[np.repeat(self.start[ids] - total[:-1], size) + np.arange(total[-1])].tobytes(), total[ends]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", engine: str = "prefix") -> DataFrame:
    """One row (id, ids array<int>) per input row. Null and empty texts have no ids; repeated rows stay repeated;
    rows with a null id are encoded like others; further columns are not read, so their names can't clash."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = tokens.encoder(path, engine)
        for b in common.slices(batches, name="tokens", drop=tokens.forget):
            for first, after, ids, ends in enc.rows(b.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, after - first), lists], ["id", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """One row (id, text) per row of ids; ids outside the vocabulary are an error, bytes that aren't UTF-8 become U+FFFD."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        strings = Strings(tokens.encoder(path, "prefix").bpe.token_bytes)
        for b in common.slices(batches, name="tokens", drop=tokens.forget):
            lists = b.column(1).fill_null([]) if b.column(1).null_count else b.column(1)
            ends = np.cumsum(np.array(lists.value_lengths(), np.int64))
            body, stops = strings.join(lists.flatten().to_numpy(zero_copy_only=False), ends)
            texts = [body[s:e].decode("utf-8", "replace") for s, e in zip([0, *stops.tolist()], stops.tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass and keeps digests only: (id, n_tokens, ids_sha256, decoded_sha256)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = tokens.encoder(path, "prefix")
        table = enc.bpe.token_bytes
        decimals, texts = Strings([b"%d," % i for i in range(len(table))]), Strings(table)
        for b in common.slices(batches, name="tokens", drop=tokens.forget):
            for first, after, ids, ends in enc.rows(b.column(1)):
                a, d = [], []
                (decimal, x), (text, y) = decimals.join(ids, ends), texts.join(ids, ends)
                for s, e in zip([0, *x.tolist()], x.tolist(), strict=False):
                    a.append(hashlib.sha256(decimal[s : max(s, e - 1)]).hexdigest())
                for s, e in zip([0, *y.tolist()], y.tolist(), strict=False):
                    d.append(hashlib.sha256(text[s:e].decode("utf-8", "replace").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, after - first), pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents"), tokens.default_tokenizer()).withColumnRenamed("id", "doc_id")
