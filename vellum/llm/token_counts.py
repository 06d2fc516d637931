"""Exact length histogram: documents by encoded length, with suffix sums that answer questions for every limit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from . import common, tokens

#: Lengths are summed within stretches of so many, then over the stretches, so no task orders all lengths.
STRETCH = 4096


def lengths(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """One row (length) per document: its number of ids. Null and empty texts have length 0; every row counts,
    repeated ones too; no other column is read."""

    def run(batches):
        enc = tokens.encoder(path)
        for b in common.slices(batches, name="tokens", drop=tokens.forget):
            begun = 0  # ids of the parts of a very long text so far
            for first, after, ids, ends in enc.column(b.column(0)):
                if after == first:
                    begun += len(ids)
                    continue
                n = np.diff(ends, prepend=0)
                n[0] += begun
                begun = 0
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["length"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "length bigint")


def histogram(lengths_df: DataFrame, length_col: str = "length") -> DataFrame:
    """For each length that occurs: docs of it, docs and ids of it and above (suffix sums), docs up to it, all docs
    and ids, the ids left if every document is cut to it, and the ids in documents that fit into it whole.

    Only the histogram is ordered. It is written first, so that no text is encoded twice. An empty table gives no rows.
    """
    h = common.written(lengths_df.groupBy(F.col(length_col).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("docs")))
    h = h.withColumn("ids", F.col("length") * F.col("docs")).withColumn("stretch", F.floor(F.col("length") / STRETCH))
    high = W.orderBy(F.col("stretch").desc()).rowsBetween(W.unboundedPreceding, -1)
    above = h.groupBy("stretch").agg(F.sum("docs").alias("d"), F.sum("ids").alias("i"))
    everything = W.partitionBy(F.lit(0))
    above = above.select("stretch", F.coalesce(F.sum("d").over(high), F.lit(0)).alias("docs_over"), F.coalesce(F.sum("i").over(high), F.lit(0)).alias("ids_over"), F.sum("d").over(everything).alias("all_docs"), F.sum("i").over(everything).alias("all_ids"))
    own = W.partitionBy("stretch").orderBy(F.col("length").desc()).rowsBetween(W.unboundedPreceding, 0)
    out = h.join(above, "stretch").withColumn("docs_ge", F.sum("docs").over(own) + F.col("docs_over")).withColumn("ids_ge", F.sum("ids").over(own) + F.col("ids_over"))
    return out.select(
        "length", "docs", "docs_ge", "ids_ge", (F.col("all_docs") - F.col("docs_ge") + F.col("docs")).alias("docs_le"), "all_docs", "all_ids",
        (F.col("all_ids") - F.col("ids_ge") + F.col("docs_ge") * F.col("length")).alias("truncated_ids"), (F.col("all_ids") - F.col("ids_ge") + F.col("ids")).alias("whole_ids"),
    )


def truncated_total(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, total): ids in all if each document is cut to the limit, for any limits >= 0.

    The suffix sums at the least length that isn't below the limit answer it. Without documents it is 0.
    """
    at = lambda x: F.min(F.when(F.col("length") >= x, F.struct("length", "docs_ge", "ids_ge")))
    row = hist.agg(F.coalesce(F.max("all_ids"), F.lit(0)).alias("all_ids"), *(at(x).alias(f"at{k}") for k, x in enumerate(limits)))
    total = lambda k, x: F.coalesce(F.col("all_ids") - F.col(f"at{k}.ids_ge") + F.col(f"at{k}.docs_ge") * x, F.col("all_ids"))
    return row.select(F.explode(F.array(*(F.struct(F.lit(x).cast("long").alias("context_limit"), total(k, x).alias("total")) for k, x in enumerate(limits)))).alias("x")).select("x.*")


def quantile(hist: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the smallest length that at least this share of the documents doesn't exceed; null without any."""
    at = lambda x: F.min(F.when(F.col("docs_le") >= F.ceil(F.lit(float(x)) * F.col("all_docs")), F.col("length")))
    row = hist.agg(*(at(x).alias(f"at{k}") for k, x in enumerate(shares)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(float(x)).alias("share"), F.col(f"at{k}").alias("length")) for k, x in enumerate(shares)))).alias("x")).select("x.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(lengths(common.table(spark, sf_dir, "documents"), tokens.default_tokenizer()))
