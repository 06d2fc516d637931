"""Exact dedup by DataFrame functions alone: copies are merged locally, then by salted digest, then over all salts."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

SALTS = 16
#: Groups of more than a 1/HOT of all rows, and of more than LEAST_HOT, are hot.
HOT, LEAST_HOT = 4096, 100_000


def normalised(text):
    """Lower-cases A-Z alone; null counts as empty. lower() does just that to pure ASCII, and faster."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (sha, text, keep_id, group_size) per distinct text; text is filled only where texts share a digest.

    Full texts are grouping keys at each stage beside the digest: partial aggregation merges the copies of a task,
    the first shuffle those of a digest and salt, the second the winners of all salts. So no task gets more rows of
    one text than there are salts, times tasks before, and equal digests of different texts stay apart.
    """
    ids = F.col(id_col)
    base = docs.select(ids.alias("id"), normalised(F.col(text_col)).alias("text")).select("id", "text", F.sha2("text", 256).alias("sha"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    salted = base.groupBy("sha", "salt", "text").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    whole = salted.repartition("sha").groupBy("sha", "text").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))
    return whole


def membership(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, keep_id, group_size, kept, text_sha256) per input row.

    Of equal texts the row with the largest id is kept. Null texts are empty texts. A null id is smaller than any
    other; a group of null ids only has a null keep_id and keeps its rows. Rows repeated with the same id are one
    document: all of them are marked kept, and ``dedup`` returns them once.
    """
    grouped = groups(docs, id_col, text_col)
    by_digest = grouped.groupBy("sha").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    by_digest = common.written(by_digest)
    base = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text")).withColumn("sha", F.sha2("text", 256))
    single = by_digest.where("texts = 1").drop("texts")
    rows = by_digest.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    # groups of more than a 1/HOT of all rows, so fewer than HOT, are broadcast; their rows are dealt out by id instead
    large = F.col("group_size") > F.lit(max(LEAST_HOT, rows // HOT))
    hot = F.broadcast(single.where(large).select("sha", F.struct("keep_id", "group_size").alias("hot")))
    some = base.select("id", "sha").join(hot, "sha", "left")
    some = some.withColumn("key", F.when(F.col("hot").isNull(), F.col("sha")).otherwise(F.pmod(F.xxhash64("id"), F.lit(HOT)).cast("string")))
    found = single.where(~large).select(F.col("sha").alias("key"), F.struct("keep_id", "group_size").alias("cold"))
    out = some.join(found, "key", "left").withColumn("of", F.coalesce("hot", "cold")).where("of IS NOT NULL").select("id", "sha", "of.keep_id", "of.group_size")
    clash = by_digest.where("texts > 1").select("sha")
    if not clash.isEmpty():  # different texts of one digest: members are told by their full texts
        apart = grouped.join(clash, "sha", "left_semi")
        out = out.unionByName(base.join(clash, "sha", "left_semi").join(apart, ["sha", "text"]).select("id", "sha", "keep_id", "group_size"))
    return out.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns, one for each distinct text (see ``membership``)."""
    found = groups(docs, id_col, text_col)
    by_digest = common.written(found.groupBy("sha").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id")))
    rows = docs.withColumn("__sha", F.sha2(normalised(F.col(text_col)), 256))
    one = by_digest.where("texts = 1")
    # an id may be repeated with other texts: a row stays by its id and digest, both of which repeats are dropped by
    own = one.where("keep_id IS NOT NULL").select(F.col("keep_id").alias(id_col), F.col("sha").alias("__sha"))
    kept = rows.where(F.col(id_col).isNotNull()).join(own, [id_col, "__sha"], "left_semi").dropDuplicates([id_col, "__sha"])
    lone = rows.where(F.col(id_col).isNull()).join(one.where("keep_id IS NULL").select(F.col("sha").alias("__sha")), "__sha", "left_semi").dropDuplicates(["__sha"])
    out = kept.select(*docs.columns).unionByName(lone.select(*docs.columns))
    clash = by_digest.where("texts > 1").select(F.col("sha").alias("__sha"))
    if not clash.isEmpty():  # different texts of one digest are told apart by their full texts
        apart = found.select(F.col("keep_id").alias("__keep"), F.col("sha").alias("__digest"), F.col("text").alias("__same"))
        some = rows.join(clash, "__sha", "left_semi").withColumn("__text", normalised(F.col(text_col)))
        hit = F.col(id_col).eqNullSafe(F.col("__keep")) & (F.col("__sha") == F.col("__digest")) & (F.col("__text") == F.col("__same"))
        out = out.unionByName(some.join(apart, hit, "left_semi").dropDuplicates(["__text"]).select(*docs.columns))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership(common.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
"""
