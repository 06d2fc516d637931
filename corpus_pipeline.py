"""Documents to packed sequences in five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import common, exact_dedup, jaccard_join, language_id, packing, tokens, toxicity


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose language can't be told."""
    return language_id.keep(docs, language_id.fit(docs))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are likely toxic."""
    return toxicity.keep(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the copy with the largest doc_id of each text."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of linked documents."""
    return jaccard_join.dedup(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens at most."""
    return packing.pack(docs, tokens.default_tokenizer()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", identify_language),
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("packing", pack_sequences),
]

#: The stages hold trained models and a tokenizer, which SQL can't express; tests/llm holds a run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the last stage. An empty table gives none; null and letterless texts go in the first stage; rows
    with null ids pass all stages; columns beyond doc_id and text go along and may have any names."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.written(docs)
    return docs
