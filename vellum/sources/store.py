"""Intermediate tables in the folder that all executors share: each file is parsed once, whatever reads it later."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on one machine, where it is unset, a temporary folder. On a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "vellum-tables")


def materialise(df: DataFrame) -> DataFrame:
    """The same rows, written and read back."""
    path = f"{shared_folder(df.sparkSession)}/tables-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
