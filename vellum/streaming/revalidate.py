"""Re-validation on a stream of changes, and what its diagnostics clear."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stale(before: DataFrame, now: DataFrame) -> DataFrame:
    """Paths that had diagnostics and have none now."""
    return before.select("rel_path").distinct().join(now.select("rel_path").distinct(), "rel_path", "left_anti")


def publications(before: DataFrame, now: DataFrame) -> DataFrame:
    """(rel_path, diagnostics): every file's diagnostics on 0-based lines, and empty ones for stale files."""
    found = now.groupBy("rel_path").agg(F.sort_array(F.collect_list(F.struct(F.greatest(F.coalesce("line", F.lit(1)) - 1, F.lit(0)).alias("line"), "message"))).alias("diagnostics"))
    return found.unionByName(stale(before, now).withColumn("diagnostics", F.expr("cast(array() AS array<struct<line:int,message:string>>)")))


def revalidate(changes: DataFrame, check, publish, state_path: str, checkpoint: str):
    """Starts a streaming query over changes (method, path): each batch that opens or changes a .md file re-validates
    the corpus with ``check()`` and hands ``publish`` the publications. What was last published is kept in
    ``state_path``, by batch, so that a batch that is run again clears the same files."""
    events = changes.where("method IN ('textDocument/didOpen', 'textDocument/didChange') AND path LIKE '%.md'")

    def each(batch: DataFrame, n: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        states = _states(spark, state_path)
        earlier = [k for k in sorted(states) if k < n]
        now = check().select("rel_path", "line", "message")
        now.write.mode("overwrite").parquet(f"{state_path}/{n}")
        now = spark.read.schema(now.schema).parquet(f"{state_path}/{n}")
        before = spark.read.schema(now.schema).parquet(f"{state_path}/{earlier[-1]}") if earlier else now.limit(0)
        publish(publications(before, now), n)
        for k in earlier[:-1]:  # the last one is read again if this batch is run again
            states[k]()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def _states(spark, state_path: str) -> dict:
    """Batches whose state is whole, each with a function that deletes it."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(state_path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
    whole = [p for p in found if p.getName().isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return {int(p.getName()): (lambda p=p: fs.delete(p, True)) for p in whole}
