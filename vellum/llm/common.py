"""What the operators of this subpackage share: tables, intermediate storage, column checks."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


#: Rows that Python functions get at once: texts may be long, and two batches of each task are in memory on either side.
BATCH_ROWS = 1024


def bounded(spark: SparkSession) -> None:
    """Sees to it that no larger batches are handed to Python in this session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder in the place that all executors share (spark.checkpoint.dir).

    Where that setting is absent, as in tests, a folder of this machine is used if Spark runs on it alone.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "vellum-work")
    return f"{base.rstrip('/')}/vellum-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows read back from a table in the shared folder: cuts the lineage and survives lost executors."""
    bounded(df.sparkSession)
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_at = path
    return back


def discard(df: DataFrame) -> None:
    """Deletes a written table whose successors have been written too."""
    jvm, context = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
    path = jvm.org.apache.hadoop.fs.Path(df.written_at)
    path.getFileSystem(context.hadoopConfiguration()).delete(path, True)


def slices(batches, rows: int = BATCH_ROWS, name: str = "", drop=lambda: None):
    """The same batches in pieces of so many rows; what was freed goes back to the system at the end.

    ``name`` and ``drop``: what the function that reads them keeps in its worker (see ``holding``).
    """
    holding(name, drop)
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
    trim()


_HELD: dict = {}


def holding(name: str, drop) -> None:
    """Says that this worker keeps something by a name from now on, and lets go of what it keeps by other names.

    A worker runs tasks of many stages: tables that one operator keeps between tasks must not stay for the next one.
    """
    others = [k for k in _HELD if k != name]
    for k in others:
        _HELD.pop(k)()
    _HELD[name] = drop
    if others:
        gc.collect()
        trim()


def trim() -> None:
    """Gives a process's freed memory back to the system, so that idle workers and the driver stay small."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)


def doc_bucket(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4; bucket 2 is held out from every fit."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(doc_bucket(id_col) == 2, F.lit(False))


def vector_sum(df: DataFrame, counts, size: int, chunks: int = 64):
    """Element-wise sum of one uint32 vector per partition, as a numpy array on the driver.

    ``counts(batches)`` turns a partition's Arrow batches into its vector. ``size`` is a fixed parameter of the
    caller, so what reaches the driver doesn't grow with the rows. Partial vectors are added up by chunk, batch by
    batch, on the executors.
    """
    import numpy as np
    import pyarrow as pa

    step = -(-size // chunks)

    def partial(batches):
        v = counts(batches)
        for c in range(chunks):
            part = v[c * step : (c + 1) * step]
            at = np.flatnonzero(part).astype(np.uint32)
            if len(at):
                kind = np.uint8 if part.max() < 256 else np.uint16 if part.max() < 65536 else np.uint32
                width = np.dtype(kind).itemsize
                sparse = len(at) * (4 + width) < len(part) * width
                body = at.tobytes() + part[at].astype(kind).tobytes() if sparse else part.astype(kind).tobytes()
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "sparse": pa.array([len(at) if sparse else 0], pa.int32()), "width": pa.array([width], pa.int32()), "body": pa.array([body], pa.binary())})

    def add(batches):
        total: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                v = total.setdefault(row["chunk"], np.zeros(step, np.uint64))
                n, kind = row["sparse"], f"<u{row['width']}"
                if n:
                    v[np.frombuffer(row["body"], np.uint32, n)] += np.frombuffer(row["body"], kind, n, 4 * n)
                else:
                    got = np.frombuffer(row["body"], kind)
                    v[: len(got)] += got
        for c, v in total.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "body": pa.array([v.tobytes()], pa.binary())})

    parts = df.mapInArrow(partial, "chunk int, sparse int, width int, body binary")
    out = np.zeros(step * chunks, np.uint64)
    # chunks are a few dozen, so few tasks hold them; they come to the driver one task's at a time
    for row in parts.repartition(8, "chunk").mapInArrow(add, "chunk int, body binary").toLocalIterator():
        out[row.chunk * step : (row.chunk + 1) * step] += np.frombuffer(row.body, np.uint64)
    trim()
    return out[:size]
