"""What a run is over: files and folders named by a caller, and the paths that git tracks."""

from __future__ import annotations

import os
import subprocess
import warnings

from pyspark.sql import DataFrame, SparkSession, functions as F

from vellum.sources.corpus import walk, with_path_columns


def absolute(paths: list[str], start: str) -> list[str]:
    """Paths relative to ``start`` made absolute; nothing is looked up."""
    return [os.path.normpath(os.path.join(start, p)) for p in paths]


def selected(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """(rel_path, content) of the named files and of all files in the named folders; of the whole tree if none is named.

    Other than .md files and paths that don't exist are passed over. A file named twice comes twice. Files outside the
    root have paths that begin with ``..``.
    """
    if not paths:
        return walk(spark, root)
    out, files = None, []
    for p in absolute(paths, root):
        rel = os.path.relpath(p, root)
        if os.path.isdir(p):
            part = walk(spark, p).select(F.concat(F.lit("" if rel == "." else rel + "/"), "rel_path").alias("rel_path"), "content")
            out = part if out is None else out.unionByName(part)
        elif os.path.isfile(p) and len(os.path.basename(p)) > 3 and p.endswith(".md"):
            files.append((rel,))

    def read(batches):
        import pyarrow as pa

        for b in batches:
            names, texts = b.column(0).to_pylist(), []
            for n in names:
                with open(os.path.join(root, n), encoding="utf-8") as f:
                    texts.append(f.read())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["rel_path", "content"])

    named = spark.createDataFrame(files, "rel_path string").mapInArrow(read, "rel_path string, content string")
    warnings.warn("only the named files are looked at; name none to look at all", stacklevel=2)
    return with_path_columns(named if out is None else out.unionByName(named))


def _git(root: str, *args: str) -> bytes | None:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, check=False)
    return done.stdout if done.returncode == 0 else None


def repository(root: str) -> str | None:
    """The work tree that a folder is in, or None."""
    found = _git(root, "rev-parse", "--show-toplevel")
    return found.decode().rstrip("\n") if found else None


def tracked(spark: SparkSession, root: str) -> DataFrame | None:
    """(path) of every file in the last commit, relative to the root; None outside a repository or before a commit.

    The listing is made on the driver. It serves as the known paths of broken links.
    """
    top = repository(root)
    listed = _git(top, "ls-tree", "-r", "-z", "--name-only", "HEAD") if top else None
    if listed is None:
        return None
    top, here = os.path.realpath(top), os.path.realpath(root)
    names = [(os.path.relpath(os.path.join(top, n), here),) for n in listed.decode("utf-8", "replace").split("\0") if n]
    return spark.createDataFrame(names, "path string")
