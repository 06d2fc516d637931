"""Document types: by front matter, else by path patterns of the nearest schema folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vellum.functions.columns import glob_to_regex
from vellum.sources.schema import Schema


def one(schemas: Schema | dict[str, Schema]) -> dict[str, Schema]:
    return {".": schemas} if isinstance(schemas, Schema) else schemas


def schema_dir(schemas: dict[str, Schema], path: Column) -> Column:
    """The nearest folder above a path that has a schema; one CASE, deepest folders first."""
    out = None
    for d in sorted(schemas, key=lambda x: (-x.count("/") - (x != "."), x)):
        hit = F.lit(True) if d == "." else path.startswith(d + "/")
        out = F.when(hit, F.lit(d)) if out is None else out.when(hit, F.lit(d))
    return out


def path_types(schemas: dict[str, Schema], path: Column) -> Column:
    """All types whose patterns match, in order: patterns are constants of the plan, so no join is needed."""
    found = F.array().cast("array<string>")
    for d, s in schemas.items():
        rel = path if d == "." else F.substring(path, F.lit(len(d) + 2), F.length(path))
        if not any(e.startswith("path pattern") for e in s.errors):
            own = F.array_distinct(F.filter(F.array(*[F.when(rel.rlike(glob_to_regex(p)), F.lit(n)) for n, p in s.paths()] or [F.lit(None).cast("string")]), lambda x: x.isNotNull()))
            found = F.when(schema_dir(schemas, path) == d, own).otherwise(found)
    return found


def with_path_type(files: DataFrame, schemas) -> DataFrame:
    """Adds path_types and path_type (the only match), from the path alone."""
    schemas = one(schemas)
    return files.withColumn("path_types", path_types(schemas, F.col("rel_path"))).withColumn("path_type", F.when(F.size("path_types") == 1, F.col("path_types")[0]))


def resolve(docs: DataFrame, schemas) -> DataFrame:
    """Adds schema_dir, resolution (explicit, path, opted_out, conflict, unknown) and doc_type."""
    schemas = one(schemas)
    docs = docs if "path_types" in docs.columns else with_path_type(docs, schemas)
    at = schema_dir(schemas, F.col("rel_path"))
    known = F.lit(False)
    for d, s in schemas.items():
        known = known | ((F.col("schema_dir") == d) & F.col("fm_type").isin(*s.types))
    docs = docs.withColumn("schema_dir", at)
    how = F.when(F.col("fm_type") == "none", "opted_out").when(known, "explicit").when(F.col("fm_type").isNotNull(), "unknown").when(F.size("path_types") == 1, "path").when(F.size("path_types") > 1, "conflict").otherwise("unknown")
    return docs.withColumn("resolution", how).withColumn("doc_type", F.when(F.col("resolution") == "explicit", F.col("fm_type")).when(F.col("resolution") == "path", F.col("path_type")))
