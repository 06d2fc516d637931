"""Filtering documents: cheap predicates on paths first, contents parsed only if a predicate or output needs them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F

from vellum.functions.columns import glob_to_regex, property_equals
from vellum.operators import tables
from vellum.operators.resolve import one, resolve, schema_dir, with_path_type

DATE_FIELDS = ("date", "created", "published", "updated")


def _has_property(key: str, value: str):
    return F.exists("fm", lambda e: (e.key == key) & property_equals(e.vals, e.kind, value))


@dataclass(frozen=True)
class Query:
    """A query over a corpus; each method returns a narrower one, and an output method a DataFrame.

    All predicates hold together. ``last`` counts from the newest by filename date, then name, after all filters.
    """

    corpus: DataFrame
    schemas: object
    parsed: bool = False
    type_name: str | None = None
    glob: str | None = None
    days_: int | None = None
    as_of: str | None = None
    props: tuple = field(default=())
    needle: str | None = None
    link: str | None = None
    last_: int | None = None

    def type(self, name: str) -> Query:
        names = sorted({n for s in (self.schemas.values() if isinstance(self.schemas, dict) else [self.schemas]) for n in s.types})
        if name not in names:
            raise ValueError(f"unknown type '{name}' (known types: {', '.join(names)})")
        return replace(self, type_name=name)

    def filename_glob(self, pattern: str) -> Query:
        return replace(self, glob=pattern)

    def days(self, n: int, as_of: str | None = None) -> Query:
        return replace(self, days_=n, as_of=as_of)

    def property(self, flag: str) -> Query:
        """key=value"""
        key, eq, value = flag.partition("=")
        if not eq:
            raise ValueError(f"expected key=value, got '{flag}'")
        return replace(self, props=(*self.props, (key.strip(), value.strip())))

    def grep(self, text: str) -> Query:
        return replace(self, needle=text)

    def has_link(self, text: str) -> Query:
        return replace(self, link=text)

    def last(self, n: int) -> Query:
        return replace(self, last_=n)

    def matches(self, columns: tuple[str, ...] = (), more: tuple | None = None) -> DataFrame:
        """Matching documents. Contents are parsed only for predicates and ``columns`` that need it, and bodies only for
        what of them these need; ``columns`` and ``more`` are those of ``tables.parse``.

        With ``last`` they come newest first; without it no order is paid for (sort by ``newest`` where it is shown).
        """
        rows = with_path_type(self.corpus, self.schemas)
        if more:
            rows = rows.withColumn("schema_dir", schema_dir(one(self.schemas), F.col("rel_path")))
        if self.glob is not None:
            rows = rows.where(F.col("basename").rlike(glob_to_regex(self.glob, separator=False)))
        if self.type_name:  # a path that says another type is out at once
            rows = rows.where(F.col("path_type").isNull() | (F.col("path_type") == self.type_name))
        since = None
        if self.days_ is not None:
            since = F.date_sub(F.to_date(F.lit(self.as_of)) if self.as_of else F.current_date(), self.days_)
            rows = rows.where(F.col("file_date").isNull() | (F.col("file_date") >= since))
        needs = bool(self.props or self.needle is not None or self.link is not None)
        newest = (F.col("file_date").desc_nulls_last(), F.col("basename").desc(), F.col("rel_path"))

        def cut(df: DataFrame) -> DataFrame:
            return df if self.last_ is None else df.orderBy(*newest).limit(self.last_)

        if not needs and not self.type_name and self.days_ is None:
            rows = cut(rows)
            return tables.parse(rows, columns, more) if (columns or more) and not self.parsed else rows
        if not self.parsed:
            body = (*columns, *(("body_text",) if self.needle is not None else ()), *(("links.url",) if self.link is not None else ()))
            rows = tables.parse(rows, body, more)
        rows = resolve(rows, self.schemas)
        if self.type_name:
            rows = rows.where((F.col("doc_type") == self.type_name) | (F.lit(not needs) & (F.col("path_type") == self.type_name)))
        if since is not None:
            dated = lambda k: F.get(F.filter("fm", lambda e: (e.key == k) & (e.kind == "string")), F.lit(0))
            at = F.coalesce("file_date", *(F.try_to_date(F.left(dated(k).vals[0], F.lit(10)), "yyyy-MM-dd") for k in DATE_FIELDS))
            rows = rows.where(at >= since)
        for key, value in self.props:
            rows = rows.where(_has_property(key, value))
        if self.needle is not None:
            rows = rows.where(F.contains(F.lower("body_text"), F.lit(self.needle.lower())))
        if self.link is not None:
            rows = rows.where(F.exists("links", lambda x: F.contains(x.url, F.lit(self.link))))
        return cut(rows)

    def paths(self) -> DataFrame:
        return self.matches().select("rel_path")

    def count(self) -> DataFrame:
        return self.matches().agg(F.count(F.lit(1)).alias("n"))

    def markdown(self) -> DataFrame:
        rows = self.matches(("blocks.md",))
        return rows.select("rel_path", F.concat(F.lit("## "), "rel_path", F.lit("\n\n"), F.array_join(F.transform("blocks", lambda b: b.md), "\n\n")).alias("markdown"))

    def json(self) -> DataFrame:
        from vellum.operators.json_output import document_json, outline

        rows = self.matches() if self.parsed else self.matches(("title",), outline(self.schemas))
        return document_json(resolve(rows, self.schemas), self.schemas)
