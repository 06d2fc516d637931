"""Corpora: (rel_path, content) with path columns, from a tree of files or rendered from tables."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from vellum.functions.columns import filename_date, glob_to_regex


def with_path_columns(files: DataFrame) -> DataFrame:
    """Adds dir, basename, stem, parent_name and file_date to rows with rel_path."""
    path = F.col("rel_path")
    base = F.substring_index(path, "/", -1)
    folder = F.when(F.instr(path, "/") > 0, F.substring(path, F.lit(1), F.length(path) - F.length(base) - 1)).otherwise("")
    return files.withColumns({"dir": folder, "basename": base, "stem": F.regexp_replace(base, r"\.md$", ""), "parent_name": F.substring_index(folder, "/", -1), "file_date": filename_date(base)})


class Ignored:
    """Whether paths below a root are ignored, by .git/info/exclude and the ignore files of each folder entered.

    Later rules win, and those of deeper folders over others; a folder's rules hold for what lies in it alone.
    """

    def __init__(self, root: str):
        self.root = root
        self.rules: dict[str, list] = {"": self._read(os.path.join(root, ".git", "info", "exclude"))}

    @staticmethod
    def _read(path: str) -> list[tuple]:
        """(pattern, negated, for folders alone) of each line."""
        out = []
        try:
            with open(path, encoding="utf-8") as f:
                lines = f.read().split("\n")
        except OSError:
            return out
        for line in lines:
            line = line.rstrip()
            if line and not line.startswith("#"):
                no, line = line.startswith("!"), line.removeprefix("!")
                body = line.rstrip("/")
                anchored = body.lstrip("/") if "/" in body else "**/" + body
                out.append((re.compile(glob_to_regex(anchored)), no, line.endswith("/")))
        return out

    def enter(self, folder: str) -> None:
        """Reads the ignore files of a folder given relative to the root."""
        own = [r for name in (".gitignore", ".ignore") for r in self._read(os.path.join(self.root, folder, name))]
        if own:
            key = "" if folder == "." else folder + "/"
            self.rules[key] = self.rules.get(key, []) + own

    def __call__(self, rel: str, is_folder: bool) -> bool:
        out = False
        for base in sorted((b for b in self.rules if rel.startswith(b)), key=len):
            for pattern, no, folders in self.rules[base]:
                if (is_folder or not folders) and pattern.match(rel[len(base) :]):
                    out = not no
        return out


def walk(spark: SparkSession, root: str) -> DataFrame:
    """All *.md files of a tree, dot folders included, .git and ignored paths left out: (rel_path, content).

    Only paths are listed on the driver; contents are read on the executors, from a file system that all share. Files
    that can't be read are left out.
    """
    ignored, found = Ignored(root), []
    for folder, dirs, names in os.walk(root):
        rel = os.path.relpath(folder, root)
        ignored.enter(rel)
        below = lambda n: os.path.normpath(os.path.join(rel, n))  # noqa: B023, E731
        dirs[:] = sorted(d for d in dirs if d != ".git" and not ignored(below(d), True))
        found += [(below(n),) for n in sorted(names) if n.endswith(".md") and len(n) > 3 and not ignored(below(n), False)]

    def read(batches):
        import pyarrow as pa

        for b in batches:
            paths, texts = [], []
            for p in b.column(0).to_pylist():
                try:
                    with open(os.path.join(root, p), encoding="utf-8") as f:
                        texts.append(f.read())
                    paths.append(p)
                except (OSError, UnicodeDecodeError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], ["rel_path", "content"])

    return with_path_columns(spark.createDataFrame(found, "rel_path string").mapInArrow(read, "rel_path string, content string"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Dealt out by key to all shuffle partitions. Small rows, but much to parse: partitions must not be merged."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders/<date>-<key>.md: typed front matter, items with properties, a link to the customer."""
    o = _spread(table(spark, sf_dir, "orders"), "o_orderkey")
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    items = _spread(table(spark, sf_dir, "lineitem"), "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines")).hint("merge")
    o = o.join(items, o.o_orderkey == items.l_orderkey, "left")
    body = F.array_join(F.transform(F.coalesce("lines", F.array()), lambda x: F.concat(F.lit("- Part "), x.l_partkey.cast("string"), F.lit("\n  - Quantity: "), x.l_quantity.cast("int").cast("string"), F.lit("\n  - Flag: "), x.l_returnflag)), "\n")
    key = F.col("o_orderkey").cast("string")
    front = F.concat(F.lit("---\ntype: order\nstatus: "), "o_orderstatus", F.lit("\npriority: "), "o_orderpriority", F.lit("\ncust: "), F.col("o_custkey").cast("string"), F.lit("\ncents: "), F.round(F.col("o_totalprice") * 100).cast("long").cast("string"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("\nrush: true")).otherwise(""), F.lit("\n---\n"))
    text = F.concat(front, F.lit("# Order "), key, F.lit("\n\nPlaced by customer "), F.col("o_custkey").cast("string"), F.lit(".\n\n## Items\n\n"), body, F.lit("\n\n## Customer\n\n- [Customer](../customers/"), F.col("o_custkey").cast("string"), F.lit(".md)\n"))
    return with_path_columns(o.select(F.concat(F.lit("orders/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-"), F.lpad(key, 10, "0"), F.lit(".md")).alias("rel_path"), text.alias("content")))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers/<key>.md: typed by path; the title is wrong for each seventh, links back to even orders only."""
    c = _spread(table(spark, sf_dir, "customer"), "c_custkey")
    o = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0")
    back = _spread(o, "o_custkey").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("- [Order](../orders/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.lit(".md)")))), "\n").alias("back")).hint("merge")
    c = c.join(back, c.c_custkey == back.o_custkey, "left")
    key = F.col("c_custkey").cast("string")
    title = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("Customer "), key)).otherwise(key)
    front = F.concat(F.lit("---\nname: "), "c_name", F.lit("\nsegment: "), "c_mktsegment", F.when(F.col("c_custkey") % 11 == 0, F.lit("\nnation: \"x\"")).when(F.col("c_custkey") % 13 == 0, F.lit("")).otherwise(F.concat(F.lit("\nnation: "), F.col("c_nationkey").cast("string"))), F.lit("\n---\n"))
    return with_path_columns(c.select(F.concat(F.lit("customers/"), key, F.lit(".md")).alias("rel_path"), F.concat(front, F.lit("# "), title, F.lit("\n\n## Orders\n\n"), F.coalesce("back", F.lit("")), F.lit("\n")).alias("content")))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suppliers/<key>.md with faults by key: sections that are missing, strange or out of order, bad properties, lists
    of the wrong kind, links with spaces, front matter that can't be read, a managed section in its states."""
    t, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey").cast("string")
    each = lambda n: F.col("s_suppkey") % n == 0
    front = F.when(each(23), F.lit("---\ntype: [a\n---\n")).otherwise(F.lit("---\ntype: supplier\n---\n"))
    intro = F.when(each(2), F.lit("- about\n\n")).otherwise(F.lit("Supplies parts.\n\n"))
    facts = F.concat(F.lit("## Facts\n\n"), F.when(each(6), F.lit("")).otherwise(F.concat(F.lit("- Code: "), key, F.lit("\n"))), F.lit("- Balance: "), F.when(each(5), F.lit("none")).otherwise(F.round("s_acctbal").cast("int").cast("string")), F.lit("\n\n"))
    note = F.when(each(3), F.lit("1. ordered\n\n")).when(each(7), F.lit("Some **words `here`**.\n\n")).otherwise(F.lit("- point\n\n"))
    notes = F.concat(F.lit("## Notes\n\n"), note, F.when(each(4), F.lit("- [far](a b.md)\n\n")).otherwise(""))
    extra = F.when(each(11), F.lit("## Extra\n\n- x\n\n")).otherwise("")
    rules = F.when(each(19), F.lit("")).when(each(9), F.lit("## Old Rules\n\n- be fair\n")).when(each(8), F.lit("## Rules\n\n- be mean\n")).when(each(10), F.lit("## Rules\n\n- be fair\n- own rule\n")).otherwise(F.lit("## Rules\n\n- be fair\n"))
    body = F.when(each(17), notes).when(each(13), F.concat(notes, facts)).otherwise(F.concat(facts, notes))
    text = F.concat(front, F.lit("# "), "s_name", F.lit("\n\n"), intro, body, extra, rules)
    return with_path_columns(t.select(F.concat(F.lit("suppliers/"), key, F.lit(".md")).alias("rel_path"), text.alias("content")))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log/<user>/2024-01.md without front matter: date headings, unsorted for each third user."""
    e = table(spark, sf_dir, "events").withColumn("k", F.when(F.col("user_id") % 3 == 0, F.col("event_id")).otherwise(F.unix_micros(F.col("ts").cast("timestamp"))))
    heads = F.transform(F.sort_array(F.collect_list(F.struct("k", "event_id", "ts", "event_type"))), lambda x: F.concat(F.lit("## "), F.date_format(x.ts, "yyyy-MM-dd HH:mm"), F.lit(" - "), x.event_type, F.lit("\n\nEvent "), x.event_id.cast("string"), F.lit(".")))
    rows = e.groupBy("user_id").agg(F.array_join(heads, "\n\n").alias("body"))
    return with_path_columns(rows.select(F.concat(F.lit("log/"), F.col("user_id").cast("string"), F.lit("/2024-01.md")).alias("rel_path"), F.concat(F.lit("---\nuser: "), F.col("user_id").cast("string"), F.lit("\n---\n# January 2024\n\n"), "body", F.lit("\n")).alias("content")))


#: Characters that are escaped.
MARKED = r"[*&|!#_<>\[\]\\`~]"


def _prose_file(d: DataFrame, body) -> DataFrame:
    """Source and language in front matter, empty where null, then the body."""
    front = F.concat(F.lit("---\ntype: prose\nlang: "), F.coalesce("lang", F.lit("")), F.lit("\nsource: "), F.coalesce("source", F.lit("")), F.lit("\n---\n"))
    return with_path_columns(d.select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel_path"), F.concat(front, body, F.lit("\n")).alias("content")))


#: Texts whose lines all begin with a letter and end without a space are one paragraph once their markup is escaped.
LINES = r"^\p{L}([^\n\r]*\S)?(\n\p{L}([^\n\r]*\S)?)*$(?!\n)"


def rendered(docs: DataFrame) -> DataFrame:
    """Each document, whatever its text: as a paragraph with escaped markup, or in a fence longer than any in it.

    Null texts are empty ones, which have no block.
    """
    text = F.coalesce("text", F.lit(""))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.array_max(F.transform(F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit("`+"), F.lit(0))), F.length)) + 1))
    body = F.when(text == "", "").when(text.rlike(LINES), F.regexp_replace(text, MARKED, r"\\$0")).otherwise(F.concat(fence, F.lit("\n"), text, F.lit("\n"), fence))
    return _prose_file(docs, body)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents/<id>.md of every row of documents."""
    return rendered(table(spark, sf_dir, "documents"))
