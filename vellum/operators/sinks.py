"""Where results go: JSON lines, Markdown, rewritten files, a summary, messages to an editor."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, functions as F


def json_lines(rows: DataFrame, target: str, pretty: bool = False) -> None:
    """Writes the ``json`` column as text files, an object on each line, or indented over several."""
    import json

    indent = F.udf(lambda s: json.dumps(json.loads(s), indent=2, ensure_ascii=False), "string", useArrow=True)
    rows.select((indent("json") if pretty else F.col("json")).alias("value")).write.text(target)


def write_back(formatted: DataFrame, root: str) -> None:
    """Writes the files that changed into their tree, which all executors share. Each is replaced at once, so a task
    that runs again writes the same again."""

    def put(rows) -> None:
        for r in rows:
            path = os.path.join(root, r.rel_path)
            part = f"{path}.part"
            with open(part, "w", encoding="utf-8", newline="") as f:
                f.write(r.formatted)
            os.replace(part, path)

    formatted.where("changed").select("rel_path", "formatted").foreachPartition(put)


def summary(formatted: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """One row: files checked and changed, the diagnostics that no fix is for, a line of text, and the exit status."""
    zero, one = F.lit(0), F.lit(1)
    files = formatted.select(one.alias("checked"), F.col("changed").cast("int").alias("changed"), zero.alias("unfixable"))
    rows = files.unionByName(diagnostics.select(zero.alias("checked"), zero.alias("changed"), (~F.col("fixable")).cast("int").alias("unfixable")))
    rows = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("checked", "changed", "unfixable")))
    text = F.concat(F.lit("formatted "), F.col("changed").cast("string"), F.lit(" of "), F.col("checked").cast("string"), F.lit(" file(s)"))
    return rows.select("checked", "changed", "unfixable", text.alias("text"), F.when(F.col("unfixable") > 0, 1).otherwise(0).alias("status"))


def uri(path: Column) -> Column:
    """file:// and the path, all but letters, digits and -._~/ percent-encoded."""
    plain = F.replace(F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("*"), F.lit("%2A"))
    return F.concat(F.lit("file://"), F.replace(plain, F.lit("%7E"), F.lit("~")))


def uri_path(address: Column) -> Column:
    """The path of a file:// address; null for any other."""
    path = F.replace(F.substring(address, F.lit(8), F.length(address)), F.lit("+"), F.lit("%2B"))
    return F.when(address.startswith("file:///"), F.try_url_decode(path))


def messages(publications: DataFrame, root: str) -> DataFrame:
    """(rel_path, message): a publishDiagnostics notification for each file; an empty list clears it."""
    at = lambda d: F.struct(F.struct(d.line.alias("line"), F.lit(0).alias("character")).alias("start"), F.struct(d.line.alias("line"), F.lit(0).alias("character")).alias("end"))
    found = F.transform("diagnostics", lambda d: F.struct(at(d).alias("range"), F.lit(1).alias("severity"), d.message.alias("message")))
    params = F.struct(uri(F.concat(F.lit(root.rstrip("/") + "/"), "rel_path")).alias("uri"), found.alias("diagnostics"))
    whole = F.struct(F.lit("2.0").alias("jsonrpc"), F.lit("textDocument/publishDiagnostics").alias("method"), params.alias("params"))
    return publications.select("rel_path", F.to_json(whole).alias("message"))
