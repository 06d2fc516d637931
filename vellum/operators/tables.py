"""Parsed relations: documents, and from them blocks, links, sections, items and properties."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SECTION = "section_idx:int,section_title:string"
PARSED = (
    "fm_present boolean, fm_error string, fm_type string, fm array<struct<pos:int,key:string,kind:string,json:string,vals:array<string>,kinds:array<string>>>, title string, h1_line int, body_text string, "
    f"blocks array<struct<idx:int,kind:string,level:int,line:int,ordered:boolean,text:string,md:string,{SECTION}>>, "
    f"links array<struct<block_idx:int,line:int,text:string,url:string,is_image:boolean,{SECTION}>>, "
    f"items array<struct<block_idx:int,item_id:int,parent:int,depth:int,ordered:boolean,text:string,md:string,has_children:boolean,{SECTION}>>, "
    "malformed array<struct<line:int,url:string>>"
)
#: Columns that don't depend on the body.
FRONT = ("fm_present", "fm_error", "fm_type", "fm")
#: What goes to Python workers and comes from them at a time, whatever the size of a document.
ROWS, BYTES = 1024, 1 << 20


def _parsed(content: str | None) -> dict:
    from vellum.functions import markdown as M
    from vellum.functions.batches import entry

    d = M.Document(content or "")
    items: list[dict] = []
    inside: dict = {"section_idx": None, "section_title": None}

    def add(block: dict, at: int, parent: int | None, depth: int) -> None:
        for i in block["items"]:
            inner = [c for c in i["children"] if c["kind"] == "list"]
            me = len(items)
            items.append({"block_idx": at, "item_id": me, "parent": parent, "depth": depth, "ordered": block["ordered"], "text": M.plain(i["inlines"]), "md": M.markup(i["inlines"]), "has_children": bool(inner)} | inside)
            for c in inner:
                add(c, at, me, depth + 1)

    blocks, links = [], []
    for k, b in enumerate(d.blocks):
        inl = b.get("inlines")
        text = M.plain(inl) if inl is not None else "\n".join(M.block_text(b))
        if b["kind"] == "heading" and b["level"] <= 2:
            inside = {"section_idx": k, "section_title": text} if b["level"] == 2 else {"section_idx": None, "section_title": None}
        blocks.append({"idx": k, "kind": b["kind"], "level": b.get("level"), "line": b["line"], "ordered": b.get("ordered"), "text": text, "md": "\n".join(M.render_block(b))} | inside)
        links += [{"block_idx": k, "line": n, "text": t, "url": u, "is_image": i} | inside for n, t, u, i in M.block_links(b)]
        if b["kind"] == "list":
            add(b, k, None, 0)
    title, line = d.title()
    fm = [dict(zip(("key", "kind", "json", "vals", "kinds"), entry(k, v))) | {"pos": n} for n, (k, v) in enumerate(d.fields.items())]
    return {"fm_present": bool(d.front_present), "fm_error": d.front_error, "fm_type": d.doc_type, "fm": fm, "title": title, "h1_line": line, "body_text": "".join(t + "\n" for b in d.blocks for t in M.block_text(b)), "blocks": blocks, "links": links, "items": items, "malformed": [{"line": n, "url": u} for n, u in M.malformed_links(content or "")]}


def _columns(wanted: tuple[str, ...] | None):
    """The type of the parsed columns: front matter, and all others or those wanted, by name or name.field."""
    from pyspark.sql.types import ArrayType, StructType

    out = StructType()
    for f in StructType.fromDDL(PARSED):
        own = None if wanted is None else [w.partition(".")[2] for w in wanted if w.partition(".")[0] == f.name]
        if own is None or f.name in FRONT or "" in own:
            out.add(f)
        elif own:
            out.add(f.name, ArrayType(StructType([x for x in f.dataType.elementType if x.name in own]), True))
    names = {f.name for f in out}
    for w in wanted or ():
        name, _, part = w.partition(".")
        if name not in names or part and part not in out[name].dataType.elementType.names:
            raise ValueError(f"there is no parsed column '{w}'")
    return out


def parsed_arrays(contents: pa.Array, arrow: pa.Schema, front) -> list[pa.Array]:
    """The columns of a schema for some contents: plain documents at once, each of the others by itself."""
    from vellum.functions.batches import Batch, front_arrays

    if all(n in FRONT for n in arrow.names):
        got = front_arrays([front.read(x or "") for x in contents.to_pylist()], arrow)
        return [got[n] for n in arrow.names]
    b = Batch(contents, front)
    got = front_arrays(b.front, arrow)
    out = [got[f.name] if f.name in FRONT else b.column(f) for f in arrow]
    if b.plain.all():
        return out
    rest = [k for k, p in enumerate(b.plain.tolist()) if not p]
    slow = pa.RecordBatch.from_pylist([{n: x[n] for n in arrow.names} for x in (_parsed(contents[k].as_py()) for k in rest)], schema=arrow)
    order = list(range(len(contents)))
    for n, k in enumerate(rest):
        order[k] = len(contents) + n
    order = pa.array(order, pa.int64())
    return [pa.concat_arrays([x, y]).take(order) for x, y in zip(out, slow.columns)]


def narrowed(column: pa.Array, field: pa.Field) -> pa.Array:
    """A column of structs with the fields of a type alone."""
    if column.type == field.type:
        return column
    inner = field.type.value_type
    return pa.ListArray.from_arrays(column.offsets, pa.StructArray.from_arrays([column.values.field(f.name) for f in inner], fields=list(inner)), type=field.type)


def slices(batch: pa.RecordBatch, at: int):
    """Parts of a batch of bounded rows and bytes of one column."""
    import numpy as np

    size = np.cumsum(np.nan_to_num(pa.compute.binary_length(batch.column(at)).to_numpy(zero_copy_only=False), nan=0))
    k = 0
    while k < batch.num_rows:
        base = size[k - 1] if k else 0
        n = max(1, min(ROWS, int(np.searchsorted(size, base + BYTES, "right")) - k))
        yield batch.slice(k, n)
        k += n


def parse(corpus: DataFrame, columns: tuple[str, ...] | None = None, more: tuple | None = None) -> DataFrame:
    """The corpus with parsed columns instead of content, one pass over each file.

    Filter by path columns before: what is below isn't parsed. Null contents are empty documents. ``columns``: what is
    needed beyond front matter, by name or name.field ("items.text"); all by default. With none, bodies aren't parsed.
    ``more``: columns it needs likewise, the DDL of columns to add, and a function to these of the batch and its parsed
    columns, run in the same workers.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", corpus.sparkSession.conf
    if not 0 < int(conf.get(key)) <= ROWS:  # a worker holds what comes to it whole
        conf.set(key, str(ROWS))
    keep = [c for c in corpus.columns if c != "content"]
    rows = corpus.select(*keep, "content").withColumn("size_bytes", F.octet_length("content"))
    schema = rows.drop("content").schema
    names, parsed_type = [*schema.names], _columns(columns)
    given, added, extend = more or ((), "", None)
    added = StructType.fromDDL(added) if added else StructType()
    arrow = to_arrow_schema(_columns(None if columns is None else (*columns, *given)))
    out_schema, added_names = to_arrow_schema(parsed_type), added.names

    def run(batches):
        import pyarrow.compute  # noqa: F401

        from vellum.functions.batches import Front

        front = Front()
        for b in batches:
            at = b.schema.get_field_index("content")
            for some in slices(b, at):
                got = pa.RecordBatch.from_arrays(parsed_arrays(some.column(at), arrow, front), schema=arrow)
                extra = extend(some, got) if extend else []
                yield pa.RecordBatch.from_arrays([*(some.column(some.schema.get_field_index(n)) for n in names), *(narrowed(got.column(f.name), f) for f in out_schema), *extra], [*names, *out_schema.names, *added_names])

    return rows.mapInArrow(run, StructType([*schema.fields, *parsed_type.fields, *added.fields]))


def blocks(docs: DataFrame) -> DataFrame:
    """Top-level blocks with the index and title of the level-2 section that they are in."""
    return docs.select("rel_path", F.explode("blocks").alias("b")).select("rel_path", "b.*").withColumn("section_title", F.nullif("section_title", F.lit("")))


def links(docs: DataFrame) -> DataFrame:
    from vellum.functions.columns import link_target

    rows = docs.select("rel_path", "dir", F.posexplode("links").alias("link_ord", "x")).select("rel_path", "dir", "link_ord", "x.*")
    return rows.withColumn("target", link_target(F.col("url"), F.col("dir"))).drop("dir")


def items(docs: DataFrame) -> DataFrame:
    return docs.select("rel_path", F.explode("items").alias("x")).select("rel_path", "x.*")


def fields(docs: DataFrame) -> DataFrame:
    return docs.select("rel_path", F.explode("fm").alias("x")).select("rel_path", "x.*")


def properties(docs: DataFrame) -> DataFrame:
    """Key: Value sub-items by the item they describe; keys trimmed and lower-cased, values trimmed."""
    i = items(docs).where("instr(text, ': ') > 0 AND parent IS NOT NULL")
    at = F.instr("text", ": ")
    return i.select("rel_path", "section_title", "section_idx", F.col("parent").alias("item_id"), F.col("item_id").alias("ord"), F.lower(F.trim(F.substring(F.col("text"), F.lit(1), at - 1))).alias("key"), F.trim(F.substring(F.col("text"), at + 2, F.length("text"))).alias("value"))


def sections(docs: DataFrame) -> DataFrame:
    """Headings of level 2 to 4 as a tree: each with its parent section and the end of its block range."""
    h = docs.select("rel_path", F.size("blocks").alias("n"), F.filter("blocks", lambda x: (x.kind == "heading") & (x.level <= 4)).alias("hs")).select("rel_path", "n", "hs", F.explode("hs").alias("h"))
    later = F.filter("hs", lambda x: (x.idx > F.col("h.idx")) & (x.level <= F.col("h.level")))
    before = F.filter("hs", lambda x: (x.idx < F.col("h.idx")) & (x.level < F.col("h.level")) & (x.level >= 2))
    return h.where("h.level >= 2").select("rel_path", F.col("h.idx").alias("section_idx"), F.col("h.level").alias("level"), F.col("h.text").alias("heading"), F.col("h.line").alias("line"), F.when(F.size(before) > 0, F.element_at(before, -1).idx).alias("parent_section_idx"), F.when(F.size(later) > 0, later[0].idx).otherwise(F.col("n")).alias("end_idx"))
