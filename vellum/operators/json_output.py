"""Documents as JSON lines, and the link graph that they span."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, functions as F

from vellum.operators import tables
from vellum.sources.schema import Schema
from vellum.sources.store import materialise


def _object(pairs: list[tuple[str, object, object]]):
    """A JSON object with its keys in order; a pair whose condition is false is left out."""
    parts = [F.when(keep, F.concat(F.lit(f'"{k}":'), v)) for k, v, keep in pairs]
    return F.concat(F.lit("{"), F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), ","), F.lit("}"))


def _quoted(c):
    """A JSON string, or null."""
    return F.coalesce(F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2), F.lit("null"))


def _coerced(value: str, d: dict):
    """A property's text as its declared type, or as it is."""
    if d.get("type") == "integer" and re.fullmatch(r"[+-]?[0-9]+", value, re.ASCII) and -(2**63) <= int(value) < 2**63:
        return int(value)
    if d.get("type") == "float" and re.fullmatch(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", value, re.ASCII) and abs(float(value)) != float("inf"):
        return float(value)
    if d.get("type") == "bool" and value in ("true", "yes", "false", "no"):
        return value in ("true", "yes")
    return value


def _properties(texts, declared: dict) -> dict:
    """Typed values of Key: Value texts; a repeated key has an array."""
    out: dict = {}
    for text in texts:
        key, colon, value = text.partition(": ")
        if colon:
            out.setdefault(key.strip().lower(), []).append(_coerced(value.strip(), declared.get(key.strip().lower()) or {}))
    return {k: v[0] if len(v) == 1 else v for k, v in out.items()}


def _sections(blocks: list, items: list, links: list, declared: dict) -> list[dict]:
    """Level-2 sections with subsections down to level 4; deeper headings are content.

    ``declared``: properties by section title, of level 2 alone; * stands for titles without a definition.
    """
    below: dict = {}
    for x in items:
        below.setdefault((x["block_idx"], x["parent"]), []).append(x)

    def item(x, props):
        inner = below.get((x["block_idx"], x["item_id"]), [])
        found = {} if props is None else _properties((y["text"] for y in inner), props)
        return {"text": x["text"]} | ({"properties": found} if found else {"items": [item(y, None) for y in inner]} if inner else {})

    def build(part, level, titles):
        out, n = [], 0
        while n < len(part):
            head, n = part[n], n + 1
            if head["kind"] != "heading" or head["level"] != level:
                continue
            start = n
            while n < len(part) and not (part[n]["kind"] == "heading" and part[n]["level"] <= level):
                n += 1
            inside = part[start:n]
            direct = inside if level == 4 else inside[: next((k for k, b in enumerate(inside) if b["kind"] == "heading" and b["level"] == level + 1), len(inside))]
            props = titles.get(head["text"], titles.get("*"))
            own = [item(x, props) for b in direct for x in below.get((b["idx"], None), [])]
            content = "\n\n".join(b["md"] for b in direct).strip("\n")
            flat = _properties((x["text"] for x in own), props) if props is not None and all(len(x) == 1 for x in own) else {}
            at = {b["idx"] for b in direct}
            urls = [{"text": x["text"], "url": x["url"]} for x in links if x["block_idx"] in at]
            deeper = build(inside, level + 1, {}) if level < 4 else []
            pairs = {"content": content if not own else "", "properties": flat, "items": [] if flat else own, "links": urls, "subsections": deeper}
            out.append({"heading": head["text"]} | {k: v for k, v in pairs.items() if v})
        return out

    return build(blocks, 2, declared)


def _declared(schemas) -> dict:
    """Properties by section title of each schema folder and type."""
    schemas = {".": schemas} if isinstance(schemas, Schema) else schemas or {}
    declared: dict = {}
    for folder, s in schemas.items():
        for name, t in s.types.items():
            titles = declared.setdefault((folder, name), {})
            for d in (t.get("structure") or {}).get("sections") or []:
                titles.setdefault(d["title"], d.get("properties"))
    return declared


#: What an outline is made of.
OUTLINED = {"blocks": ("idx", "kind", "level", "text", "md"), "items": ("block_idx", "item_id", "parent", "text"), "links": ("block_idx", "text", "url", "is_image")}


def outline(schemas) -> tuple:
    """``more`` of ``tables.parse``: intro and sections as JSON, made where documents are parsed, so that blocks stay there.

    The batch needs schema_dir and path_type.
    """
    declared, encode = _declared(schemas), json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode

    def of(folder, fm_type, path_type):
        """The type, as ``resolve`` tells it."""
        name = path_type if fm_type is None else None if fm_type == "none" else fm_type
        return declared.get((folder, name), {})

    def rows(column, names):
        flat = zip(*(column.values.field(n).to_pylist() for n in names))
        ends = column.offsets.to_pylist()
        flat = [dict(zip(names, x)) for x in flat]
        return [flat[a:b] for a, b in zip(ends, ends[1:])]

    def run(batch, parsed):
        import pyarrow as pa

        known = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("schema_dir", "path_type")]
        intros, sections = [], []
        for folder, path_type, fm_type, blocks, items, links in zip(*known, parsed.column("fm_type").to_pylist(), *(rows(parsed.column(c), n) for c, n in OUTLINED.items())):
            start = next((b["idx"] for b in blocks if b["kind"] == "heading" and b["level"] == 1), -1)
            first = next((b["idx"] for b in blocks if b["idx"] > start and b["kind"] == "heading" and b["level"] == 2), len(blocks))
            intros.append("\n\n".join(b["md"] for b in blocks[start + 1 : first]))
            sections.append(encode(_sections(blocks[first:], [x for x in items if x["block_idx"] > first], [x for x in links if x["block_idx"] > first and not x["is_image"]], of(folder, fm_type, path_type))))
        return [pa.array(intros, pa.string()), pa.array(sections, pa.string())]

    return tuple(f"{c}.{n}" for c, names in OUTLINED.items() for n in names), "__intro string, __sections string", run


def _sections_json(schemas):
    """A function of schema folder, type, blocks, items and links."""
    declared = _declared(schemas)

    def run(folder, name, blocks, items, links):
        return json.dumps(_sections(blocks, items, links, declared.get((folder, name), {})), ensure_ascii=False, separators=(",", ":"))

    return F.udf(run, "string", useArrow=True)


def _outlined(docs: DataFrame, schemas) -> DataFrame:
    """Intro and sections of documents that are parsed already."""
    start = F.coalesce(F.get(F.filter("blocks", lambda b: (b.kind == "heading") & (b.level == 1)), F.lit(0)).idx, F.lit(-1))
    first = F.coalesce(F.get(F.filter("blocks", lambda b: (b.kind == "heading") & (b.level == 2) & (b.idx > F.col("__start"))), F.lit(0)).idx, F.size("blocks"))
    intro = F.array_join(F.transform(F.filter("blocks", lambda b: (b.idx > F.col("__start")) & (b.idx < F.col("__first"))), lambda b: b.md), "\n\n")
    # only what follows the first section's heading goes to Python
    body = F.transform(F.filter("blocks", lambda b: b.idx >= F.col("__first")), lambda b: F.struct(b.idx.alias("idx"), b.kind.alias("kind"), b.level.alias("level"), F.when(b.kind == "heading", b.text).alias("text"), b.md.alias("md")))
    items = F.transform(F.filter("items", lambda x: x.block_idx > F.col("__first")), lambda x: F.struct(x.block_idx.alias("block_idx"), x.item_id.alias("item_id"), x.parent.alias("parent"), x.text.alias("text")))
    links = F.transform(F.filter("links", lambda x: (x.block_idx > F.col("__first")) & ~x.is_image), lambda x: F.struct(x.block_idx.alias("block_idx"), x.text.alias("text"), x.url.alias("url")))
    folder = F.col("schema_dir") if "schema_dir" in docs.columns else F.lit(".")

    rows = docs.withColumn("__start", start).withColumn("__first", first).withColumn("__intro", intro)
    return rows.withColumn("__sections", _sections_json(schemas)(folder, F.col("doc_type"), body, items, links))


def document_json(docs: DataFrame, schemas=None) -> DataFrame:
    """(rel_path, json) of resolved documents: path, type, frontmatter, title, intro, sections with content, typed
    properties, items, links and subsections.

    An empty intro and empty parts of sections are left out; type and title are null if there is none. Content is left
    out where a section has items, items where they are the section's properties, sub-items where they are the item's.
    """
    fm = F.concat(F.lit("{"), F.array_join(F.concat(F.when(F.coalesce("fm_type", "doc_type").isNotNull(), F.array(F.concat(F.lit('"type":'), _quoted(F.coalesce("fm_type", "doc_type"))))).otherwise(F.array().cast("array<string>")), F.transform("fm", lambda e: F.concat(_quoted(e.key), F.lit(":"), e.json))), ","), F.lit("}"))
    rows = docs if "__sections" in docs.columns else _outlined(docs, schemas)
    whole = _object([
        ("path", _quoted(F.col("rel_path")), F.lit(True)), ("type", _quoted(F.col("doc_type")), F.lit(True)), ("frontmatter", fm, F.col("fm_present")), ("title", _quoted(F.col("title")), F.lit(True)),
        ("intro", _quoted(F.col("__intro")), F.col("__intro") != ""), ("sections", F.col("__sections"), F.lit(True)),
    ])
    return rows.select("rel_path", whole.alias("json"))


def reachable(docs: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(rel_path, depth) of documents within so many local .md links of the seeds, each once at its least depth.

    One frontier join for each level: links ⋈ frontier, semi-joined with what exists, anti-joined with what was seen.
    """
    edges = materialise(tables.links(docs).where("NOT is_image AND target LIKE '%.md'").select("rel_path", "target"))
    there = docs.select(F.col("rel_path").alias("target"))
    seen = materialise(seeds.select("rel_path").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for k in range(1, depth + 1):
        step = edges.join(frontier.select("rel_path"), "rel_path").select("target").distinct().join(there, "target", "left_semi")
        frontier = step.join(seen.select(F.col("rel_path").alias("target")), "target", "left_anti").select(F.col("target").alias("rel_path"), F.lit(k).alias("depth"))
        frontier = materialise(frontier)  # or each level would work out all levels before it again
        seen = seen.union(frontier)
    return seen
