"""Rewriting documents: what can be fixed is fixed on the parsed blocks, then the file is serialised afresh."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from vellum.functions import markdown as M
from vellum.sources.schema import Schema


def _split(blocks: list[dict]) -> tuple[list[dict], list[list[dict]]]:
    """What comes before the first level-2 heading, and the sections."""
    at = [k for k, b in enumerate(blocks) if b["kind"] == "heading" and b["level"] == 2] + [len(blocks)]
    return blocks[: at[0]], [blocks[a:b] for a, b in zip(at, at[1:], strict=False)]


def _name(section: list[dict]) -> str:
    return M.plain(section[0]["inlines"])


def _managed(parts: list[list[dict]], name: str, managed: dict) -> list[list[dict]]:
    """Sections with a managed one brought up to its template: in place of its older names, or at the end.

    What its author put behind the template's blocks, or behind the items of its last list, is kept.
    """
    want = M.Document(managed["template"]).blocks
    lower = [_name(p).lower() for p in parts]
    old = [n.lower() for n in managed.get("migrate_from") or []]
    at = [k for k, n in enumerate(lower) if n == name.lower()][:1]
    legacy = [] if at else [k for k, n in enumerate(lower) if n in old]
    if not at and not legacy:
        return [*parts, want]
    first, last = (at or legacy)[0], (at or legacy)[-1]
    have = [b for p in parts[first : last + 1] for b in p]
    own = have[len(want) :]
    end, held = want[-1], have[len(want) - 1] if len(have) >= len(want) else {}
    if end["kind"] == "list" == held.get("kind") and end["ordered"] == held["ordered"] and len(held["items"]) > len(end["items"]):
        more = held["items"][len(end["items"]) :]
        if not legacy and [M.render_block(b) for b in (*have[: len(want) - 1], {**held, "items": held["items"][: len(end["items"])]})] == [M.render_block(b) for b in want]:
            return parts
        own = [*own, {"kind": "list", "ordered": held["ordered"], "items": more, "line": 0}]
    elif not legacy and [M.render_block(b) for b in have[: len(want)]] == [M.render_block(b) for b in want]:
        return parts
    return [*parts[:first], [*want, *own], *parts[last + 1 :]]


def fix_document(content: str, t: dict, title: str | None) -> str:
    """The text with all fixes of its type: order first, then the rest, so that no fix is lost."""
    doc = M.Document(content)
    if doc.front_error:  # rewriting would lose what couldn't be read
        return content
    st = t.get("structure") or {}
    if doc.front_present:
        head, parts = _split(doc.blocks)
        defs = {d["title"]: (k, d) for k, d in enumerate(st.get("sections") or [])}
        if st.get("date_headings") is not None:
            dated = [(m, p) for p in parts if (m := re.match(r"(?s)^([0-9]{4}-[0-9]{2}-[0-9]{2})(?: ([0-9]{2}:[0-9]{2}))?(?: - (.*))?$", _name(p)))]
            first = next((k for k, p in enumerate(parts) if any(p is q for _, q in dated)), len(parts))
            # what isn't dated stays before, or with the entry that it follows
            entries: list[tuple] = []
            for p in parts[first:]:
                m = next((m for m, q in dated if q is p), None)
                if m:
                    entries.append(((m[1], m[2] or "99:99"), [p]))
                else:
                    entries[-1][1].append(p)
            entries.sort(key=lambda e: e[0], reverse=(st["date_headings"] or {}).get("sort") != "oldest_first")
            parts = parts[:first] + [p for _, own in entries for p in own]
        elif defs:
            known = [defs[_name(p)][0] for p in parts if _name(p) in defs]
            if st.get("strict_sections", True) and known != sorted(known):
                parts = sorted(parts, key=lambda p: defs[_name(p)][0] if _name(p) in defs else len(defs))
            kept = []
            for p in parts:
                d = defs.get(_name(p), (0, None))[1]
                if d and not d.get("required", True) and len(p) == 1:
                    continue
                mode = d and (d.get("bullets") or ("unordered" if d.get("template") else None))
                body = p[1:]
                if d and d.get("intro_text") and not (body and body[0]["kind"] == "paragraph" and M.plain(body[0]["inlines"]).startswith(d["intro_text"])):
                    body = [{"kind": "paragraph", "inlines": [("text", d["intro_text"])], "line": 0}, *body]
                if mode:
                    body = [{"kind": "list", "ordered": mode == "ordered", "items": [{"inlines": b["inlines"], "children": []}], "line": 0} if b["kind"] == "paragraph" else {**b, "ordered": mode == "ordered"} if b["kind"] == "list" and mode in ("ordered", "unordered") else b for b in body]
                kept.append([p[0], *body])
            parts = kept
            for name, (_, d) in defs.items():
                if managed := d.get("managed_content"):
                    parts = _managed(parts, name, managed)
        doc.blocks = head + [b for p in parts for b in p]
        if title:
            h1 = next((b for b in doc.blocks if b["kind"] == "heading" and b["level"] == 1), None)
            if h1 is None:
                doc.blocks.insert(0, {"kind": "heading", "level": 1, "inlines": [("text", title)], "line": 0})
            elif M.plain(h1["inlines"]) != title:
                h1["inlines"] = [("text", title)]
    return M.serialise(doc, list((t.get("fields") or {})))


def format_documents(corpus: DataFrame, schema: Schema) -> DataFrame:
    """(rel_path, doc_type, formatted, changed) of covered documents; others come back as they are.

    corpus: rel_path, stem, parent_name, content and path_type. One Python pass over each file, nothing shuffled.
    """
    types = schema.types

    def run(batches):
        import datetime

        for b in batches:
            rows = b.to_pylist()
            kinds, texts = [], []
            for r in rows:
                doc = M.Document(r["content"] or "")
                kind = doc.doc_type if doc.doc_type in types else None if doc.doc_type else r["path_type"]
                t = types.get(kind)
                kinds.append(kind)
                if t is None or r["content"] is None:
                    texts.append(r["content"])
                    continue
                mode = (t.get("structure") or {}).get("title") or "none"
                if mode == "from_date":
                    m = re.fullmatch(r"([0-9]{4})-(0[1-9]|1[0-2])", r["stem"])
                    title = datetime.date(int(m[1]), int(m[2]), 1).strftime("%B %Y") if m else None
                else:
                    name = doc.fields.get("name")
                    title = {"from_filename": r["stem"], "from_directory": r["parent_name"], "from_project": name if isinstance(name, str) else r["stem"], "none": None, "required": None}.get(mode, mode)
                texts.append(fix_document(r["content"], t, title))
            yield pa.RecordBatch.from_arrays([pa.array([r["rel_path"] for r in rows], pa.string()), pa.array(kinds, pa.string()), pa.array(texts, pa.string()), pa.array([x != r["content"] for x, r in zip(texts, rows, strict=True)])], ["rel_path", "doc_type", "formatted", "changed"])

    return corpus.select("rel_path", "stem", "parent_name", "content", "path_type").mapInArrow(run, "rel_path string, doc_type string, formatted string, changed boolean")
