"""Diagnostics; (rel_path, code, line, message, fixable).

Rules within a document are arrays of its own row, so that all of them take one pass; links are joined.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from vellum.functions.columns import ENTRY_HEADING, entry_key, month_title, parse_date, parse_datetime, template_regex
from vellum.operators import tables
from vellum.functions.markdown import Document, render_block
from vellum.sources.schema import Schema

FIXABLE = {"MissingH1", "H1Mismatch", "SectionOutOfOrder", "SectionsOutOfOrder", "SectionNotBullets", "WrongListType", "SectionNeedsIntro", "ManagedSectionNeedsUpdate", "EntriesOutOfOrder", "EmptyOptionalSection"}


def _out(rows: DataFrame, code: str, message: Column, line: Column | None = None) -> DataFrame:
    return rows.select("rel_path", F.lit(code).alias("code"), (F.lit(None) if line is None else line).cast("int").alias("line"), message.alias("message"), F.lit(code in FIXABLE).alias("fixable"))


def _hit(code: str, message: Column, line: Column | None = None) -> Column:
    """One diagnostic of a document."""
    return F.struct(F.lit(code).alias("code"), (F.lit(None) if line is None else line).cast("int").alias("line"), message.alias("message"), F.lit(code in FIXABLE).alias("fixable"))


_HITS = "array<struct<code:string,line:int,message:string,fixable:boolean>>"


def _if(test: Column, hit: Column) -> Column:
    return F.when(test, F.array(hit))


def _each(rows: Column, hit) -> Column:
    return F.transform(rows, hit)


def _all(hits: list[Column]) -> Column:
    """Arrays of diagnostics, some of them null, as one."""
    none = F.array().cast(_HITS)
    return F.concat(none, *(F.coalesce(h.cast(_HITS), none) for h in hits))


def _by_type(schema: Schema, rule) -> Column:
    """What a rule of (name, type) finds in documents of that type with front matter."""
    out = None
    for name, t in schema.types.items():
        if hits := rule(name, t):
            own = (F.col("doc_type") == name) & F.col("fm_present")
            out = F.when(own, _all(hits)) if out is None else out.when(own, _all(hits))
    return F.array().cast(_HITS) if out is None else out


def _found(docs: DataFrame, hits: Column) -> DataFrame:
    # an outer explode, since for an inner one the array is worked out once more to filter by its size
    return docs.select("rel_path", F.explode_outer(hits).alias("x")).where("x IS NOT NULL").select("rel_path", "x.code", "x.line", "x.message", "x.fixable")


def _bound(c: Column, use) -> Column:
    """``use`` of a column's value, which is worked out once."""
    return F.transform(F.array(c), lambda v: use(v))[0]


def _typed(kind: Column, value: Column, d: dict) -> Column:
    """The complaint about one value, or null."""
    t = d["type"]
    got = F.concat(F.lit("expected "), F.lit(t), F.lit(", got "), kind)
    if t in ("string", "link"):
        return F.when(kind != "string", got)
    if t in ("date", "datetime"):
        ok = (parse_date if t == "date" else parse_datetime)(value).isNotNull()
        return F.when(kind != "string", got).when(~ok, F.concat(F.lit(f"invalid {t} '"), value, F.lit("'")))
    if t == "integer":
        return F.when(kind != "int", got)
    if t == "float":
        return F.when(~kind.isin("int", "float"), got)
    if t == "bool":
        return F.when(kind != "bool", got)
    allowed = [str(v) for v in d.get("values") or []]
    return F.when(kind != "string", got).when(F.lit(bool(allowed)) & ~value.isin(*allowed), F.concat(F.lit("invalid value '"), value, F.lit(f"' (allowed: {', '.join(allowed)})")))


def _field(key: str) -> Column:
    return F.get(F.filter("fm", lambda x: x.key == key), F.lit(0))


def _titled(headings: Column, title: str) -> Column:
    return F.get(F.filter(headings, lambda b: b.text == title), F.lit(0))


def _falls_to(title: Column, d: dict, defs: list[dict]) -> Column:
    """Whether a section has this definition: by its title, or * if no other definition has that."""
    return ~title.isin(*[x["title"] for x in defs]) if d["title"] == "*" else title == d["title"]


def _mode(d: dict):
    return d.get("bullets") or ("unordered" if d.get("template") else None)


def _only_lists(rows: Column, label, mode) -> list[Column]:
    """Blocks of an array that aren't lists, or lists of the other kind; ``label`` of a block says where."""
    out = [_each(F.filter(rows, lambda b: b.kind != "list"), lambda b: _hit("SectionNotBullets", F.concat(label(b), F.lit(": only bullet lists are allowed here")), b.line))]
    if mode in ("ordered", "unordered"):
        out.append(_each(F.filter(rows, lambda b: (b.kind == "list") & (b.ordered == F.lit(mode != "ordered"))), lambda b: _hit("WrongListType", F.concat(label(b), F.lit(f": expected {mode} list")), b.line)))
    return out


def _intro_hits(name: str, t: dict) -> list[Column]:
    mode = _mode((t.get("structure") or {}).get("intro") or {})
    if not mode:
        return []
    at = lambda level: F.get(F.filter("blocks", lambda b: (b.kind == "heading") & (b.level == level)), F.lit(0)).idx
    ends = F.struct(at(1).alias("h1"), F.coalesce(at(2), F.size("blocks")).alias("h2"))
    inside = _bound(ends, lambda e: F.filter("blocks", lambda b: (b.idx > e.h1) & (b.idx < e.h2)))
    return _only_lists(inside, lambda b: F.lit("intro"), mode)


def intros(docs: DataFrame, schema: Schema) -> DataFrame:
    """Blocks between the title and the first section where only lists are allowed."""
    return _found(docs, _by_type(schema, _intro_hits))


def _field_hits(name: str, t: dict) -> list[Column]:
    out = []
    for key, d in (t.get("fields") or {}).items():

        def complaints(e, key=key, d=d):
            hits, there = [], e.isNotNull() & (e.kind != "null")
            if d.get("required"):
                missing = e.isNull()
                if key.startswith("type"):
                    missing = missing & (F.col("resolution") != "path")
                hits.append(_if(missing, _hit("MissingRequiredField", F.lit(f"missing required field '{key}'"), F.lit(1))))
            if d["type"] == "list":
                hits.append(_if(there & (e.kind != "list"), _hit("InvalidFieldType", F.concat(F.lit(f"field '{key}': expected list, got "), e.kind), F.lit(1))))
                if d.get("item_type"):
                    bad = lambda x: F.when(x.kinds == "list", F.lit("nested lists are not supported")).otherwise(_typed(x.kinds, x.vals, {"type": d["item_type"], "values": d.get("values")}))
                    each = F.transform(F.arrays_zip(e.vals.alias("vals"), e.kinds.alias("kinds")), lambda x, i: F.struct(i.alias("i"), bad(x).alias("bad")))
                    hits.append(F.when(there & (e.kind == "list"), _each(F.filter(each, lambda x: x.bad.isNotNull()), lambda x: _hit("InvalidFieldType", F.concat(F.lit(f"field '{key}["), x.i.cast("string"), F.lit("]': "), x.bad), F.lit(1)))))
            else:
                bad = F.when(there, _typed(e.kind, F.get(e.vals, F.lit(0)), d))
                hits.append(_bound(bad, lambda b: _if(b.isNotNull(), _hit("InvalidFieldType", F.concat(F.lit(f"field '{key}': "), b), F.lit(1)))))
            return _all(hits)

        out.append(_bound(_field(key), complaints))
    return out


def fields(docs: DataFrame, schema: Schema) -> DataFrame:
    """Missing and badly typed front matter fields. Null values are accepted; undeclared fields ignored."""
    return _found(docs, _by_type(schema, _field_hits))


def _union(docs: DataFrame, parts: list[DataFrame]) -> DataFrame:
    empty = docs.sparkSession.createDataFrame([], "rel_path string, code string, line int, message string, fixable boolean")
    return reduce(DataFrame.unionByName, parts, empty)


def expected_title(mode: str) -> Column:
    if mode == "from_filename":
        return F.col("stem")
    if mode == "from_directory":
        return F.col("parent_name")
    if mode == "from_project":
        return F.coalesce(F.get(F.filter("fm", lambda e: (e.key == "name") & (e.kind == "string")), F.lit(0)).vals[0], F.col("stem"))
    if mode == "from_date":
        return F.coalesce(month_title(F.col("stem")), F.lit(""))
    return F.lit(mode)


def _title_hits(name: str, t: dict) -> list[Column]:
    mode = (t.get("structure") or {}).get("title") or "none"
    if mode == "none":
        return []
    want, title = F.lit("") if mode == "required" else expected_title(mode), F.col("title")
    out = [_if(title.isNull(), _hit("MissingH1", F.concat(F.lit("document is missing H1 title '"), want, F.lit("'"))))]
    if mode != "required":
        out.append(_if(title.isNotNull() & (title != want), _hit("H1Mismatch", F.concat(F.lit("H1 '"), title, F.lit("' does not match expected '"), want, F.lit("'")), F.col("h1_line"))))
    return out


def titles(docs: DataFrame, schema: Schema) -> DataFrame:
    return _found(docs, _by_type(schema, _title_hits))


def _h2() -> Column:
    return F.filter("blocks", lambda b: (b.kind == "heading") & (b.level == 2))


def _date_hits(name: str, t: dict) -> list[Column]:
    st = t.get("structure") or {}
    if st.get("date_headings") is None:
        return []
    keyed = F.transform(_h2(), lambda b: F.struct(entry_key(b.text).alias("key"), b.text.alias("text"), b.line.alias("line")))

    def complaints(h):
        hits = [_each(F.filter(h, lambda b: b.key.isNull()), lambda b: _hit("InvalidDateHeading", F.concat(F.lit("'"), b.text, F.lit("' is not a valid date heading (expected YYYY-MM-DD or YYYY-MM-DD HH:MM, optionally followed by ' - title')")), b.line))]
        if st.get("title") == "from_date":
            other = F.filter(h, lambda b: b.key.isNotNull() & (F.left(b.key, F.lit(7)) != F.col("stem")))
            hits.append(_each(other, lambda b: _hit("DateHeadingFileMismatch", F.concat(F.lit("date heading '"), b.text, F.lit("' doesn't match file period '"), F.col("stem"), F.lit("'")), b.line)))
        keys = F.transform(F.filter(h, lambda b: b.key.isNotNull()), lambda b: b.key)
        want = F.sort_array(keys, asc=(st["date_headings"] or {}).get("sort") == "oldest_first")
        return _all([*hits, _if(keys != want, _hit("EntriesOutOfOrder", F.lit("date entries are not in the expected order")))])

    return [_bound(keyed, complaints)]


def date_headings(docs: DataFrame, schema: Schema) -> DataFrame:
    """Shape of date headings, their period, and their order."""
    return _found(docs, _by_type(schema, _date_hits))


def _section_hits(name: str, t: dict) -> list[Column]:
    st = t.get("structure") or {}
    defs = st.get("sections") or []
    if not defs or st.get("date_headings") is not None:
        return []
    titles_ = [d["title"] for d in defs]
    order = F.create_map(*[x for i, n in enumerate(titles_) for x in (F.lit(n), F.lit(i))])

    def complaints(h2):
        out = []
        if st.get("strict_sections", True):
            out.append(_each(F.filter(h2, lambda b: ~b.text.isin(*titles_)), lambda b: _hit("UnexpectedSection", F.concat(F.lit("unexpected section '"), b.text, F.lit(f"' (allowed: {', '.join(titles_)})")), b.line)))
            placed = F.transform(F.filter(h2, lambda b: b.text.isin(*titles_)), lambda b: F.struct(order[b.text].alias("at"), b.text.alias("text"), b.line.alias("line")))
            wrong = _bound(placed, lambda p: F.filter(p, lambda b, i: (i > 0) & (b.at < F.get(p, i - 1).at)))
            out.append(_bound(wrong, lambda w: _all([_each(w, lambda b: _hit("SectionOutOfOrder", F.concat(F.lit("section '"), b.text, F.lit("' appears out of order")), b.line)), _if(F.size(w) > 0, _hit("SectionsOutOfOrder", F.lit("sections are out of order")))])))
        for d in defs:
            if d.get("required", True) and d["title"] != "*":
                out.append(_if(~F.exists(h2, lambda b: b.text == d["title"]), _hit("MissingSection", F.lit(f"required section '{d['title']}' is missing"))))
            mode = _mode(d)
            if mode:
                rows = F.filter("blocks", lambda b: ((b.kind != "heading") | (b.level != 2)) & _falls_to(F.nullif(b.section_title, F.lit("")), d, defs))
                label = lambda b: F.concat(F.lit("section '"), b.section_title, F.lit("'"))
                out.append(_bound(rows, lambda r: _all(_only_lists(r, label, mode))))
            if d.get("template"):
                bad = F.filter("items", lambda x: _falls_to(x.section_title, d, defs) & ~F.concat(F.lit("- "), x.md).rlike(template_regex(d["template"])))
                out.append(_each(bad, lambda x: _hit("TemplateMismatch", F.concat(F.lit("section '"), x.section_title, F.lit(f"': item doesn't match template '{d['template']}'")))))
            if d.get("intro_text"):
                heads = F.filter(h2, lambda b: _falls_to(b.text, d, defs))
                first = lambda h: F.get(F.filter("blocks", lambda b: b.idx == h.idx + 1), F.lit(0))
                bare = lambda h: _bound(first(h), lambda f: F.coalesce(~((f.kind == "paragraph") & f.text.startswith(d["intro_text"])), F.lit(True)))
                out.append(_each(F.filter(heads if d["title"] == "*" else F.slice(heads, 1, 1), bare), lambda h: _hit("SectionNeedsIntro", F.lit(f"section is missing required intro paragraph starting with '{d['intro_text']}'"), h.line)))
        optional = [d["title"] for d in defs if not d.get("required", True)]
        if optional:
            empty = F.exists(h2, lambda b: b.text.isin(*optional) & F.coalesce(F.get(F.filter("blocks", lambda x: x.idx == b.idx + 1), F.lit(0)).kind == "heading", F.lit(True)))
            out.append(_if(empty, _hit("EmptyOptionalSection", F.lit("empty optional section(s) will be removed"))))
        return _all(out)

    return [_bound(_h2(), complaints)]


def sections(docs: DataFrame, schema: Schema) -> DataFrame:
    """Unexpected, missing and misplaced sections, empty optional ones, list rules, templates and intros."""
    return _found(docs, _by_type(schema, _section_hits))


def _managed_hits(name: str, t: dict) -> list[Column]:
    out = []
    for d in (t.get("structure") or {}).get("sections") or []:
        if not d.get("managed_content"):
            continue
        blocks = Document(d["managed_content"]["template"]).blocks
        want = ["\n".join(render_block(b)) for b in blocks]
        at = F.get(F.filter(_h2(), lambda b: F.lower(b.text) == d["title"].lower()), F.lit(0)).idx
        end = lambda a: F.coalesce(F.get(F.filter(_h2(), lambda b: b.idx > a), F.lit(0)).idx, F.size("blocks"))
        have = lambda e: F.transform(F.filter("blocks", lambda b: (b.idx >= e.at) & (b.idx < e.end)), lambda b: b.md)

        def differs(have, blocks=blocks, want=want):
            last = F.get(have, F.lit(len(want) - 1))
            same = F.slice(have, 1, len(want) - 1) == F.array(*map(F.lit, want[:-1])) if len(want) > 1 else F.lit(True)
            mark = f"{len(blocks[-1]['items']) + 1}. " if blocks[-1].get("ordered") else "- "
            ends = (last == want[-1]) | (last.startswith(want[-1] + "\n" + mark) if blocks[-1]["kind"] == "list" else F.lit(False))
            return ~F.coalesce(same & ends, F.lit(False))

        place = _bound(at, lambda a: F.struct(a.alias("at"), end(a).alias("end")))
        bad = _bound(place, lambda e: e.at.isNull() | _bound(have(e), differs))
        out.append(_if(bad, _hit("ManagedSectionNeedsUpdate", F.lit("managed section needs to be updated"))))
    return out


def managed_sections(docs: DataFrame, schema: Schema) -> DataFrame:
    """Managed sections that are missing, go by an older name, or differ from their template.

    A section's rendered blocks are compared with the template's; the last list may have more items than there.
    """
    return _found(docs, _by_type(schema, _managed_hits))


def _property(value: Column, d: dict) -> Column:
    """The complaint about one property's text, or null."""
    got = lambda what: F.concat(F.lit(f"must be {what} (got '"), value, F.lit("')"))
    t = d["type"]
    if t == "integer":
        number = value.try_cast("decimal(38,0)")
        fits = value.rlike("^[+-]?[0-9]+$") & number.between(Decimal(-(2**63)), Decimal(2**64 - 1))
        return F.when(~F.coalesce(fits, F.lit(False)), got("an integer"))
    if t == "float":
        return F.when(~value.rlike(r"(?i)^[+-]?(inf(inity)?|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"), got("a number"))
    if t == "bool":
        return F.when(~F.lower(value).isin("true", "false", "yes", "no"), got("a boolean"))
    if t in ("date", "datetime"):
        return F.when((parse_date if t == "date" else parse_datetime)(value).isNull(), got(f"a valid {t}"))
    if t == "enum" and d.get("values"):
        allowed = [str(v) for v in d["values"]]
        return F.when(~value.isin(*allowed), got(f"one of: {', '.join(allowed)}"))
    if t == "list":
        return F.lit("list type not supported for properties")
    return F.lit(None).cast("string")


def _property_hits(name: str, t: dict) -> list[Column]:
    out = []
    defs = (t.get("structure") or {}).get("sections") or []
    pair = lambda x: F.struct(F.lower(F.trim(F.substring_index(x.text, ": ", 1))).alias("k"), F.trim(F.substring(x.text, F.instr(x.text, ": ") + 2, F.length(x.text))).alias("v"))
    for d in defs:
        declared = d.get("properties") or {}
        if not declared or d.get("managed_content"):
            continue

        def group(h, pairs, declared=declared):
            hits = []
            for key, p in declared.items():

                def complaints(value, key=key, p=p):
                    bad = _bound(F.when(value.isNotNull(), _property(value, p)), lambda b: _if(b.isNotNull(), _hit("InvalidFieldType", F.concat(F.lit("field '"), h.text, F.lit(f"/{key}': "), b), h.line)))
                    missing = [_if(value.isNull(), _hit("MissingRequiredField", F.concat(F.lit("missing required field '"), h.text, F.lit(f"/{key}'")), h.line))] if p.get("required") else []
                    return _all([bad, *missing])

                own = F.filter(pairs, lambda x: x.k == key)  # noqa: B023
                hits.append(_bound(own, lambda o: _bound(F.when(F.size(o) > 0, F.get(o, F.size(o) - 1).v), complaints)))  # noqa: B023
            return _all(hits)

        def section(h, group=group):
            later = F.filter("blocks", lambda b: (b.kind == "heading") & (b.level <= 2) & (b.idx > h.idx))
            end = F.coalesce(F.get(later, F.lit(0)).idx, F.size("blocks"))
            inside = _bound(end, lambda e: F.filter("items", lambda x: (x.block_idx > h.idx) & (x.block_idx < e)))

            def groups(inside):
                def of(top):
                    flat = (F.size(top) > 0) & F.forall(top, lambda x: ~x.has_children & F.contains(x.text, F.lit(": ")))
                    sub = lambda x: F.transform(F.filter(inside, lambda y: (y.parent == x.item_id) & (y.depth == 1) & F.contains(y.text, F.lit(": "))), pair)
                    return F.when(flat, F.array(F.transform(top, pair))).otherwise(F.transform(top, sub))

                return _bound(F.filter(inside, lambda x: x.parent.isNull()), of)

            return F.flatten(F.transform(_bound(inside, groups), lambda pairs: group(h, pairs)))

        heads = F.filter(_h2(), lambda b: _falls_to(b.text, d, defs))  # noqa: B023
        out.append(F.flatten(F.transform(heads, lambda h: section(h))))  # noqa: B023
    return out


def properties(docs: DataFrame, schema: Schema) -> DataFrame:
    """Properties of items by their Key: Value sub-items, or of a section whose items are all such lines themselves.

    Of a repeated key the last value counts. Rows are on the section's heading; a group is one section's items.
    """
    return _found(docs, _by_type(schema, _property_hits))


def broken_links(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Local links whose target is neither a document nor a known path: an anti join."""
    there = docs.select(F.col("rel_path").alias("target"))
    there = there if known is None else there.union(known.select(F.col("path").alias("target")))
    bad = tables.links(docs.where("fm_present AND doc_type IS NOT NULL")).where("target IS NOT NULL").join(there.distinct(), "target", "left_anti")
    return _out(bad, "UnknownType", F.concat(F.lit("broken link: '"), "url", F.lit("'")), F.col("line"))


def section_links(docs: DataFrame, schema: Schema) -> DataFrame:
    """Target types of links, and backlinks: the edges joined with themselves the other way round."""
    out, edges = [], None
    kinds = docs.select(F.col("rel_path").alias("target"), F.col("doc_type").alias("target_type"), "fm_type")
    for name, t in schema.types.items():
        defs = (t.get("structure") or {}).get("sections") or []
        for d in defs:
            want = (d.get("links") or {}).get("target_type")
            if not want:
                continue
            edges = tables.links(docs) if edges is None else edges
            own = edges.where(_falls_to(F.col("section_title"), d, defs)).join(docs.where((F.col("doc_type") == name) & F.col("fm_present")).select("rel_path"), "rel_path", "left_semi")
            own = own.join(kinds, "target")
            wrong = own.where(F.coalesce(F.col("target_type"), F.lit("")) != want)
            tail = F.when(F.col("target_type").isNull(), ", but target has no type").otherwise(F.concat(F.lit(", got '"), "target_type", F.lit("'")))
            out.append(_out(wrong, "LinkTargetTypeMismatch", F.concat(F.lit("link '"), "url", F.lit(f"' must target type '{want}'"), tail)))
            if d["links"].get("bidirectional"):
                back = [s["title"] for s in (schema.types.get(want, {}).get("structure") or {}).get("sections") or [] if (s.get("links") or {}).get("target_type") == name]
                reverse = edges.where(F.col("section_title").isin(*back)).select(F.col("rel_path").alias("target"), F.col("target").alias("rel_path")).distinct()
                names = "' or '".join(back)
                miss = own.where(F.col("target_type") == want).join(reverse, ["target", "rel_path"], "left_anti")
                out.append(_out(miss, "MissingBacklink", F.concat(F.lit("link to '"), "url", F.lit(f"' requires a backlink in section '{names}'"))))
    return _union(docs, out)


def _type_hits(schema: Schema) -> Column:
    out, col = [], F.col
    for name, t in schema.types.items():
        limit = (t.get("structure") or {}).get("size_warning")
        if limit:
            out.append(_if((col("doc_type") == name) & (col("size_bytes") > limit), _hit("FileTooLarge", F.concat(F.lit("file is "), col("size_bytes").cast("string"), F.lit(f" bytes, exceeding the {limit}-byte warning threshold")), F.lit(1))))
    known = ", ".join(sorted(schema.types))
    out.append(_if((col("resolution") == "unknown") & col("fm_type").isNotNull(), _hit("UnknownType", F.concat(F.lit("unknown type '"), col("fm_type"), F.lit(f"' (valid types: {known})")), F.lit(1))))
    out.append(_if(col("resolution") == "conflict", _hit("UnknownType", F.concat(F.lit("file matches path patterns from multiple types: "), F.array_join("path_types", ", ")), F.lit(0))))
    unreadable = col("fm_error").isNotNull() & col("resolution").isin("unknown", "path")
    error = _hit("UnknownType", F.concat(F.lit("frontmatter parse error: "), col("fm_error")), F.lit(1))
    if schema.folder and schema.types:  # presets alone don't cover files that none of them matches
        out.append(_if(~col("fm_present") & (col("resolution") == "unknown") & ~unreadable, _hit("MissingFrontmatter", F.lit("document is missing frontmatter"))))
        out.append(_if(col("fm_present") & col("fm_type").isNull() & (col("resolution") == "unknown"), _hit("MissingRequiredField", F.lit(f"missing required field 'type (valid types: {known})'"), F.lit(1))))
        out.append(_if(unreadable, error))
    else:
        out.append(_if(unreadable & (col("resolution") == "path"), error))
    required = [n for n, t in schema.types.items() if any(d.get("required") for d in (t.get("fields") or {}).values())]
    bare = ~col("fm_present") & (col("resolution") == "path") & ~unreadable & (col("doc_type").isin(*required) if required else F.lit(False))
    out.append(_if(bare, _hit("MissingFrontmatter", F.concat(F.lit("file matched type '"), col("doc_type"), F.lit("' by path but is missing required frontmatter fields")))))
    return _all(out)


def sizes_and_types(docs: DataFrame, schema: Schema) -> DataFrame:
    return _found(docs, _type_hits(schema))


def _spaced_hits() -> Column:
    return F.when(F.col("resolution") != "opted_out", _each(F.col("malformed"), lambda x: _hit("MalformedLink", F.concat(F.lit("link '"), x.url, F.lit("' contains an unencoded space (use %20 or rename the file)")), x.line)))


def spaced_links(docs: DataFrame) -> DataFrame:
    """Links with an unencoded space, outside front matter, fences and code spans; documents may opt out of types."""
    return _found(docs, _spaced_hits())


def with_hits(docs: DataFrame, schema: Schema) -> DataFrame:
    """Documents with all that the rules find within them as an array ``hits``, which ``check`` takes as it is: to be
    written with the columns that links need, in place of the parsed ones."""
    rules = (_field_hits, _title_hits, _intro_hits, _date_hits, _section_hits, _managed_hits, _property_hits)
    within = _by_type(schema, lambda name, t: [h for rule in rules for h in rule(name, t)])
    return docs.withColumn("hits", _all([_type_hits(schema), within, _spaced_hits()]))


#: What ``check`` reads of documents that have ``hits``.
LINKED = ("rel_path", "dir", "fm_present", "fm_type", "doc_type", "links", "hits")


def schema_errors(docs: DataFrame, schema: Schema) -> DataFrame:
    """What is wrong with the schema itself, on its folder."""
    rows = [(schema.folder, "UnknownType", 0, e, False) for e in schema.errors]
    return docs.sparkSession.createDataFrame(rows, "rel_path string, code string, line int, message string, fixable boolean")


def check(docs: DataFrame, schema: Schema, known: DataFrame | None = None) -> DataFrame:
    """All diagnostics of resolved documents. Persist or write ``docs`` before: links are read several times."""
    docs = docs if "hits" in docs.columns else with_hits(docs, schema)
    return _union(docs, [schema_errors(docs, schema), _found(docs, F.col("hits")), broken_links(docs, known), section_links(docs, schema)])


def report(diagnostics: DataFrame) -> DataFrame:
    """path:line:  message"""
    line = F.when(F.col("line").isNull(), "").otherwise(F.concat(F.lit(":"), F.col("line").cast("string")))
    return diagnostics.select(F.concat("rel_path", line, F.lit(":  "), "message").alias("text"))
