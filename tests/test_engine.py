import os

import pytest

from vellum.operators import tables, validate
from vellum.operators.query import Query
from vellum.operators.resolve import resolve
from vellum.sources import corpus
from vellum.sources.schema import schema

TYPES = {"note": "paths: ['notes/*.md']\nfields:\n  n: {type: integer, required: true}\n  l: {type: list, item_type: date}\n", "other": "paths: ['x/*.md']\n"}


def _files(spark, rows):
    return corpus.with_path_columns(spark.createDataFrame(rows, "rel_path string, content string"))


def test_resolution_and_fields(spark):
    s = schema(TYPES)
    docs = resolve(tables.parse(_files(spark, [("notes/a.md", "---\nn: 5\nl: [2024-01-01, x, [1]]\n---\n"), ("notes/b.md", '---\nn: "5"\n---\n'), ("notes/c.md", None), ("y.md", "---\ntype: none\n---\n"), ("z.md", "---\ntype: nope\n---\n"), ("q.md", "---\ntype: note\n---\n")])), s)
    got = {r.rel_path: (r.resolution, r.doc_type) for r in docs.collect()}
    assert got == {"notes/a.md": ("path", "note"), "notes/b.md": ("path", "note"), "notes/c.md": ("path", "note"), "y.md": ("opted_out", None), "z.md": ("unknown", None), "q.md": ("explicit", "note")}
    found = {(r.rel_path, r.message) for r in validate.check(docs, s).collect()}
    assert found == {("notes/a.md", "field 'l[1]': invalid date 'x'"), ("notes/a.md", "field 'l[2]': nested lists are not supported"), ("notes/b.md", "field 'n': expected integer, got string"), ("notes/c.md", "file matched type 'note' by path but is missing required frontmatter fields"), ("z.md", "unknown type 'nope' (valid types: note, other)"), ("q.md", "missing required field 'n'")}


def test_query_errors(spark):
    q = Query(_files(spark, [("a.md", "x")]), schema(TYPES))
    with pytest.raises(ValueError, match="unknown type"):
        q.type("zzz")
    with pytest.raises(ValueError, match="key=value"):
        q.property("abc")


def test_last_does_not_parse(spark):
    q = Query(_files(spark, [("2024-01-01.md", "x"), ("2024-02-01.md", "y"), ("n.md", "z")]), schema(TYPES)).last(2).paths()
    assert [r.rel_path for r in q.collect()] == ["2024-02-01.md", "2024-01-01.md"]
    assert "MapInArrow" not in q._jdf.queryExecution().toString()


def test_malformed_links(spark):
    text = "---\nx: '[a](b c)'\n---\n[x](a b.md) `[n](o p)` [t](u \"v\")\n    ```\n[x](c d.md)\n```\n~~~\n[y](e\tf.md)\n[ok](a%20b.md)\n"
    docs = resolve(tables.parse(_files(spark, [("a.md", text)])), schema(TYPES))
    assert [(r.line, r.message.split("'")[1]) for r in validate.spaced_links(docs).collect()] == [(4, "a b.md"), (4, 'u "v"'), (9, "e\tf.md")]


def test_walk(spark, tmp_path):
    for p in (".dot/a.md", "b/c.md", "skip/d.md", ".git/e.md", "f.txt"):
        os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
        (tmp_path / p).write_text("# x\n")
    (tmp_path / ".gitignore").write_text("skip/\n")
    for p in ("b/local.md", "b/keep.md", "d/b/local.md", "d/secret.md", "d/skip.md/e.md"):
        os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
        (tmp_path / p).write_text("# y\n")
    (tmp_path / "b" / ".gitignore").write_text("*.md\n!keep.md\n!c.md\n")
    os.makedirs(tmp_path / ".git" / "info", exist_ok=True)
    (tmp_path / ".git" / "info" / "exclude").write_text("secret.md\n")
    (tmp_path / "d" / "bad.md").write_bytes(b"\xff\xfe")
    assert {r.rel_path for r in corpus.walk(spark, str(tmp_path)).collect()} == {".dot/a.md", "b/c.md", "b/keep.md", "d/b/local.md", "d/skip.md/e.md"}


def test_schema_folders(tmp_path):
    from vellum.sources.schema import find_root, load_all, preset

    for p in (".types/note.yaml", "sub/.types/task.yaml", "gone/.types/x.yaml", ".git/.types/y.yaml"):
        os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
        (tmp_path / p).write_text("paths: ['*.md']\n")
    (tmp_path / ".gitignore").write_text("gone/\n")
    found = load_all(str(tmp_path), ".types")
    assert {k: v.folder for k, v in found.items()} == {".": ".types", "sub": "sub/.types"}
    assert find_root(str(tmp_path / "sub"), ".types") == str(tmp_path / "sub")
    assert load_all(str(tmp_path / ".git"), ".none")["."].folder == "" and "title" in preset("journal")
    with pytest.raises(ValueError, match="unknown preset 'zzz'"):
        preset("zzz")


def test_front_matter_that_cannot_be_read(spark):
    docs = resolve(tables.parse(_files(spark, [("a.md", "---\nx: [\n---\n"), ("b.md", "text"), ("c.md", "---\nx: 1\n---\n"), ("notes/d.md", "---\n- x\n---\n")])), schema(TYPES))
    found = sorted((r.rel_path, r.code, r.line, r.message.split(":")[0]) for r in validate.sizes_and_types(docs, schema(TYPES)).collect())
    assert found == [("a.md", "UnknownType", 1, "frontmatter parse error"), ("b.md", "MissingFrontmatter", None, "document is missing frontmatter"), ("c.md", "MissingRequiredField", 1, "missing required field 'type (valid types"), ("notes/d.md", "UnknownType", 1, "frontmatter parse error")]
    presets_alone = schema({}, True)
    presets_alone.folder = ""
    assert not validate.sizes_and_types(resolve(tables.parse(_files(spark, [("b.md", "text")])), presets_alone), presets_alone).count()


def test_properties(spark):
    s = schema({"n": "paths: ['*.md']\nstructure:\n  sections:\n    - {title: Flat, properties: {n: {type: integer, required: true}, on: {type: bool}, at: {type: date}, k: {type: enum, values: [a, b]}}}\n    - {title: '*', properties: {f: {type: float}}}\n"})
    text = "---\nx: 1\n---\n## Flat\n\n- N: 5x\n- N: 18446744073709551615\n- On: YES\n- at: 2024-02-30\n- K: c\n\n## Other\n\n- one\n  - F: 1e5\n- two\n  - F: 1,5\n\n## Flat\n\n- a\n  - N: -1\n- b\n"
    docs = resolve(tables.parse(_files(spark, [("a.md", text)])), s)
    assert sorted((r.line, r.message) for r in validate.properties(docs, s).collect()) == [
        (4, "field 'Flat/at': must be a valid date (got '2024-02-30')"), (4, "field 'Flat/k': must be one of: a, b (got 'c')"),
        (12, "field 'Other/f': must be a number (got '1,5')"), (19, "missing required field 'Flat/n'"),
    ]


def test_managed_sections(spark):
    from vellum.operators.fix import fix_document

    definition = "paths: ['*.md']\nstructure:\n  strict_sections: false\n  sections:\n    - title: Rules\n      managed_content:\n        template: |\n          ## Rules\n\n          Be fair.\n\n          - one\n        migrate_from: [Old]\n"
    s = schema({"n": definition})
    bodies = {"same": "## Rules\n\nBe fair.\n\n- one\n", "more": "## Rules\n\nBe fair.\n\n- one\n- own\n\nMine.\n", "case": "## rules\n\nBe fair.\n\n- one\n", "other": "## Rules\n\nBe mean.\n\n- one\n- own\n", "old": "## Old\n\nx\n\n## A\n", "none": "## A\n"}
    docs = resolve(tables.parse(_files(spark, [(f"{k}.md", "---\nx: 1\n---\n" + b) for k, b in bodies.items()])), s)
    assert {r.rel_path for r in validate.managed_sections(docs, s).collect()} == {"case.md", "other.md", "old.md", "none.md"}
    assert all(r.code != "ManagedSectionNeedsUpdate" or r.fixable for r in validate.check(docs, s).collect())
    fixed = {k: fix_document("---\nx: 1\n---\n" + b, s.types["n"], None).split("---\n\n")[1] for k, b in bodies.items()}
    assert fixed["same"] == bodies["same"] and fixed["more"] == bodies["more"] and fixed["none"] == "## A\n\n" + bodies["same"]
    assert fixed["case"] == bodies["same"] and fixed["other"] == "## Rules\n\nBe fair.\n\n- one\n\n- own\n" and fixed["old"] == bodies["same"] + "\n## A\n"


def test_sections_stay_in_place_unless_strict():
    from vellum.operators.fix import fix_document

    t = {"structure": {"strict_sections": False, "sections": [{"title": "A"}, {"title": "B"}]}}
    text = "---\nx: 1\n---\n\n## B\n\n## A\n"
    assert fix_document(text, t, None) == text and "## A\n\n## B" in fix_document(text, {"structure": {"sections": [{"title": "A"}, {"title": "B"}]}}, None)


def test_revalidation_stream(spark, tmp_path):
    from vellum.streaming.revalidate import revalidate

    os.makedirs(tmp_path / "in")
    state, got = {"bad": ["a.md", "b.md"]}, []
    check = lambda: spark.createDataFrame([(p, 3, "wrong") for p in state["bad"]], "rel_path string, line int, message string")
    changes = spark.readStream.schema("method string, path string").json(str(tmp_path / "in"))
    q = revalidate(changes, check, lambda df, n: got.append({r.rel_path: [tuple(d) for d in r.diagnostics] for r in df.collect()}), f"file://{tmp_path}/state", str(tmp_path / "cp"))
    try:
        for n, bad in enumerate((["a.md", "b.md"], ["a.md"], [], ["c.md"])):
            state["bad"] = bad
            (tmp_path / "in" / f"{n}.json").write_text('{"method": "textDocument/didChange", "path": "a.md"}\n')
            q.processAllAvailable()
    finally:
        q.stop()
    assert got == [{"a.md": [(2, "wrong")], "b.md": [(2, "wrong")]}, {"a.md": [(2, "wrong")], "b.md": []}, {"a.md": []}, {"c.md": [(2, "wrong")]}]
    assert len(os.listdir(tmp_path / "state")) == 2


def test_registered_queries_hold_against_sql(spark):
    import duckdb

    from vellum.plans.registry import ORACLE_SQL, QUERIES

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("orders", "customer", "lineitem", "events", "documents", "supplier"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name in ("q_property_eq", "q_grep_ci", "x_fields", "x_properties", "v_fields_customer", "v_size_warning", "f_sort_entries", "f_idempotent", "v_sections", "v_intro", "v_properties", "v_managed", "v_malformed", "v_unreadable", "f_managed", "j_bfs_depth2", "agg_diagnostics", "x_body_text", "j_json", "r_types"):
        df = QUERIES[name](spark, d)
        cur = con.execute(ORACLE_SQL[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(tuple(map(str, r)) for r in df.select(*names).collect()) == sorted(tuple(map(str, r)) for r in cur.fetchall()), name


def test_every_document_is_rendered(spark):
    texts = [None, "", "Plain text.\nTwo lines.", "A *b* _c_ & <d> [e](f) `g` ~h~ \\ !i #j | k", "Half\n\n- list\n# head", " led", "A ```` fence\n\n```\nx", "one\r\ntwo", "Ends\n", "1. one", "&amp; x", "Über # äh\nÉté | *"]
    rows = [(k, t, "en" if k % 2 else None, None if k == 3 else "web") for k, t in enumerate(texts)]
    docs = tables.parse(corpus.rendered(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    got = {int(r.stem): r.body_text for r in docs.collect()}
    # a paragraph's lines are joined by spaces; a fence keeps them, but body_text ends each block with one line break
    assert got == {k: "" if not t else (t.replace("\n", " ") if k in (2, 3, 11) else t.rstrip("\n")) + "\n" for k, t in enumerate(texts)}


def test_queries_over_all_documents(spark):
    import duckdb

    from vellum.functions.markdown import Document
    from vellum.plans.registry import ORACLE_SQL, QUERIES

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    for name in ("x_body_text", "q_grep_ci", "v_size_warning"):
        df = QUERIES[name](spark, d)
        cur = con.execute(ORACLE_SQL[name])
        names = [c[0] for c in cur.description]
        assert sorted(tuple(map(str, r)) for r in df.select(*names).collect()) == sorted(tuple(map(str, r)) for r in cur.fetchall()), name
    raw = {f"documents/{i}.md": (t, lang) for i, t, lang in con.execute("select doc_id, text, lang from documents").fetchall()}
    json = {r.rel_path: r for r in QUERIES["j_json"](spark, d).collect()}
    assert {p: (Document(r.intro).blocks[0]["kind"], r.type, r.lang) for p, r in json.items()} == {p: ("paragraph", "prose", lang) for p, (_, lang) in raw.items()}
    from vellum.operators.tables import _parsed

    assert {p: _parsed(r.intro)["body_text"] for p, r in json.items()} == {p: t.replace("\n", " ") + "\n" for p, (t, _) in raw.items()}


def test_json_sections(spark):
    import json

    s = schema({"t": "structure:\n  strict_sections: false\n  sections:\n    - {title: A, properties: {n: {type: integer}, f: {type: float}, b: {type: bool}}}\n    - {title: '*', properties: {n: {type: integer}}}\n    - {title: None}\n"})
    text = """---
type: t
---
## Before

# T

in

## A

- one
  - N: 5
  - b: yes
  - f: 1.5
  - x: q
  - x: r
- two
  - plain
    - deep

### A1

para [l](u.md)

#### A11

- k: v

##### A111

end

### A2

## Flat

- n: 7
- m: 8
- note

## None

- n: 7
"""
    got = json.loads(Query(_files(spark, [("a.md", text)]), s).json().first().json)
    assert got["title"] == "T" and got["intro"] == "in"
    assert got["sections"] == [
        {"heading": "A", "items": [{"text": "one", "properties": {"n": 5, "b": True, "f": 1.5, "x": ["q", "r"]}}, {"text": "two", "items": [{"text": "plain", "items": [{"text": "deep"}]}]}], "subsections": [
            {"heading": "A1", "content": "para [l](u.md)", "links": [{"text": "l", "url": "u.md"}], "subsections": [{"heading": "A11", "items": [{"text": "k: v"}]}]},
            {"heading": "A2"},
        ]},
        {"heading": "Flat", "properties": {"n": 7, "m": "8"}},
        {"heading": "None", "items": [{"text": "n: 7"}]},
    ]


def test_json_of_orders(spark):
    import duckdb

    from vellum.plans.registry import ORACLE_SQL, QUERIES

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("orders", "lineitem", "documents"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name in ("j_sections", "j_json"):
        df = QUERIES[name](spark, d)
        cur = con.execute(ORACLE_SQL[name])
        names = [c[0] for c in cur.description]
        assert sorted(tuple(map(str, r)) for r in df.select(*names).collect()) == sorted(tuple(map(str, r)) for r in cur.fetchall()), name


def test_check_reports_links_schema_intro_and_fallback(spark):
    s = schema({"t": "structure:\n  strict_sections: false\n  intro: {bullets: unordered}\n  sections:\n    - {title: A, required: false}\n    - {title: '*', bullets: ordered, intro_text: Hi, links: {target_type: u}}\n", "u": "paths: ['u/*.md']\n"})
    text = "---\ntype: t\nx: '[f](g h)'\n---\n# T\n\npara [x](a b.md)\n\n1. one\n\n## A\n\nfree `[c](d e)`\n\n## B\n\nHi there\n\n## C\n\n- [l](a.md)\n"
    docs = resolve(tables.parse(_files(spark, [("a.md", text), ("o.md", "---\ntype: none\n---\n[x](y z)\n")])), s)
    assert {(r.code, r.line, r.message) for r in validate.check(docs, s).collect()} == {
        ("MalformedLink", 7, "link 'a b.md' contains an unencoded space (use %20 or rename the file)"),
        ("SectionNotBullets", 7, "intro: only bullet lists are allowed here"),
        ("WrongListType", 9, "intro: expected unordered list"),
        ("SectionNotBullets", 17, "section 'B': only bullet lists are allowed here"),
        ("WrongListType", 21, "section 'C': expected ordered list"),
        ("SectionNeedsIntro", 19, "section is missing required intro paragraph starting with 'Hi'"),
        ("LinkTargetTypeMismatch", None, "link 'a.md' must target type 'u', got 't'"),
    }
    bad = schema({"t": "fields:\n  a: {type: odd}\n"})
    bad.folder = ".types"
    docs = resolve(tables.parse(_files(spark, [("a.md", "# x\n")])), bad)
    assert [(r.rel_path, r.line, r.message) for r in validate.check(docs, bad).collect()] == [(".types", 0, "schema error: t: type 't', field 'a': unknown type 'odd'")]


def test_targets(spark, tmp_path):
    import subprocess

    from vellum.sources import targets

    for p in ("a.md", "b/c.md", "b/d.txt", "e/f.md"):
        os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
        (tmp_path / p).write_text(p)
    root = str(tmp_path)
    assert targets.tracked(spark, root) is None
    with pytest.warns(UserWarning, match="only the named"):
        got = targets.selected(spark, root, ["a.md", "b", "no.md", "b/d.txt", "a.md"])
    assert sorted((r.rel_path, r.content, r.dir) for r in got.collect()) == [("a.md", "a.md", ""), ("a.md", "a.md", ""), ("b/c.md", "b/c.md", "b")]
    assert targets.selected(spark, root, []).count() == 3
    run = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True)
    run("init")
    assert targets.tracked(spark, root) is None
    run("add", "a.md", "b")
    run("commit", "-m", "x")
    assert sorted(r.path for r in targets.tracked(spark, str(tmp_path / "b")).collect()) == ["../a.md", "c.md", "d.txt"]


def test_sinks(spark, tmp_path):
    from pyspark.sql import functions as F

    from vellum.operators import sinks
    from vellum.streaming.revalidate import publications

    (tmp_path / "x").mkdir()
    formatted = spark.createDataFrame([("x/a.md", "new\r\n", True), ("x/b.md", "old", False)], "rel_path string, formatted string, changed boolean")
    sinks.write_back(formatted, str(tmp_path))
    assert os.listdir(tmp_path / "x") == ["a.md"] and (tmp_path / "x/a.md").read_bytes() == b"new\r\n"
    diagnostics = spark.createDataFrame([("x/a.md", 3, "m", False), ("x/a.md", None, "n", True)], "rel_path string, line int, message string, fixable boolean")
    assert tuple(sinks.summary(formatted, diagnostics).first()) == (2, 1, 1, "formatted 1 of 2 file(s)", 1)
    sinks.json_lines(spark.createDataFrame([('{"a":[1]}',)], "json string"), f"file://{tmp_path}/j", pretty=True)
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/j").collect()] == ["{", '  "a": [', "    1", "  ]", "}"]
    odd = "/r/a b+~*é%41.md"
    row = spark.range(1).select(sinks.uri(F.lit(odd)).alias("u")).select("u", sinks.uri_path(F.col("u")).alias("p"), sinks.uri_path(F.lit("http://x")).alias("n")).first()
    assert tuple(row) == ("file:///r/a%20b%2B~%2A%C3%A9%2541.md", odd, None)
    sent = {r.rel_path: r.message for r in sinks.messages(publications(diagnostics.withColumn("rel_path", F.lit("gone.md")), diagnostics), "/r").collect()}
    assert sent["gone.md"] == '{"jsonrpc":"2.0","method":"textDocument/publishDiagnostics","params":{"uri":"file:///r/gone.md","diagnostics":[]}}'
    assert '"start":{"line":2,"character":0}' in sent["x/a.md"] and sent["x/a.md"].count('"severity":1') == 2
