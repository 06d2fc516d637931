"""Parsing by batches: equal to the parser of single documents, and no more of a document than a query needs."""

import random

import pyarrow as pa
import pytest

from vellum.functions.batches import Batch, Front
from vellum.operators import json_output, tables, validate
from vellum.operators.query import Query
from vellum.operators.resolve import resolve
from vellum.plans import registry
from vellum.sources import corpus
from vellum.sources.schema import schema

SF = "/root/testdata/sf0.001"
WORDS = ["abc", "Part 12", "a  b", "K: v", "é", "中", "a_b", "_a", "x!", "1.", "a)", "# x", "a #", "ends ", "[l](u)", "[l l](../a/b.md)", "[a](b c)", "[a]: b", "&amp;", "*e*", "`c`", "\\x", "a|b", " ", "\t", "\r", "---", "===", "[](u)", "![i](u)", "<b>"]
MARKS = ["", "", "", "# ", "## ", "### ", "####### ", "- ", "- ", "  - ", "    - ", "* ", "1. ", "> ", " ", "```", "---"]
PLAIN = ["", "", "# T", "## A", "## B b", "### c", "- Part 1", "- [a](../b.md)", "  - K: v", "  - [s](t.md)", "text here", "[p](q.md)", "## [h](i.md)"]
FIELDS = ["a: 1", "b: x", "type: t", "type: 5", 'c: "q"', "d: [1, x]", "e:", "f: true", "g: 007", "h: x y", "i: 1.5", "- x", " z: 1", "# c", "a: 2", "{k: 1}", "k: {a: 1}", "l: |", "m: &x 1", "n: *x", "? o", "p: a#b", "q: a # b", "null: 1", "r: ~", "s: [", "u: -5", "v: 1e5", "<<: {a: 1}", "w: x: y", "---  ", "x: a ", "bb: Null", "cc: nULL", "true: 1", "..."]


def _files(spark, rows):
    return corpus.with_path_columns(spark.createDataFrame(rows, "rel_path string, content string"))


def _document(r: random.Random) -> str:
    front = ["---", *(r.choice(FIELDS) for _ in range(r.randint(0, 3))), *["---"] * (r.random() < 0.9)] if r.random() < 0.6 else []
    odd = r.random() < 0.4
    body = [r.choice(MARKS) + r.choice(WORDS) if odd and r.random() < 0.3 else r.choice(PLAIN) for _ in range(r.randint(0, 14))]
    return "\n".join(front + body) + r.choice(["", "\n", "\n\n"])


@pytest.mark.parametrize("wanted", [None, (), ("links.url", "items.text", "blocks.md")])
def test_batches_equal_the_parser(spark, wanted):
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, r, plain = to_arrow_schema(tables._columns(wanted)), random.Random(7), 0
    for _ in range(40):
        texts = [None if r.random() < 0.02 else _document(r) for _ in range(r.randint(1, 90))]
        contents = pa.array(["---\n", *texts], pa.string()).slice(1)
        got = pa.RecordBatch.from_arrays(tables.parsed_arrays(contents, arrow, Front()), schema=arrow)
        got.validate(full=True)
        assert got.to_pylist() == pa.RecordBatch.from_pylist([tables._parsed(x) for x in texts], schema=arrow).to_pylist()
        plain += int(Batch(contents, Front()).plain.sum())
    assert plain > 200


def test_given_tables_are_plain(spark):
    for files in (corpus.orders(spark, SF), corpus.customers(spark, SF), corpus.logs(spark, SF)):
        texts = [r.content for r in files.select("content").collect()]
        assert Batch(pa.array(texts), Front()).plain.all()


def test_unknown_columns_are_refused(spark):
    with pytest.raises(ValueError, match="items.colour"):
        tables.parse(_files(spark, [("a.md", "x")]), ("items.colour",))


def test_parts_of_batches_are_bounded():
    b = pa.RecordBatch.from_arrays([pa.array(["x" * (tables.BYTES // 2)] * 5 + [None] + ["y"] * 5000)], ["content"])
    parts = list(tables.slices(b, 0))
    assert sum(p.num_rows for p in parts) == b.num_rows and max(p.num_rows for p in parts) <= tables.ROWS
    assert max(sum(len(x or "") for x in p.column(0).to_pylist()) for p in parts) <= tables.BYTES


def test_no_large_batches_go_to_workers(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    registry.QUERIES["j_json"](spark, SF)
    assert int(spark.conf.get(key)) <= tables.ROWS


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["r_types", "v_field_enum", "x_fields", "q_property_eq", "q_property_multi", "q_property_number", "q_count_cap", "q_days_asof"])
def test_front_matter_queries_parse_no_bodies(spark, name):
    plan = _plan(registry.QUERIES[name](spark, SF))
    parsed = [x for x in plan.split("\n") if "MapInArrow" in x]
    assert len(parsed) == 1 and "blocks" not in parsed[0] and "items" not in parsed[0]


@pytest.mark.parametrize("name, other", [("x_links", "items"), ("x_items", "blocks"), ("x_properties", "blocks"), ("q_has_link", "blocks"), ("x_sections", "items"), ("j_sections", "blocks"), ("j_json", "blocks")])
def test_body_queries_parse_once_what_they_need(spark, name, other):
    plan = _plan(registry.QUERIES[name](spark, SF))
    parsed = [x for x in plan.split("\n") if "MapInArrow" in x]
    assert len(parsed) == 1 and other not in parsed[0] and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("name", ["v_link_broken", "v_backlink_missing", "j_bfs_depth2", "agg_diagnostics"])
def test_link_queries_keep_links_alone(spark, name, monkeypatch):
    kept = []
    for module in (registry, json_output):
        real = module.materialise
        monkeypatch.setattr(module, "materialise", lambda df, real=real: (kept.append(df.columns), real(df))[1])
    registry.QUERIES[name](spark, SF)
    assert kept and not {"blocks", "items", "body_text"} & {c for columns in kept for c in columns}


def test_rules_take_one_pass(spark):
    s = schema({"t": "structure:\n  title: required\n  sections:\n    - {title: A, bullets: unordered, properties: {n: {type: integer, required: true}}}\n    - {title: B, template: '- [x](y)', links: {target_type: t}}\n", "u": "fields:\n  n: {type: integer, required: true}\n"})
    docs = resolve(tables.parse(_files(spark, [("a.md", "---\ntype: t\n---\n## C\n\n## B\n\n- z\n\n## A\n\n1. k\n   - n: q\n2. l\n\npara\n"), ("b.md", "---\ntype: u\n---\n")])), s)
    within = validate.with_hits(docs, s)
    found = validate._found(within, within.hits)
    plan = _plan(found)
    assert plan.count("MapInArrow") == 1 and "Window" not in plan and "Union" not in plan
    assert sorted((r.rel_path, r.code) for r in found.collect()) == [("a.md", c) for c in ("InvalidFieldType", "MissingH1", "MissingRequiredField", "SectionNotBullets", "SectionOutOfOrder", "SectionsOutOfOrder", "TemplateMismatch", "UnexpectedSection", "WrongListType")] + [("b.md", "MissingRequiredField")]


def test_json_is_the_same_where_it_is_parsed(spark):
    s = schema({"t": "paths: ['p/*.md']\nstructure:\n  sections:\n    - {title: A, properties: {n: {type: integer}}}\n"})
    text = "# T\n\nintro\n\n## A\n\n- x\n  - n: 5\n  - m: [l](u)\n\n### B\n\nbody ![i](j)\n\n## C\n\n[k](l.md)\n"
    files = _files(spark, [("p/a.md", text), ("b.md", "---\ntype: t\n---\n" + text), ("p/c.md", "---\ntype: none\n---\n" + text), ("p/d.md", "---\ntype: x\n---\n" + text), ("e.md", "## A\n\n- n: 5\n\n# T\n\n## A\n\n- n: 5\n"), ("f.md", None)])
    here = {r.rel_path: r.json for r in Query(files, s).json().collect()}
    after = {r.rel_path: r.json for r in json_output.document_json(resolve(tables.parse(files), s), s).collect()}
    assert here == after and '"n":5' in here["p/a.md"] and '"n":5' in here["b.md"] and '"n":5' not in here["p/c.md"] + here["p/d.md"]
