import pytest

from vellum.functions import markdown as M
from vellum.functions.columns import glob_to_regex, template_regex
from vellum.operators.fix import fix_document
from vellum.sources.schema import load_yaml, schema

SAMPLE = """---
type: note
date: 2024-01-02
tags: [a, yes]
---
Title
=====

Para *em* **bold `x`** [l](a%20b.md "t") ![i](p.png)
second line

* one
  * Key: v
* two

  more

1) a
2) b

> q [z](y.md)
> > inner

| a | b |
|---|:-:|
| 1 | [x](u.md) |

```py
code
```

See [ref].

[ref]: target.md
"""


def test_parse():
    d = M.Document(SAMPLE)
    assert d.doc_type == "note" and d.fields == {"date": "2024-01-02", "tags": ["a", "yes"]}
    assert d.title() == ("Title", 6)
    assert [b["kind"] for b in d.blocks] == ["heading", "paragraph", "list", "list", "quote", "table", "code", "paragraph"]
    assert [x[2] for b in d.blocks for x in M.block_links(b)] == ["a%20b.md", "p.png", "y.md", "u.md", "target.md"]


@pytest.mark.parametrize("text", [SAMPLE, "", "a\nb", "- a\n\n  b\n- c\n", "> - x\n>   y\n", "# x #\n\n---\n", "1. a\n   - b\n", "```\n````\n"])
def test_serialise_is_stable(text):
    once = M.serialise(M.Document(text))
    assert M.serialise(M.Document(once)) == once


@pytest.mark.parametrize(("text", "error"), [("---\ntype: 5\n---\n", "type: expected string, got int"), ("---\n- a\n---\n", "front matter is not a mapping")])
def test_front_matter_errors(text, error):
    assert M.Document(text).front_error == error


def test_globs_and_templates():
    import re

    java = lambda p: p.replace(r"\z", r"\Z")
    assert re.match(glob_to_regex("**/a/*.md"), "x/y/a/b.md") and re.match(glob_to_regex("**/a/*.md"), "a/b.md")
    assert not re.match(glob_to_regex("*.md"), "a/b.md") and re.match(glob_to_regex("*.md", False), "a/b.md")
    assert re.match(glob_to_regex("[ab]{x,y}?"), "axz") and not re.match(glob_to_regex("[!ab]x"), "ax")
    assert re.match(java(template_regex("- **Bold**: Text")), "- **k**: anything ") and not re.match(java(template_regex("- **Bold**: Text")), "- k: v")
    assert re.match(java(template_regex("- YYYY-MM-DD - [Name](path)")), "- 2024-01-01 - [a](b.md)")


def test_fix():
    t = load_yaml("structure:\n  title: from_filename\n  sections:\n    - {title: A, bullets: ordered}\n    - {title: B, required: false}\n    - {title: C, intro_text: Hello}\n")
    text = "---\nx: 1\n---\n## C\n\nz\n\n## B\n\n## A\n\npara\n\n- i\n"
    once = fix_document(text, t, "stem")
    assert once == "---\nx: 1\n---\n\n# stem\n\n## A\n\n1. para\n\n1. i\n\n## C\n\nHello\n\nz\n"
    # each paragraph becomes a list of its own; read again, lists side by side are one, and that is stable
    twice = fix_document(once, t, "stem")
    assert twice == once.replace("1. para\n\n1. i", "1. para\n2. i")
    assert fix_document(twice, t, "stem") == twice
    broken = "---\ntype: 5\n---\n*  x\n"
    assert fix_document(broken, t, "s") == broken


def test_schema_errors():
    assert schema({"a": "fields: {x: {type: enum}}"}).errors
    assert schema({"a": "paths: [x.md, x.md]"}).errors == ["path pattern error: duplicate path pattern 'x.md'"]
    assert "readme" in schema({}, presets=True).types


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("**a `x` b**", [("strong", [("text", "a "), ("code", "x"), ("text", " b")])]),
        ("***x***", [("emphasis", [("strong", [("text", "x")])])]),
        ("*a **b** c*", [("emphasis", [("text", "a "), ("strong", [("text", "b")]), ("text", " c")])]),
        ("**a *b***", [("strong", [("text", "a "), ("emphasis", [("text", "b")])])]),
        ("*a [b* c](u)", [("text", "*a "), ("link", [("text", "b* c")], "u")]),
        ("a * b *c *", [("text", "a * b *c *")]),
        ("snake_case_name _em_", [("text", "snake_case_name "), ("emphasis", [("text", "em")])]),
        ("*foo**bar**baz*", [("emphasis", [("text", "foo"), ("strong", [("text", "bar")]), ("text", "baz")])]),
        ("**foo*", [("text", "*"), ("emphasis", [("text", "foo")])]),
        ("[a [b](c) d](e)", [("text", "[a "), ("link", [("text", "b")], "c"), ("text", " d](e)")]),
        ("![i [b](c)](e)", [("image", [("text", "i "), ("link", [("text", "b")], "c")], "e")]),
        ("[x][r] [R] [r][] [no]", [("link", [("text", "x")], "t"), ("text", " "), ("link", [("text", "R")], "t"), ("text", " "), ("link", [("text", "r")], "t"), ("text", " [no]")]),
        ("`a` ``b ` c`` `open", [("code", "a"), ("text", " "), ("code", "b ` c"), ("text", " `open")]),
        ("&amp; &copy; &x \\* <http://a.b> <b>t</b>", [("text", "& © &x * "), ("link", [("text", "http://a.b")], "http://a.b"), ("text", " t")]),
    ],
)
def test_inlines(text, want):
    assert M.parse_inlines(text, {"r": "t"}) == want


@pytest.mark.parametrize("text", ["[" * 100_000, "*a " * 30_000, "*a* " * 20_000, "a**b" * 20_000, "](" * 30_000, "`" + "a`` " * 20_000, "<!--" * 20_000, "[a](b) " * 10_000, "[" * 20_000 + "a](b)" * 5_000, "_" * 50_000])
def test_inlines_take_linear_time(text):
    import time

    began = time.process_time()
    M.parse_inlines(text, {"r": "t"})
    assert time.process_time() - began < 8


def test_table_cells_know_definitions():
    d = M.Document("| a |\n|---|\n| [x][r] |\n\n[r]: target.md\n")
    assert [x[2] for b in d.blocks for x in M.block_links(b)] == ["target.md"] and M.block_text(d.blocks[0]) == ["a", "x"]
