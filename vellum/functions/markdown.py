"""Markdown to blocks and back, without Spark: front matter, CommonMark blocks, tables, inlines.

A block is a dict with ``kind`` (heading, paragraph, list, code, quote, table, rule) and ``line`` (from 1). Inlines
are tuples: ("text", s), ("code", s), ("break",), ("strong" | "emphasis", [...]), ("link" | "image", [...], url).
HTML, hard breaks and link titles are dropped. Nested quotes keep their nesting, and lines count from the file's top.
"""

from __future__ import annotations

import html
import json
import re
import unicodedata

import yaml


class _Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
    """YAML 1.2: dates, yes/no and base-60 numbers stay strings."""


_Loader.yaml_implicit_resolvers = {}
for tag, pattern, first in (
    ("null", r"(?:~|null|Null|NULL|)", ["~", "n", "N", ""]),
    ("bool", r"(?:true|True|TRUE|false|False|FALSE)", list("tTfF")),
    ("int", r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+", list("-+0123456789")),
    ("float", r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)", list("-+.0123456789")),
):
    _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(f"^(?:{pattern})$"), first)
_Loader.add_constructor("tag:yaml.org,2002:int", lambda loader, node: int(node.value, 0) if node.value[:2] in ("0x", "0o") else int(node.value))


def load_yaml(text: str):
    return yaml.load(text, Loader=_Loader)  # noqa: S506


def kind_of(value) -> str:
    for kinds, name in ((bool, "bool"), (int, "int"), (float, "float"), (str, "string"), (list, "list"), (dict, "map")):
        if isinstance(value, kinds):
            return name
    return "null"


def split_front_matter(content: str) -> tuple[str | None, str, int]:
    """Front matter, body, and how many lines come before the body."""
    lines = content.split("\n")
    if lines and lines[0].rstrip() == "---":
        for k in range(1, len(lines)):
            if lines[k].rstrip() == "---":
                return "\n".join(lines[1:k]), "\n".join(lines[k + 1 :]), k + 1
    return None, content, 0


_CLOSED = re.compile(r"\A---[^\S\n]*\n(?:(.*?)\n)??---[^\S\n]*(?:\n|\Z)", re.S)


def front_matter(content: str) -> str | None:
    """The front matter alone, without a look at the body."""
    m = _CLOSED.match(content)
    return None if m is None else m[1] or ""


def read_front(front: str | None) -> tuple:
    """(present, error, type, fields); present is None where there is none or it can't be read."""
    if front is None:
        return None, None, None, {}
    kind = None
    try:
        fields = load_yaml(front)
        fields = {} if fields is None else fields
        if not isinstance(fields, dict):
            raise ValueError("front matter is not a mapping")
        if "type" in fields and not isinstance(fields["type"], str):
            raise ValueError(f"type: expected string, got {kind_of(fields['type'])}")
        kind = fields.pop("type", None)
        return True, None, kind, {str(k): v for k, v in fields.items()}
    except (yaml.YAMLError, ValueError) as e:
        return None, str(e).split("\n")[0], kind, {}


_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})[ \t]*([^\n]*)$")
_MARK = re.compile(r"^( {0,3})([-+*]|[0-9]{1,9}[.)])( +|\t|$)(.*)$")
_CELL = re.compile(r"^ *\|?(?: *:?-+:? *\|)* *:?-+:? *\|? *$")
_DEFINITION = re.compile(r"^ {0,3}\[([^\]]+)\]:[ \t]*<?([^\s>]+)>?(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*$")
_HTML = re.compile(r"^ {0,3}<(?:!--|[?!]|/?[A-Za-z][A-Za-z0-9-]*(?:[\s/>]|$))")


def _cells(row: str) -> list[str]:
    row = row.strip()
    row = row[1:] if row.startswith("|") else row
    row = row[:-1] if row.endswith("|") and not row.endswith("\\|") else row
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", row)]


def _starts_block(line: str) -> bool:
    m = _MARK.match(line)
    return bool(_ATX.match(line) or _RULE.match(line) or _FENCE.match(line) or line.lstrip(" ").startswith(">") or (m and m[4] and m[2] in ("-", "+", "*", "1.", "1)")))


def parse_blocks(lines: list[str], first: int, defs: dict[str, str]) -> list[dict]:
    out, k = [], 0
    while k < len(lines):
        line = lines[k]
        if not line.strip():
            k += 1
            continue
        at = first + k
        if m := _ATX.match(line):
            out.append({"kind": "heading", "level": len(m[1]), "raw": m[2] or "", "line": at})
            k += 1
        elif m := _FENCE.match(line):
            body, k = [], k + 1
            while k < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$", lines[k]):
                body.append(re.sub(rf"^ {{0,{len(m[1])}}}", "", lines[k]))
                k += 1
            k += 1
            out.append({"kind": "code", "language": m[3].strip() or None, "text": "".join(x + "\n" for x in body), "line": at})
        elif _RULE.match(line):
            out.append({"kind": "rule", "line": at})
            k += 1
        elif line.startswith("    ") or line.startswith("\t"):
            body = []
            while k < len(lines) and (lines[k].startswith(("    ", "\t")) or not lines[k].strip()):
                body.append(lines[k][4:] if lines[k].startswith("    ") else lines[k][1:])
                k += 1
            while body and not body[-1].strip():
                body.pop()
            out.append({"kind": "code", "language": None, "text": "".join(x + "\n" for x in body), "line": at})
        elif line.lstrip(" ").startswith(">"):
            body = []
            while k < len(lines) and lines[k].strip() and (lines[k].lstrip(" ").startswith(">") or not _starts_block(lines[k])):
                body.append(re.sub(r"^ {0,3}> ?", "", lines[k]))
                k += 1
            out.append({"kind": "quote", "blocks": parse_blocks(body, at, defs), "line": at})
        elif m := _MARK.match(line):
            ordered, sign = m[2][-1] in ".)", m[2][-1]
            items = []
            while k < len(lines) and (m := _MARK.match(lines[k])) and m[2][-1] == sign and not _RULE.match(lines[k]):
                width = len(m[1]) + len(m[2]) + (len(m[3]) if m[4] and len(m[3].expandtabs(4)) <= 4 and m[3] != "\t" else 1)
                body, start = [m[4]], k
                k += 1
                while k < len(lines):
                    x = lines[k].expandtabs(4) if lines[k].startswith("\t") else lines[k]
                    if not x.strip():
                        ahead = next((y for y in lines[k:] if y.strip()), None)
                        if ahead is None or len(ahead) - len(ahead.lstrip(" ")) < width and not ahead.startswith("\t"):
                            break
                        body.append("")
                    elif len(x) - len(x.lstrip(" ")) >= width:
                        body.append(x[width:])
                    elif body[-1].strip() and not _starts_block(x) and not _MARK.match(x):
                        body.append(x.lstrip(" "))
                    else:
                        break
                    k += 1
                items.append({"blocks": parse_blocks(body, first + start, defs), "line": first + start})
                while k < len(lines) and not lines[k].strip() and k + 1 < len(lines) and (n := _MARK.match(next((y for y in lines[k:] if y.strip()), ""))) and n[2][-1] == sign:
                    k += 1
            out.append({"kind": "list", "ordered": ordered, "items": items, "line": at})
        elif (m := _DEFINITION.match(line)) and not (out and out[-1].get("open")):
            defs.setdefault(" ".join(m[1].lower().split()), m[2])
            k += 1
        elif _HTML.match(line):
            while k < len(lines) and lines[k].strip():
                k += 1
        elif "|" in line and k + 1 < len(lines) and "-" in lines[k + 1] and _CELL.match(lines[k + 1]) and len(_cells(line)) == len(_cells(lines[k + 1])):
            align = [{(True, True): "center", (True, False): "left", (False, True): "right"}.get((c.startswith(":"), c.endswith(":"))) for c in _cells(lines[k + 1])]
            block = {"kind": "table", "header": _cells(line), "align": align, "rows": [], "line": at}
            k += 2
            while k < len(lines) and lines[k].strip() and not _starts_block(lines[k]):
                block["rows"].append(_cells(lines[k]))
                k += 1
            out.append(block)
        else:
            body, setext = [line.strip()], 0
            k += 1
            while k < len(lines) and lines[k].strip():
                if m := re.match(r"^ {0,3}(=+|-+)[ \t]*$", lines[k]):
                    setext, k = 1 if m[1][0] == "=" else 2, k + 1
                    break
                if _starts_block(lines[k]):
                    break
                body.append(lines[k].strip(" \t"))
                k += 1
            raw = "\n".join(body)
            out.append({"kind": "heading", "level": setext, "raw": raw, "line": at} if setext else {"kind": "paragraph", "raw": raw, "line": at})
    return out


_DESTINATION = re.compile(r"\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?\s*\)", re.S)
_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")
_REFERENCE = re.compile(r"\[([^\[\]]{0,999})\]")
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_URI = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]+:[^\s<>]*)>")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_PLAIN_RUN = re.compile(r"[^\\\n`\[\]!<*_&]+")
_TICKS = re.compile("`+")
_STARS = re.compile(r"\*+|_+")


class _Run:
    """A run of * or _ that may open or close emphasis."""

    __slots__ = ("sign", "left", "size", "opens", "closes")

    def __init__(self, sign: str, size: int, before: str, after: str):
        gap = lambda c: not c or c.isspace()
        mark = lambda c: bool(c) and not c.isalnum() and not c.isspace() and unicodedata.category(c)[0] in "PS"
        to_right = not gap(after) and (not mark(after) or gap(before) or mark(before))
        to_left = not gap(before) and (not mark(before) or gap(after) or mark(after))
        self.sign, self.left, self.size = sign, size, size
        self.opens = to_right and (sign == "*" or not to_left or mark(before))
        self.closes = to_left and (sign == "*" or not to_right or mark(after))


def _emphasis(nodes: list) -> list[tuple]:
    """Resolves runs among nodes, left to right, on a stack; what matches nothing is text."""
    stack: list = []
    open_at: list[int] = []  # places of runs on the stack
    bottom: dict = {}  # below these places there is no opener for such a closer
    for node in nodes:
        if isinstance(node, _Run) and node.closes:
            kind = (node.sign, node.opens, node.size % 3)
            while node.left:
                k = len(open_at) - 1
                while k >= 0 and open_at[k] >= bottom.get(kind, 0):
                    run = stack[open_at[k]]
                    odd = (run.closes or node.opens) and (run.size + node.size) % 3 == 0 and (run.size % 3 or node.size % 3)
                    if run.sign == node.sign and run.opens and not odd:
                        break
                    k -= 1
                else:
                    bottom[kind] = len(stack)
                    break
                at = open_at[k]
                run, inner = stack[at], stack[at + 1 :]
                n = 2 if run.left > 1 and node.left > 1 else 1
                run.left -= n
                node.left -= n
                del open_at[k + 1 :]
                del stack[at + 1 :]
                if not run.left:
                    stack.pop()
                    open_at.pop()
                stack.append(("strong" if n == 2 else "emphasis", _merged(inner)))
                bottom = {x: min(y, len(stack)) for x, y in bottom.items()}
            if not node.left:
                continue
        if isinstance(node, _Run) and node.opens:
            open_at.append(len(stack))
        stack.append(node)
    return _merged(stack)


def _merged(nodes: list) -> list[tuple]:
    """Runs left over and neighbouring texts become one text."""
    out: list[tuple] = []
    text: list[str] = []
    for x in nodes:
        if isinstance(x, _Run):
            text.append(x.sign * x.left)
        elif x[0] == "text":
            text.append(x[1])
        else:
            if text:
                out.append(("text", "".join(text)))
                text = []
            out.append(x)
    if text:
        out.append(("text", "".join(text)))
    return [x for x in out if x != ("text", "")]


def parse_inlines(s: str, defs: dict[str, str]) -> list[tuple]:
    """Linear in the text: brackets are kept on a stack and emphasis is resolved when their contents are known."""
    nodes: list = []
    brackets: list[tuple[int, int, bool]] = []  # place among nodes, place in s, image or not
    barred = 0  # brackets at lower places hold a link already, and links don't nest
    unclosed: set[int] = set()  # lengths of code fences of which there is none further on
    i = 0
    while i < len(s):
        if m := _PLAIN_RUN.match(s, i):
            nodes.append(("text", m[0]))
            i = m.end()
            continue
        c = s[i]
        if c == "\\":
            after = s[i + 1 : i + 2]
            if after == "\n":  # a hard break
                i += 2
            elif after and after in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
                nodes.append(("text", after))
                i += 2
            else:
                nodes.append(("text", c))
                i += 1
            continue
        if c == "\n":
            hard = False
            if nodes and not isinstance(nodes[-1], _Run) and nodes[-1][0] == "text":
                hard = nodes[-1][1].endswith("  ")
                nodes[-1] = ("text", nodes[-1][1].rstrip(" "))
            if not hard:
                nodes.append(("break",))
            i += 1
            continue
        if c == "`":
            m = _TICKS.match(s, i)
            n = len(m[0])
            end = None if n in unclosed else next((x for x in _TICKS.finditer(s, m.end()) if len(x[0]) == n), None)
            if end:
                body = s[m.end() : end.start()].replace("\n", " ")
                if len(body) > 2 and body[0] == body[-1] == " " and body.strip():
                    body = body[1:-1]
                nodes.append(("code", body))
                i = end.end()
            else:
                unclosed.add(n)
                nodes.append(("text", m[0]))
                i = m.end()
            continue
        if c == "[" or s.startswith("![", i):
            brackets.append((len(nodes), i + (c == "!"), c == "!"))
            nodes.append(("text", "![" if c == "!" else "["))
            i += 1 + (c == "!")
            continue
        if c == "]" and brackets:
            at, start, image = brackets.pop()
            url, stop = None, i + 1
            if image or at >= barred:
                if m := _DESTINATION.match(s, i + 1):
                    url, stop = _ESCAPED.sub(r"\1", m[1] if m[1] is not None else m[2]), m.end()
                elif defs and i - start <= 1000:
                    m = _REFERENCE.match(s, i + 1)
                    key = " ".join((m[1] if m and m[1] else s[start + 1 : i]).lower().split())
                    if key in defs:
                        url, stop = defs[key], m.end() if m else i + 1
            if url is None:
                nodes.append(("text", c))
            else:
                inner = _emphasis(nodes[at + 1 :])
                del nodes[at:]
                nodes.append(("image" if image else "link", inner, html.unescape(url)))
                if not image:
                    barred = at
            i = stop
            continue
        if c == "<":
            if m := _URI.match(s, i):
                nodes.append(("link", [("text", m[1])], m[1]))
                i = m.end()
                continue
            if s.startswith("<!--", i):
                end = -1 if 0 in unclosed else s.find("-->", i + 4)
                if end >= 0:
                    i = end + 3
                    continue
                unclosed.add(0)
            elif m := _TAG.match(s, i):
                i = m.end()
                continue
        if c in "*_":
            m = _STARS.match(s, i)
            nodes.append(_Run(c, len(m[0]), s[i - 1 : i], s[m.end() : m.end() + 1]))
            i = m.end()
            continue
        if c == "&" and (m := _ENTITY.match(s, i)):
            nodes.append(("text", html.unescape(m[0])))
            i = m.end()
            continue
        nodes.append(("text", c))
        i += 1
    return _emphasis(nodes)


def plain(inlines: list[tuple]) -> str:
    """Without markup; a line break is a space, an image its alternative text."""
    return "".join(x[1] if x[0] in ("text", "code") else " " if x[0] == "break" else plain(x[1]) for x in inlines)


def code_span(s: str) -> str:
    runs = [len(r) for r in re.findall("`+", s)]
    n = next(k for k in range(1, len(runs) + 2) if k not in runs)
    pad = " " if s[:1] == "`" or s[-1:] == "`" else ""
    return "`" * n + pad + s + pad + "`" * n


def markup(inlines: list[tuple], newline: str = " ") -> str:
    parts = []
    for x in inlines:
        if x[0] == "text":
            parts.append(x[1])
        elif x[0] == "code":
            parts.append(code_span(x[1]))
        elif x[0] == "break":
            parts.append(newline)
        elif x[0] in ("strong", "emphasis"):
            sign = "**" if x[0] == "strong" else "*"
            parts.append(sign + markup(x[1], newline) + sign)
        else:
            parts.append(("!" if x[0] == "image" else "") + "[" + markup(x[1], newline) + "](" + x[2] + ")")
    return "".join(parts)


def inline_links(inlines: list[tuple]):
    for x in inlines:
        if x[0] in ("link", "image"):
            yield plain(x[1]), x[2], x[0] == "image"
        elif x[0] in ("strong", "emphasis"):
            yield from inline_links(x[1])


class Document:
    """A parsed file."""

    def __init__(self, content: str):
        front, body, skipped = split_front_matter(content or "")
        self.front_present, self.front_error, self.doc_type, self.fields = read_front(front)
        self.defs: dict[str, str] = {}
        self.blocks = parse_blocks(body.split("\n"), skipped + 1, self.defs)
        self._fill(self.blocks)

    def _fill(self, blocks: list[dict]) -> None:
        for b in blocks:
            if "raw" in b:
                b["inlines"] = parse_inlines(b["raw"], self.defs)
            if b["kind"] == "table":
                b["cells"] = [parse_inlines(c, self.defs) for row in [b["header"], *b["rows"]] for c in row]
            for item in b.get("items", ()):
                self._fill(item["blocks"])
                head = item["blocks"][0] if item["blocks"] and item["blocks"][0]["kind"] == "paragraph" else None
                item["inlines"] = head["inlines"] if head else []
                item["children"] = item["blocks"][1:] if head else item["blocks"]
            self._fill(b.get("blocks", []))

    def title(self) -> tuple[str | None, int | None]:
        return next(((plain(b["inlines"]), b["line"]) for b in self.blocks if b["kind"] == "heading" and b["level"] == 1), (None, None))


def block_text(b: dict) -> list[str]:
    """Texts of headings, paragraphs, items, code, quotes and cells, in order."""
    k = b["kind"]
    if k in ("heading", "paragraph"):
        return [plain(b["inlines"])]
    if k == "code":
        return [b["text"].rstrip("\n")]
    if k == "list":
        return [t for i in b["items"] for t in [plain(i["inlines"]), *(x for c in i["children"] for x in block_text(c))]]
    if k == "quote":
        return [t for c in b["blocks"] for t in block_text(c)]
    if k == "table":
        return [plain(c) for c in b["cells"]]
    return []


def block_links(b: dict, line: int | None = None):
    """(line, text, url, is_image); links within items' children and quotes are on line 0."""
    line = b["line"] if line is None else line
    k = b["kind"]
    if k in ("heading", "paragraph"):
        yield from ((line, *x) for x in inline_links(b["inlines"]))
    elif k == "list":
        for i in b["items"]:
            yield from ((line, *x) for x in inline_links(i["inlines"]))
            for c in i["children"]:
                yield from block_links(c, 0)
    elif k == "quote":
        for c in b["blocks"]:
            yield from block_links(c, 0)
    elif k == "table":
        for c in b["cells"]:
            yield from ((line, *x) for x in inline_links(c))


#: Fixed value: what counts as a link with an unencoded space.
_SPACED = re.compile(r"\[([^\]]+)\]\(([^)]*[ \t][^)]*)\)")


def malformed_links(content: str):
    """(line, url) of links with an unencoded space or tab, outside front matter, fences and code spans."""
    _, body, skipped = split_front_matter(content)
    fenced = False
    for n, line in enumerate(body.split("\n"), skipped + 1):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        elif not fenced:
            yield from ((n, m[2]) for m in _SPACED.finditer(line) if line.count("`", 0, m.start()) % 2 == 0)


def render_block(b: dict, indent: str = "") -> list[str]:
    k = b["kind"]
    if k == "heading":
        return ["#" * b["level"] + " " + markup(b["inlines"])]
    if k == "paragraph":
        return markup(b["inlines"], "\n").split("\n")
    if k == "rule":
        return ["---"]
    if k == "code":
        fence = "`" * max([3, *(len(r) + 1 for r in re.findall("`{3,}", b["text"]))])
        return [fence + (b["language"] or ""), *b["text"].split("\n")[:-1], fence]
    if k == "quote":
        return [("> " + x).rstrip() for x in render_blocks(b["blocks"])]
    if k == "list":
        out = []
        for n, i in enumerate(b["items"], 1):
            mark = f"{n}. " if b["ordered"] else "- "
            out.append((mark + markup(i["inlines"])).rstrip())
            body = ([""] if i["children"] and i["children"][0]["kind"] == "paragraph" else []) + render_blocks(i["children"])
            out += [" " * len(mark) + x if x else "" for x in body]
        return out
    columns = max(len(b["align"]), len(b["header"]))
    line = lambda cells: "| " + " | ".join((cells + [""] * columns)[:columns]) + " |"
    marks = {None: "---", "left": ":---", "right": "---:", "center": ":---:"}
    return [line(b["header"]), line([marks[a] for a in b["align"]]), *(line(r) for r in b["rows"])]


def render_blocks(blocks: list[dict]) -> list[str]:
    out: list[str] = []
    for n, b in enumerate(blocks):
        out += ([""] if n else []) + render_block(b)
    return out


def yaml_scalar(v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return json.dumps(v)
    s = str(v)
    risky = s == "" or s != s.strip() or re.search(r"[:#\n\"'`]", s) or s[0] in "!&*[]{}|>%@-?," or s.lower() in ("true", "false", "null", "~") or re.fullmatch(r"[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?", s)
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"' if risky else s


def yaml_lines(key: str, v, indent: str = "") -> list[str]:
    if isinstance(v, list):
        return [f"{indent}{key}: []"] if not v else [f"{indent}{key}:", *(f"{indent}  - {yaml_scalar(x) if not isinstance(x, (list, dict)) else json.dumps(x)}" for x in v)]
    if isinstance(v, dict):
        return [f"{indent}{key}:", *(x for k, y in v.items() for x in yaml_lines(str(k), y, indent + "  "))]
    return [f"{indent}{key}: {yaml_scalar(v)}".rstrip()]


def serialise(doc: Document, order: list[str] = ()) -> str:
    """The whole file: declared fields first in their order, then the others as they came."""
    out = []
    if doc.front_present:
        keys = [k for k in order if k in doc.fields] + [k for k in doc.fields if k not in order]
        out = ["---", *(yaml_lines("type", doc.doc_type) if doc.doc_type is not None else []), *(x for k in keys for x in yaml_lines(k, doc.fields[k])), "---", ""]
    body = render_blocks(doc.blocks)
    return "\n".join(out + body).rstrip("\n") + "\n"
