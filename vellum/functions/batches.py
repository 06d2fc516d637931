"""Markdown of whole Arrow batches by array operations, for documents of plain shape; the others are left to the parser.

Plain: front matter of single lines, then ATX headings, paragraphs of one line, and dash lists with one level below,
whose texts are without markup or one whole link. What is built equals what ``markdown.Document`` gives for them.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa

from vellum.functions import markdown as M

BLANK, HEAD, PARA, ITEM, SUB, OTHER = range(6)

#: Bytes that may be markup or white space, or begin a white space character beyond ASCII.
_SPECIAL = np.zeros(256, bool)
_SPECIAL[[*range(10), *range(11, 32), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3, *b"\\`[]!<*_&|"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_WORD = _LETTER.copy()
_WORD[48:58] = True
_LINK = re.compile(rb"\[([ \"-%'-);:=>?@A-Z^a-z{}~+,./0-9-]+)\]\(([A-Za-z0-9./_~%:?=#,;+@$-]+)\)")
_KEY = re.compile(r"[A-Za-z][A-Za-z0-9_-]{0,99}")
_OWN = re.compile("[A-Za-z0-9_\"']")
_PLAIN_WORD = re.compile(r"[A-Za-z][A-Za-z0-9_#/.-]*")
_RESERVED = {"null", "true", "false"}
_LINES_KEPT = 20000
_INT, _STRING = ["int"], ["string"]


def entry(key: str, value) -> tuple:
    """(key, kind, json, vals, kinds) of one field."""
    word = lambda v: "true" if v is True else "false" if v is False else "" if v is None else v if isinstance(v, str) else json.dumps(v)
    each = value if isinstance(value, list) else [value]
    return key, M.kind_of(value), json.dumps(value, ensure_ascii=False), [word(x) for x in each], [M.kind_of(x) for x in each]


class Front:
    """Front matter, line by line where each line is a field of its own; lines are remembered up to a bound."""

    def __init__(self):
        self.lines: dict = {}
        self.keys: set = set()

    def _line(self, line: str):
        """The field that a line holds, or False if it has to be read with the others."""
        key, colon, v = line.partition(": ")
        got = False
        if colon and (key in self.keys or _KEY.fullmatch(key) and key.lower() not in _RESERVED):
            if len(self.keys) < _LINES_KEPT:
                self.keys.add(key)
            if v.isdigit() and v.isascii() and (v[0] != "0" or len(v) == 1) and len(v) < 4000:
                return key, "int", v, [v], _INT
            if _PLAIN_WORD.fullmatch(v) and v.lower() not in _RESERVED:
                got = key, "string", '"' + v + '"', [v], _STRING
        if not got:
            try:
                found = M.load_yaml(line)
                if isinstance(found, dict) and len(found) == 1 and _OWN.match(line) and "\r" not in line and not line.rstrip().endswith(("|", ">", "-", "+")):
                    (k, value), = found.items()
                    got = entry(k, value) if isinstance(k, str) else False
            except Exception:  # the whole front matter is read instead, which says what is wrong
                pass
        if len(self.lines) >= _LINES_KEPT:
            self.lines.clear()
        self.lines[line] = got
        return got

    def fields(self, front: str):
        """(type, fields), or None if the lines don't stand alone."""
        out, kept, keys = [], self.lines, self.keys
        for line in front.split("\n"):
            e = kept.get(line)
            if e is None:
                key, _, v = line.partition(": ")
                if key in keys and v.isdigit() and v[0] != "0" and v.isascii() and len(v) < 4000:
                    e = key, "int", v, [v], _INT
                else:
                    e = self._line(line)
            if not e:
                return None
            out.append(e)
        names = [e[0] for e in out]
        if len(set(names)) < len(names):
            return None
        if "type" not in names:
            return None, out
        kind = out.pop(names.index("type"))
        return (kind[3][0], out) if kind[1] == "string" else None

    def read(self, content: str) -> tuple:
        """(present, error, type, fields) of a file."""
        front = M.front_matter(content) if content.startswith("---") else None
        if front is None:
            return False, None, None, []
        if (got := self.fields(front)) is not None:
            return True, None, *got
        present, error, kind, fields = M.read_front(front)
        return bool(present), error, kind, [entry(k, v) for k, v in fields.items()]


def front_arrays(rows: list[tuple], schema: pa.Schema) -> dict:
    """The four columns of front matter."""
    flat = [e for r in rows for e in r[3]]
    counts = np.fromiter((len(r[3]) for r in rows), np.int64, len(rows))
    offsets = _offsets(counts)
    kind = schema.field("fm").type
    inner = kind.value_type
    many = _offsets(np.fromiter((len(e[3]) for e in flat), np.int64, len(flat)))
    strings = lambda k: pa.ListArray.from_arrays(many, pa.array([x for e in flat for x in e[k]], pa.string()), type=inner.field(("vals", "kinds")[k - 3]).type)
    parts = {"pos": pa.array(np.arange(len(flat)) - np.repeat(offsets.to_numpy()[:-1], counts), pa.int32()), "vals": strings(3), "kinds": strings(4)}
    parts |= {n: pa.array([e[k] for e in flat], pa.string()) for k, n in enumerate(("key", "kind", "json"))}
    fm = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([parts[f.name] for f in inner], fields=list(inner)), type=kind)
    return {"fm_present": pa.array([r[0] for r in rows], pa.bool_()), "fm_error": pa.array([r[1] for r in rows], pa.string()), "fm_type": pa.array([r[2] for r in rows], pa.string()), "fm": fm}


def _offsets(counts) -> pa.Array:
    out = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=out[1:])
    return pa.array(out, pa.int32())


def _gather(data, starts, ends, newline=None):
    """Slices one after the other and their offsets; where ``newline`` is set a line break follows."""
    lens = ends - starts if newline is None else ends - starts + newline
    offs = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=offs[1:])
    buf = data[np.arange(offs[-1]) + np.repeat(starts - offs[:-1], lens)]
    if newline is not None:
        buf[offs[1:][newline] - 1] = 10
    return buf, offs


def _strings(buf, offs, valid=None) -> pa.Array:
    bits = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.StringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf)), bits)


def _lengths(counts):
    return np.concatenate([[0], np.cumsum(counts)])


class Batch:
    """Lines of many documents; ``plain`` says which of them have the shape above."""

    def __init__(self, contents: pa.Array, front: Front):
        n = len(contents)
        contents = contents.cast(pa.string()).fill_null("")
        offs = np.frombuffer(contents.buffers()[1], np.int32)[contents.offset : contents.offset + n + 1].astype(np.int64)
        raw = b"" if contents.buffers()[2] is None else contents.buffers()[2].to_pybytes()[offs[0] : offs[-1]]
        raw = raw if len(contents) else b""
        offs = offs - offs[0]
        data = np.frombuffer(raw + b"\n" * 16, np.uint8)
        body_data = data[: len(raw)]
        nl = np.flatnonzero(body_data == 10)
        c = np.searchsorted(nl, offs[1:]) - np.searchsorted(nl, offs[:-1])
        first = _lengths(c + 1)
        total = int(first[-1])
        is_first, is_last = np.zeros(total, bool), np.zeros(total, bool)
        is_first[first[:-1]] = True
        is_last[first[1:] - 1] = True
        ls, le = np.empty(total, np.int64), np.empty(total, np.int64)
        ls[is_first], ls[~is_first] = offs[:-1], nl + 1
        le[is_last], le[~is_last] = offs[1:], nl
        doc = np.repeat(np.arange(n), c + 1)
        size = le - ls
        c0, c1, c2, c3, c4 = (data[ls + k] for k in range(5))

        dashes = (size == 3) & (c0 == 45) & (c1 == 45) & (c2 == 45)
        has_front = dashes[first[:-1]]
        later = np.flatnonzero(dashes & ~is_first)
        close = np.full(n, -1)
        at, place = np.unique(doc[later], return_index=True)
        close[at] = later[place]
        plain = ~(has_front & (close < 0))
        has_front &= plain
        self.front = [(False, None, None, [])] * n
        for d in np.flatnonzero(has_front).tolist():
            a, b = ls[first[d] + 1], le[close[d] - 1]
            got = front.fields(raw[a:b].decode()) if close[d] > first[d] + 1 else None
            if got is None:
                plain[d] = False
            else:
                self.front[d] = (True, None, *got)
        begin = np.where(has_front, close + 1, first[:-1])
        line = np.arange(total)
        body = line >= begin[doc]

        level = np.zeros(total, np.int64)
        hash_ = c0 == 35
        for k in range(7):
            hash_ = hash_ & (data[ls + k] == 35) & (size > k)
            level += hash_
        after, final = data[ls + level + 1], data[np.maximum(le - 1, 0)]
        starts = _LETTER.copy()
        starts[91] = True
        kind = np.full(total, OTHER)
        kind[starts[c0]] = PARA
        kind[(c0 == 45) & (c1 == 32) & (size > 2) & starts[c2]] = ITEM
        kind[(c0 == 32) & (c1 == 32) & (c2 == 45) & (c3 == 32) & (size > 4) & starts[c4]] = SUB
        kind[(level > 0) & (level < 7) & (size > level + 1) & (data[ls + level] == 32) & (after != 32) & (after != 35) & (final != 35)] = HEAD
        kind[(size > 0) & (final == 32)] = OTHER
        kind[size == 0] = BLANK
        ts = ls + np.select([kind == HEAD, kind == ITEM, kind == SUB], [level + 1, 2, 4], 0)
        te = le.copy()

        # lines with what may be markup must be one link
        sp = np.flatnonzero(_SPECIAL[body_data])
        sp = sp[~((data[sp] == 95) & _WORD[data[np.maximum(sp - 1, 0)]] & _WORD[data[sp + 1]] & (sp > 0))]
        marked = np.zeros(total, bool)
        marked[np.searchsorted(ls, sp, "right") - 1] = True
        marked &= body
        bad = body & (kind == OTHER) | marked & (data[ts] != 91)
        prior = np.where(line == begin[doc], BLANK, np.concatenate([[BLANK], kind[:-1]]))
        follows = np.where(is_last, BLANK, np.concatenate([kind[1:], [BLANK]]))
        quiet = lambda x: (x == BLANK) | (x == HEAD)
        listed = (kind == ITEM) | (kind == SUB)
        bad |= body & (kind == PARA) & ~(quiet(prior) & quiet(follows))
        bad |= body & (kind == ITEM) & (prior == PARA) | body & (kind == SUB) & (prior != ITEM) & (prior != SUB)
        seen = np.maximum.accumulate(np.where(body & (kind != BLANK), line, -1)) if total else line
        seen = np.concatenate([[-1], seen[:-1]])
        bad |= body & (kind == ITEM) & (prior == BLANK) & (seen >= begin[doc]) & listed[seen]  # a loose list
        plain &= np.bincount(doc[bad], minlength=n) == 0

        self.link_at, spans = [], []
        md = ts.copy()
        for k in np.flatnonzero(marked & plain[doc]).tolist():
            m = _LINK.fullmatch(raw, ts[k], le[k])
            if m is None:
                plain[doc[k]] = False
            else:
                self.link_at.append(k)
                spans.append((*m.span(1), *m.span(2)))
        at, spans = np.array(self.link_at, np.int64), np.array(spans, np.int64).reshape(-1, 4)
        good = plain[doc[at]] if len(at) else np.zeros(0, bool)
        self.link_at, spans = at[good], spans[good]
        ts[self.link_at], te[self.link_at] = spans[:, 0], spans[:, 1]
        self.urls = spans[:, 2:]

        texts = np.flatnonzero(body & plain[doc] & (kind != BLANK))
        starts_block = np.zeros(total, bool)
        starts_block[texts] = ~(listed[texts] & ((prior[texts] == ITEM) | (prior[texts] == SUB)))
        self.n, self.raw, self.data, self.plain, self.doc, self.line_no = n, raw, data, plain, doc, line - first[doc] + 1
        self.ls, self.le, self.ts, self.te, self.md, self.kind, self.level = ls, le, ts, te, md, kind, level
        self.texts, self.blocks = texts, np.flatnonzero(starts_block)
        self.block_of = np.cumsum(starts_block) - 1
        self.n_blocks = np.bincount(doc[self.blocks], minlength=n)
        self.first_block = _lengths(self.n_blocks)
        self.idx = np.arange(len(self.blocks)) - self.first_block[doc[self.blocks]]
        self.items = np.flatnonzero(listed & body & plain[doc])
        self.n_items = np.bincount(doc[self.items], minlength=n)
        b_kind, b_level = kind[self.blocks], level[self.blocks]
        top = (b_kind == HEAD) & (b_level <= 2)
        last = np.maximum.accumulate(np.where(top, np.arange(len(top)), -1)) if len(top) else np.zeros(0, np.int64)
        inside = (last >= self.first_block[doc[self.blocks]]) & (b_level[last] == 2) if len(top) else np.zeros(0, bool)
        self.section, self.inside = np.where(inside, last, 0), inside

    def _text(self, lines) -> pa.Array:
        return _strings(*_gather(self.data, self.ts[lines], self.te[lines]))

    def _section(self, blocks) -> dict:
        """section_idx and section_title of blocks."""
        head, inside = self.section[blocks], self.inside[blocks]
        at = self.blocks[head] if len(head) else np.zeros(0, np.int64)
        if not len(head):
            return {"section_idx": lambda: pa.array([], pa.int32()), "section_title": lambda: pa.array([], pa.string())}
        return {"section_idx": lambda: pa.array(self.idx[head], pa.int32(), mask=~inside), "section_title": lambda: _strings(*_gather(self.data, self.ts[at], np.where(inside, self.te[at], self.ts[at])), inside)}

    def _list(self, field: pa.Field, counts, parts: dict) -> pa.Array:
        inner = field.type.value_type
        return pa.ListArray.from_arrays(_offsets(counts), pa.StructArray.from_arrays([parts[f.name]() for f in inner], fields=list(inner)), type=field.type)

    def column(self, field: pa.Field) -> pa.Array:
        """One parsed column; what isn't plain has empty values."""
        return getattr(self, "_col_" + field.name)(field)

    def _titles(self):
        at = self.blocks[(self.kind[self.blocks] == HEAD) & (self.level[self.blocks] == 1)]
        docs, k = np.unique(self.doc[at], return_index=True)
        has, line = np.zeros(self.n, bool), np.zeros(self.n, np.int64)
        has[docs], line[docs] = True, at[k]
        return has, line

    def _col_title(self, field):
        has, at = self._titles()
        return _strings(*_gather(self.data, self.ts[at], np.where(has, self.te[at], self.ts[at])), has)

    def _col_h1_line(self, field):
        has, at = self._titles()
        return pa.array(self.line_no[at], pa.int32(), mask=~has)

    def _col_body_text(self, field):
        buf, offs = _gather(self.data, self.ts[self.texts], self.te[self.texts], np.ones(len(self.texts), bool))
        return _strings(buf, offs[_lengths(np.bincount(self.doc[self.texts], minlength=self.n))])

    def _block_texts(self):
        """Texts of blocks; those of a list's items are joined."""
        counts = np.bincount(self.block_of[self.texts], minlength=len(self.blocks))
        ends = _lengths(counts)
        more = np.ones(len(self.texts), bool)
        more[ends[1:] - 1] = False
        buf, offs = _gather(self.data, self.ts[self.texts], self.te[self.texts], more)
        return _strings(buf, offs[ends])

    def _block_md(self):
        counts = np.bincount(self.block_of[self.texts], minlength=len(self.blocks))
        return _strings(*_gather(self.data, self.ls[self.blocks], self.le[self.blocks + counts - 1]))

    def _col_blocks(self, field):
        b, kind = self.blocks, self.kind[self.blocks]
        names = pa.array(["heading", "paragraph", "list"], pa.string())
        parts = {
            "idx": lambda: pa.array(self.idx, pa.int32()),
            "kind": lambda: names.take(pa.array(np.minimum(kind, ITEM) - HEAD)),
            "level": lambda: pa.array(self.level[b], pa.int32(), mask=kind != HEAD),
            "line": lambda: pa.array(self.line_no[b], pa.int32()),
            "ordered": lambda: pa.array(np.zeros(len(b), bool), pa.bool_(), mask=kind != ITEM),
            "text": self._block_texts,
            "md": self._block_md,
        }
        return self._list(field, self.n_blocks, parts | self._section(np.arange(len(b))))

    def _col_links(self, field):
        at = self.link_at
        own = self.block_of[at]
        parts = {
            "block_idx": lambda: pa.array(self.idx[own], pa.int32()),
            "line": lambda: pa.array(np.where(self.kind[at] == SUB, 0, self.line_no[self.blocks[own]]), pa.int32()),
            "text": lambda: self._text(at),
            "url": lambda: _strings(*_gather(self.data, self.urls[:, 0], self.urls[:, 1])),
            "is_image": lambda: pa.array(np.zeros(len(at), bool), pa.bool_()),
        }
        return self._list(field, np.bincount(self.doc[at], minlength=self.n), parts | self._section(own))

    def _col_items(self, field):
        at = self.items
        sub, own = self.kind[at] == SUB, self.block_of[at]
        number = np.arange(len(at)) - _lengths(self.n_items)[self.doc[at]]
        above = number[np.maximum.accumulate(np.where(sub, 0, np.arange(len(at))))] if len(at) else number
        parts = {
            "block_idx": lambda: pa.array(self.idx[own], pa.int32()),
            "item_id": lambda: pa.array(number, pa.int32()),
            "parent": lambda: pa.array(above, pa.int32(), mask=~sub),
            "depth": lambda: pa.array(sub.astype(np.int32), pa.int32()),
            "ordered": lambda: pa.array(np.zeros(len(at), bool), pa.bool_()),
            "text": lambda: self._text(at),
            "md": lambda: _strings(*_gather(self.data, self.md[at], self.le[at])),
            "has_children": lambda: pa.array(~sub & np.concatenate([sub[1:], [False]]), pa.bool_()) if len(at) else pa.array([], pa.bool_()),
        }
        return self._list(field, self.n_items, parts | self._section(own))

    def _col_malformed(self, field):
        return pa.array([[]] * self.n, field.type)
