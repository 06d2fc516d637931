"""Byte-pair encoding of whole texts, with exact ids.

Whole Arrow batches are cut into pre-tokens by array operations over their bytes. The ids of each distinct pre-token
are worked out once per Python worker and kept in a hash table of bounded size, which is looked up for all pre-tokens
of a batch at once and compares them byte by byte. Two engines work out the ids of a pre-token:

* ``library``: the model of the tokenizers library itself.
* ``prefix``: per-prefix dynamic programming (``PrefixBPE``), written here.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

from . import common

#: The pre-tokeniser's pattern and the place of byte values among printable characters are part of
#: the public byte-level BPE format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Bits of the hash table's size, and how many pre-tokens it holds before it starts afresh: half of its places.
TABLE_BITS = 21
ENTRIES = 1 << (TABLE_BITS - 1)
#: Pre-tokens of more bytes are not kept in the table but in a dictionary, up to a length and number.
IN_TABLE, IN_DICT, LONG_ENTRIES = 15, 64, 1 << 16
#: Places that a pre-token may have in the table.
TRIES = 8
#: Bytes that are worked on at once, and from which a text is cut before a space between visible characters.
GROUP, PART = 1 << 20, 1 << 22

#: Classes of characters: white space (the White_Space property alone, not the separators 1C to 1F), letters, numbers.
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary file."""
    out = {chr(b): b for b in PRINTABLE}
    for k, b in enumerate(b for b in range(256) if b not in set(PRINTABLE)):
        out[chr(256 + k)] = b
    return out


class PrefixBPE:
    """Encodes a pre-token by one pass over its prefixes.

    The encoding of every prefix is unique, so it is enough to keep its last token. An automaton over all token
    strings reports the tokens that end at a position; the one whose predecessor (the last token of what is left
    of it) may stand before it is the prefix's last token. Two tokens may stand side by side if undoing their
    merges along the common border never shows a merge that byte-pair encoding would have made earlier.
    """

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_characters()
        vocab = spec["model"]["vocab"]
        size = max(vocab.values()) + 1
        self.token_bytes: list[bytes] = [b""] * max(size, 1 + max([a["id"] for a in spec.get("added_tokens", [])], default=0))
        for text, i in vocab.items():
            self.token_bytes[i] = bytes(to_byte[c] for c in text)
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        for text, i in self.special.items():
            self.token_bytes[i] = text.encode()
        # order[t]: when the merge that makes t is made; bytes come before all merges.
        self.rank = [-1] * size
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.merged: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, t = vocab[left], vocab[right], vocab[left + right]
            self.merged[a, b] = t
            if self.parts[t] is None:
                self.parts[t], self.rank[t] = (a, b), r
        self._fits: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for i, b in enumerate(self.token_bytes[:size]):
            if len(b) == 1 or (b and self.parts[i] is not None):
                self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()

    def fits(self, a: int, b: int) -> bool:
        """Whether byte-pair encoding can leave a and b side by side."""
        key = (a, b)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            known = self._fits[key] = self._walk_border(a, b)
        return known

    def _walk_border(self, a: int, b: int) -> bool:
        # Undo the later of the two merges, again and again. A pair met on the way would have been merged in place
        # of what was undone last, if its own merge comes first (on the left side also if it comes at that time).
        before = len(self.parts) * 2
        while True:
            t = self.merged.get((a, b))
            if t is not None and self.rank[t] * 2 < before:
                return False
            if self.rank[a] < 0 and self.rank[b] < 0:
                return True
            if self.rank[a] > self.rank[b]:
                before = self.rank[a] * 2
                a = self.parts[a][1]
            else:
                before = self.rank[b] * 2 + 1
                b = self.parts[b][0]

    def encode(self, word: bytes) -> list[int]:
        last = [-1] * (len(word) + 1)
        size = [0] * (len(word) + 1)
        fits = self._fits.get
        for end, (n, t) in self.automaton.iter(word.decode("latin-1")):
            if size[end + 1]:
                continue
            start = end + 1 - n
            if start:
                p = last[start]
                ok = fits((p, t))
                if not (self.fits(p, t) if ok is None else ok):
                    continue
            last[end + 1], size[end + 1] = t, n
        out, i = [], len(word)
        while i:
            out.append(last[i])
            i -= size[i]
        return out[::-1]


class Pretokeniser:
    """Starts of the pre-tokens (see ``PATTERN``) in joined texts, found by comparing classes of neighbouring bytes."""

    def __init__(self):
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        self.of = np.full(0x110000, _OTHER, np.uint8)
        for kind, name in ((_SPACE, "White_Space"), (_LETTER, "L"), (_NUMBER, "N")):
            for m in regex.finditer(rf"\p{{{name}}}+", every):
                a, b = (x + 0x800 * (x >= 0xD800) for x in m.span())
                self.of[a:b] = kind

    def classes(self, data: np.ndarray) -> np.ndarray:
        """The class of each byte's character; ``data``: UTF-8 and three more bytes at least."""
        out = self.of[:256][data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            at = [data[lead + k].astype(np.int32) for k in range(4)]
            low = [x & 0x3F for x in at]
            two = (at[0] & 0x1F) << 6 | low[1]
            three = (at[0] & 0x0F) << 12 | low[1] << 6 | low[2]
            four = (at[0] & 0x07) << 18 | low[1] << 12 | low[2] << 6 | low[3]
            kind = self.of[np.where(at[0] < 0xE0, two, np.where(at[0] < 0xF0, three, np.minimum(four, 0x10FFFF)))]
            out[lead] = out[lead + 1] = kind
            for k, least in ((2, 0xE0), (3, 0xF0)):
                more = at[0] >= least
                out[lead[more] + k] = kind[more]
        return out

    def starts(self, data: np.ndarray, size: int, segments: np.ndarray) -> np.ndarray:
        """``segments``: places, ascending, where a text of its own begins; ``data`` has ``size`` bytes and padding."""
        kind = self.classes(data)
        hard = np.zeros(len(data), bool)
        hard[segments] = True
        start = hard.copy()
        start[1:] |= kind[1:] != kind[:-1]
        start[0] = True
        # the last white space before something visible parts from the white space before it; a space joins what follows
        p = np.flatnonzero(start[1:size] & (kind[1:size] != _SPACE) & (kind[: size - 1] == _SPACE) & ~hard[1:size]) + 1
        q = p - 1
        for _ in range(3):
            q = q - ((data[q] & 0xC0) == 0x80)
        start[q] = True
        start[p[data[p - 1] == 32]] = False
        # an apostrophe that begins a pre-token takes these endings, whatever follows
        a = np.flatnonzero(data[:size] == 39)
        a = a[start[a] & ~hard[a + 1]]
        if len(a):
            x, y = data[a + 1], data[a + 2]
            one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
            two = (((x == 114) | (x == 118)) & (y == 101) | (x == 108) & (y == 108)) & ~hard[a + 2]
            inside = a + 1 + one + 2 * two <= size
            for ends, count in ((a[one & inside], 2), (a[two & inside], 3)):
                start[ends + 1] = False
                start[ends + count] = True
        return np.flatnonzero(start[:size])


_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class Encoder:
    """ids of whole columns of texts. ``engine``: ``library`` or ``prefix``.

    The strings of special tokens in a text count as those tokens; none are added around it. Beside the vocabulary
    an encoder holds its table alone, whose size doesn't depend on the texts.
    """

    def __init__(self, path: str, engine: str = "library"):
        with open(path, encoding="utf-8") as f:
            form = json.load(f).get("pre_tokenizer") or {}
        if form.get("type") != "ByteLevel" or form.get("add_prefix_space"):
            raise ValueError(f"{path}: not a byte-level vocabulary without a space in front")
        self.engine = engine
        if engine == "library":
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            lib = Tokenizer.from_file(path)
            self.special = {t.content: i for i, t in lib.get_added_tokens_decoder().items()}
            self._model = lib.model
            self._shown = {b: c for c, b in byte_characters().items()}
        else:
            self.bpe = PrefixBPE(path)
            self.special = self.bpe.special
        names = sorted((s.encode() for s in self.special), key=len, reverse=True)
        self._specials = {s.encode(): i for s, i in self.special.items()}
        self._find = re.compile(b"|".join(map(re.escape, names))) if names else None
        self._cut_before_spaces = not any(b" " in s for s in names)
        self.pretokens = Pretokeniser()
        self._clear()

    def _clear(self) -> None:
        places = 1 << TABLE_BITS
        self._key = [np.zeros(places, np.uint64), np.zeros(places, np.uint64)]
        self._at, self._count = np.zeros(places, np.int32), np.zeros(places, np.uint8)
        self._ids, self._used, self._held = np.empty(1 << 20, np.uint32), 0, 0
        self._long: dict[bytes, tuple[int, int]] = {}

    def _encode_new(self, pieces: list[bytes]) -> list[list[int]]:
        special = self._specials
        if self.engine == "library":
            shown, tokenize = self._shown, self._model.tokenize
            return [[special[p]] if p in special else [t.id for t in tokenize(p.decode("latin-1").translate(shown))] for p in pieces]
        return [[special[p]] if p in special else self.bpe.encode(p) for p in pieces]

    def _keep(self, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Puts ids behind those that are held; whether they stay there is up to the caller. Returns places and numbers."""
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(count.sum())
        if self._used + total > len(self._ids):
            grown = np.empty(max(2 * len(self._ids), self._used + total), np.uint32)
            grown[: self._used] = self._ids[: self._used]
            self._ids = grown
        self._ids[self._used : self._used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self._end = self._used + total
        return self._used + np.cumsum(count) - count, count

    def _look_up(self, w0: np.ndarray, w1: np.ndarray, slot: np.ndarray, want: str) -> np.ndarray:
        """Place of each key in the table (``want``: held) or of a free place for it (free); -1 if there is none."""
        out = np.full(len(w0), -1, np.int64)
        rest = np.arange(len(w0))
        for k in range(TRIES):
            place = (slot[rest] + k) & ((1 << TABLE_BITS) - 1) if k else slot
            there = self._key[1][place]
            hit = (there == w1[rest]) & (self._key[0][place] == w0[rest]) if want == "held" else there == 0
            out[rest[hit]] = place[hit]
            rest = rest[~hit & (there != 0)]
            if not len(rest):
                break
        return out

    def _spans(self, raw: np.ndarray, ends: np.ndarray):
        """(first row, row after the last, first byte, byte after the last) of parts of about GROUP bytes."""
        row, at, size = 0, 0, len(raw)
        while row < len(ends):
            last = max(row + 1, int(np.searchsorted(ends, at + GROUP, "right")))
            stop = int(ends[last - 1])
            while stop - at > PART and self._cut_before_spaces:
                near = at + GROUP
                cut = -1
                while cut < 0 and near < stop - 1:
                    x = raw[near : min(stop, near + 65538)]
                    here = np.flatnonzero((x[1:-1] == 32) & (x[:-2] > 32) & (x[:-2] < 127) & (x[2:] > 32) & (x[2:] < 127))
                    cut, near = (near + 1 + int(here[0]), near) if len(here) else (-1, near + 65536)
                if cut < 0:
                    break
                yield row, row, at, cut
                at = cut
            yield row, last, at, stop
            row, at = last, stop

    def column(self, texts: pa.Array):
        """For parts of a column, in order: first row, row after the last, their ids joined (uint32), the ends of each row's.

        Null counts as empty. A very long text comes in several parts: all but the last have no row's end (the row
        after the last is the first), so their ids are the beginning of that row's.
        """
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        if texts.null_count:
            texts = texts.fill_null("")
        wide = pa.types.is_large_string(texts.type)
        _, places, body = texts.buffers()
        places = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(body, np.uint8)[places[0] : places[-1]] if body is not None else np.empty(0, np.uint8)
        places = places - places[0]
        for first, after, a, b in self._spans(raw, places[1:]):
            ids, ends = self._part(raw[a:b], np.maximum(places[first : max(after, first + 1)], a) - a, places[first + 1 : after + 1] - a)
            yield first, after, ids, ends

    def _part(self, raw: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = len(raw)
        if not size:
            return np.empty(0, np.uint32), np.zeros(len(stops), np.int64)
        data = np.zeros(size + 24, np.uint8)
        data[:size] = raw
        body, segments, inner = raw.tobytes(), begins, None
        if self._find is not None and any(s in body for s in self._specials):
            edges = np.append(begins, size)
            found = np.array([m.span() for m in self._find.finditer(body)], np.int64)
            # one that spans two texts is none
            own = np.searchsorted(edges, found[:, 0], "right") == np.searchsorted(edges, found[:, 1] - 1, "right")
            inner = found[own]
            segments = np.unique(np.concatenate([begins, inner.ravel()]))
        start = self.pretokens.starts(data, size, segments[segments < size])
        if inner is not None and len(inner):
            within = np.searchsorted(inner[:, 0], start, "left") - 1
            start = start[(within < 0) | (start >= inner[within, 1])]
        length = np.diff(np.append(start, size))
        place, count = self._find_pieces(data, body, start, length)
        total = np.cumsum(count)
        ids = self._ids[np.repeat(place - (total - count), count) + np.arange(total[-1])]
        return ids, np.concatenate([[0], total])[np.searchsorted(start, stops)]

    def _find_pieces(self, data: np.ndarray, body: bytes, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each pre-token are, and how many they are."""
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        short = np.minimum(length, IN_TABLE)
        w0 = eight[start] & _MASK[np.minimum(short, 8)]
        w1 = eight[start + 8] & _MASK[np.maximum(short - 8, 0)] | short.astype(np.uint64) << np.uint64(56)
        slot = w1 * _MIX[0] ^ w0
        slot = (slot ^ slot >> np.uint64(29)) * _MIX[1]
        slot = (slot >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        if self._held > ENTRIES or len(self._long) > LONG_ENTRIES:
            self._clear()
        there = self._look_up(w0, w1, slot, "held")
        there[length > IN_TABLE] = -1
        place, count = self._at[there].astype(np.int64), self._count[there].astype(np.int64)
        miss = np.flatnonzero(there < 0)
        if not len(miss):
            return place, count
        pieces = [body[a : a + n] for a, n in zip(start[miss].tolist(), length[miss].tolist(), strict=True)]
        known = self._long
        where: dict[bytes, int] = {}
        first: list[int] = []
        for i, p in zip(miss.tolist(), pieces, strict=True):
            if p not in where and p not in known:
                where[p] = len(first)
                first.append(i)
        if first:
            new = list(where)
            at, n = self._keep(self._encode_new(new))
            old = [known.get(p) for p in pieces]
            at_new, n_new = at.tolist(), n.tolist()
            both = [o or (at_new[where[p]], n_new[where[p]]) for o, p in zip(old, pieces, strict=True)]
            lead = np.array(first)
            fits = length[lead] <= IN_TABLE
            kept = self._insert(w0[lead[fits]], w1[lead[fits]], slot[lead[fits]], at[fits], n[fits])
            for p, x, y in zip(new, at_new, n_new, strict=True):
                if IN_TABLE < len(p) <= IN_DICT:
                    known[p] = (x, y)
                    kept = True
            if kept:
                self._used = self._end
        else:
            both = [known[p] for p in pieces]
        found = np.array(both, np.int64)
        place[miss], count[miss] = found[:, 0], found[:, 1]
        return place, count

    def _insert(self, w0, w1, slot, at, n) -> bool:
        rest, kept = np.arange(len(w0)), False
        for _ in range(TRIES):  # keys that want the same free place: one gets it, the others look again
            if not len(rest):
                break
            free = self._look_up(w0[rest], w1[rest], slot[rest], "free")
            rest, free = rest[free >= 0], free[free >= 0]
            place, one = np.unique(free, return_index=True)
            got = rest[one]
            self._key[0][place], self._key[1][place], self._at[place], self._count[place] = w0[got], w1[got], at[got], n[got]
            self._held += len(got)
            kept = kept or len(got) > 0
            rest = np.delete(rest, one)
        return kept

    def rows(self, texts: pa.Array):
        """(first row, row after the last, ids, ends) as ``column``, but only whole rows: a long text's parts are joined."""
        held: list[np.ndarray] = []
        for first, after, ids, ends in self.column(texts):
            if after == first:
                held.append(ids)
                continue
            if held:
                before = sum(map(len, held))
                ids, ends, held = np.concatenate([*held, ids]), ends + before, []
            yield first, after, ids, ends

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """ids of each text as little-endian unsigned 32-bit values."""
        out: list[bytes] = []
        for _, _, ids, ends in self.rows(pa.array(texts, pa.large_string())):
            body, at = ids.astype("<u4").tobytes(), 0
            for e in ends.tolist():
                out.append(body[4 * at : 4 * e])
                at = e
        return out

    def ids(self, text: str | None) -> bytes:
        return self.batch([text])[0]


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same rows of ids with one more id at the end of each."""
    return np.insert(ids, ends, np.uint32(end_id)), ends + np.arange(1, len(ends) + 1)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def forget() -> None:
    """Lets go of the encoders that this worker keeps."""
    _ENCODERS.clear()


def encoder(path: str, engine: str = "library") -> Encoder:
    """One encoder for each file, engine and Python worker, kept until the worker turns to another operator."""
    common.holding("tokens", forget)
    if (path, engine) not in _ENCODERS:
        _ENCODERS[path, engine] = Encoder(path, engine)
    return _ENCODERS[path, engine]


def default_tokenizer() -> str:
    """The vocabulary file that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def sentence_ends(path: str):
    """For each id whether a sentence may end after it: its text ends with a stop, a mark or a line feed."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    to_byte = byte_characters()
    vocab = spec["model"]["vocab"]
    out = np.zeros(1 + max([*vocab.values(), *(a["id"] for a in spec.get("added_tokens", []))]), bool)
    for text, i in vocab.items():
        out[i] = to_byte[text[-1]] in b".!?\n"
    return out
