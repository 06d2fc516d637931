"""Sets of word shingles as 64-bit hashes, for whole Arrow batches at once."""

from __future__ import annotations

import numpy as np

SIZE = 5

_M = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_R, _SHIFT = 0x9E3779B97F4A7C15, np.uint64(32)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A random odd value for each byte; those that part words are 9 to 13 and 32.
_VALUE = (np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_PARTS = np.zeros(256, bool)
_PARTS[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M[0]
    x = (x ^ (x >> np.uint64(27))) * _M[1]
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, r in enumerate((_R, pow(_R, -1, 1 << 64))):
            t = np.full(size, r, np.uint64)
            t[0] = 1
            _powers[k] = np.multiply.accumulate(t)
    return _powers


def forget() -> None:
    """Lets go of the tables of powers."""
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of joined texts (uint8, each followed by a space), and the first word of each text."""
    data = _LOWER[data]
    gap = _PARTS[data]
    word = ~gap
    start = np.flatnonzero(word & np.concatenate([[True], gap[:-1]]))
    stop = np.flatnonzero(gap & np.concatenate([[False], word[:-1]]))
    up, down = _power_tables(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * up[: len(data)], dtype=np.uint64)])
    h = (total[stop] - total[start]) * down[start]
    return mix(h + (stop - start).astype(np.uint64) * _M[1]), np.searchsorted(start, ends)


def sets_of(texts: list[str | None], most: int = 1 << 19):
    """Yields the sorted distinct shingle hashes of each text.

    A text of fewer than five words has one shingle, the whole sequence; one without words has none.
    """
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and (not group or size < most):
            group.append((texts[at] or "").encode("utf-8", "surrogatepass") + b" ")
            size += len(group[-1])
            at += 1
        data = np.frombuffer(b"".join(group), np.uint8)
        ends = np.cumsum([len(x) for x in group])
        words, last = word_hashes(data, ends)
        h = np.zeros(max(0, len(words) - SIZE + 1), np.uint64)
        for k in range(SIZE):
            h = mix(h * _M[0] + words[k : k + len(h)])
        a = 0
        for b in last.tolist():
            if b - a >= SIZE:
                yield np.unique(h[a : b - SIZE + 1])
            elif b > a:
                one = np.array([b - a], np.uint64)
                for w in words[a:b]:
                    one = mix(one * _M[1] + w)
                yield one
            else:
                yield np.empty(0, np.uint64)
            a = b
        if len(_powers[0]) > 1 << 21:  # those of a very long text
            forget()


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed integers."""
    a = np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64) if len(s) else np.uint64(0)
    b = np.bitwise_xor.reduce(mix(s * _M[1] + np.uint64(1))) if len(s) else np.uint64(0)
    return int(np.int64(a.astype(np.int64))), int(np.int64(b.astype(np.int64)))
