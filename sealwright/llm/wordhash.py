"""Vectorised word boundaries and word hashes of UTF-8 text, without a Python loop over words.

A word is a run of bytes that are not white space (space, tab to carriage return); A-Z is lower-cased. The hash is
a polynomial in 64-bit arithmetic, taken from a running sum over the bytes, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
SEGMENT = 1 << 21
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _tables.update(up=np.cumprod(up, dtype=np.uint64), down=np.cumprod(down, dtype=np.uint64))
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mixer; another seed gives another order."""
    x = x ^ np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Cut very long texts at white space, so that the tables of powers stay small."""
    start = 0
    while len(data) - start > SEGMENT:
        end = start + SEGMENT
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield start, data[start:end]
        start = end
    yield start, data[start:]


def word_count(data: bytes) -> int:
    """The number of words, as word_spans finds them."""
    n, before = 0, False
    for at in range(0, len(data), SEGMENT):
        w = ~_SPACE[np.frombuffer(data[at : at + SEGMENT], np.uint8)]
        n += int(np.count_nonzero(w[1:] & ~w[:-1])) + int(w[0] and not before)
        before = bool(w[-1])
    return n


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of `data`, which must be lower-cased already."""
    out = []
    for at, part in _segments(data):
        a = np.frombuffer(part, np.uint8)
        w = np.concatenate(([False], ~_SPACE[a], [False]))
        turn = np.flatnonzero(w[1:] != w[:-1])
        s, e = turn[::2], turn[1::2]
        up, down = _powers(len(a) + 1)
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], dtype=np.uint64)))
        out.append((s + at, e + at, mix((run[e] - run[s]) * down[s])))
    return tuple(np.concatenate(x) for x in zip(*out))


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of `width` consecutive words; empty if there are fewer."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(BASE) + words[k : k + n]
    return mix(out, 1)
