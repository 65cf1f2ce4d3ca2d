"""Near-duplicate passages across documents by compact windows.

The tokens of a text are its shingles of five words. For each of a few hash functions, every node of the Cartesian
tree over the tokens' hashes stands for all subsequences whose least hash is the node's: a compact window (left, anchor,
right). Only windows that hold a passage of `min_words` words are made, about two for each such length of text and
hash. Windows of all documents meet at equal (hash function, least value): their subsequences share that part
of the signature, and the common anchor aligns them. The intervals of windows that meet are then verified: a passage of
the least length or more inside each must have a Jaccard similarity of at least `similarity`. Passages of this similarity meet
with a probability of 1 - (1 - similarity) ** hashes; one agreeing hash makes a candidate, and the tokens decide.

A window is clipped to less than twice the least length around its anchor, since longer passages are cut into parts of
such lengths, the best of which is as similar as the whole. Windows that are equal within the least length on both sides of the anchor are one content
and are compared once for all of them, by the window of the first; only different contents at one anchor are compared by their tokens.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, materialize, read, slices
from .components import components
from .wordhash import _powers, mix, shingles, word_count, word_spans

WIDTH, MIN_WORDS, SIMILARITY, HASHES = 5, 50, 0.8, 3
#: Places by which equal tokens may be out of step in the first look; the second look allows for all insertions that leave the similarity.
STEP = 2
#: Bits of the map that bounds the common tokens of two contexts.
BITS = 4096
#: Contents at one anchor up to which all pairs are compared without an index. In larger groups neighbours and leaders are compared first, which only saves work.
SMALL, NEAR, LEADERS = 48, 6, 64
#: Of the rarest tokens of a context, as many as may differ and SHARED more are looked up; a link needs SHARED of them. PROBES are made at a time.
SHARED, PROBES = 2, 1 << 21
PIECE = 1 << 20
#: Contents that a task compares at a time, or all of one anchor where it has more.
ROWS = 10_000


def tokens(text: bytes | None, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, word starts, word ends)."""
    starts, ends, words = word_spans((text or b"").lower())
    return shingles(words, width), starts, ends


def _levels(v: np.ndarray, top: int, pick) -> list[np.ndarray]:
    out = [v]
    for j in range(top):
        last, step = out[-1], 1 << j
        out.append(pick(last[:-step], last[step:]) if len(last) > step else last[:0])
    return out


def compact_windows(v: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, left, right) of the windows of at least `t` tokens; zeros in `v` separate texts.

    left and right are the tokens on either side of the anchor, 2 t - 2 at most. Of equal values the first is the least.
    """
    n = len(v)
    none = np.zeros(0, np.int64)
    if n < t:
        return none, none, none
    top = t.bit_length() - 1
    reach = (2 * t - 2).bit_length()
    low = _levels(v, max(top, reach - 1), np.minimum)
    least = np.minimum(low[top][: n - t + 1], low[top][t - (1 << top) : t - (1 << top) + n - t + 1])
    edge = np.zeros(t - 1, v.dtype)
    padded = np.concatenate((edge, least, edge))
    high = _levels(padded, top, np.maximum)[top]
    best = np.maximum(high[:n], high[t - (1 << top) : t - (1 << top) + n])
    c = np.flatnonzero((best == v) & (v > 0))
    own, left, right = v[c], c.copy(), c + 1
    for j in range(len(low) - 1, -1, -1):
        step = 1 << j
        at = left - step
        ok = at >= 0
        ok[ok] = low[j][at[ok]] > own[ok]
        left = np.where(ok, at, left)
        ok = right + step <= n
        ok[ok] = low[j][right[ok]] >= own[ok]
        right = np.where(ok, right + step, right)
    left, right = np.minimum(c - left, 2 * t - 2), np.minimum(right - 1 - c, 2 * t - 2)
    keep = left + right + 1 >= t
    return c[keep], left[keep], right[keep]


def _digests(h: np.ndarray, c: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    up, down = _powers(len(h) + 1)
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)))
    whole = (run[c + right + 1] - run[c - left]) * down[c - left]
    return mix(whole + (left * 1000 + right).astype(np.uint64), 77)


WINDOWS = "key long, content long, ent long, c int, more int, l short, r short"


def _windows(texts: DataFrame, t: int, width: int, hashes: int) -> DataFrame:
    """Windows of the texts in `texts` (ent, t); a task skips texts that it has seen."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        ents = np.array([x[0] for x in held], np.int64)
        size = np.array([len(x[1]) for x in held])
        base = np.cumsum(size + 1) - size
        h = np.concatenate([np.zeros(1, np.uint64), *[np.append(x[1], np.uint64(0)) for x in held]])
        gap = np.concatenate(([0], base + size))
        for f in range(hashes):
            v = np.maximum(mix(h, 100 + f), np.uint64(1))
            v[gap] = 0
            c, left, right = compact_windows(v, t)
            own = np.searchsorted(base, c, "right") - 1
            place = c - base[own] + np.array([x[2] for x in held], np.int64)[own]
            # windows in the margin of a piece belong to the piece that has them whole
            keep = (place >= np.array([x[3] for x in held], np.int64)[own]) & (place < np.array([x[4] for x in held], np.int64)[own])
            c, left, right, own, place = c[keep], left[keep], right[keep], own[keep], place[keep]
            key = (v[c] & np.uint64(0xFFFFFFFFFFFFFFF8)) | np.uint64(f)
            content = _digests(h, c, np.minimum(left, t - 1), np.minimum(right, t - 1))
            # a repetitive text has one window again and again; a chain of overlapping ones is one row
            order = np.lexsort((place, content, own))
            own, key, content, place, left, right = (x[order] for x in (own, key, content, place, left, right))
            first = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (content[1:] != content[:-1]) | (key[1:] != key[:-1]) | (np.diff(place) > t))) if len(own) else np.zeros(0, bool))
            last = np.append(first[1:], len(own)) - 1
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x[first].view(np.int64)) for x in (key, content)), pa.array(ents[own[first]]), *(pa.array(x.astype(np.int32)) for x in (place[first], place[last] - place[first])), *(pa.array(x[first].astype(np.int16)) for x in (left, right))],
                ["key", "content", "ent", "c", "more", "l", "r"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held, total = [], 0
        for b in batches:
            for ent, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1))):
                if not text or (mark := hashlib.md5(text).digest()) in seen:
                    continue
                seen.add(mark)
                h = tokens(text, width)[0]
                for at in range(0, len(h) if len(h) >= t else 0, PIECE):
                    lo, hi = max(0, at - 2 * t), min(len(h), at + PIECE + 2 * t)
                    held.append((ent, h[lo:hi], lo, at, at + PIECE))
                    total += hi - lo
                    if total >= 200_000:
                        yield from flush(held)
                        held, total = [], 0
        if held:
            yield from flush(held)

    return texts.mapInArrow(run, WINDOWS)


def _marks(rows: DataFrame) -> DataFrame:
    """(doc, mark, n_words) of the texts in `rows` (doc, t): their MD5 and numbers of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashlib.md5(x).hexdigest() for x in texts], pa.string()), pa.array([word_count(x) for x in texts], pa.int32())], ["doc", "mark", "n_words"])

    return rows.mapInArrow(run, "doc long, mark string, n_words int")


CONTEXT = ["key", "content", "l", "r", "first_doc", "first"]


def _contexts(wanted: DataFrame, texts: DataFrame, t: int, width: int) -> DataFrame:
    """The tokens of each window in `wanted`, 16 bits of each, in places that the anchor aligns."""
    lists = wanted.groupBy("ent").agg(F.collect_list(F.struct("key", "content", "c", "l", "r", "first_doc", "first")).alias("w"))
    joined = lists.join(texts, "ent").select("t", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = np.arange(-(2 * t - 2), 2 * t - 1)
        for whole in batches:
            for b in slices(whole, 0):
                out = []
                for text, w in zip(as_bytes(b.column(0)), b.column(1)):
                    h = tokens(text, width)[0]
                    x = w.values
                    c, left, right = (x.field(k).to_numpy().astype(np.int64) for k in ("c", "l", "r"))
                    at = c[:, None] + reach
                    ok = (reach >= -left[:, None]) & (reach <= right[:, None])
                    code = np.where(ok, h[np.clip(at, 0, len(h) - 1)] >> np.uint64(48), 0).astype(np.uint16)
                    out.append((*(x.field(k) for k in CONTEXT), code))
                if out:
                    codes = np.concatenate([x[-1] for x in out])
                    flat = pa.py_buffer(np.ascontiguousarray(codes).tobytes())
                    size = 2 * (4 * t - 3)
                    ctx = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(codes), [None, flat]).cast(pa.binary())
                    cols = [pa.concat_arrays([x[k] for x in out]) for k in range(len(CONTEXT))]
                    yield pa.RecordBatch.from_arrays([*cols, ctx], [*CONTEXT, "ctx"])

    return joined.mapInArrow(run, "key long, content long, l short, r short, first_doc long, first long, ctx binary")


class Group:
    """Contents at common anchors: verified links, components, matched spans, and what of them rows of lesser order have.

    A row has the tokens around its anchor, `left` and `right` of them. A link is a pair of intervals around the anchor, of `t` tokens
    at least each, of which the Jaccard similarity is high enough. Passages of up to 2 t - 1 tokens are looked at: a longer one is cut
    into such parts, and the best of them is as similar as the whole.
    """

    def __init__(self, ctx: np.ndarray, left: np.ndarray, right: np.ndarray, t: int, similarity: float, order: np.ndarray | None = None):
        self.t, self.similarity, self.mid = t, similarity, 2 * t - 2
        #: Common tokens that a link has at least.
        self.need = math.ceil(2 * t * similarity / (1 + similarity) - 1e-9)
        #: Places by which equal tokens may be out of step: more inserted words make 2 t - 1 tokens too unlike.
        self.step = max(STEP, int((1 - similarity) * (2 * t - 1)))
        place = np.arange(-self.mid, self.mid + 1)
        self.ok, self.ctx = (place >= -left[:, None]) & (place <= right[:, None]), np.maximum(ctx, np.uint16(2))
        n = len(ctx)
        self.root, self.lo, self.hi = np.arange(n), np.full(n, 2 * t), np.full(n, -2 * t)
        self.cut_lo, self.cut_hi = np.full(n, 2 * t), np.full(n, -2 * t)
        self.left, self.right, self.order = left, right, np.arange(n) if order is None else order
        self._bits()

    def _bits(self) -> None:
        """A bitmap of each row's tokens, and how many of them share a bit with another one. The k-th place of a token counts as a token of its own."""
        n, width = self.ctx.shape
        self.token, self.bits = np.empty((n, width), np.int32), np.zeros((n, BITS // 64), np.uint64)
        place = np.arange(width, dtype=np.int32)
        for at in range(0, n, 4096):
            ok = self.ok[at : at + 4096]
            x = np.sort((self.ctx[at : at + 4096].astype(np.int32) << 8) | place, axis=1)
            by, value = x & 255, x >> 8
            valid = np.take_along_axis(ok, by, 1)
            new = np.ones(x.shape, bool)
            new[:, 1:] = value[:, 1:] != value[:, :-1]
            seen = np.cumsum(valid, axis=1, dtype=np.int32)
            before = np.maximum.accumulate(np.where(new, seen - valid, np.int32(0)), axis=1)
            token = np.where(valid, value * width + (seen - before - 1), np.int32(-1))
            np.put_along_axis(self.token[at : at + 4096], by, token, 1)
            r, p = np.nonzero(valid)
            bit = (token[r, p].astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(33 - BITS.bit_length())
            np.bitwise_or.at(self.bits, (at + r, (bit >> 6).astype(np.intp)), np.uint64(1) << (bit & np.uint32(63)).astype(np.uint64))
        self.spare = self.ok.sum(1) - np.bitwise_count(self.bits).sum(1, dtype=np.int64)

    def _codes(self, rows: np.ndarray, none: int, reach: int | None = None) -> np.ndarray:
        """The tokens of rows, with `none`, 0 or 1, in places out of the window."""
        part = slice(None) if reach is None else slice(self.mid - reach, self.mid + reach + 1)
        return np.where(self.ok[rows, part], self.ctx[rows, part], np.uint16(none))

    @staticmethod
    def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where a token of `a` is in `b` too, STEP places away at most."""
        m = a == b
        for s in range(1, STEP + 1):
            m[:, s:] |= a[:, s:] == b[:, :-s]
            m[:, :-s] |= a[:, :-s] == b[:, s:]
        return m

    def compare(self, x: np.ndarray, y: np.ndarray) -> None:
        """Join the components of the pairs that have a link. What a row shares with one of lesser order can be cut of it: the other one keeps it,
        or has it cut for what a still lesser row shares."""
        for at in range(0, len(x), 1 << 13):
            p, q = x[at : at + (1 << 13)], y[at : at + (1 << 13)]
            hit, *spans = self.verify(p, q)
            p, q, spans = p[hit], q[hit], [z[hit] for z in spans]
            for k, other, lo, hi in ((p, q, spans[0], spans[1]), (q, p, spans[2], spans[3])):
                np.minimum.at(self.lo, k, lo)
                np.maximum.at(self.hi, k, hi)
                later = self.order[k] > self.order[other]
                np.minimum.at(self.cut_lo, k[later], lo[later])
                np.maximum.at(self.cut_hi, k[later], hi[later])
            self._union(p, q)

    def _union(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            p, q = self.root[x], self.root[y]
            if not (p != q).any():
                return
            np.minimum.at(self.root, np.maximum(p, q), np.minimum(p, q))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]

    def verify(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        """(linked, first and last place of the passage in x, the same in y) of each pair.

        Passages of t tokens, little out of step, are tried first; only pairs without one that may have `need` common tokens are looked at in full.
        """
        n, t = len(x), self.t
        hit, out = np.zeros(n, bool), [np.zeros(n, np.int64) for _ in range(4)]
        can = (np.bitwise_count(self.bits[x] & self.bits[y]).sum(1, dtype=np.int64) + np.minimum(self.spare[x], self.spare[y])) >= self.need
        some = np.flatnonzero(can)
        if not len(some):
            return hit, *out
        p, q = x[some], y[some]
        places = np.arange(2 * t - 1)
        a, b = self._codes(p, 0, t - 1), self._codes(q, 1, t - 1)
        m = self._equal(a, b)
        run = np.zeros((len(p), len(places) + 1), np.int16)
        np.cumsum(m, axis=1, out=run[:, 1:])
        good = run[:, t:] - run[:, :-t] >= self.need
        start = np.arange(t) - (t - 1)
        good &= (start >= -np.minimum(self.left[p], self.left[q] + STEP)[:, None]) & (start + t - 1 <= np.minimum(self.right[p], self.right[q] + STEP)[:, None])
        near = good.any(axis=1)
        hit[some[near]] = True
        m, good, a, b = m[near], good[near], a[near], b[near]
        if len(m):
            lo, hi = good.argmax(axis=1)[:, None], (2 * t - 2 - good[:, ::-1].argmax(axis=1))[:, None]
            # a span goes from the first to the last equal token of the passages that were found
            for k, equal, more in ((0, m, 0), (2, self._equal(b, a), STEP)):
                equal = equal & (places >= lo - more) & (places <= hi + more)
                out[k][some[near]], out[k + 1][some[near]] = equal.argmax(axis=1) - (t - 1), t - 1 - equal[:, ::-1].argmax(axis=1)
        rest = some[~near]
        for at in range(0, len(rest), 1 << 12):
            self._wide(x, y, rest[at : at + (1 << 12)], hit, out)
        return hit, *out

    def _partner(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place in `b` of each token of `a`, the least out of step; -1 if there is none."""
        out = np.full(a.shape, -1, np.int16)
        place = np.arange(a.shape[1], dtype=np.int16)
        for d in range(self.step, -1, -1):
            for s in (-d, d) if d else (0,):
                here, there = (slice(0, a.shape[1] - s), slice(s, None)) if s >= 0 else (slice(-s, None), slice(0, s))
                np.copyto(out[:, here], place[there], where=a[:, here] == b[:, there])
        return out

    @staticmethod
    def _distinct(there: np.ndarray) -> np.ndarray:
        """A run of one repeated token that meets a single one counts once."""
        there[:, 1:][there[:, 1:] == there[:, :-1]] = -1
        return there

    def _promising(self, there: np.ndarray) -> np.ndarray:
        """First places of which some interval of enough tokens could be similar, by its tokens that are in the other row: a bound that takes one pass.

        An interval from place a to b, with partners p and q, is similar if (1 + s) common - s (b - a + 1) - s (q - p + 1) >= 0, which is a sum of what
        depends on the last place and what depends on the first.
        """
        s, mid, n = self.similarity, self.mid, there.shape[1]
        found = there >= 0
        run = np.cumsum(found, axis=1, dtype=np.float32)
        value = np.float32(1 + s) * run - np.float32(s) * (np.arange(n, dtype=np.float32)[None, :] + there)
        last = np.where(found, value, np.float32(-1e9))[:, mid:]
        most = np.maximum.accumulate(last[:, ::-1], axis=1)[:, ::-1]
        first = np.where(found, value, np.float32(1e9))[:, : mid + 1]
        # the least interval has `need` tokens
        at = np.maximum(np.arange(mid + 1) + self.need - 1 - mid, 0)
        ok = at < most.shape[1]
        return np.where(ok, most[:, np.where(ok, at, 0)] - first + np.float32(1 - s) >= -1e-3, False)

    def _wide(self, x: np.ndarray, y: np.ndarray, some: np.ndarray, hit: np.ndarray, out: list[np.ndarray]) -> None:
        """Intervals around the anchor of any length, from one common token to another."""
        a, b = self._codes(x[some], 0), self._codes(y[some], 1)
        there = self._distinct(self._partner(a, b))
        firsts = self._promising(there) & ((there >= 0).sum(1) >= self.need)[:, None]
        enough = firsts.any(1)
        some, a, b, there, firsts = some[enough], a[enough], b[enough], there[enough], firsts[enough]
        if not len(some):
            return
        back = self._distinct(self._partner(b, a)) >= 0
        runs = []
        for found in (there >= 0, back):
            run = np.zeros((len(found), found.shape[1] + 1), np.int32)
            np.cumsum(found, axis=1, out=run[:, 1:])
            runs.append(run)
        t, mid, s = self.t, self.mid, self.similarity
        to = there.astype(np.int32)
        each = np.arange(len(to))[:, None]
        mine = runs[1][each, np.maximum(to, 0)], runs[1][each, to + 1]
        row, i = np.nonzero(firsts)
        for at in range(0, len(row), 1 << 13):
            k, j = row[at : at + (1 << 13)], i[at : at + (1 << 13)]
            first, last = to[k, j][:, None], to[k, mid:]
            nx, ny = np.arange(mid, 2 * mid + 1)[None, :] - j[:, None] + 1, last - first + 1
            common = np.minimum(runs[0][k, mid + 1 :] - runs[0][k, j][:, None], mine[1][k, mid:] - mine[0][k, j][:, None])
            fine = (last >= mid) & (first <= mid) & (nx <= 2 * t - 1) & (ny <= 2 * t - 1) & (common * (1 + s) >= s * (np.maximum(nx, t) + np.maximum(ny, t)) - 1e-9)
            size = np.where(fine, nx + ny, 0)
            z = size.argmax(1)
            size = size[np.arange(len(k)), z]
            # the longest of each pair; the pairs are in order
            got = np.flatnonzero(size)
            for q in got[np.argsort(size[got], kind="stable")]:
                o = some[k[q]]
                if not hit[o] or size[q] >= out[1][o] - out[0][o] + out[3][o] - out[2][o] + 2:
                    hit[o] = True
                    out[0][o], out[1][o], out[2][o], out[3][o] = j[q] - mid, z[q], to[k[q], j[q]] - mid, to[k[q], mid + z[q]] - mid

    def link(self, group: np.ndarray) -> None:
        """`group` is sorted: rows of one anchor follow each other."""
        size = np.bincount(group)[group]
        for d in range(1, SMALL):
            x = np.flatnonzero((group[:-d] == group[d:]) & (size[:-d] <= SMALL))
            if not len(x):
                break
            self.compare(x, x + d)
        for g in np.unique(group[size > SMALL]):
            self._large(np.flatnonzero(group == g))

    def _trim(self, rows: np.ndarray, orders: list[np.ndarray]) -> None:
        """Links to lesser rows for those of a large group that have none yet: to the least row of the component, and to the nearest lesser ones in both orders."""
        first = np.full(len(self.root), -1)
        by = rows[np.argsort(self.order[rows], kind="stable")][::-1]
        first[self.root[by]] = by
        x = rows[self.cut_hi[rows] < self.cut_lo[rows]]
        self.compare(first[self.root[x]], x)
        for order in orders:
            for way in (order, order[::-1]):
                lesser, stack = np.full(len(self.root), -1), []
                for row, key in zip(way.tolist(), self.order[way].tolist()):
                    while stack and self.order[stack[-1]] >= key:
                        stack.pop()
                    if stack:
                        lesser[row] = stack[-1]
                    stack.append(row)
                x = rows[(self.cut_hi[rows] < self.cut_lo[rows]) & (lesser[rows] >= 0)]
                self.compare(lesser[x], x)

    def _large(self, rows: np.ndarray) -> None:
        mid = self.mid
        codes = self._codes(rows, 0)
        orders = [rows[np.lexsort(part[:, ::-1].T)] for part in (codes[:, mid : mid + self.t], codes[:, mid : mid - self.t : -1])]
        for order in orders:
            for d in range(1, NEAR + 1):
                x, y = order[:-d], order[d:]
                apart = self.root[x] != self.root[y]
                if d > 1:
                    x, y = x[apart], y[apart]
                self.compare(x, y)
        roots, n = np.unique(self.root[rows], return_counts=True)
        for leader in roots[np.argsort(-n, kind="stable")][:LEADERS]:
            others = rows[self.root[rows] != self.root[leader]]
            self.compare(np.full(len(others), leader), others)
        self._rest(rows, self.token[rows])
        self._trim(rows, orders)

    def _rest(self, rows: np.ndarray, codes: np.ndarray) -> None:
        """Compare all rows of different components that can have a link: none is left out.

        A link has `need` common tokens, so of any others + SHARED tokens of a row, where others are all but `need`, SHARED are in the linked row too.
        Every row looks up its rarest tokens.
        """
        n = len(rows)
        roots, root = np.unique(self.root[rows], return_inverse=True)
        if len(roots) < 2:
            return
        r, p = np.nonzero(codes >= 0)
        token = np.unique(codes[r, p], return_inverse=True)[1].astype(np.int64)
        held = np.bincount(token)
        place = np.lexsort((held[token], r))
        rank = np.empty(len(r), np.int64)
        count = np.bincount(r, minlength=n)
        rank[place] = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
        looked = rank < (count - self.need + SHARED)[r]
        # sorted by token, then by component: a row skips its own component
        parts = len(roots)
        order = np.lexsort((root[r], token))
        index, owner = token[order] * parts + root[r[order]], r[order]
        probe = np.flatnonzero(looked & (held[token] > 1))
        at = 0
        while at < len(probe):
            # a row's probes stay together
            to = int(np.searchsorted(r[probe], r[probe[min(at + PROBES // 32, len(probe) - 1)]], "right"))
            self._look(rows, r, token, root, index, owner, probe[at:to], parts, n)
            at = to

    def _look(self, rows: np.ndarray, r: np.ndarray, token: np.ndarray, root: np.ndarray, index: np.ndarray, owner: np.ndarray, k: np.ndarray, parts: int, n: int) -> None:
        key, own = token[k] * parts, root[r[k]]
        edges = [np.searchsorted(index, key + d) for d in (0, own, own + 1, parts)]
        x = np.concatenate((r[k], r[k]))
        lo, hi = np.concatenate((edges[0], edges[2])), np.concatenate((edges[1], edges[3]))
        some = hi > lo
        order = np.argsort(x[some], kind="stable")
        x, lo, hi = (z[some][order] for z in (x, lo, hi))
        ends = np.cumsum(hi - lo)
        at = 0
        while at < len(x):
            # whole rows of about PROBES pairs
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PROBES, "right"))
            to = max(int(np.searchsorted(x, x[min(to, len(x) - 1)])) if to < len(x) else len(x), int(np.searchsorted(x, x[at], "right")))
            size = hi[at:to] - lo[at:to]
            pair = np.repeat(x[at:to], size) * n + owner[np.repeat(lo[at:to] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            pair, times = np.unique(pair, return_counts=True)
            pair = pair[times >= SHARED]
            for b in range(0, len(pair), 1 << 13):
                u, v = rows[pair[b : b + (1 << 13)] // n], rows[pair[b : b + (1 << 13)] % n]
                apart = self.root[u] != self.root[v]
                self.compare(u[apart], v[apart])
            at = to


EXACT, NEARLY, LOST = 0, 1, 2
LINKED = "key long, content long, comp long, lo short, hi short, cut_lo short, cut_hi short"


def _linked(contexts: DataFrame, t: int, similarity: float) -> DataFrame:
    """Contents with a verified link: their component at the anchor, the matched span around it, and what is cut of it (null where no lesser text has it)."""

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        """The links of whole anchors."""
        table = pa.Table.from_batches(rows).combine_chunks()
        key, content = table.column(0).to_numpy(), table.column(1).to_numpy()
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (content[1:] != content[:-1])))
        table = table.take(pa.array(np.flatnonzero(new)))
        key, content = key[new], content[new]
        ctx = np.frombuffer(b"".join(table.column(6).to_pylist()), np.uint16).reshape(-1, 4 * t - 3)
        doc, text = table.column(4).to_numpy(), table.column(5).to_numpy()
        by = np.lexsort((text, doc))
        order = np.empty(len(by), np.int64)
        order[by] = np.cumsum(np.concatenate(([0], (np.diff(doc[by]) != 0) | (np.diff(text[by]) != 0)))) if len(by) else 0
        g = Group(ctx, table.column(2).to_numpy().astype(np.int64), table.column(3).to_numpy().astype(np.int64), t, similarity, order)
        g.link(np.concatenate(([0], np.cumsum(key[1:] != key[:-1]))))
        got = np.flatnonzero(g.hi >= g.lo)
        return pa.RecordBatch.from_arrays(
            [pa.array(key[got]), pa.array(content[got]), pa.array(content[g.root[got]]), *(pa.array(z[got].astype(np.int16)) for z in (g.lo, g.hi)), *(pa.array(z[got].astype(np.int16), mask=(g.cut_hi < g.cut_lo)[got]) for z in (g.cut_lo, g.cut_hi))],
            ["key", "content", "comp", "lo", "hi", "cut_lo", "cut_hi"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n < ROWS:
                continue
            key = b.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last anchor may go on
            if cut or len(held) > 1 and held[-2].column(0)[-1].as_py() != key[0]:
                rest = held.pop().slice(cut)
                held += [b.slice(0, cut)] if cut else []
                yield solve(held)
                held, n = [rest], rest.num_rows
        if held:
            yield solve(held)

    return contexts.repartition("key").sortWithinPartitions("key", "content").mapInArrow(run, LINKED)


def _spans(docs: DataFrame, id_col: str, text_col: str, width: int, min_words: int, similarity: float, hashes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of each distinct text, the passages that others have too (rep, rep_doc, start, end, first, first_doc), in words, and those that a smaller
    document keeps (rep, start, end); and the texts (doc, mark, ent, rep, rep_doc, n_words)."""
    t = min_words - width + 1
    id_, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    rows = docs.select(id_.alias("doc"), text.alias("t"))
    known = materialize(_marks(rows.where("t is not null")), "passage-texts")
    clash = known.groupBy("doc").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).where("doc is null or a <> b").limit(1).count()
    # an id names a text unless several texts share it
    ent = F.xxhash64("doc", "mark") if clash else F.col("doc")
    known = known.withColumn("ent", ent).distinct()
    texts = rows.where("t is not null").withColumn("mark", F.md5(F.col("t").cast("binary"))) if clash else rows.where("t is not null")
    texts = texts.withColumn("ent", ent).select("ent", "t")

    last = F.lit((1 << 63) - 1)
    reps = known.groupBy("mark").agg(F.min(F.struct(F.coalesce("doc", last).alias("o"), "ent")).alias("x")).select("mark", F.col("x.o").alias("rep_doc"), F.col("x.ent").alias("rep"))
    known = materialize(known.join(reps, "mark").select("doc", "mark", "ent", "rep", "rep_doc", "n_words"), "passage-docs")
    owners = known.select("ent", "rep", "rep_doc").distinct()

    by_key, by_content = Window.partitionBy("key"), Window.partitionBy("key", "content").orderBy("ent", "c")
    met = _windows(texts, t, width, hashes).repartition("key").withColumn("place", F.row_number().over(by_content))
    met = met.withColumn("n", F.count("*").over(by_key)).where("n > 1").withColumn("several", F.min("content").over(by_key) != F.max("content").over(by_key))
    met = met.withColumn("copies", F.max("place").over(Window.partitionBy("key", "content"))).where("several or copies > 1").drop("n", "place")
    met = materialize(met.join(owners, "ent"), "passage-windows")
    one = met.where("several").groupBy("key", "content").agg(F.min(F.struct("rep_doc", "rep")).alias("o"), F.min(F.struct("ent", "c", "l", "r")).alias("w"))
    one = one.select("key", "content", "w.*", F.col("o.rep_doc").alias("first_doc"), F.col("o.rep").alias("first"))
    links = materialize(_linked(_contexts(one, texts.dropDuplicates(["ent"]) if clash else texts, t, width), t, similarity), "passage-links")
    met = met.join(links, ["key", "content"], "left").where("copies > 1 or comp is not null")
    # exact copies have a first document of their own: a near one holds only the matched span, and loses what a keeper has
    side = F.lit(t - 1)
    exact = F.struct(F.xxhash64("key", "content").alias("gid"), (-F.least("l", side)).cast("int").alias("a"), F.least("r", side).cast("int").alias("b"), F.lit(EXACT).alias("kind"))
    near = F.struct(F.xxhash64("key", "comp", F.lit(1)).alias("gid"), F.col("lo").cast("int").alias("a"), F.col("hi").cast("int").alias("b"), F.lit(NEARLY).alias("kind"))
    lost = F.struct(F.lit(None).cast("long").alias("gid"), F.col("cut_lo").cast("int").alias("a"), F.col("cut_hi").cast("int").alias("b"), F.lit(LOST).alias("kind"))
    every = F.filter(F.array(F.when(F.col("copies") > 1, exact), F.when(F.col("comp").isNotNull(), near), F.when(F.col("cut_lo").isNotNull(), lost)), lambda x: x.isNotNull())
    found = met.select("rep", "rep_doc", "c", "more", F.explode(every).alias("x")).select("rep", "rep_doc", "x.gid", "x.kind", (F.col("c") + F.col("x.a")).alias("start"), (F.col("c") + F.col("more") + F.col("x.b") + width).alias("end"))
    found = materialize(found.distinct(), "passage-found")
    first = found.where("gid is not null").groupBy("gid").agg(F.min(F.struct("rep_doc", "rep")).alias("f"), F.max(F.struct("rep_doc", "rep")).alias("z")).where("f <> z").select("gid", F.col("f.rep").alias("first"), F.col("f.rep_doc").alias("first_doc"))
    shared = found.join(first, "gid").select("rep", "rep_doc", "start", "end", "first", "first_doc", (F.col("kind") == EXACT).alias("exact"))
    cuts = shared.where("exact and first <> rep").select("rep", "start", "end").unionByName(found.where(F.col("kind") == LOST).select("rep", "start", "end"))
    return shared, cuts, known


def _merged(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping spans of one `keys` become one, with its least first_doc and number of different ones."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    new = spans.withColumn("new", F.coalesce((F.col("start") > F.max("end").over(past)).cast("int"), F.lit(1)))
    run = new.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_doc").alias("first_doc"), F.countDistinct("first_doc").alias("n_links")).drop("run")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, hashes: int = HASHES) -> DataFrame:
    """One row for each maximal passage of a document that another document has too, exactly or nearly.

    (id_col, start_word, end_word, first_doc, n_links, class_id, kept): words are counted from 0, the end is exclusive.
    first_doc is the smallest document id that has (part of) the passage; in that document the passage is kept.
    n_links counts the different such documents of the merged parts, class_id is the smallest document id that a chain of common passages reaches.
    Exact copies of a whole text of `min_words` words are one passage each. Repeats within one document alone do not count.
    Null, empty and shorter texts have no passages; an id with several texts counts as several documents, a null id stays null;
    fully repeated rows count once. Other columns are ignored. An empty table gives no rows.
    """
    spans, _, known = _spans(docs, id_col, text_col, width, min_words, similarity, hashes)
    spans = materialize(spans, "passage-spans")
    sizes = known.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep")
    merged = _merged(spans.select("rep", "start", "end", "first_doc"), ["rep"])
    copied = known.where(f"n_words >= {min_words}").join(sizes, "rep", "left_semi")
    copies = copied.select("doc", "ent", "rep", "rep_doc", F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"), F.col("rep_doc").alias("first_doc"), F.lit(1).cast("long").alias("n_links"))
    own = known.join(merged, "rep").join(copied.select("ent").distinct(), "ent", "left_anti").select("doc", "ent", "rep", "rep_doc", "start", "end", "first_doc", "n_links")
    out = own.unionByName(copies)
    links = spans.where("first <> rep").select(F.col("rep_doc").alias("a"), F.col("first_doc").alias("b"))
    roots = components(links)
    out = out.join(roots, F.col("rep_doc") == F.col("node"), "left")
    return out.select(F.col("doc").alias(id_col), F.col("start").cast("long").alias("start_word"), F.col("end").cast("long").alias("end_word"), "first_doc", "n_links", F.coalesce("root", "rep_doc").alias("class_id"), (F.col("first_doc") == F.coalesce("doc", F.lit((1 << 63) - 1))).alias("kept"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, hashes: int = HASHES) -> DataFrame:
    """`docs` without the passages that a document with a smaller id has too; all columns kept.

    An exact copy of a window stays in the first document that has it. Of a near copy goes the part that was verified against a window of a smaller
    document, which keeps it or loses it to a still smaller one, so that each passage stays in some document.
    A passage is cut from its first word to the start of the word after its last. Further exact copies of a text of
    `min_words` words, and documents of which no word is left after a cut, go; null, empty and untouched texts stay as they are.
    An integer column n_chars, if there is one, is set to the new number of characters of a cut text. Columns may have any other names.
    """
    _, cuts, known = _spans(docs, id_col, text_col, width, min_words, similarity, hashes)
    cuts = _merged(cuts.withColumn("first_doc", F.lit(0)), ["rep"]).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    gone = (F.col("ent") != F.col("rep")) & (F.col("n_words") >= min_words)
    # names that no column of `docs` has
    free = "_"
    while any(c.endswith(free) for c in docs.columns):
        free += "_"
    doc_, mark_, gone_, spans_ = (f"{c}{free}" for c in ("doc", "mark", "gone", "spans"))
    fate = known.join(cuts, "rep", "left").where(gone | F.col("spans").isNotNull()).select(F.col("doc").alias(doc_), F.col("mark").alias(mark_), gone.alias(gone_), F.transform(F.flatten(F.transform("spans", lambda s: F.array(s["start"], s["end"]))), lambda x: x.cast("int")).alias(spans_))
    # an id, or its absence, does not name one text
    same = docs[f"`{id_col}`"].cast("long").eqNullSafe(F.col(doc_)) & (F.md5(docs[f"`{text_col}`"].cast("string").cast("binary")) == F.col(mark_))
    joined = docs.join(fate, same, "left").where(~F.coalesce(F.col(gone_), F.lit(False))).drop(doc_, mark_, gone_)
    at = joined.columns.index(text_col)
    schema = T.StructType([f if f.name != text_col else T.StructField(text_col, T.StringType()) for f in docs.schema.fields])
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, at):
                text, kept, sizes = [], [], []
                for s, cut in zip(as_bytes(b.column(at)), b.column(b.num_columns - 1).to_pylist()):
                    if cut:
                        starts = word_spans(s.lower())[0]
                        edge = np.append(starts, len(s))
                        pick = np.minimum(np.array(cut).reshape(-1, 2), len(starts))
                        parts, last = [], 0
                        for lo, hi in pick:
                            parts.append(s[last : edge[lo]])
                            last = int(edge[hi])
                        s = b"".join([*parts, s[last:]])
                        kept.append(bool(s.strip()))
                        sizes.append(len(s.decode()))
                    else:
                        kept.append(True)
                        sizes.append(None)
                    text.append(s)
                cols = list(b.columns[:-1])
                cols[at] = pa.array(text, pa.large_binary()).cast(pa.large_string()).cast(b.schema.field(at).type)
                if chars is not None:
                    cols[chars] = pc.coalesce(pa.array(sizes, pa.int64()).cast(cols[chars].type), cols[chars])
                yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1]).filter(pa.array(kept, pa.bool_()))

    return joined.mapInArrow(run, schema)


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"))
