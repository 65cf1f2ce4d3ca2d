"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints are made per document in Arrow batches. Distinct fingerprints are then laid out in one table for
each choice of `blocks - distance` of the `blocks` bit blocks: the chosen blocks come first, so two
fingerprints that differ in at most `distance` bits agree on the whole prefix in one table at least
(pigeonhole). Each table is sorted by the Gray rank of the permuted fingerprint, which keeps equal prefixes
together and neighbours alike. Range partitions of that order hold a tree whose upper nodes keep the bit
patterns that all fingerprints below share; a pair of nodes is dropped as soon as the differences
accumulated on the way down exceed the distance, or when both are already in one component. Each partition returns spanning links,
at most one for each fingerprint, never all pairs. A prefix that lies across partitions is compared piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, materialize, read
from .components import components

SEED = 42
FANOUT = 4
#: Piece rows up to which a second look needs no components first; either way gives the same links.
FEW_PIECES = 500_000


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """64-bit SimHash of the word shingles, repeats included; zero without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    last = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        digests = b"".join([xxhash.xxh64_digest(joined[s:e], SEED) for s, e in zip(starts[at : at + (1 << 16)], last[at : at + (1 << 16)])])
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp) for each row; a null or empty text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in as_bytes(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, fp long")


class Layout:
    """Bit permutations: in table t the blocks of `chosen[t]` come first."""

    def __init__(self, distance: int, blocks: int):
        if not 0 < distance < blocks <= 64:
            raise ValueError("blocks must exceed the distance")
        edges = [64 * k // blocks for k in range(blocks + 1)]
        self.spans = [(a, z) for a, z in zip(edges, edges[1:])]
        self.chosen = list(combinations(range(blocks), blocks - distance))
        self.prefix = np.array([sum(self.spans[k][1] - self.spans[k][0] for k in c) for c in self.chosen], np.uint64)

    def order(self, t: int) -> list[int]:
        return [*self.chosen[t], *(k for k in range(len(self.spans)) if k not in self.chosen[t])]

    def permute(self, x: np.ndarray, t: int) -> np.ndarray:
        out = np.zeros_like(x)
        for k in self.order(t):
            a, z = self.spans[k]
            out = (out << np.uint64(z - a)) | ((x >> np.uint64(64 - z)) & np.uint64((1 << (z - a)) - 1))
        return out

    def restore(self, x: np.ndarray, t: int) -> np.ndarray:
        out, left = np.zeros_like(x), 64
        for k in self.order(t):
            a, z = self.spans[k]
            left -= z - a
            out |= ((x >> np.uint64(left)) & np.uint64((1 << (z - a)) - 1)) << np.uint64(64 - z)
        return out


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in the reflected Gray sequence."""
    b = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        b ^= b >> np.uint64(s)
    return b


def gray_code(rank: np.ndarray) -> np.ndarray:
    return rank ^ (rank >> np.uint64(1))


class Forest:
    """Trees over runs of codes in Gray order, one for each group; finds links that span the components."""

    def __init__(self, codes: np.ndarray, group: np.ndarray, distance: int):
        self.codes, self.d, n = codes, distance, len(codes)
        self.root = np.arange(n)
        every = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.levels = [{"lo": np.arange(n), "and": codes, "or": codes, "mask": np.full(n, every), "group": group}]
        while n and (np.diff(self.levels[-1]["group"]) == 0).any():
            x = self.levels[-1]
            g, m = x["group"], len(x["group"])
            first = np.concatenate(([True], g[1:] != g[:-1]))
            at = np.arange(m) - np.flatnonzero(first)[np.cumsum(first) - 1]
            lo = np.flatnonzero(at % FANOUT == 0)
            a, o = np.bitwise_and.reduceat(x["and"], lo), np.bitwise_or.reduceat(x["or"], lo)
            self.levels.append({"lo": lo, "hi": np.append(lo[1:], m), "and": a, "or": o, "mask": ~(a ^ o), "group": g[lo]})
        self._spread()

    def _spread(self) -> None:
        """The component of each node whose codes are all in one, else -1 - its place."""
        below = self.root
        for k, x in enumerate(self.levels):
            if k:
                least, most = np.minimum.reduceat(below, x["lo"]), np.maximum.reduceat(below, x["lo"])
                below = np.where((least == most) & (least >= 0), least, -1 - np.arange(len(least)))
            x["one"] = below

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            if not (x != y).any():
                return
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]

    def link(self, sides: np.ndarray | None = None, slab: int = 1 << 15) -> None:
        """Join each tree with itself; with `sides`, only codes of different sides need comparing."""
        near = np.flatnonzero((np.diff(self.levels[0]["group"]) == 0) & (np.bitwise_count(self.codes[1:] ^ self.codes[:-1]) <= self.d))
        self.union(near, near + 1)
        self._spread()
        top = len(self.levels) - 1
        n = len(self.levels[top]["lo"])
        stack = [(top, np.arange(n), np.arange(n), np.zeros(n, np.int64))] if top else []
        since = 0
        while stack:
            k, i, j, acc = stack.pop()
            if len(i) > slab:
                for s in range(0, len(i), slab):
                    stack.append((k, i[s : s + slab], j[s : s + slab], acc[s : s + slab]))
                continue
            x, y = self.levels[k], self.levels[k - 1]
            keep = (x["one"][i] != x["one"][j]) | (x["one"][i] < 0)
            i, j, acc = i[keep], j[keep], acc[keep]
            if not len(i):
                continue
            mask = x["mask"][i] & x["mask"][j]
            ni, nj = x["hi"][i] - x["lo"][i], x["hi"][j] - x["lo"][j]
            p = np.repeat(np.arange(len(i)), ni * nj)
            q = np.arange(len(p)) - np.repeat(np.cumsum(ni * nj) - ni * nj, ni * nj)
            ci, cj = x["lo"][i][p] + q // nj[p], x["lo"][j][p] + q % nj[p]
            keep = (ci < cj) if k == 1 else (ci <= cj) | (i[p] != j[p])
            ci, cj, p = ci[keep], cj[keep], p[keep]
            new = (y["and"][ci] ^ y["and"][cj]) & y["mask"][ci] & y["mask"][cj] & ~mask[p]
            acc = acc[p] + np.bitwise_count(new)
            keep = acc <= self.d
            ci, cj, acc = ci[keep], cj[keep], acc[keep]
            if not len(ci):
                continue
            if k > 1:
                near = np.argsort(-(cj - ci), kind="stable")  # the nearest are popped first
                stack.append((k - 1, ci[near], cj[near], acc[near]))
                continue
            if sides is not None:
                keep = sides[ci] != sides[cj]
                ci, cj = ci[keep], cj[keep]
            self.union(ci, cj)
            since += len(p)
            if since > 4 * len(self.codes):
                self._spread()
                since = 0


def _tables(fps: DataFrame, lay: Layout) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.uint64(1 << 63)
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for t in range(len(lay.chosen)):
                rank = gray_rank(lay.permute(x, t)) ^ top  # ordered as signed numbers
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(rank.view(np.int64))], ["t", "rank"])

    return fps.select("fp").mapInArrow(run, "t int, rank long")


LINKS = "kind int, a long, b long, t int, key long, part int"


def links(fps: DataFrame, distance: int = 4, blocks: int = 6) -> DataFrame:
    """Spanning links (a, b) of the distinct fingerprints in `fps` (fp long) that differ in at most `distance` bits."""
    lay = Layout(distance, blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        t = np.concatenate([x[0] for x in held])
        rank = np.concatenate([x[1] for x in held]).view(np.uint64) ^ np.uint64(1 << 63)
        key = rank >> (np.uint64(64) - lay.prefix[t])
        group = np.concatenate(([0], np.cumsum((t[1:] != t[:-1]) | (key[1:] != key[:-1]))))
        edge = (group == 0) | (group == group[-1])
        size = np.bincount(group)
        busy = size[group] > 1
        forest = Forest(gray_code(rank[busy]), group[busy], distance)
        forest.link()
        root = np.arange(len(rank))
        root[busy] = np.flatnonzero(busy)[forest.root]
        code, fp = gray_code(rank), np.empty_like(rank)
        for k in np.unique(t):
            fp[t == k] = lay.restore(code[t == k], k)
        fp = fp.view(np.int64)
        own = np.flatnonzero(root != np.arange(len(root)))
        part = TaskContext.get().partitionId()
        for kind, at in ((0, own), (1, np.flatnonzero(edge))):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), kind, np.int32)), pa.array(fp[at]), pa.array(fp[root[at]]), pa.array(t[at].astype(np.int32)), pa.array(key[at].view(np.int64)), pa.array(np.full(len(at), part, np.int32))],
                ["kind", "a", "b", "t", "key", "part"],
            )

    laid = _tables(fps, lay).repartitionByRange("t", "rank").sortWithinPartitions("t", "rank")
    found = materialize(laid.mapInArrow(run, LINKS), "simhash-links")
    within = found.where("kind = 0").select("a", "b")
    pieces = found.where("kind = 1").select("t", "key", "part", F.col("a").alias("fp"))
    torn = pieces.groupBy("t", "key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("t", "key")
    return within.unionByName(_across(pieces.join(torn, ["t", "key"]), within, lay, distance))


def _across(pieces: DataFrame, within: DataFrame, lay: Layout, distance: int) -> DataFrame:
    """Links between the pieces of prefixes that lie across partitions."""
    pieces = materialize(pieces, "simhash-pieces")
    if pieces.count() <= FEW_PIECES:
        spread = pieces.select("t", "key", "part", F.lit(None).cast("long").alias("root"))
    else:
        spread = pieces.join(components(within), F.col("fp") == F.col("node"), "left").select("t", "key", "part", F.coalesce("root", "fp").alias("root"))
    heads = spread.groupBy("t", "key", "part").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    other = heads.select("t", "key", F.col("part").alias("part2"), F.col("least").alias("least2"), F.col("most").alias("most2"))
    pairs = heads.join(other, ["t", "key"]).where("part < part2").where("coalesce(least <> most2 or least2 <> most or least <> least2, true)")
    pairs = pairs.select("t", "key", F.col("part").alias("p"), F.col("part2").alias("q"))
    left = pieces.join(pairs, ["t", "key"]).where("part = p")
    right = pieces.join(pairs, ["t", "key"]).where("part = q")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["t"].iloc[0])
        fp = pdf["fp"].to_numpy()
        rank = gray_rank(lay.permute(fp.view(np.uint64), t))
        at = np.argsort(rank, kind="stable")
        forest = Forest(gray_code(rank[at]), np.zeros(len(at), np.int64), distance)
        forest.link()
        own = np.flatnonzero(forest.root != np.arange(len(at)))
        return pd.DataFrame({"a": fp[at[own]], "b": fp[at[forest.root[own]]]})

    cols = ["t", "key", "p", "q", "fp"]
    return left.select(*cols).unionByName(right.select(*cols)).groupBy("t", "key", "p", "q").applyInPandas(run, "a long, b long")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4, blocks: int = 6) -> DataFrame:
    """(id, fp, root, component_id) for each row of `docs`; root tells components of one component_id apart, as repeated ids have them."""
    made = materialize(fingerprints(docs, id_col, text_col, width), "simhash-fingerprints")
    least = made.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(least, distance, blocks))
    linked = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    return made.join(named, "fp").select("id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4, blocks: int = 6) -> DataFrame:
    """One row for each row of `docs`: (id_col, fingerprint, component_id).

    component_id is the smallest id among the documents that a chain of links reaches, the own one
    included. Null or empty texts have fingerprint zero and link like any other. Repeated ids keep their
    rows; a null id stays null and never becomes a component_id while another id is reachable. Other columns are ignored. An
    empty table gives no rows.
    """
    found = grouped(docs, id_col, text_col, width, distance, blocks)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
