"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one full-dimensional codeword from each codebook. Codebooks are fitted on residuals of a
bounded sample (`SAMPLE` vectors, the smallest hashes of their ids) and refined together by least squares. Every row is encoded by beam search, and the index
stores its codes, the norm of its reconstruction and the norm of what is left. A query's inner products with all codewords form a lookup
table; a row's approximate score is the sum of a few entries. Every row whose approximate score comes within `Z` standard errors of
the running k-th best exact score is scored exactly on the original vectors: the number of candidates has no cap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read

SAMPLE = 16384
BOOKS, WORDS, BEAM = 8, 256, 8
SEEDS, Z = 64, 3.5
QUERY_BLOCK, ROW_BLOCK = 4096, 4096


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(x @ c.T - 0.5 * (c * c).sum(1), axis=1)


class Codebooks:
    """(BOOKS, WORDS, d) codewords with their Gram matrix."""

    def __init__(self, c: np.ndarray):
        self.c = c.astype(np.float32)
        self.m, self.k, self.d = c.shape
        flat = self.c.reshape(-1, self.d)
        self.gram = flat @ flat.T

    @classmethod
    def fit(cls, x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 2, seed: int = 11) -> "Codebooks":
        x = x.astype(np.float32)
        rng = np.random.default_rng(seed)
        words = max(1, min(words, len(x)))
        left, c = x.copy(), np.zeros((books, words, x.shape[1]), np.float32)
        for m in range(books):
            c[m] = left[rng.choice(len(left), words, replace=False)]
            for _ in range(6):
                own = _nearest(left, c[m])
                n = np.bincount(own, minlength=words)
                total = np.zeros_like(c[m], np.float64)
                np.add.at(total, own, left)
                c[m][n > 0] = (total[n > 0] / n[n > 0, None]).astype(np.float32)
                c[m][n == 0] = left[rng.choice(len(left), int((n == 0).sum()))]
            left = left - c[m][_nearest(left, c[m])]
        out = cls(c)
        for _ in range(rounds):
            codes = out.encode(x) + np.arange(books) * words
            ata, atx = np.zeros((books * words,) * 2), np.zeros((books * words, x.shape[1]))
            for a in range(books):
                np.add.at(atx, codes[:, a], x)
                for b in range(books):
                    np.add.at(ata, (codes[:, a], codes[:, b]), 1.0)
            keep = 0.01 * len(x) / words
            c = np.linalg.solve(ata + keep * np.eye(len(ata)), atx + keep * out.c.reshape(-1, out.d))
            out = cls(c.reshape(books, words, -1))
        return out

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Beam search: keep the best `beam` partial sums at each codebook; (n, books) codes."""
        out = np.zeros((len(x), self.m), np.int64)
        norms = np.diagonal(self.gram).reshape(self.m, self.k)
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024].astype(np.float32)
            dots = (part @ self.c.reshape(-1, self.d).T).reshape(len(part), self.m, self.k)
            codes, cost = np.zeros((len(part), 1, 0), np.int64), np.zeros((len(part), 1), np.float32)
            for m in range(self.m):
                grow = cost[:, :, None] + norms[m] - 2 * dots[:, m][:, None, :]
                for p in range(m):
                    grow += 2 * self.gram[p * self.k + codes[:, :, p], m * self.k : (m + 1) * self.k]
                flat = grow.reshape(len(part), -1)
                b = min(beam, flat.shape[1])
                best = np.argpartition(flat, b - 1, axis=1)[:, :b]
                cost = np.take_along_axis(flat, best, 1)
                codes = np.concatenate([np.take_along_axis(codes, (best // self.k)[:, :, None], 1), (best % self.k)[:, :, None]], axis=2)
            out[at : at + 1024] = codes[np.arange(len(part)), cost.argmin(1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.c[m][codes[:, m]] for m in range(self.m))


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v) of rows that take part: id known, vector not null or empty, all components finite, not all zero."""
    v = F.col(vec_col).cast("array<double>")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull()).where(fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


INDEX = "id long, v array<double>, codes binary, norm double, rest double"


def build_index(vectors: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, Codebooks | None]:
    """Index every row of `vectors` (id, v); vectors of another length than the most frequent one (then the shortest) are left out."""
    sizes = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], INDEX), None
    d = sizes[0]["d"]
    vectors = vectors.where(F.size("v") == d)
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    books = Codebooks.fit(np.array([r["v"] for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), d)
            codes = books.encode(x)
            made = books.decode(codes).astype(np.float64)
            sent = pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), sent, pa.array((made * made).sum(1)), pa.array(np.linalg.norm(x - made, axis=1))], ["id", "v", "codes", "norm", "rest"])

    return materialize(vectors.mapInArrow(run, INDEX), "vector-index"), books


def _exact(q: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray, metric: str) -> np.ndarray:
    """Double-precision measure of pairs, summed from the first component to the last."""
    out = np.empty(len(qi))
    for at in range(0, len(qi), 1 << 15):
        a, b = q[qi[at : at + (1 << 15)]], x[xi[at : at + (1 << 15)]]
        out[at : at + (1 << 15)] = np.cumsum(a * b if metric == "ip" else -((a - b) ** 2), axis=1)[:, -1]
    return out


def search(index: DataFrame, books: Codebooks | None, queries: DataFrame, k: int = 20, metric: str = "ip") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows found for each query (id, v), rows with the query's id left out.

    metric "ip" is the inner product, "l2" the negated squared distance. Ties go to the smaller id. Queries come in
    blocks of about QUERY_BLOCK, each broadcast; every task keeps k rows of a query.
    """
    spark = index.sparkSession
    schema = "query_id long, vec_id long, score double"
    if books is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = books.d
    queries = queries.where(F.size("v") == d).groupBy("id").agg(F.min("v").alias("v"))
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def part(block: int) -> DataFrame:
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == block).collect()
        shared = spark.sparkContext.broadcast((np.array([r["id"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.float64).reshape(-1, d)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            norm_q = np.linalg.norm(q, axis=1)
            table = np.einsum("qd,mkd->qmk", q.astype(np.float32), books.c)
            best_q, best_id, best_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            floor = np.full(len(q), -np.inf)
            for whole in batches:
                for b in (whole.slice(i, ROW_BLOCK) for i in range(0, whole.num_rows, ROW_BLOCK)):
                    own, x = b.column(0).to_numpy(), _matrix(b.column(1), d)
                    codes = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, books.m)
                    norm, slack = b.column(3).to_numpy(), b.column(4).to_numpy() * (Z / np.sqrt(d))
                    got = []
                    for lo in range(0, len(q), 512):
                        some = np.arange(lo, min(lo + 512, len(q)))
                        s = np.zeros((len(some), len(own)), np.float32)
                        for m in range(books.m):
                            s += table[some, m][:, codes[:, m]]
                        error = norm_q[some][:, None] * slack[None, :]
                        if metric == "l2":
                            s = 2 * s - norm[None, :] - (norm_q[some] ** 2)[:, None]
                            error = 2 * error
                        n = min(max(SEEDS, 2 * k), len(own))
                        seed = np.argpartition(-s, n - 1, axis=1)[:, :n]
                        exact = _exact(q, x, np.repeat(some, n), seed.ravel(), metric).reshape(len(some), n)
                        exact[own[seed] == ids[some][:, None]] = -np.inf
                        if n >= k:
                            floor[some] = np.maximum(floor[some], -np.partition(-exact, k - 1, axis=1)[:, k - 1])
                        close = s + error >= floor[some][:, None]
                        np.put_along_axis(close, seed, True, axis=1)
                        qi, xi = np.nonzero(close & (own[None, :] != ids[some][:, None]))
                        got.append((some[qi], xi, _exact(q, x, some[qi], xi, metric)))
                    qi, xi, sc = (np.concatenate(c) for c in zip(*got)) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                    best_q, best_id, best_s = np.concatenate((best_q, qi)), np.concatenate((best_id, own[xi])), np.concatenate((best_s, sc))
                    order = np.lexsort((best_id, -best_s, best_q))
                    best_q, best_id, best_s = best_q[order], best_id[order], best_s[order]
                    start = np.searchsorted(best_q, best_q)
                    keep = np.arange(len(best_q)) - start < k
                    best_q, best_id, best_s = best_q[keep], best_id[keep], best_s[keep]
                    full = np.flatnonzero(np.arange(len(best_q)) - np.searchsorted(best_q, best_q) == k - 1)
                    floor[best_q[full]] = np.maximum(floor[best_q[full]], best_s[full])
            yield pa.RecordBatch.from_arrays([pa.array(ids[best_q]), pa.array(best_id), pa.array(best_s)], ["query_id", "vec_id", "score"])

        return index.mapInArrow(run, schema)

    found = part(0)
    for block in range(1, n_blocks):
        found = found.unionByName(part(block))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest rows by inner product of every row whose id is divisible by `every`.

    Null ids and vectors that are null, empty, zero or not finite take no part. Repeated ids are one query (the least vector) and as many
    candidates as rows. With fewer candidates than k, all are returned; an empty table gives no rows. Other columns are ignored.
    """
    index, books = build_index(usable(vectors, id_col, vec_col))
    return search(index, books, index.where(F.col("id") % every == 0).select("id", "v"), k)


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_reduce(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2]), lambda x, y: x + y) AS score
      FROM ok a JOIN ok b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
