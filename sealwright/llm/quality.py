"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` words. Every passage gets a vector of byte-class, word-length,
repetition and hashed-trigram shares, and a learned layer encodes it. Gated attention, learned from document
labels alone, weighs the encoded passages; the weighted sum is scored by a logistic unit. Training runs on
a bounded sample of labelled documents (`MOST_LABELLED`, the smallest hashes of their ids); scoring reads every
passage of every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, held_out, read, slices
from .wordhash import word_spans

PASSAGE = 64
#: Bound of the training sample, in labelled documents. All passages of one are learned.
MOST_LABELLED = 5000
GRAMS, UNITS, GATES, ROUNDS, BAGS = 32, 24, 12, 30, 128

_CLASS = np.full(256, 12, np.uint8)
for _k, _chars in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r\t", b".,", b";:'\"-()?", b"!", b"#$%&*+=@^~", b"|/\\_", b"<>[]{}`"]):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 11
CLASSES = 13
FEATURES = CLASSES + 5 + GRAMS


def passages(text: bytes | None) -> np.ndarray:
    """(passages, FEATURES) of a text; one row of zeros without words."""
    text = text or b""
    starts, ends, hashes = word_spans(text.lower())
    n = len(starts)
    if not n:
        return np.zeros((1, FEATURES), np.float32)
    first = np.arange(0, n, PASSAGE)
    k = len(first)
    bag = np.arange(n) // PASSAGE
    cut = np.append(starts[first], len(text))
    cut[0] = 0
    a = np.frombuffer(text, np.uint8)
    own = np.repeat(np.arange(k), np.diff(cut))
    size = np.diff(cut).astype(np.float64)
    kinds = np.bincount(own * CLASSES + _CLASS[a], minlength=k * CLASSES).reshape(k, CLASSES) / size[:, None]
    gram = (a[:-2].astype(np.uint32) * 0x9E5 + a[1:-1] * np.uint32(0x3C7) + a[2:] * np.uint32(0x85D)) >> 4
    grams = np.bincount(own[: len(gram)] * GRAMS + (gram % GRAMS), minlength=k * GRAMS).reshape(k, GRAMS) / size[:, None]
    count = np.bincount(bag)
    length = (ends - starts).astype(np.float64)
    mean = np.bincount(bag, length) / count
    spread = np.sqrt(np.maximum(np.bincount(bag, length**2) / count - mean**2, 0))
    order = np.lexsort((hashes, bag))
    new = np.ones(n, bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (bag[order][1:] != bag[order][:-1])
    distinct = np.bincount(bag[order], new) / count
    whole = len(np.unique(hashes)) / n
    more = np.stack([np.log1p(mean), spread / 8, distinct, np.full(k, whole), np.log1p(count) / 5], axis=1)
    return np.concatenate([kinds, more, grams], axis=1).astype(np.float32)


class Attention:
    """score = s(w . sum_k a_k h_k + b), h = tanh(W f), a = softmax(v . (tanh(A h) * s(B h)))."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        shape = {"W": (FEATURES, UNITS), "c": (UNITS,), "A": (UNITS, GATES), "B": (UNITS, GATES), "v": (GATES,), "w": (UNITS,), "b": ()}
        self.p = {k: rng.normal(0, 1 / np.sqrt(max(1, s[0] if s else 1)), s) if k not in "cb" else np.zeros(s) for k, s in shape.items()}
        self.mean, self.scale, self.known = np.zeros(FEATURES), np.ones(FEATURES), False

    def forward(self, f: np.ndarray, first: np.ndarray) -> tuple:
        p, n = self.p, np.diff(np.append(first, len(f)))
        h = np.tanh(f @ p["W"] + p["c"])
        t, g = np.tanh(h @ p["A"]), 1 / (1 + np.exp(-(h @ p["B"])))
        e = (t * g) @ p["v"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), n))
        a = e / np.repeat(np.add.reduceat(e, first), n)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return h, t, g, a, z, 1 / (1 + np.exp(-np.clip(z @ p["w"] + p["b"], -30, 30)))

    def step(self, f: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted log loss."""
        p, n = self.p, np.diff(np.append(first, len(f)))
        h, t, g, a, z, s = self.forward(f, first)
        d = (s - y) * weight / weight.sum()
        dz = np.repeat(d[:, None] * p["w"], n, axis=0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first), n))
        dt, dg = de[:, None] * p["v"] * g * (1 - t * t), de[:, None] * p["v"] * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ p["A"].T + dg @ p["B"].T) * (1 - h * h)
        return {"W": f.T @ dh, "c": dh.sum(0), "A": h.T @ dt, "B": h.T @ dg, "v": (t * g).T @ de, "w": z.T @ d, "b": d.sum()}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, seed: int = 7) -> "Attention":
        if len(set(y.tolist())) < 2:
            return self
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-3
        bags = [(b - self.mean) / self.scale for b in bags]
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(x) for k, x in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        t = 0
        for _ in range(ROUNDS):
            for pick in np.array_split(rng.permutation(len(bags)), -(-len(bags) // BAGS)):
                f = np.concatenate([bags[i] for i in pick])
                first = np.concatenate(([0], np.cumsum([len(bags[i]) for i in pick])[:-1]))
                t += 1
                for k, x in self.step(f, first, y[pick], weight[pick]).items():
                    x = x + 1e-4 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.999 * v[k] + 0.001 * x * x
                    self.p[k] = self.p[k] - 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.known = True
        return self

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        """0.5 for every bag while nothing is known."""
        if not self.known or not bags:
            return np.full(len(bags), 0.5)
        first = np.concatenate(([0], np.cumsum([len(b) for b in bags])[:-1]))
        return self.forward((np.concatenate(bags) - self.mean) / self.scale, first)[-1]


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Attention:
    """Fit on at most `most` labelled, not held-out documents, both labels alike as far as they go and weighted back to their shares.

    An id that several rows have is one document, whose text is the one with the smallest hash.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    known = known.where(~held_out(F.col("doc_id"))).join(docs.where("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    least = min(most // 2, min(totals.values(), default=0))
    quota = {y: min(n, most - least if n > least else least) for y, n in totals.items()}
    picked = [r for y in sorted(quota) for r in known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(quota[y]).collect()]
    if not picked:
        return Attention()
    chosen = spark.createDataFrame([(r["doc_id"], r["y"]) for r in picked], "doc_id long, y int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [passages(t).tobytes() for t in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bags, pa.binary()), b.column(2)], ["doc_id", "bag", "y"])

    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = sample.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "y")
    rows = sorted(sample.mapInArrow(run, "doc_id long, bag binary, y int").collect(), key=lambda r: (r["doc_id"], r["bag"]))
    y = np.array([r["y"] for r in rows], np.float64)
    share = {k: totals[k] / max(1, quota[k]) for k in totals}
    weight = np.array([share[int(k)] for k in y])
    return Attention().fit([np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES).astype(np.float64) for r in rows], y, weight)


def scored(docs: DataFrame, model: Attention, text_col: str = "text") -> tuple[DataFrame, str]:
    """`docs` with one more double column, whose name is returned."""
    name = "score"
    while name in docs.columns:
        name += "_"
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, at):
                scores = np.concatenate([model.score([passages(t) for t in as_bytes(b.column(at))[i : i + 256]]) for i in range(0, b.num_rows, 256)])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores)], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])), name


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of `docs`: doc_id, held_out, score, predicted.

    Null, empty and wordless texts are one passage of zeros and get the model's score for it. Labels of unknown
    documents and null labels are ignored, contradicting ones averaged. With labels of one kind
    or none, every score is 0.5. Repeated rows are scored alike; a null doc_id is scored and not held out.
    """
    model = train(docs, labels)
    out, name = scored(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= 0.5).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
