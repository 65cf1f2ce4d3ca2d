"""Language identification by language-bitmask n-gram filters.

Learning puts every character n-gram of letters of a language's sample into bit-sliced Bloom filters: one table of slots whose bits are the
languages, so that one probe, the AND of a few slots, returns all languages that contain an n-gram. The tasks that read the sample fill slots, and
Spark joins the masks of a slot by OR, so the driver gathers one row a slot at most. A text's n-grams are looked up together, the
popcount of each language is corrected for the rate of false positives measured on the filled filter, and the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, held_out, read
from .wordhash import mix

#: Bound of the training sample: documents of a language (the smallest hashes of their ids). Their whole texts are learned.
MOST_DOCS = 1500
SIZES = (3, 4, 5)
SLOT_BITS, PROBES, MOST_LANGS = 21, 3, 512
#: Characters that are looked at together; the n-grams across a cut are counted too.
PIECE = 1 << 20


def letters(text: str) -> np.ndarray:
    """Lower-cased code points, every run of other characters than letters as one space, with a space at both ends."""
    return np.concatenate([np.array([32], np.uint32), *_letters(text)])


def _letters(text: str) -> Iterator[np.ndarray]:
    """The letters after the first space, in pieces cut after a blank where there is one."""
    at, open_ = 0, False  # open_: the last code point given is a letter
    while at < len(text):
        to = len(text)
        if to - at > PIECE:
            to = text.find(" ", at + PIECE, at + 2 * PIECE) + 1 or at + PIECE
        low = text[at:to].lower()
        a = np.frombuffer(low.encode("utf-32-le", "replace"), np.uint32)
        ok = ((a >= 97) & (a <= 122)) if low.isascii() else _is_letter(a)
        a = np.where(ok, a, np.uint32(32))
        keep = np.ones(len(a), bool)
        keep[1:] = (a[1:] != 32) | (a[:-1] != 32)
        keep[0] = open_ or a[0] != 32
        a = a[keep]
        if len(a):
            open_ = bool(a[-1] != 32)
            yield a
        at = to
    if open_:
        yield np.array([32], np.uint32)


def text_grams(text: str) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of a text, piece by piece."""
    carried = np.array([32], np.uint32)
    for a in _letters(text):
        a = np.concatenate((carried, a))
        yield grams(a, len(carried))
        carried = a[-(max(SIZES) - 1) :]


def _is_letter(a: np.ndarray) -> np.ndarray:
    ok = (a >= 97) & (a <= 122)
    high = np.flatnonzero(a > 127)
    if len(high):
        known, back = np.unique(a[high], return_inverse=True)
        ok[high] = np.array([chr(c).isalpha() for c in known.tolist()])[back]
    return ok


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def grams(whole: np.ndarray, old: int = 0) -> np.ndarray:
    """Hashes of the n-grams of all SIZES that have a letter and end behind the first `old` code points."""
    out = []
    for n in SIZES:
        a = whole[max(0, old - n + 1) :]
        if len(a) < n:
            continue
        h = np.full(len(a) - n + 1, n, np.uint64)
        any_letter = np.zeros(len(h), bool)
        for k in range(n):
            part = a[k : k + len(h)]
            h = h * np.uint64(0x100000001B3) + part
            any_letter |= part != 32
        out.append(mix(h[any_letter], 5))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


@dataclass
class Filters:
    """slots[g] has the masks of the languages 64 g to 64 g + 63."""

    langs: list[str] = field(default_factory=list)
    slots: list[np.ndarray] = field(default_factory=list)
    false: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def _group(self, g: int) -> np.ndarray:
        while len(self.slots) <= g:
            self.slots.append(np.zeros(1 << SLOT_BITS, np.uint64))
        return self.slots[g]

    def put(self, lang: int, hashes: np.ndarray) -> None:
        for at in self._at(hashes):
            self._group(lang // 64)[at] |= np.uint64(1 << lang % 64)

    def put_masks(self, group: int, at: np.ndarray, masks: np.ndarray) -> None:
        self._group(group)[at] |= masks

    def close(self) -> "Filters":
        """A bit of a slot is set at random with its fill rate; all probes must meet one."""
        self._group((len(self.langs) - 1) // 64 if self.langs else 0)
        self.false = np.array([float(((self.slots[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()) ** PROBES for k in range(len(self.langs))])
        if len(self.langs) <= 8:
            self.slots = [x.astype(np.uint8) for x in self.slots]
        return self

    @staticmethod
    def _at(hashes: np.ndarray) -> list[np.ndarray]:
        width = np.uint64((1 << SLOT_BITS) - 1)
        return [((hashes >> np.uint64(SLOT_BITS * k)) & width).astype(np.intp) for k in range(PROBES)]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        total = np.zeros(len(self.langs))
        n = 0
        for hashes in text_grams(text):
            n += len(hashes)
            at = self._at(hashes)
            for g, slots in enumerate(self.slots):
                mask = slots[at[0]]
                for k in at[1:]:
                    mask = mask & slots[k]
                some = range(64 * g, min(64 * g + 64, len(self.langs)))
                if slots.dtype == np.uint8:
                    count = np.bincount(mask, minlength=256)
                    total[some] += [count[(np.arange(256) >> k) & 1 == 1].sum() for k in range(len(some))]
                else:
                    total[some] += [int(((mask >> np.uint64(k % 64)) & np.uint64(1)).sum()) for k in some]
        share = np.clip((total - self.false * n) / np.maximum(1 - self.false, 1e-9) / max(1, n), 0, 1)
        best = int(np.argmax(share))
        return self.langs[best], float(share[best] / max(share.sum(), 1e-12)) if share[best] > 0 else 0.0


def train(docs: DataFrame, most: int = MOST_DOCS) -> Filters:
    """Filters of the languages of not held-out rows with a language. Raises if there are more than MOST_LANGS.

    Learned from one whole text each (that with the smallest hash, where an id has several) of at most `most` ids of a language: those with the
    smallest hashes. Every n-gram of them is in the filter of its language. However often an id is repeated, it counts once.
    """
    known = docs.where("doc_id is not null and lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    ids = known.select("lang", "doc_id").distinct()
    sizes = {r["lang"]: r["n"] for r in ids.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MOST_LANGS + 1).collect()}
    langs = sorted(sizes)
    if len(langs) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not langs:
        return Filters()
    # the smallest hashes of ids lie below a bound that leaves about four times as many as are wanted
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, 4 * most / sizes[lang]))])
    order = F.xxhash64("doc_id")
    few = ids.where(order.cast("double") <= (share[F.col("lang")] - 0.5) * float(2**64))
    chosen = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id"))).where(F.col("k") <= most).select("lang", "doc_id")
    code = {lang: k for k, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filters(langs)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for part in text_grams(text):
                    own.put(code[lang], part)
        for g, slots in enumerate(own.slots):
            at = np.flatnonzero(slots)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g, np.int32)), pa.array(at.astype(np.int32)), pa.array(slots[at].view(np.int64))], ["g", "slot", "mask"])

    # at most MOST_LANGS * most short rows are broadcast; of repeated rows of an id, partial minima leave one text
    sample = known.join(F.broadcast(chosen), ["lang", "doc_id"], "left_semi").select("lang", "doc_id", F.col("text").cast("string").alias("text"))
    sample = sample.groupBy("lang", "doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("lang", "text")
    filled = sample.mapInArrow(run, "g int, slot int, mask long").groupBy("g", "slot").agg(F.bit_or("mask").alias("mask"))
    filters = Filters(langs)
    for g, part in filled.toPandas().groupby("g"):
        filters.put_masks(int(g), part["slot"].to_numpy(np.intp), part["mask"].to_numpy(np.int64).view(np.uint64))
    return filters.close()


def languages(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs`: doc_id, held_out, lang_pred, score.

    Texts that are null or have no letter are `und` with score 0, and so is every text when no language could be
    learned. Ties go to the language that sorts first. Repeated rows get the same answer and are learned once; other columns are ignored.
    """
    filters = docs.sparkSession.sparkContext.broadcast(train(docs.select("doc_id", "lang", F.col("text").cast("string").alias("text"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [filters.value.predict(t.decode() if t is not None else None) for t in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(read(spark, sf_dir, "documents"))
