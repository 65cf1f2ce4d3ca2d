"""Periodic runs of words, by divide and conquer over the midpoints of a batch of texts.

Words are interned to integers; the texts of a batch lie in one array, with an integer of its own between two of them, so that no
run leaves its text. The array is halved again and again: a run lies in the smallest aligned block that holds it, and crosses its midpoint. For
every midpoint of a level and every period q that fits, a run with exponent k has at least half of its length on one side. So the
values of the Z-function of the right half at q (or of the reversed left half) must reach k*q/2 - q: the first words of this
comparison are looked at for all midpoints and periods of a level at once, which leaves very few, and the extent of those to both
sides is found by bisection over prefix hashes. Found intervals are deduplicated, the smallest period of an interval stays, and
every run is verified word by word; should a hash have lied, the extents of the batch are found again by direct comparison.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, read, slices
from .wordhash import _powers, mix

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))),
        T.StructField("collapsed", T.StringType()),
    ]
)
_ARROW = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])
FIRST = 8


class Extents:
    """Longest common extensions of positions of one array."""

    def __init__(self, x: np.ndarray):
        self.x, self.n = x, len(x)
        up, self.down = _powers(self.n + 1)
        self.run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(x.astype(np.int64).view(np.uint64), 3) * up[: self.n], dtype=np.uint64)))

    def _equal(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.run[i + n] - self.run[i]) * self.down[i] == (self.run[j + n] - self.run[j]) * self.down[j]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that are equal from i and j > i on."""
        low, high = np.zeros(len(i), np.int64), self.n - j
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            good = self._equal(i, j, mid) & open_
            low, high = np.where(good, mid, low), np.where(good | ~open_, high, mid - 1)
        return low

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that are equal up to i and j > i, both excluded, backwards."""
        low, high = np.zeros(len(i), np.int64), i.copy()
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            good = self._equal(i - mid, j - mid, mid) & open_
            low, high = np.where(good, mid, low), np.where(good | ~open_, high, mid - 1)
        return low


class Plain(Extents):
    """The same by direct comparison, for arrays on which a hash has lied."""

    def __init__(self, x: np.ndarray):
        self.x, self.n = x, len(x)

    def _far(self, i: int, j: int, most: int, step: int) -> int:
        x, done = self.x, 0
        while done < most:
            n = min(4096, most - done)
            a, b = (x[i + done : i + done + n], x[j + done : j + done + n]) if step > 0 else (x[i - done - n : i - done][::-1], x[j - done - n : j - done][::-1])
            bad = np.flatnonzero(a != b)
            if len(bad):
                return done + int(bad[0])
            done += n
        return done

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.array([self._far(a, b, self.n - b, 1) for a, b in zip(i.tolist(), j.tolist())], np.int64)

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.array([self._far(a, b, a, -1) for a, b in zip(i.tolist(), j.tolist())], np.int64)


def _alive(half: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, period) where the words from the start of a row equal those a period later, for the first words that `need` asks for."""
    periods, width = len(need), half.shape[1]
    mask = np.ones((len(half), periods), bool)
    for t in range(min(2, int(need.max()))):
        n = min(periods, width - 1 - t)  # what `need` asks for lies inside the half
        eq = half[:, 1 + t : n + 1 + t] == half[:, t : t + 1]
        mask[:, :n] &= eq if need[:n].min() > t else eq | (need[:n] <= t)
    row, q = np.divmod(np.flatnonzero(mask), periods)
    q += 1
    for t in range(2, FIRST):
        asked = need[q - 1] > t
        if not asked.any():
            break
        ok = ~asked
        ok[asked] = half[row[asked], t] == half[row[asked], t + q[asked]]
        row, q = row[ok], q[ok]
    return row, q


def runs_of(x: np.ndarray, longest: int, exponent: int = 4, least: int = 6, extents: type[Extents] = Extents) -> np.ndarray:
    """(start, end, period) of every run in `x`, in order; no run is longer than `longest`. Values that separate texts occur once."""
    n = 1 << max(3, int(len(x) - 1).bit_length())
    x = np.concatenate((x, -np.arange(1, n - len(x) + 1) - (1 << 40)))
    ext, found = None, []
    half = 1
    while 2 * half < max(least, exponent):
        half *= 2
    while half <= n // 2:
        periods = min(2 * half, longest) // exponent
        if periods:
            q = np.arange(1, periods + 1)
            need = np.maximum(-(-np.maximum(exponent * q, least) // 2) - q, 0)
            blocks = x.reshape(-1, 2 * half)
            for right in (True, False):
                row, q = _alive(blocks[:, half:] if right else blocks[:, :half][:, ::-1], need)
                if not len(row):
                    continue
                ext = ext or extents(x)
                m = row * 2 * half + half
                i, j = (m, m + q) if right else (m - q, m)
                start, end = i - ext.behind(i, j), j + ext.ahead(i, j)
                ok = end - start >= np.maximum(exponent * q, least)
                found.append(np.stack((start[ok], end[ok], q[ok]), 1))
        half *= 2
    if not found:
        return np.zeros((0, 3), np.int64)
    out = np.unique(np.concatenate(found), axis=0)
    out = out[np.concatenate(([True], (out[1:, :2] != out[:-1, :2]).any(1)))] if len(out) else out
    for s, e, q in out.tolist():
        if not (np.array_equal(x[s : e - q], x[s + q : e]) and (s == 0 or x[s - 1] != x[s - 1 + q]) and (e == n or x[e] != x[e - q])):
            if extents is Plain:
                raise AssertionError("a run by direct comparison is none")
            return runs_of(x, longest, exponent, least, Plain)
    return out


def _batch(texts: list[bytes | None], ids: list[Any] | None, rewrite: Callable | None, exponent: int, least: int) -> list[dict]:
    known: dict[bytes, int] = {}
    words, parts, starts, at = [], [], [], 0
    for k, t in enumerate(texts):
        own = (t or b"").split()
        if rewrite:
            own = rewrite(ids[k], own)
        words.append(own)
        starts.append(at)
        parts.append(np.fromiter((known.setdefault(w, len(known)) for w in own), np.int64, len(own)))
        parts.append(np.array([-1 - k]))
        at += len(own) + 1
    found = runs_of(np.concatenate(parts), max(map(len, words)), exponent, least) if texts else np.zeros((0, 3), np.int64)
    owner = np.searchsorted(np.array(starts), found[:, 0], "right") - 1
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for k, own in enumerate(words):
        mine = found[edges[k] : edges[k + 1]] - np.array([starts[k], starts[k], 0])
        if len(mine):
            mine = mine[np.lexsort((mine[:, 2], mine[:, 0]))]
            gone = np.zeros(len(own) + 1, np.int64)
            np.add.at(gone, mine[:, 0] + mine[:, 2], 1)
            np.add.at(gone, mine[:, 1], -1)
            own = [own[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
        out.append({"n_words": len(words[k]), "runs": [{"start": s, "length": e - s, "period": q} for s, e, q in mine.tolist()], "collapsed": b" ".join(own).decode("utf-8", "replace")})
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = 4, least: int = 6, rewrite: Callable[[Any, list[bytes]], list[bytes]] | None = None) -> tuple[DataFrame, str]:
    """`docs` with one more struct column (its name is returned): n_words, runs and the collapsed text.

    Words are what white space separates. A run is a stretch of words with smallest period q, at least `least` words and `exponent` (2 or
    more) periods long, that cannot be extended; runs are in the order of (start, period). The collapsed text joins the words that no run holds
    behind its first period by single spaces. Null and empty texts have no words, no runs and an empty collapsed text. Repeated rows are rows; a clashing
    column name gets trailing underscores; an empty table gives no rows. `rewrite` may replace a row's words, given its id, before the search.
    A text's words are held by one task, about 100 bytes a word; texts are taken in batches of about 8 MB.
    """
    if exponent < 2 or least < 2:
        raise ValueError("runs have at least two periods and two words")
    name = "periodic"
    while name in docs.columns:
        name += "_"
    text, key = docs.columns.index(text_col), docs.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text):
                ids = b.column(key).to_pylist() if rewrite else None
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_batch(as_bytes(b.column(text)), ids, rewrite, exponent, least), _ARROW)], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, FOUND)])), name


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten, made periodic from a place on that its id tells."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, name = periodic_runs(read(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text")), rewrite=planted)
    runs = F.col(f"{name}.runs")
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    out = found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col(f"{name}.collapsed"), 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return out.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: CRC-32 of a short ASCII string, bit by bit.
CRC32_MACRO_BODY = (
    "xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(str_split({0}, ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), "
    "lambda acc, b: CASE WHEN b >= 0 THEN xor(acc, b) ELSE xor(acc >> 1, CASE WHEN acc % 2 = 1 THEN 3988292384 ELSE 0 END) END))"
)
OP12_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {CRC32_MACRO_BODY.format("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
g AS (SELECT rid, doc_id, w, len(w) AS n, h, h // 10 AS g FROM t),
a AS (SELECT rid, doc_id, w, n, h, CASE WHEN n > 0 THEN g % n END AS a, g FROM g),
d AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
             THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM a),
words AS (SELECT rid, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM d),
same AS (SELECT x.rid, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i WHERE 4 * (y.i - x.i) <= x.n),
isle AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS k FROM same),
long AS (SELECT rid, q, min(i) AS s, count(*) + q AS l FROM isle GROUP BY rid, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT rid, s, l, min(q) AS q FROM long GROUP BY rid, s, l),
best AS (SELECT rid, s, l, q FROM runs QUALIFY row_number() OVER (PARTITION BY rid ORDER BY l DESC, s, q) = 1),
listed AS (SELECT rid, count(*) AS n_runs, string_agg(concat(s, ',', l, ',', q, chr(10)), '' ORDER BY s, q) AS lines FROM runs GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS c FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(s AS BIGINT) AS start, CAST(l AS BIGINT) AS length, CAST(q AS BIGINT) AS period, CAST(1000 * l // q AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (rid) LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)
"""
