"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are all windows of `width` consecutive item words (the whole item where it is shorter). For each
pattern length, a shift table over blocks of two words says how far the search may jump, the block at the
end of a window selects a bucket, and direct comparison with the bucket's patterns confirms an occurrence.
Items are taken in blocks of at most `block_bytes` of text, whose size is measured first; further blocks are
further passes over the same rows, so that nothing unbounded is broadcast and no item is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, read

WORD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("spans", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD).split()


class Searcher:
    """Shift, bucket and pattern tables for the windows of one pattern length."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, dict[bytes, list[int]]] = {}

    def add(self, pattern: list[bytes], item: int) -> None:
        for end in range(self.block, self.length + 1):
            key = b" ".join(pattern[end - self.block : end])
            self.shift[key] = min(self.shift.get(key, self.default), self.length - end)
        owners = self.bucket.setdefault(key, {}).setdefault(b" ".join(pattern), [])
        if not owners or owners[-1] != item:
            owners.append(item)

    def search(self, text: list[bytes], spans: list[tuple[int, int]], items: set[int]) -> None:
        m, n, two, default = self.length, len(text), self.block == 2, self.default
        shift, bucket, i = self.shift.get, self.bucket, self.length - 1
        while i < n:
            key = text[i - 1] + b" " + text[i] if two else text[i]
            jump = shift(key, default)
            if jump:
                i += jump
                continue
            owners = bucket[key].get(b" ".join(text[i - m + 1 : i + 1]))
            if owners:
                spans.append((i - m + 1, i + 1))
                items.update(owners)
            i += 1


def searchers(items: list[tuple[str | None, bytes]], width: int) -> tuple[list[Searcher], list[str | None]]:
    by_length: dict[int, Searcher] = {}
    for k, (_, text) in enumerate(items):
        own = words(text)
        n = min(width, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            by_length.setdefault(n, Searcher(n)).add(own[i : i + n], k)
    return list(by_length.values()), [x[0] for x in items]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def scan(docs: DataFrame, items: DataFrame, text_col: str = "text", width: int = 13, block_bytes: int = 2 << 20) -> tuple[DataFrame, str]:
    """`docs` with one more struct column (its name is returned): n_words, n_hit, merged hit spans, item ids found."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // block_bytes))
    name = "found"
    while name in docs.columns:
        name += "_"
    schema = T.StructType([*docs.schema.fields, T.StructField(name, FOUND)])
    at = docs.columns.index(text_col)
    out = docs.withColumn(name, F.lit(None).cast(FOUND))
    for k in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k) if n_blocks > 1 else items
        rows = [(r["item"], r["text"].encode()) for r in part.toLocalIterator()]
        shared = spark.sparkContext.broadcast(searchers(rows, width))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tables, names = shared.value
            for b in batches:
                found = []
                for text, old in zip(as_bytes(b.column(at)), b.column(b.num_columns - 1).to_pylist()):
                    own = words(text)
                    old_spans = old["spans"] if old else []
                    spans, got = list(zip(old_spans[::2], old_spans[1::2])), set()
                    for t in tables:
                        t.search(own, spans, got)
                    spans = merged(spans)
                    ids = {names[i] for i in got if names[i] is not None} | set(old["items"] if old else ())
                    found.append({"n_words": len(own), "n_hit": sum(e - s for s, e in spans), "spans": [x for s in spans for x in s], "items": sorted(ids, key=str.encode)})
                kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, kind)], names=b.schema.names)

        out = out.mapInArrow(run, schema)
    return out, name


def is_contaminated(name: str, share: int = 20):
    return (F.col(f"{name}.n_hit") > 0) & (share * F.col(f"{name}.n_hit") >= F.col(f"{name}.n_words"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13) -> DataFrame:
    """One row for each row of `docs`: id, n_words, n_hit, spans (first word, end, ...), items, contaminated.

    A word is hit if it lies in an occurrence of any window of any item. Null or empty texts have no words and
    no hits. Repeated item texts report every id; items without id mark words but are not listed; null item
    texts and items without words match nothing. Other columns of `docs` are ignored. Empty tables give no
    rows, or rows without hits.
    """
    found, name = scan(docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col)), items, text_col, width)
    return found.select(id_col, *[F.col(f"{name}.{c}").alias(c) for c in ("n_words", "n_hit", "spans", "items")], is_contaminated(name).alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", width: int = 13) -> DataFrame:
    """The rows of `docs`, all columns kept, without the contaminated ones."""
    found, name = scan(docs, items, text_col, width)
    return found.where(~is_contaminated(name)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bl AS (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, item, n, i FROM dw JOIN bw USING (n, g)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
"""
