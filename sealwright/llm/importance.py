"""Importance resampling towards a target: hashed n-gram features, gains by bucket, draws without replacement by perturbed weights.

The dictionary of distinct features is counted first, for the corpus and the target; each distinct string is hashed once, and bucket
counts are sums over the dictionary. A bucket's gain goes back to its strings, and the strings' gains to the feature counts of the documents. That
join is split by frequency: a feature that makes up more than one in `FREQUENT` of all features belongs to a table that cannot have more
than `FREQUENT` rows, so it is broadcast and summed where the document is read; all rarer features are joined by a shuffle in which
no key can have more than that share of the rows. Scores add a Gumbel variable that the document's id gives, and the highest scores are
drawn; ranks come from a range sort and the row counts of its partitions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, materialize, read, slices
from .decontaminate import words
from .periodic import CRC32_MACRO_BODY

#: The most frequent features are at most so many, of at most so many bytes each: what is broadcast.
FREQUENT = 1 << 15
FREQUENT_BYTES = 256
#: Distinct features that a task counts before it gives them on.
HELD = 200_000


def features(text: bytes | None, longest: int) -> list[bytes]:
    """Runs of 1 to `longest` words, joined by one space, with repeats."""
    own = words(text)
    out = list(own)
    for n in range(2, longest + 1):
        out += [b" ".join(own[i : i + n]) for i in range(len(own) - n + 1)]
    return out


def feature_counts(docs: DataFrame, text_col: str = "text", longest: int = 1) -> DataFrame:
    """(feature, n): how often each distinct feature occurs in all texts of `docs`. Tasks count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["feature", "n"])
            held.clear()
            return b

        for b in batches:
            for t in as_bytes(b.column(0)):
                held.update(features(t, longest))
                if len(held) > HELD:
                    yield out()
        yield out()

    found = docs.select(F.col(f"`{text_col}`").cast("string").alias("t")).mapInArrow(run, "feature string, n long")
    return found.groupBy("feature").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, target: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """(feature, bucket, s, t): every distinct feature of the corpus or the target, hashed once, with its counts in both. Written."""
    both = feature_counts(docs, text_col, longest).select("feature", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.union(feature_counts(target, text_col, longest).select("feature", F.lit(0).cast("long"), "n")).groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    return materialize(both.select("feature", (F.crc32(F.col("feature").cast("binary")) % buckets).cast("int").alias("bucket"), "s", "t"), "importance-dictionary")


def bucket_gains(features_: DataFrame, buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) of the buckets that have features: floor(1000 ln of target share over corpus share), both smoothed by one for each bucket."""
    counts = features_.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    totals = features_.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    one = lambda c: F.col(c).cast("double")
    ratio = (one("t") + 1) * (one("all_s") + buckets) / ((one("s") + 1) * (one("all_t") + buckets))
    return counts.join(F.broadcast(totals)).select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("gain"))


def weighted(docs: DataFrame, target: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """(row, key, n_words, n_features, weight) for each row of `docs`, written: `row` holds all its columns but the text; `key` is unique."""
    spark = docs.sparkSession
    known = dictionary(docs, target, text_col, longest, buckets)
    gains = known.join(F.broadcast(bucket_gains(known, buckets)), "bucket").select("feature", "gain", "s")  # `buckets` rows at most
    total = known.agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0]
    often = (F.col("s") * FREQUENT > total) & (F.octet_length("feature") <= FREQUENT_BYTES)
    shared = spark.sparkContext.broadcast({r["feature"].encode(): r["gain"] for r in gains.where(often).collect()})
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(None).cast("int").alias("none")]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, key = shared.value, TaskContext.get().partitionId() << 40
        for whole in batches:
            for b in slices(whole, 1):
                cols: list[list] = [[] for _ in range(6)]
                for t in as_bytes(b.column(1)):
                    own = Counter(features(t, longest))
                    n, weight, rare, times = 0, 0, [], []
                    for f, k in own.items():
                        n += k
                        gain = table.get(f)
                        if gain is None:
                            rare.append(f)
                            times.append(k)
                        else:
                            weight += gain * k
                    for c, v in zip(cols, (key, len(words(t)) if longest > 1 else n, n, weight, rare, times)):
                        c.append(v)
                    key += 1
                kinds = [pa.int64()] * 4 + [pa.list_(pa.binary()), pa.list_(pa.int64())]
                arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
                arrays[4] = arrays[4].cast(pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["row", "key", "n_words", "n_features", "often", "rare", "times"])

    kind = rows.schema["row"].dataType.simpleString()
    read_ = materialize(rows.mapInArrow(run, f"row {kind}, key long, n_words long, n_features long, often long, rare array<string>, times array<long>"), "importance-counts")
    rare = read_.select("key", F.explode(F.arrays_zip("rare", "times")).alias("f")).select("key", F.col("f.rare").alias("feature"), F.col("f.times").alias("times"))
    rest = rare.join(gains.where(~often).select("feature", "gain"), "feature").groupBy("key").agg(F.sum(F.col("times") * F.col("gain")).alias("seldom"))
    return materialize(read_.drop("rare", "times").join(rest, "key", "left").select("row", "key", "n_words", "n_features", (F.col("often") + F.coalesce("seldom", F.lit(0))).alias("weight")), "importance-weights")


def perturbation(doc_id: Column, seed: int = 2024) -> Column:
    """floor(-1000 ln(-ln u)) where u comes from the hash of the seed and the id (a null id counts as an empty one)."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(u))).cast("long")


def ranked(scored: DataFrame, order: list[Column], most: int) -> DataFrame:
    """`scored` in `order` with its rank from 1, null beyond `most`. No partition is gathered: a range sort, then the counts of its partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * n, pa.int64()), pa.array(range(at, at + n), pa.int64())], names=[*b.schema.names, "part_", "at_"])
            at += n

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.schema.fields)
    laid = materialize(scored.orderBy(*order).mapInArrow(run, f"{fields}, part_ long, at_ long"), "importance-sorted")
    counts = laid.groupBy("part_").agg(F.count("*").alias("n_"))  # one row for each partition of the sort
    before = counts.withColumn("before_", F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).drop("n_")
    place = F.col("before_") + F.col("at_") + 1
    return laid.join(F.broadcast(before), "part_").withColumn("rank", F.when(place <= most, place)).drop("part_", "at_", "before_")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024
) -> DataFrame:
    """(row, n_features, weight, score, rank) for each row of `docs`; `row` holds all its columns but the text.

    Features are runs of 1 to `longest` lower-cased words with repeats. weight is the sum of the gains of a row's features (0 without any).
    Of the N rows with at least `least_words` words, the floor(`percent` * N / 100) highest scores are drawn and ranked from 1; ties go to the
    smaller id, null ids last, then to either row. Null and empty texts have no features. Repeated rows are rows, with equal scores. An empty table gives no rows; an empty target gives every
    bucket the gain of its smoothed share. Columns of any name are kept inside `row`.
    """
    found = weighted(docs, target, text_col, longest, buckets)
    own = F.col("row").getField(id_col)
    scored = found.select("row", "key", own.alias("id"), "n_features", "weight", (F.col("weight") + perturbation(own, seed)).alias("score"), (F.col("n_words") >= least_words).alias("may"))
    may = scored.where("may").drop("may")
    drawn = ranked(may, [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("key").asc()], percent * may.count() // 100)
    rest = scored.where("not may").drop("may").withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("row", "n_features", "weight", "score", "rank")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, read(spark, sf_dir, "benchmark")).select("row.doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: CRC-32 of the UTF-8 bytes of a string, which blob literals give in hexadecimal.
_CRC = (
    "xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(range(0, strlen(f)), lambda i: [CAST(('0x' || substr(hex(encode(f)), 2 * i + 1, 2)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), "
    "lambda acc, b: CASE WHEN b >= 0 THEN xor(acc, b) ELSE xor(acc >> 1, CASE WHEN acc % 2 = 1 THEN 3988292384 ELSE 0 END) END))"
)
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
df AS (SELECT rid, f, count(*) AS k FROM (SELECT rid, unnest(w) AS f FROM d) GROUP BY rid, f),
bf AS (SELECT f, count(*) AS k FROM (SELECT unnest({_WORDS}) AS f FROM benchmark) GROUP BY f),
dict AS (SELECT f, CAST(sum(s) AS BIGINT) AS s, CAST(sum(t) AS BIGINT) AS t FROM (SELECT f, k AS s, 0 AS t FROM df UNION ALL SELECT f, 0, k FROM bf) GROUP BY f),
hashed AS (SELECT f, s, t, {_CRC} % 10000 AS bucket FROM dict),
totals AS (SELECT CAST(sum(s) AS DOUBLE) AS all_s, CAST(sum(t) AS DOUBLE) AS all_t FROM dict),
gain AS (SELECT bucket, CAST(floor(1000 * ln((sum(t)::DOUBLE + 1) * (any_value(all_s) + 10000) / ((sum(s)::DOUBLE + 1) * (any_value(all_t) + 10000)))) AS BIGINT) AS gain FROM hashed, totals GROUP BY bucket),
w AS (SELECT rid, CAST(sum(k * gain) AS BIGINT) AS weight FROM df JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY rid),
sc AS (SELECT d.rid, doc_id, len(w) AS n, coalesce(weight, 0) AS weight,
              coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256(concat('2024:', doc_id)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN w USING (rid)),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS total FROM sc WHERE n >= 20)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN rank <= 10 * total // 100 THEN CAST(rank AS BIGINT) END AS rank
FROM sc LEFT JOIN r USING (rid)
"""
