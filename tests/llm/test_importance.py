import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from conftest import same_as_duckdb
from pyspark.sql import functions as F

from sealwright.llm import importance
from sealwright.llm.registry import ORACLES, QUERIES

DOCS = "doc_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, target, longest=1, buckets=10_000, percent=10, least=20, seed=2024):
    def feats(text):
        w = words(text)
        return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(at(f) for _, x in docs for f in feats(x)), Counter(at(f) for x in target for f in feats(x))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in s | t}
    out = []
    for i, x in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[at(f)] for f in feats(x))
        out.append([i, len(feats(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    may = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def got(df):
    return sorted(((r["row"]["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=repr)


def corpus(rng, n):
    vocab = [f"w{i}" for i in range(300)] + ["É", "漢字", "Zz", "it"]
    return [(i, " ".join(rng.choices(vocab, weights=[1 / (k + 1) for k in range(len(vocab))], k=rng.randrange(60))) + rng.choice([".", "", "!?", "-x"])) for i in range(n)]


def test_same_rows_as_sql(spark):
    same_as_duckdb(spark, QUERIES["op13_importance"], ORACLES["op13_importance"])


@pytest.mark.parametrize("longest", [1, 3])
def test_equal_to_brute_force(spark, longest, monkeypatch):
    monkeypatch.setattr(importance, "FREQUENT", 64)  # most features take the way by a shuffle
    rng = random.Random(longest)
    docs, target = corpus(rng, 120), [t for _, t in corpus(rng, 9)]
    found = importance.resample(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=101, percent=30)
    assert got(found) == brute(docs, target, longest, 101, 30)


def test_both_ways_of_the_join_agree(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(random.Random(4), 80), DOCS)
    every = []
    for frequent, size in ((1, 256), (1 << 40, 256), (1 << 40, 2)):
        monkeypatch.setattr(importance, "FREQUENT", frequent)
        monkeypatch.setattr(importance, "FREQUENT_BYTES", size)
        every.append(got(importance.resample(docs, docs.limit(3))))
    assert every[0] == every[1] == every[2]


def test_unusual_rows(spark):
    rows = [(None, "a " * 30), (None, None), (1, ""), (2, "b c " * 20), (2, "b c " * 20), (2, "b c " * 20), (3, "d" * 300_000 + " e" * 25), (4, " ".join(f"x{i}" for i in range(50_000)))]
    docs = spark.createDataFrame(rows, DOCS)
    extra = docs.withColumn("row", F.lit(1)).withColumn("key", F.lit("k")).withColumn("rank", F.lit(7)).withColumn("t", F.lit("no"))
    want = brute(rows, ["b", None], percent=50)
    found = importance.resample(extra, spark.createDataFrame([("b",), (None,)], "text string"), percent=50)
    assert got(found) == want and sum(r[4] is not None for r in want) == 3
    assert found.first()["row"].asDict().keys() == {"doc_id", "row", "key", "rank", "t"}
    none = spark.createDataFrame([], "text string")
    assert got(importance.resample(docs, none, percent=50)) == brute(rows, [], percent=50)
    assert importance.resample(docs.limit(0), none).count() == 0
    assert got(importance.resample(docs.where("text = ''"), none)) == brute([(1, "")], [])


def test_ranks_over_many_partitions(spark):
    rows = [(i, i % 7) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, score long").repartition(9)
    found = {r["id"]: r["rank"] for r in importance.ranked(df, [F.col("score").desc(), F.col("id").asc()], 1234).collect()}
    want = {i: k + 1 if k < 1234 else None for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert found == want
