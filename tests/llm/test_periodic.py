import random
import time

import numpy as np
import pytest
from conftest import same_as_duckdb
from pyspark.sql import functions as F

from sealwright.llm import periodic
from sealwright.llm.registry import ORACLES, QUERIES


def brute(words, exponent, least):
    """Every period of every place, extended one word at a time."""
    n, out = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in out.items())


def word_lists(rng, n):
    for _ in range(n):
        w = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(100))]
        if rng.random() < 0.5 and w:
            at = rng.randrange(len(w))
            w[at:at] = w[: rng.randrange(1, 9)] * rng.randrange(2, 12)
        yield w


@pytest.mark.parametrize("extents", [periodic.Extents, periodic.Plain])
def test_runs_equal_brute_force(extents):
    rng = random.Random(5)
    for w in word_lists(rng, 1500):
        k, least = rng.choice([2, 3, 4, 4, 5]), rng.choice([2, 4, 6, 9])
        got = periodic.runs_of(np.array([*w, -1]), len(w), k, least, extents).tolist()
        assert sorted((s, e - s, q) for s, e, q in got) == brute(w, k, least)


def test_a_wrong_hash_is_noticed():
    class Liar(periodic.Extents):
        def _equal(self, i, j, n):
            return np.ones(len(i), bool)

    w = [5, 1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 6]
    assert periodic.runs_of(np.array([*w, -1]), len(w), 4, 6, Liar).tolist() == [[1, 11, 2]]


def test_same_rows_as_sql(spark):
    rows = same_as_duckdb(spark, QUERIES["op12_periodic"], ORACLES["op12_periodic"])
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_batches_of_texts(spark):
    rng = random.Random(6)
    rows = [(i, " \t".join("abc"[x] for x in w)) for i, w in enumerate(word_lists(rng, 200))]
    found, name = periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    for r in found.collect():
        w = (r["text"] or "").split()
        runs = brute(w, 4, 6)
        assert [tuple(x) for x in r[name]["runs"]] == sorted(runs, key=lambda x: (x[0], x[2])) and r[name]["n_words"] == len(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert r[name]["collapsed"] == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_unusual_rows(spark):
    rows = [(None, "a " * 9), (1, None), (2, ""), (2, " \n\x0b "), (2, " \n\x0b "), (3, "é a b " * 7), (4, "A a " * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("periodic", F.lit("mine")).withColumn("runs", F.lit(0))
    found, name = periodic.periodic_runs(docs)
    assert name == "periodic_" and found.columns == [*docs.columns, name]
    got = sorted((r["doc_id"] or 0, r[name]["n_words"], [tuple(x) for x in r[name]["runs"]], r[name]["collapsed"]) for r in found.collect())
    assert got == [(0, 9, [(0, 9, 1)], "a"), (1, 0, [], ""), (2, 0, [], ""), (2, 0, [], ""), (2, 0, [], ""), (3, 14, [(0, 14, 2)], "é a b"), (4, 16, [(0, 16, 2)], "A a")]
    assert periodic.periodic_runs(docs.limit(0))[0].count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, exponent=1)


def test_long_texts(spark):
    rng = np.random.default_rng(3)
    words = [f"w{x}" for x in rng.zipf(1.4, 400_000) % 5000]
    words[1000:1000] = ["x", "y", "z"] * 20_000
    same = ["same"] * 60_000
    began = time.time()
    found, name = periodic.periodic_runs(spark.createDataFrame([(1, " ".join(words)), (2, " ".join(same))], "doc_id long, text string"))
    got = {r["doc_id"]: r[name] for r in found.collect()}
    assert (1000, 60_000, 3) in [tuple(x) for x in got[1]["runs"]] and [tuple(x) for x in got[2]["runs"]] == [(0, 60_000, 1)] and got[2]["collapsed"] == "same"
    assert time.time() - began < 60


def test_planted_documents():
    import zlib

    words = [b"%d" % i for i in range(100)]
    hit = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    miss = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10)
    g = zlib.crc32(str(hit).encode()) // 10
    a, p = g % 100, 1 + (100 - g % 100) // (3 + g % 8)
    got = periodic.planted(hit, words)
    assert len(got) == 100 and got[:a] == words[:a] and all(got[i] == words[a + (i - a) % p] for i in range(a, 100))
    assert periodic.planted(miss, words) == words and periodic.planted(None, words) == words and periodic.planted(hit, []) == []
