"""Points in intervals against all pairs, and rules of root sets."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from sealwright.operators import authority, intervals


@pytest.mark.parametrize("kind", ["long", "double", "timestamp"])
def test_equal_to_all_pairs(spark, kind):
    rng = random.Random(kind)
    span = rng.choice([50, 5000])
    value = {"long": lambda: rng.randrange(-span, span), "double": lambda: round(rng.uniform(-span, span), 3), "timestamp": lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=rng.randrange(span * 100), microseconds=rng.randrange(10**6))}[kind]
    points = [(i, rng.choice("ab"), value() if rng.random() > 0.05 else None) for i in range(200)]
    held = []
    for j in range(120):
        a, b = value(), value()
        held.append((j, rng.choice("abc"), None if rng.random() < 0.1 else a, None if rng.random() < 0.1 else b))
    want = {(i, j) for i, p, t in points for j, q, a, b in held if p == q and t is not None and (a is None or a <= t) and (b is None or t < b)}
    got = intervals.within(spark.createDataFrame(points, f"i int, p string, t {kind}"), spark.createDataFrame(held, f"j int, p string, a {kind}, b {kind}"), ["p"], "t", "a", "b")
    rows = [(r["i"], r["j"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and want


@pytest.mark.parametrize("kind", ["long", "double", "timestamp"])
def test_numbers_of_pairs(spark, kind):
    rng = random.Random(kind)
    value = {"long": lambda: rng.randrange(-30, 30), "double": lambda: round(rng.uniform(-9, 9), 1), "timestamp": lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=rng.randrange(40), microseconds=rng.choice([0, 1]))}[kind]
    points = [(i, rng.choice(["a", "b", None]), value() if rng.random() > 0.05 else None) for i in range(200)]
    held = [(rng.choice(["a", "b", "c", None]), None if rng.random() < 0.1 else value(), None if rng.random() < 0.1 else value()) for _ in range(120)]
    want = {i: sum(p is not None and p == q and t is not None and (a is None or a <= t) and (b is None or t < b) for q, a, b in held) for i, p, t in points}
    points, held = spark.createDataFrame(points, f"i int, p string, t {kind}"), spark.createDataFrame(held, f"p string, a {kind}, b {kind}")
    rows = intervals.counted(points, held, ["p"], "t", "a", "b").collect()
    assert len(rows) == 200 and {r["i"]: r["n"] for r in rows} == want and len(set(want.values())) > 5
    assert {r["n"] for r in intervals.counted(points, held.limit(0), ["p"], "t", "a", "b").collect()} == {0}


def test_many_pairs_are_counted_not_made(spark):
    """A billion pairs, and blocks of intervals of which Spark knows no size."""
    points, held = spark.range(30000).select(F.lit(1).alias("p"), (F.col("id") % 7).alias("t")), spark.range(33334).select(F.lit(1).alias("p"), (-F.col("id")).alias("a"), (F.col("id") + 7).alias("b"))
    assert [tuple(r) for r in intervals.counted(points, held, ["p"], "t", "a", "b").groupBy("n").count().collect()] == [(33334, 30000)]
    pairs = intervals.within(points, held, ["p"], "t", "a", "b")
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_bounds_and_empty_tables(spark):
    points = spark.createDataFrame([(1, -(10**12)), (2, 0), (3, 10**12), (4, None)], "i int, t long")
    held = spark.createDataFrame([("all", None, None), ("none", 5, 5), ("back", 9, 2), ("one", 0, 1)], "j string, a long, b long")
    at = lambda h: {(r["i"], r["j"]) for r in intervals.within(points.withColumn("p", F.lit(1)), h.withColumn("p", F.lit(1)), ["p"], "t", "a", "b").collect()}
    assert at(held) == {(1, "all"), (2, "all"), (3, "all"), (2, "one")}
    assert at(held.where("j = 'all'")) == {(1, "all"), (2, "all"), (3, "all")} and at(held.limit(0)) == set()
    with pytest.raises(ValueError):
        intervals.within(points.withColumn("p", F.lit(1)), held.withColumn("p", F.lit(1)), ["p"], "p", "j", "j")


def test_a_wide_interval_has_few_blocks(spark):
    n = spark.range(1).select(F.size(intervals._blocks(F.lit(1).cast("long"), F.lit(16**6 - 1).cast("long"), 6)).alias("n")).first()["n"]
    assert n <= 30 * 7


def test_both_ways_of_a_registry_agree(spark, monkeypatch):
    rng = random.Random(2)
    day = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=rng.randrange(2000))
    keys = spark.createDataFrame([(f"k{i}", rng.choice(["sign", "seal"]), day() if rng.random() < 0.9 else None, day() if rng.random() < 0.9 else None, rng.choice([None, 5])) for i in range(25)], "key_id string, purpose string, valid_from timestamp, valid_until timestamp, compromised_after_sequence long")
    facts = spark.createDataFrame([(i, day() if rng.random() < 0.95 else None, rng.choice(["sign", "seal", "other"]), rng.choice([None, 4, 5])) for i in range(150)] + [(7, None, None, None)] * 2, "i long, at timestamp, why string, seq long")
    ask = lambda: sorted((tuple(r) for r in authority.active_keys(facts, keys, F.col("at"), F.col("why"), F.col("seq")).collect()), key=repr)
    small = ask()
    monkeypatch.setattr(authority, "MOST_KEYS", 0)
    large = ask()
    some = [r for r in small if r[1] is not None]
    assert some == [r for r in large if r[1] is not None] and len(small) == len(large) == 152 and any(r[4] for r in some)


def test_root_sets(spark):
    pem = "-----BEGIN PUBLIC KEY-----\nMCowBQYDK2VwAyEA" + "A" * 42 + "A=\n-----END PUBLIC KEY-----\n"
    roots = spark.createDataFrame([("a", pem), ("b", pem), ("b", pem), ("", pem), ("c", "x")], "key_id string, public_key string")
    assert {tuple(r) for r in authority.root_violations(roots, 2).collect()} == {("b", 2, "named_twice"), ("", 3, "key"), ("c", 4, "public_key")}
    good = roots.where("key_id = 'a'")
    assert [tuple(r) for r in authority.root_violations(good, 2).collect()] == [(None, 1, "threshold")] == [tuple(r) for r in authority.root_violations(good, 0).collect()]
    assert authority.root_violations(good, 1).count() == 0
