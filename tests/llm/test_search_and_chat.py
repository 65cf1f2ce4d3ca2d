import random

import numpy as np
from pyspark.sql import functions as F

from sealwright.llm import neighbours, toolcalls
from sealwright.llm.components import components


def brute(rows, every=20, k=20):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in ok:
        if q % every == 0:
            scored = sorted((-float(np.cumsum(v * w)[-1]), i) for i, w in ok if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=24) * (1 + i % 5)]) for i in range(700)]
    want = brute(rows)
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.98


def test_unusual_vectors(spark):
    rows = [(0, [1.0, 2.0]), (20, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (80, [1.0, None]), (100, []), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.0, 0.5]), (None, [1.0, 1.0]), (4, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("v", F.lit(2))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 5.0), (0, 2, 2, 5.0), (0, 3, 3, 0.0)]
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_beam_search_reconstructs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 16)).astype(np.float32)
    books = neighbours.Codebooks.fit(x, books=4, words=64)
    wide, narrow = (((x - books.decode(books.encode(x, beam))) ** 2).sum() for beam in (8, 1))
    assert wide < narrow < (x**2).sum() * 0.5


CALLS = "thread long, id string, after string, name string, arguments map<string,string>, place long"


def test_calls_are_linked_ordered_and_validated(spark):
    calls = [(1, "c", "b", "user", {"text": "t", "turn": "1"}, 2), (1, "a", None, "user", {"text": 'q"\n', "turn": "x"}, 0), (1, "b", "a", "other", {}, 1), (1, "x", "y", "user", {"turn": "1"}, 3), (1, "y", "x", "user", {"text": "t", "turn": "1", "more": "2"}, 4), (2, None, None, "user", None, 0)]
    results = spark.createDataFrame([("a", 5, "second"), ("a", 4, "first"), ("zz", 1, "lost"), (None, 1, "n")], "id string, place long, content string")
    got = {r["id"]: r for r in toolcalls.linked(spark.createDataFrame(calls, CALLS), results, toolcalls.chat_schemas(spark)).collect()}
    assert {k: r["depth"] for k, r in got.items()} == {"a": 1, "b": 2, "c": 3, "x": None, "y": None, None: 1}
    assert got["a"]["n_results"] == 2 and got["a"]["problems"] == ["type:turn"]
    assert got["b"]["problems"] == ["unknown_tool"] and got["x"]["problems"] == ["missing:text"] and got["y"]["problems"] == ["unexpected:more"] and got[None]["problems"] == ["no_arguments"]
    assert got["a"]["json"] == '{"arguments":{"text":"q\\"\\u000a","turn":"x"},"id":"a","name":"user","result":"first"}'
    lost = toolcalls.orphans(spark.createDataFrame(calls, CALLS), results).collect()
    assert {r["id"] for r in lost} == {"zz", None}


def test_conversations_with_odd_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 5000, "user", "c"), (1, 5001, "assistant", None), (2, 0, "assistant", "no call"), (None, 0, "user", "x"), (3, None, "user", "x"), (4, 0, None, "x"), (5, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit(1)).withColumn("depth", F.lit(1))
    calls, results = toolcalls.conversation_calls(df)
    got = {r["id"]: (r["depth"], r["n_results"]) for r in toolcalls.linked(calls, results, toolcalls.chat_schemas(spark)).collect()}
    assert got == {"1:0": (1, 1), "1:5000": (2, 1), "5:0": (1, 0)}
    calls, results = toolcalls.conversation_calls(df.limit(0))
    assert toolcalls.linked(calls, results, toolcalls.chat_schemas(spark)).count() == 0


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1080)] + [(2000, 2000 + i) for i in range(1, 60)] + [(None, 1), (7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}
