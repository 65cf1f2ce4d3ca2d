"""Paths, object ids, texts for reading and recorded headers."""

import json

import pytest
from pyspark.sql import functions as F

from sealwright.functions import values as V
from sealwright.operators import authority


def column(spark, rows, c, kind="string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], f"v {kind}").coalesce(1).select(c).collect()]


def test_paths_inside_a_root(spark):
    import os

    paths = ["a", "a/b/../c", "./a//b/", "../a", "a/../..", "a/..", "", ".", "/a", "../r", "../r/x", "../../top/r/y", "..", "../../../../top/r/z", "é/ü", "a/../../r/../r/q", None]
    for root in ("/top/r", "/top/r/", "/top//./r"):
        got = column(spark, paths, V.inside(root, F.col("v")))
        base = os.path.normpath(root)
        for p, g in zip(paths, got):
            full = p is not None and os.path.normpath(os.path.join(base, p))
            assert g == (full if p is not None and not p.startswith("/") and full.startswith(base + "/") else None), (root, p)
    for bad in ("top", "/a/../b"):
        with pytest.raises(ValueError):
            V.inside(bad, F.lit("x"))
    assert column(spark, ["a", ".."], V.inside("/", F.col("v"))) == ["/a", None]


def test_object_ids(spark):
    good = ["a" * 40, "0" * 64]
    assert column(spark, [*good, "a" * 41, "A" * 40, "a" * 40 + "\n", "", None], V.object_id(F.col("v"))) == [*good, None, None, None, None, None]


def test_pretty_texts(spark):
    values = [{"b": [1, 2.5, {}], "a": {"é": None, "x": []}}, [], "t", 3.0, None, True]
    got = column(spark, [json.dumps(v) for v in values] + [None], V.pretty_json(F.col("v")))
    assert got[0] == '{\n  "b": [\n    1,\n    2.5,\n    {}\n  ],\n  "a": {\n    "é": null,\n    "x": []\n  }\n}\n'
    assert got[1:] == ["[]\n", '"t"\n', "3\n", "null\n", "true\n", None]


def test_headers_by_code_units(spark):
    smile = "\U0001f600"
    long = {"a": smile * 600, "b": "x" + smile * 600, "c": "é" * 1024, "d": "é" * 1025, "e": smile * 512}
    order = [("x", "￿"), ("x", smile), ("x", "a"), ("x-y", "a")]
    raw = spark.createDataFrame([([*long.items(), *order],)], "h array<struct<name string, value string>>")
    got = [tuple(x) for x in raw.select(authority.recordable_headers(F.col("h"))).first()[0]]
    want = {"a": smile * 512, "b": "x" + smile * 511, "c": "é" * 1024, "d": "é" * 1024, "e": smile * 512}
    assert dict(got[:5]) == want
    assert got[5:] == [("x", "a"), ("x", smile), ("x", "￿"), ("x-y", "a")]


def test_canonical_order(spark):
    smile, high = "\U0001f600", "￿"
    cases = {("a", "b"): True, ("b", "a"): False, ("a", "a"): False, (): True, ("é", "é"): False, ("z", "é"): True, (smile, high): True, (high, smile): False, ("a", None): None, None: None}
    got = column(spark, [list(c) if c is not None else None for c in cases], V.canonically_ascending(F.col("v")), "array<string>")
    assert got == list(cases.values())
    texts = ["b", "éa", "é", smile, high, "a"]
    df = spark.createDataFrame([(x,) for x in texts], "v string")
    assert [r["v"] for r in df.orderBy(V.canonical_key(F.col("v"))).collect()] == ["a", "b", "é", "éa", smile, high]


def test_directories(spark):
    from sealwright.operators import capture

    rows = [("a", "d1"), ("b", "d1"), ("c", "d2"), ("c", "d2")]
    assert [tuple(r) for r in capture.directory_violations(spark.createDataFrame(rows, "registry string, registry_digest string")).collect()] == [("d1", 2)]
