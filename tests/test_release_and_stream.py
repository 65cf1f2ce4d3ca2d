import hashlib

import pytest
from pyspark.sql import functions as F

from sealwright.operators import projection
from sealwright.sources import release
from sealwright.streaming import projection as stream


def test_release_tree(spark, tmp_path):
    files = {"bundle.json": b"{}", "data/a.jsonl": b"x\n" * 10, "data/deep/b.jsonl": b"y"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    present = release.declarations(spark, str(tmp_path))
    assert {(r["path"], r["sha256"], r["bytes"]) for r in present.collect()} == {(k, "sha256:" + hashlib.sha256(v).hexdigest(), len(v)) for k, v in files.items()}
    found = release.listing(spark, str(tmp_path))
    assert release.budget_violations(found).count() == 0
    tight = {"files": 2, "file_bytes": 19, "total_bytes": 5}
    assert [r["code"] for r in release.budget_violations(found, tight).orderBy("check_ordinal").collect()] == ["files", "file_bytes", "total_bytes"]
    declared = present.withColumn("bytes", F.when(F.col("path") == "bundle.json", 9).otherwise(F.col("bytes"))).withColumn("sha256", F.when(F.col("path") == "data/a.jsonl", "sha256:0").otherwise(F.col("sha256")))
    declared = declared.withColumn("path", F.when(F.col("path") == "data/deep/b.jsonl", "gone").otherwise(F.col("path")))
    empty = spark.createDataFrame([("none", "sha256:" + hashlib.sha256(b"").hexdigest(), 0)], "path string, sha256 string, bytes long")
    declared = declared.unionByName(empty)
    got = {(r["path"], r["code"]) for r in release.byte_violations(present, declared).collect()}
    assert got == {("bundle.json", "size"), ("data/a.jsonl", "bytes"), ("data/deep/b.jsonl", "undeclared"), ("gone", "missing")}


def test_archive_url_needs_an_origin(spark):
    for bad in ("http://a.example", "https://u@a.example", "https://a.example/x"):
        with pytest.raises(ValueError):
            release.archive_url(bad, "c", "p", F.lit("x"))


def test_stream_of_changes(spark, tmp_path):
    rows = {f"r{i}": f"line {i} " * 4 for i in range(120)}
    root = str(tmp_path / "state")
    stream.start(spark.createDataFrame(list(rows.items()), "id string, line string"), root, 600)
    batches = [[("r1", "new", 1), ("r2", None, 2), ("r1", "newer", 3)], [("r3", "long " * 100, 4), ("x", "added", 5), ("r2", None, 6)]]
    want = dict(rows)
    for n, b in enumerate(batches):
        spark.createDataFrame(b, "id string, line string, seq long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for k, v, _ in b:
            want[k] = v
    source = spark.readStream.schema("id string, line string, seq long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.maintain(source, root, str(tmp_path / "check"), 600).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    kept = {k: v for k, v in want.items() if v is not None}
    assert {r["id"]: r["line"] for r in stream.current(spark, root).collect()} == kept
    # a repeated batch changes nothing, and the shards are in order
    stream.apply_batch(spark.createDataFrame(batches[1], "id string, line string, seq long"), 1, root, 600)
    assert {r["id"]: r["line"] for r in stream.current(spark, root).collect()} == kept
    assert {r["code"] for r in projection.closure_violations(projection.inventory(stream.current(spark, root)), 600).collect()} <= {"size"}


def test_faults_of_joined_paths_take_one_join(spark):
    from pyspark.sql import functions as F

    from sealwright.operators import envelope

    one, two = (spark.createDataFrame([(1, 1, p, v) for p, v in pairs], f"chain long, sequence long, path string, {n} string") for n, pairs in (("a", [("x", "1"), ("y", "1"), ("z", "1")]), ("b", [("x", "1"), ("y", "2"), ("w", "1")])))
    both = one.join(two, [*envelope.KEY, "path"], "full")
    found = envelope._found_either(both, F.col("path"), (3, "set", "a is null or b is null"), (4, "bytes", "a <> b"))
    assert sorted(map(tuple, found.collect())) == [(1, 1, 3, "set", "w"), (1, 1, 3, "set", "z"), (1, 1, 4, "bytes", "y")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
