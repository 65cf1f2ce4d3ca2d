"""Refusals of a projection's writer and successor, and the stream that proves what it goes on from."""

import glob
import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from sealwright.operators import projection
from sealwright.streaming import proved


def line(i, v):
    return json.dumps({"id": i, "v": v}, separators=(",", ":"))


def rows_df(spark, rows):
    return spark.createDataFrame(list(rows.items()), "id string, line string")


def test_leaves_that_cannot_route(spark):
    leaves = spark.createDataFrame([(f"data/{x}.jsonl",) for x in ("a", "ab", "b1", "b1", "c123", "c1", "G", "12345")] + [("x",), (None,)], "path string")
    got = {tuple(r) for r in projection.leaf_violations(leaves).collect()}
    assert got == {("data/ab.jsonl", 3, "overlap"), ("data/b1.jsonl", 2, "duplicate"), ("data/c123.jsonl", 3, "overlap"), ("data/G.jsonl", 1, "path"), ("data/12345.jsonl", 1, "path"), ("x", 1, "path"), (None, 1, "path")}


def test_rows_that_no_snapshot_holds(spark):
    rows = [("a", "x"), ("a", "y"), (None, "z"), ("b", None), ("c", "long " * 30), ("d", "w")]
    got = {tuple(r) for r in projection.writer_violations(spark.createDataFrame(rows, "id string, line string"), 100).collect()}
    long = "data/" + hashlib.sha256(b"c").hexdigest()[:4] + ".jsonl"
    assert got == {(1, "no_id", None), (2, "repeated_id", "a"), (3, "no_line", "b"), (4, "oversized", long)}


def state(spark, n, limit):
    rows = {f"r{i}": line(f"r{i}", "x" * (i % 40)) for i in range(n)}
    placed = projection.placed(rows_df(spark, rows), limit)
    entries = projection.inventory(placed).cache()
    files: dict = {}
    for r in placed.orderBy("path", "id").collect():
        files[r["path"]] = files.get(r["path"], b"") + r["line"].encode() + b"\n"
    return rows, entries, files


def files_df(spark, files):
    return spark.createDataFrame([(p, bytearray(b) if b is not None else None) for p, b in files.items()], "path string, content binary")


def test_a_successor_needs_exactly_its_prior_files(spark):
    rows, entries, files = state(spark, 300, 900)
    changes = spark.createDataFrame([("r1", line("r1", "new")), ("r2", None), ("zz", line("zz", "added"))], "id string, line string")
    needed = {r["path"] for r in projection.affected(changes.select("id"), entries.select("path")).collect()} & set(files)
    good = {p: files[p] for p in needed}
    find = lambda given, e=entries, c=changes, **k: {tuple(r) for r in projection.successor_violations(e, given, c, **k).collect()}
    assert find(files_df(spark, good)) == set()
    after, inventory = projection.prepared_successor(entries, files_df(spark, good), changes, 900)
    want = dict(rows) | {"r1": line("r1", "new"), "zz": line("zz", "added")}
    del want["r2"]
    kept = {r["id"]: r["line"] for r in after.collect()}
    assert kept.items() <= want.items() and {r["action"] for r in inventory.collect()} >= {"write", "carry"}
    total = inventory.where("action <> 'delete'").agg(F.sum("rows")).first()[0]
    assert total == len(want)
    a, *rest = sorted(needed)
    other = next(p for p in sorted(files) if p not in needed)
    assert find(files_df(spark, {p: good[p] for p in rest})) == {(a, 7, "missing")}
    assert find(files_df(spark, good | {a: None})) == {(a, 7, "missing")}
    assert find(files_df(spark, good | {other: files[other], "data/none.jsonl": b""})) == {(other, 6, "not_affected"), ("data/none.jsonl", 6, "not_affected")}
    assert find(files_df(spark, good), entries.withColumn("rows", F.when(F.col("path") == a, F.col("rows") + 1).otherwise(F.col("rows")))) == {(a, 10, "counts")}
    swapped = good[a].replace(b'"v":"', b'"v":"y', 1)
    assert find(files_df(spark, good | {a: swapped})) == {(a, 9, "digest"), (a, 10, "counts")}
    assert find(files_df(spark, good | {a: good[a] + b'{"v":1,"id":"q"}\n'})) >= {(a, 9, "digest"), (a, 10, "counts"), (a, 18, "not_canonical")}
    twice = changes.where("id = 'r1'").union(changes).union(spark.createDataFrame([(None, None)], "id string, line string"))
    assert find(files_df(spark, good), c=twice) == {("r1", 4, "repeated_change"), (None, 5, "no_id")}
    assert find(files_df(spark, good), previous_sequence=4, next_sequence=4) == {(None, 0, "sequence")}
    assert find(files_df(spark, good).union(files_df(spark, {a: good[a]}))) == {(a, 8, "repeated_file")}


def test_proved_stream(spark, tmp_path):
    rng, limit, root = random.Random(3), 700, str(tmp_path / "state")
    want = {f"r{i}": line(f"r{i}", "x" * (i % 30)) for i in range(200)}
    proved.start(rows_df(spark, want), root, limit)
    with pytest.raises(proved.Refused):
        proved.start(spark.createDataFrame([("a", "1"), ("a", "2")], "id string, line string"), str(tmp_path / "no"), limit)
    seq = 0
    for n in range(4):
        batch = []
        for _ in range(12):
            i, seq = f"r{rng.randrange(260)}", seq + 1
            v = None if rng.random() < 0.3 else line(i, "y" * rng.randrange(60))
            batch.append((i, v, seq))
            want[i] = v
        spark.createDataFrame(batch, "id string, line string, seq long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id string, line string, seq long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = proved.maintain(source, root, str(tmp_path / "check"), limit).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    kept = {k: v for k, v in want.items() if v is not None}
    read = lambda: {r["id"]: r["line"] for r in proved.current(spark, root).collect()}
    assert read() == kept
    entries = proved.manifest(spark, root)
    assert proved.unproved(spark, root, entries).count() == 0 and entries.agg(F.sum("rows")).first()[0] == len(kept)
    assert projection.leaf_violations(entries).count() == 0 and entries.where(F.col("bytes") > limit).count() == 0
    assert entries.where("batch < 3").count() > 0  # carried, not rewritten
    # a repeated batch changes nothing
    before = sorted(tuple(r) for r in entries.collect())
    again = spark.read.parquet(str(tmp_path / "in"))
    last = again.where(F.col("seq") > 36)
    proved.apply_batch(last, 3, root, limit)
    entries = proved.manifest(spark, root)  # its file is another now
    assert read() == kept and sorted(tuple(r) for r in entries.collect()) == before
    # compaction keeps what the last manifest needs
    assert proved.compact(spark, root, 1) > 0 and read() == kept
    assert len(glob.glob(f"{root}/manifest/batch=*")) == 1 and proved.compact(spark, root, 1) == 0
    # rows that are not those of the manifest stop the next batch, and nothing changes
    e = entries.orderBy("path").first()
    victim = glob.glob(f"{root}/rows/batch={e['batch']}/leaf={proved._leaf(e['path'])}/*.parquet")[0]
    some = proved._rows(spark, root, entries.where(F.col("path") == e["path"])).collect()
    spark.createDataFrame([(r["id"], r["line"] + " ", r["path"]) for r in some], proved.ROW).coalesce(1).write.parquet(str(tmp_path / "bad"))
    os.replace(glob.glob(str(tmp_path / "bad/*.parquet"))[0], victim)
    crc = os.path.join(os.path.dirname(victim), f".{os.path.basename(victim)}.crc")
    if os.path.exists(crc):
        os.unlink(crc)
    change = spark.createDataFrame([(some[0]["id"], line(some[0]["id"], "z"), 99)], "id string, line string, seq long")
    with pytest.raises(proved.Refused, match="differ"):
        proved.apply_batch(change, 4, root, limit)
    assert proved._batches(spark, root) == [3]
