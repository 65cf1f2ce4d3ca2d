"""Release trees: ranges, digests, the staged sink, and overlapping claims."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from sealwright.operators import ownership
from sealwright.sources import tree_sink
from sealwright.sources.blocks import FileBlocks, listed, opened, register

BIG = 3_000_001


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(root) for f in fs}


def files_df(spark, files, parts=3):
    return spark.createDataFrame([(p, bytearray(b)) for p, b in files.items()], "path string, content binary").repartition(parts)


@pytest.fixture
def old(spark, tmp_path):
    """A release that is there already."""
    root = str(tmp_path / "site")
    tree_sink.write_release(files_df(spark, {"data/a.jsonl": b"old\n"}), root, "{}\n")
    return root


def test_blocks_and_digests(spark, tmp_path):
    want = {"a/b/deep.bin": os.urandom(BIG), "empty": b"", "x.txt": b"x", "a/é": b"1234567"}
    for p, data in want.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(data)
    got: dict = {}
    rows = tree_sink.read_release(spark, str(tmp_path), block_bytes=1000_000).collect()
    for r in sorted(rows, key=lambda r: (r["path"], r["start"])):
        assert r["bytes"] == len(want[r["path"]]) and r["start"] == len(got.get(r["path"], b""))
        got[r["path"]] = got.get(r["path"], b"") + bytes(r["content"])
    assert got == want and len(rows) == 7
    digests = {r["path"]: (r["bytes"], r["sha256"]) for r in tree_sink.release_digests(spark, f"file://{tmp_path}").collect()}
    assert digests == {p: (len(d), "sha256:" + hashlib.sha256(d).hexdigest()) for p, d in want.items()}
    assert [p for p, _ in listed(str(tmp_path))] == sorted(want, key=str.encode)


@pytest.mark.parametrize("limits", [{"maxFiles": 1}, {"maxFileBytes": 3}, {"maxTotalBytes": 6}, {"maxFiles": 0}])
def test_budgets_are_refused_before_reading(spark, tmp_path, limits):
    for p in ("a", "b"):
        (tmp_path / p).write_bytes(b"1234")
    with pytest.raises(Exception, match="limit|more than|positive"):
        tree_sink.read_release(spark, str(tmp_path), **limits).collect()


def test_links_and_special_files_are_refused(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a").write_bytes(b"1")
    os.symlink(tmp_path / "t" / "a", tmp_path / "t" / "link")
    with pytest.raises(ValueError, match="regular"):
        listed(str(tmp_path / "t"))
    os.unlink(tmp_path / "t" / "link")
    os.symlink("/etc", tmp_path / "t" / "link")
    with pytest.raises(Exception, match="regular"):
        tree_sink.release_digests(spark, str(tmp_path / "t")).collect()
    os.unlink(tmp_path / "t" / "link")
    os.mkfifo(tmp_path / "t" / "pipe")
    with pytest.raises(ValueError, match="regular"):
        listed(str(tmp_path / "t"))
    os.symlink(tmp_path / "t", tmp_path / "root")
    with pytest.raises(ValueError, match="directory"):
        listed(str(tmp_path / "root"))
    os.symlink(tmp_path / "t" / "a", tmp_path / "f")
    with pytest.raises(OSError):
        opened(str(tmp_path), "f")


def test_a_file_that_changes_is_noticed(tmp_path):
    (tmp_path / "a").write_bytes(b"12345")
    reader = FileBlocks({"path": str(tmp_path)}).reader(None)
    part = reader.partitions()[0]
    (tmp_path / "a").write_bytes(b"123456")
    with pytest.raises(ValueError, match="changed"):
        list(reader.read(part))


def test_a_file_above_two_gigabytes(spark, tmp_path):
    size = (2 << 30) + 5
    with open(tmp_path / "big", "wb") as f:
        f.truncate(size)
    rows = register(spark).read.format("file_blocks").option("blockBytes", 32 << 20).load(str(tmp_path))
    got = rows.agg(F.sum(F.octet_length("content")).alias("n"), F.count("*").alias("k"), F.max("start").alias("s")).first()
    assert (got["n"], got["k"], got["s"]) == (size, 65, 2 << 30)
    assert tree_sink.release_digests(spark, str(tmp_path)).first()["bytes"] == size


def test_sink_round_trip(spark, old):
    want = {f"data/{k:02x}.jsonl": os.urandom(k * 37) for k in range(40)} | {"empty": b"", "assets/logo.bin": os.urandom(BIG)}
    rows = [(p, s, bytearray(b[s : s + 100_000])) for p, b in want.items() for s in range(0, max(len(b), 1), 100_000)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "path string, start long, content binary").repartition(5)
    tree_sink.write_release(df, old, '{"é":1}\n', partitions=4, maxFiles=100)
    assert tree(old) == want | {"bundle.json": '{"é":1}\n'.encode()}
    assert os.listdir(os.path.dirname(old)) == ["site"]
    declared = spark.createDataFrame([(p, "sha256:" + hashlib.sha256(b).hexdigest(), len(b)) for p, b in want.items()], "path string, sha256 string, bytes long")
    assert tree_sink.release_faults(spark, old, declared, '{"é":1}\n').count() == 0
    open(os.path.join(old, "data/01.jsonl"), "wb").write(b"x" * 37)
    open(os.path.join(old, "data/02.jsonl"), "wb").write(b"x")
    os.unlink(os.path.join(old, "empty"))
    open(os.path.join(old, "more"), "wb").close()
    got = {(r["path"], r["check_ordinal"], r["code"]) for r in tree_sink.release_faults(spark, old, declared, "{}").collect()}
    assert got == {("data/01.jsonl", 4, "bytes"), ("data/02.jsonl", 3, "size"), ("empty", 2, "missing"), ("more", 1, "undeclared"), ("bundle.json", 3, "size")}


@pytest.mark.parametrize(
    "files",
    [{"A": b""}, {"a//b": b""}, {"../a": b""}, {"12": b""}, {"bundle.json": b""}, {"a": b"", "a/b": b""}, {"bundle.json/x": b""}, {"a/.b": b""}],
)
def test_refused_paths_leave_the_prior_release(spark, old, files):
    before = tree(old)
    with pytest.raises(Exception):
        tree_sink.write_release(files_df(spark, files), old, "{}")
    assert tree(old) == before and os.listdir(os.path.dirname(old)) == ["site"]


def test_a_failed_task_leaves_the_prior_release(spark, old):
    before = tree(old)
    df = files_df(spark, {f"f{k}": b"1" for k in range(20)})
    broken = df.withColumn("content", F.when(F.col("path") == "f7", F.raise_error("lost").cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        tree_sink.write_release(broken, old, "{}")
    with pytest.raises(Exception, match="no bytes at"):
        tree_sink.write_release(df.withColumn("start", F.lit(3)), old, "{}")
    with pytest.raises(Exception, match="maxTotalBytes"):
        tree_sink.write_release(df, old, "{}", maxTotalBytes=19)
    assert tree(old) == before and os.listdir(os.path.dirname(old)) == ["site"]


class Breaking(tree_sink.TreeWriter):
    def __init__(self, options, fails):
        super().__init__(options)
        self.fails = fails

    def _move(self, source, target):
        if self.fails and self.fails.pop(0):
            raise OSError("no move")
        super()._move(source, target)


@pytest.mark.parametrize("fails", [[True], [False, True]])
def test_a_failed_commit_restores_the_prior_release(old, fails):
    before = tree(old)
    writer = Breaking({"path": old, "bundle": "{}"}, fails)
    message = writer.write(iter([{"path": "a", "start": 0, "content": b"new"}]))
    with pytest.raises(OSError):
        writer.commit([message, None])
    writer.abort([message])
    assert tree(old) == before and os.listdir(os.path.dirname(old)) == ["site"]


def test_a_prior_release_that_cannot_be_restored_is_kept(old):
    before = tree(old)
    writer = Breaking({"path": old, "bundle": "{}"}, [False, True, True])
    message = writer.write(iter([{"path": "a", "start": 0, "content": b"new"}]))
    with pytest.raises(RuntimeError, match="kept at"):
        writer.commit([message])
    writer.abort([message])
    assert tree(os.path.join(writer.stage, "kept")) == before


def test_targets_that_are_no_directories(spark, tmp_path):
    (tmp_path / "file").write_bytes(b"1")
    os.symlink(tmp_path, tmp_path / "link")
    for name in ("file", "link"):
        with pytest.raises(Exception, match="directory"):
            tree_sink.write_release(files_df(spark, {"a": b"1"}), str(tmp_path / name), "{}")
    with pytest.raises(Exception):
        tree_sink.write_release(files_df(spark, {"a": b"1"}), "/", "{}")
    assert sorted(os.listdir(tmp_path)) == ["file", "link"] and (tmp_path / "file").read_bytes() == b"1"
    tree_sink.write_release(files_df(spark, {}), str(tmp_path / "new"), "only\n")
    assert tree(str(tmp_path / "new")) == {"bundle.json": b"only\n"}


# -- ownership -------------------------------------------------------------------------------------------------------


def nested(claims):
    """Every claim against every other."""
    rows = sorted([(e.rstrip("/") if e.endswith("/") else e, e, o or "", o is None) for o, e in claims if e is not None], key=lambda x: (x[0].replace("/", "\x01"), *x[1:]))
    out = []
    for k, (p, e, o, none) in enumerate(rows):
        around = [(len(r[0]), j, r) for j, r in enumerate(rows) if p.startswith(r[0] + "/") or (r[0] == p and j < k)]
        if around:
            top = max(around)[2]
            out.append((None if none else o, e, None if top[3] else top[2], top[1], len(around)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_overlaps_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    claims = []
    for _ in range(400):
        path = "/".join(rng.choice(["a", "b", "a-b", "ab", "c.d"]) for _ in range(rng.randrange(1, 7)))
        claims.append((rng.choice(["x", "y", None]), path + rng.choice(["", "/"])))
    claims += [("z", "hot/")] * 50 + [(None, None)]
    found = ownership.overlaps(spark.createDataFrame(claims, "owner string, entry string").repartition(6))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == nested(claims)
    assert ownership.overlaps(spark.createDataFrame([], "owner string, entry string")).count() == 0


def test_registry_faults_and_owners(spark):
    adapters = spark.createDataFrame([("one",), ("two",), ("two",), ("Bad",)], "adapter string")
    resources = spark.createDataFrame([("one", "r1"), ("two", "r1"), ("one", "7"), ("one", "r2"), ("one", "r2"), ("three", None)], "adapter string, name string")
    subjects = spark.createDataFrame([("one", "s"), ("two", "s"), ("two", "T")], "adapter string, name string")
    objects = spark.createDataFrame([("one", "data/"), ("two", "data/x"), ("two", "data-x"), ("one", "release.json"), ("one", "a//"), ("two", "pages/")], "adapter string, entry string")
    got = {tuple(r) for r in ownership.registry_faults(adapters, resources, subjects, objects).collect()}
    assert got == {
        (1, "adapter", "Bad", None), (2, "repeated_adapter", "two", None), (3, "resource", "one", "7"), (3, "resource", "three", None), (4, "subject", "two", "T"), (5, "shared_resource", "one", "r1"), (5, "shared_resource", "one", "r2"),
        (6, "shared_subject", "one", "s"), (7, "object", "one", "release.json"), (7, "object", "one", "a//"), (8, "overlap", "two", "data/x"), (9, "unknown_adapter", "three", None),
    }
    clean = objects.where("entry in ('data/', 'data-x', 'pages/')")
    paths = spark.createDataFrame([("data/a/b",), ("data",), ("data-x",), ("data-x/y",), ("pages",), ("UP",), (None,), ("pages/p",)], "path string")
    assert {tuple(r) for r in ownership.owned(paths, clean).collect()} == {
        ("data/a/b", "owned", "one"), ("data", "no_owner", None), ("data-x", "owned", "two"), ("data-x/y", "no_owner", None), ("pages", "no_owner", None), ("UP", "not_canonical", None), (None, "not_canonical", None), ("pages/p", "owned", "two")
    }
    assert {r[0] for r in ownership.touched(paths, clean).collect()} == {"data/a/b", "data", "data-x", "data-x/y", "pages", "pages/p"}
