"""A staged sink for release trees: tasks write into a folder beside the target, the commit puts the whole tree in place or leaves the old one.

The data source `release_tree` takes rows (path, start, content): a file is the contents of its path in the order of `start`. `write_release` brings
the rows of a path together and in order, so a task appends to one file at a time and holds one row of it, whatever the file's size. The rows of
one file must not be dealt to several tasks.

Each attempt of a task writes into a folder of its own, so that a lost or repeated attempt leaves nothing in the tree. The commit
checks the paths of all files together (grammar, repeats, a file that contains another, the reserved name of the bundle), moves the files into the
next tree, writes the bundle last, moves the prior tree aside and the next one to its place. If that fails the prior tree is moved
back; if even this fails, it is kept and its place is named. A failed task, a failed check and a failed move leave the prior
release byte for byte as it was. Writers to one target must be serialized. The target needs a file system with links and renames that all machines share.
"""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from sealwright.operators.changes import INTEGER_LIKE, PATH
from sealwright.sources.blocks import BLOCK, LIMITS_OPTIONS, _local, register

BUNDLE = "bundle.json"
_PATH, _INTEGER = re.compile(PATH.replace(r"\z", r"\Z")), re.compile(INTEGER_LIKE.replace(r"\z", r"\Z"))


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: the folder of its attempt, and (path, bytes) of its files."""

    folder: str
    files: list[tuple[str, int]] = field(default_factory=list)


def path_fault(paths: list[str]) -> str | None:
    """Why the paths cannot be one release with its bundle, or null."""
    known: set[str] = set()
    for p in paths:
        if not _PATH.match(p) or _INTEGER.match(p):
            return f"not a canonical path: {p}"
        if p == BUNDLE:
            return "the bundle cannot be an input"
        if p in known:
            return f"repeated path: {p}"
        known.add(p)
    known.add(BUNDLE)
    for p in known:
        parts = p.split("/")
        for i in range(1, len(parts)):
            if "/".join(parts[:i]) in known:
                return f"the file {'/'.join(parts[:i])} cannot contain {p}"
    return None


class TreeWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        local = _local(options.get("path") or "")
        if not options.get("path") or local is None:
            raise ValueError("a path on a shared, mounted file system is needed")
        if os.path.dirname(local) == local:
            raise ValueError("the root of a file system cannot be a release")
        if "bundle" not in options:
            raise ValueError("the text of the bundle is needed")
        self.root, self.bundle = local, options["bundle"]
        self.most = {k: int(options[k]) if k in options else None for k in LIMITS_OPTIONS}
        self.stage = os.path.join(os.path.dirname(local), f".{os.path.basename(local)}-{uuid.uuid4().hex}")

    # on the executors

    def write(self, iterator: Iterator[Row]) -> Written:
        done = Written(os.path.join(self.stage, "attempts", uuid.uuid4().hex))
        out, now, at, seen = None, None, 0, set()
        try:
            for row in iterator:
                path, start, content = row["path"], row["start"], bytes(row["content"] or b"")
                if path != now:
                    if out:
                        out.close()
                        done.files.append((now, at))
                    fault = path_fault([path]) if path is not None else "a path is missing"
                    if fault or path in seen:
                        raise ValueError(fault or f"the rows of {path} are not together")
                    target = os.path.join(done.folder, path)
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    out, now, at = open(target, "xb"), path, 0
                    seen.add(path)
                if start != at:
                    raise ValueError(f"{path} has no bytes at {at}")
                out.write(content)
                at += len(content)
            if out:
                out.flush()
                os.fsync(out.fileno())
                done.files.append((now, at))
        finally:
            if out:
                out.close()
        return done

    # on the driver

    def commit(self, messages: list[Written | None]) -> None:
        try:
            self._commit([m for m in messages if m is not None])
        finally:
            if not os.path.isdir(os.path.join(self.stage, "kept")):
                shutil.rmtree(self.stage, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        if not os.path.isdir(os.path.join(self.stage, "kept")):
            shutil.rmtree(self.stage, ignore_errors=True)

    def _commit(self, messages: list[Written]) -> None:
        files = [(m.folder, p, n) for m in messages for p, n in m.files]
        if fault := path_fault([p for _, p, _ in files]):
            raise ValueError(fault)
        sizes = [n for _, _, n in files]
        for name, found in (("maxFiles", len(files)), ("maxFileBytes", max(sizes, default=0)), ("maxTotalBytes", sum(sizes))):
            if self.most[name] is not None and found > self.most[name]:
                raise ValueError(f"the release exceeds {name}")
        after, before = os.path.join(self.stage, "next"), os.path.join(self.stage, "prior")
        os.makedirs(after, exist_ok=True)
        for folder, path, size in files:
            source, target = os.path.join(folder, path), os.path.join(after, path)
            if os.lstat(source).st_size != size:
                raise ValueError(f"the staged file changed: {path}")
            os.makedirs(os.path.dirname(target), exist_ok=True)
            os.rename(source, target)
        with open(os.path.join(after, BUNDLE), "xb") as f:
            f.write(self.bundle.encode())
            f.flush()
            os.fsync(f.fileno())
        moved = False
        if os.path.lexists(self.root):
            if os.path.islink(self.root) or not os.path.isdir(self.root):
                raise ValueError("the target must be a directory, never a link or special file")
            self._move(self.root, before)
            moved = True
        try:
            self._move(after, self.root)
        except BaseException:
            if moved:
                try:
                    self._move(before, self.root)
                except BaseException as e:
                    os.rename(before, os.path.join(self.stage, "kept"))
                    raise RuntimeError(f"the prior release could not be restored; it is kept at {self.stage}/kept") from e
            raise

    def _move(self, source: str, target: str) -> None:
        os.rename(source, target)


class ReleaseTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "release_tree"

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        if [f.name for f in schema.fields] != ["path", "start", "content"]:
            raise ValueError("the columns must be path, start and content")
        return TreeWriter(self.options)


def write_release(files: DataFrame, root: str, bundle: str, partitions: int | None = None, together: bool = False, **limits: int) -> None:
    """Replace the release at `root` by `files` (path, content, and start where a file is given in several rows) and the text of its bundle.

    A file without bytes is a row with empty content; null content counts as empty. With `together`, the rows of a path are in one partition already, and are not shuffled
    again. Limits are maxFiles, maxFileBytes and maxTotalBytes.
    """
    register(files.sparkSession)
    files.sparkSession.dataSource.register(ReleaseTree)
    start = F.col("start").cast("long") if "start" in files.columns else F.lit(0).cast("long")
    rows = files.select(F.col("path").cast("string").alias("path"), start.alias("start"), F.col("content").cast("binary").alias("content"))
    dealt = rows if together else rows.repartition(partitions, "path") if partitions else rows.repartition("path")
    writer = dealt.sortWithinPartitions("path", "start").write.format("release_tree").mode("append").option("bundle", bundle)
    for name, value in limits.items():
        writer = writer.option(name, value)
    writer.save(root)


def read_release(spark: SparkSession, root: str, block_bytes: int = BLOCK, **limits: int) -> DataFrame:
    """(path, bytes, start, content) of a release's files in ranges, under limits."""
    reader = register(spark).read.format("file_blocks").option("blockBytes", block_bytes)
    for name, value in limits.items():
        reader = reader.option(name, value)
    return reader.load(root)


def release_digests(spark: SparkSession, root: str, **limits: int) -> DataFrame:
    """(path, bytes, sha256) of a release's files, hashed in a stream."""
    reader = register(spark).read.format("file_digests")
    for name, value in limits.items():
        reader = reader.option(name, value)
    return reader.load(root)


def release_faults(spark: SparkSession, root: str, declared: DataFrame, bundle: str, **limits: int) -> DataFrame:
    """(path, check_ordinal, code) where a stored release is not exactly `declared` (path, sha256, bytes) and its bundle.

    1 undeclared and 2 missing files, 3 other sizes, 4 other bytes; the bundle is declared by its own text. Only files of the declared size are hashed further than
    their size: all are hashed here in one pass, since a listing has no sizes that could be trusted without opening them.
    """
    data = bundle.encode()
    own = spark.createDataFrame([(BUNDLE, "sha256:" + hashlib.sha256(data).hexdigest(), len(data))], "path string, d_sha string, d_bytes long")
    d = declared.select("path", F.col("sha256").alias("d_sha"), F.col("bytes").cast("long").alias("d_bytes")).unionByName(own)
    both = release_digests(spark, root, **limits).join(d, "path", "full")
    ordinal = F.when(F.col("d_sha").isNull(), 1).when(F.col("sha256").isNull(), 2).when(F.col("bytes") != F.col("d_bytes"), 3).when(F.col("sha256") != F.col("d_sha"), 4)
    names = F.array(*[F.lit(x) for x in ("undeclared", "missing", "size", "bytes")])
    return both.select("path", ordinal.alias("check_ordinal")).where("check_ordinal is not null").withColumn("code", F.element_at(names, F.col("check_ordinal")))
