"""Files as byte ranges: listing under budgets, a partitioned reader, and digests that are hashed in a stream.

Two data sources, registered by `register`:

`file_blocks`   (path, bytes, start, content)   every file in ranges of at most `blockBytes`; a file without bytes has one empty range
`file_digests`  (path, bytes, sha256)           one row a file; a task holds one buffer of it, whatever its size

Both list the tree on the driver and refuse links and special files, more files than `maxFiles`, a file above `maxFileBytes`
and a tree above `maxTotalBytes` before any content is read. Ranges are dealt to tasks so that each has about `blockBytes`, so
a large file is read by many tasks and many small files by one. A file whose size has changed since the listing fails the task that reads it.
Paths are relative to the root, in order of their bytes. Trees that Python cannot open are listed and read through pyarrow's file systems.
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: A range is one value in the JVM, which holds several copies of it on its way.
BLOCK = 16 << 20
CHUNK = 4 << 20
#: Options that bound a tree.
LIMITS_OPTIONS = ("maxFiles", "maxFileBytes", "maxTotalBytes")


def _local(root: str) -> str | None:
    """The path of a local root, or null where it is on another file system."""
    if root.startswith("file:"):
        return "/" + root[5:].lstrip("/")
    return None if "://" in root or root.startswith("hdfs:") else os.path.abspath(root)


def opened(root: str, path: str = "") -> BinaryIO:
    """A file below `root` for reading; links are not followed."""
    local = _local(root)
    if local is None:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        return system.open_input_file(f"{base.rstrip('/')}/{path}" if path else base)
    return os.fdopen(os.open(os.path.join(local, path) if path else local, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0) | getattr(os, "O_NONBLOCK", 0)), "rb")


def listed(root: str, most: int | None = None) -> list[tuple[str, int]]:
    """(path, bytes) of every file below `root`. Links, special files and more than `most` files raise ValueError."""
    local = _local(root)
    found: list[tuple[str, int]] = []
    if local is None:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for x in system.get_file_info(fs.FileSelector(base, recursive=True)):
            if x.type == fs.FileType.File:
                found.append((x.path[len(base.rstrip("/")) + 1 :], x.size))
            elif x.type != fs.FileType.Directory:
                raise ValueError(f"not a regular file: {x.path}")
    else:
        if not stat.S_ISDIR(os.lstat(local).st_mode):
            raise ValueError(f"not a directory: {root}")
        open_dirs = [""]
        while open_dirs:
            below = open_dirs.pop()
            with os.scandir(os.path.join(local, below)) as entries:
                for x in entries:
                    path = f"{below}/{x.name}" if below else x.name
                    if x.is_dir(follow_symlinks=False):
                        open_dirs.append(path)
                    elif x.is_file(follow_symlinks=False):
                        found.append((path, x.stat(follow_symlinks=False).st_size))
                    else:
                        raise ValueError(f"not a regular file: {path}")
                    if most is not None and len(found) > most:
                        raise ValueError(f"more than {most} files")
    if most is not None and len(found) > most:
        raise ValueError(f"more than {most} files")
    return sorted(found, key=lambda x: x[0].encode("utf-8", "surrogateescape"))


@dataclass
class Ranges(InputPartition):
    """What one task reads: (path, bytes of the file, start, length)."""

    parts: list[tuple[str, int, int, int]]


def _packed(parts: Iterator[tuple[str, int, int, int]], most: int) -> list[Ranges]:
    out: list[Ranges] = []
    held = 0
    for p in parts:
        if not out or held + p[3] > most or len(out[-1].parts) >= 10_000:
            out.append(Ranges([]))
            held = 0
        out[-1].parts.append(p)
        held += p[3]
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("a path is needed")
        self.root = options["path"]
        self.block = int(options.get("blockBytes", BLOCK))
        limits = {k: options.get(k) for k in LIMITS_OPTIONS}
        self.limits = {k: int(v) if v is not None else None for k, v in limits.items()}
        if self.block <= 0 or any(v is not None and v <= 0 for v in self.limits.values()):
            raise ValueError("limits must be positive")

    def files(self) -> list[tuple[str, int]]:
        found = listed(self.root, self.limits["maxFiles"])
        one, every, total = self.limits["maxFileBytes"], self.limits["maxTotalBytes"], 0
        for path, size in found:
            total += size
            if one is not None and size > one or every is not None and total > every:
                raise ValueError(f"the byte limit is exceeded at {path}")
        return found

    def _open(self, path: str, size: int) -> BinaryIO:
        f = opened(self.root, path)
        f.seek(0, os.SEEK_END)
        if f.tell() != size:
            f.close()
            raise ValueError(f"the file changed while it was read: {path}")
        return f


class BlockReader(_Reader):
    def partitions(self) -> list[Ranges]:
        return _packed(((p, n, s, min(self.block, n - s)) for p, n in self.files() for s in range(0, max(n, 1), self.block)), self.block)

    def read(self, partition: Ranges | None) -> Iterator[pa.RecordBatch]:
        names = ["path", "bytes", "start", "content"]
        for path, size, start, length in partition.parts if partition else ():
            with self._open(path, size) as f:
                f.seek(start)
                data = f.read(length)
                f.seek(0, os.SEEK_END)
                if len(data) != length or f.tell() != size:
                    raise ValueError(f"the file changed while it was read: {path}")
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([start]), pa.array([data], pa.binary())], names)


class DigestReader(_Reader):
    def partitions(self) -> list[Ranges]:
        return _packed(((p, n, 0, n) for p, n in self.files()), self.block)

    def read(self, partition: Ranges | None) -> Iterator[tuple[Any, ...]]:
        for path, size, _, _ in partition.parts if partition else ():
            digest, seen = hashlib.sha256(), 0
            with self._open(path, size) as f:
                f.seek(0)
                while data := f.read(CHUNK):
                    digest.update(data)
                    seen += len(data)
            if seen != size:
                raise ValueError(f"the file changed while it was read: {path}")
            yield (path, size, "sha256:" + digest.hexdigest())


class FileBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_blocks"

    def schema(self) -> str:
        return "path string, bytes long, start long, content binary"

    def reader(self, schema) -> BlockReader:
        return BlockReader(self.options)


class FileDigests(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "path string, bytes long, sha256 string"

    def reader(self, schema) -> DigestReader:
        return DigestReader(self.options)


def register(spark: SparkSession) -> SparkSession:
    for source in (FileBlocks, FileDigests):
        spark.dataSource.register(source)
    return spark
