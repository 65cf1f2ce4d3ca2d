"""Preparation in stages that are bound by digests: a stage is written once, and no stage goes on from bytes that another one did not see.

A table's digest does not depend on the order or the partitions of its rows: the number of rows, and the sums of the first and second 60 bits of the
SHA-256 of each row as JSON. It is a by-product of the write: `DataFrame.observe` gathers it from the same pass, whose tasks count
only when they succeed. It tells tables apart, it does not stand against someone who searches for collisions.

Stages are content-addressed: the key of a stage is the digest of its name, its version and the digests of its inputs. A stage whose key is known
is not run, and reads nothing. A stage's rows and its record of digest and count are written by Spark, the record last; an attempt that fails before leaves
no record, so it counts for nothing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sealwright.session import exists

RECORD = "key string, rows long, digest string, folder string"


class Refused(ValueError):
    """A stage returned, or stands for, other bytes than it must."""


@dataclass(frozen=True)
class Stored:
    """A table that a stage wrote: where its rows are, their number and digest."""

    folder: str
    rows: int
    digest: str

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.folder)


def _sums(df: DataFrame) -> list[Column]:
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(part(1)), F.lit(0).cast("decimal(38,0)")).alias("first"), F.coalesce(F.sum(part(16)), F.lit(0).cast("decimal(38,0)")).alias("second")]


def _digest(found: dict) -> str:
    return "sha256:" + hashlib.sha256(f"{found['rows']},{found['first']},{found['second']}".encode()).hexdigest()


def table_digest(df: DataFrame) -> tuple[int, str]:
    """(rows, digest) of a table, in one aggregation. The columns' names and order count, their partitions do not; a row holds no map with keys in another order."""
    found = df.agg(*_sums(df)).first().asDict()
    return found["rows"], _digest(found)


def stage_key(name: str, version: str, inputs: list[str]) -> str:
    return hashlib.sha256(json.dumps([name, version, inputs]).encode()).hexdigest()


def _known(spark: SparkSession, at: str, key: str) -> Stored | None:
    if not exists(spark, f"{at}/record/_SUCCESS"):
        return None
    # the record is one row; if two runs wrote one each, both hold the same rows
    found = spark.read.schema(RECORD).json(f"{at}/record").where(F.col("key") == key).orderBy("folder").first()
    return found and Stored(found["folder"], found["rows"], found["digest"])


def stored(spark: SparkSession, root: str, name: str, version: str, inputs: list[str], make: Callable[[], DataFrame]) -> tuple[Stored, bool]:
    """The stage `name` below `root`, and whether it was run now. `make` is called only if no run with this version and these input digests is recorded."""
    key = stage_key(name, version, inputs)
    at = f"{root.rstrip('/')}/{name}/{key}"
    if found := _known(spark, at, key):
        return found, False
    df, seen = make(), Observation(f"{name}-{uuid.uuid4().hex}")
    folder = f"{at}/rows-{uuid.uuid4().hex}"
    df.observe(seen, *_sums(df)).write.parquet(folder)
    out = Stored(folder, seen.get["rows"], _digest(seen.get))
    spark.createDataFrame([(key, out.rows, out.digest, folder)], RECORD).coalesce(1).write.mode("append").json(f"{at}/record")
    return out, True


def proved(spark: SparkSession, table: Stored) -> Stored:
    """`table`, if the rows that are stored now have its digest; else Refused."""
    rows, digest = table_digest(table.read(spark))
    if (rows, digest) != (table.rows, table.digest):
        raise Refused(f"{table.folder} holds other rows than were written: {rows} {digest}")
    return table


@dataclass(frozen=True)
class Built:
    """What a builder gives: its result, the folder of the release, and the digests of the bundle and of the set of roots it is trusted by."""

    built: object
    directory: str
    bundle_digest: str
    root_set_digest: str


@dataclass(frozen=True)
class Verified:
    bundle_digest: str
    verifier_digest: str
    result: object = None


@dataclass(frozen=True)
class Delivery:
    prepared: dict
    bundle_digest: str


@dataclass(frozen=True)
class Preparation:
    """Build, verify, prepare the delivery: one path, whose verifier is fixed before any input is seen.

    `build` takes the input and the verifier's digest, `verify` the folder and the digest of the trusted roots, `deliver` the folder. Each is a Spark program. The path stops
    (Refused) where the verifier speaks of another bundle or is another verifier, and where the folder has another bundle after verification.
    """

    verifier_digest: str
    build: Callable[[object, str], Built]
    verify: Callable[[str, str], Verified]
    deliver: Callable[[str], Delivery]

    def __call__(self, given: object) -> dict:
        built = self.build(given, self.verifier_digest)
        verified = self.verify(built.directory, built.root_set_digest)
        if (verified.bundle_digest, verified.verifier_digest) != (built.bundle_digest, self.verifier_digest):
            raise Refused("the verifier speaks of another release, or is another verifier")
        delivery = self.deliver(built.directory)
        if delivery.bundle_digest != verified.bundle_digest:
            raise Refused("the release changed after it was verified")
        return {**delivery.prepared, "built": built.built, "verified": verified}
