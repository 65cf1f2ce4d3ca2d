"""A sharded projection kept by a stream, with a manifest for every batch and proof of what it goes on from.

Below the root, `rows/batch=n/leaf=p` has the rows of the leaves that batch n wrote, `manifest/batch=n` one entry for each leaf that then exists: its
digest, bytes and rows, and the batch that wrote it. A batch reads the last manifest, the folders of the leaves that its changes touch and nothing else; their digests and counts are
computed again and must be those of the manifest, or the batch is refused and the state stays. It writes the leaves it made anew and a manifest that carries all other
entries over, 65536 at most. A repeated batch starts from the manifest before it, and writes the same again. `compact` drops
what no kept manifest names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from sealwright.operators import projection

FIRST = -1
ENTRY = "path string, digest string, bytes long, rows long, batch int"
ROW = "id string, line string, path string"


class Refused(ValueError):
    """Stored rows are not those of the manifest."""


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _batches(spark: SparkSession, root: str) -> list[int]:
    """The batches that have a whole manifest, in order."""
    fs, p = _fs(spark, f"{root}/manifest")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    whole = [n for n in names if n.startswith("batch=") and fs.exists(_fs(spark, f"{root}/manifest/{n}/_SUCCESS")[1])]
    return sorted(int(n[6:]) for n in whole)


def manifest(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """(path, digest, bytes, rows, batch): the entries after the last batch, or after the last one before `before`."""
    found = [b for b in _batches(spark, root) if before is None or b < before]
    if not found:
        raise Refused("there is no manifest to go on from")
    return spark.read.schema(ENTRY).parquet(f"{root}/manifest/batch={found[-1]}")


def _leaf(path: str) -> str:
    return path.removeprefix("data/").removesuffix(".jsonl")


def _rows(spark: SparkSession, root: str, entries: DataFrame) -> DataFrame:
    """(id, line, path) of some entries, read from their folders alone."""
    folders = [f"{root}/rows/batch={e['batch']}/leaf={_leaf(e['path'])}" for e in entries.select("path", "batch").collect()]
    if not folders:
        return spark.createDataFrame([], ROW)
    return spark.read.schema(ROW).parquet(*folders)


def current(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    return _rows(spark, root, manifest(spark, root, before))


def unproved(spark: SparkSession, root: str, entries: DataFrame) -> DataFrame:
    """(path) of the entries whose stored rows have another digest, size or number."""
    have = projection.inventory(_rows(spark, root, entries)).select("path", F.col("digest").alias("d"), F.col("bytes").alias("b"), F.col("rows").alias("r"))
    return entries.join(have, "path", "left").where("not (digest <=> d and bytes <=> b and rows <=> r)").select("path")


def _write(rows: DataFrame, carried: DataFrame | None, root: str, batch: int) -> None:
    spark = rows.sparkSession
    leaf = F.regexp_extract("path", r"data/([0-9a-f]+)\.jsonl", 1)
    at = f"{root}/rows/batch={batch}"
    rows.withColumn("leaf", leaf).repartition("leaf").write.mode("overwrite").partitionBy("leaf").parquet(at)
    made = projection.inventory(spark.read.schema(ROW).option("recursiveFileLookup", "true").parquet(at))
    made = made.select("path", "digest", "bytes", "rows", F.lit(batch).alias("batch"))
    (made if carried is None else made.unionByName(carried)).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/batch={batch}")


def start(rows: DataFrame, root: str, max_bytes: int) -> None:
    """Write the first snapshot of `rows` (id, line) and its manifest. Rows that `writer_violations` names are refused."""
    if bad := projection.writer_violations(rows, max_bytes).limit(3).collect():
        raise Refused(f"no snapshot can hold these rows: {[tuple(r) for r in bad]}")
    _write(projection.placed(rows.select("id", "line"), max_bytes).select("id", "line", "path"), None, root, FIRST)


def apply_batch(changes: DataFrame, batch: int, root: str, max_bytes: int, order: str = "seq") -> None:
    """Apply `changes` (id, line, order; a null line deletes); the last change of an id in the batch counts."""
    spark = changes.sparkSession
    last = changes.where("id is not null").groupBy("id").agg(F.max_by("line", order).alias("line"), F.max(order).alias("o")).select("id", "line")
    known = manifest(spark, root, batch)
    if bad := projection.leaf_violations(known).limit(3).collect():
        raise Refused(f"the manifest cannot route: {[tuple(r) for r in bad]}")
    touched = projection.affected(last.select("id"), known.select("path"))
    read = known.join(F.broadcast(touched), "path", "left_semi")  # both are bounded by the number of leaves
    if bad := unproved(spark, root, read).limit(3).collect():
        raise Refused(f"stored rows differ from the manifest: {[r['path'] for r in bad]}")
    after = projection.successor(_rows(spark, root, read), known.select("path"), last, max_bytes).select("id", "line", "path")
    if bad := projection.layout(after.select("id", "line"), max_bytes).where(F.col("bytes") > max_bytes).limit(1).collect():
        raise Refused(f"a leaf of the last depth is above the limit: {bad[0]['p4']}")
    _write(after, known.join(F.broadcast(touched), "path", "left_anti"), root, batch)


def maintain(stream: DataFrame, root: str, checkpoint: str, max_bytes: int, order: str = "seq") -> DataStreamWriter:
    """A writer that applies every micro-batch of a stream of changes."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: apply_batch(df, n, root, max_bytes, order))


def compact(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Drop all but the last `keep` manifests and the leaf folders that those do not name; the number of folders dropped. Not while a batch runs."""
    batches = _batches(spark, root)
    if keep < 1 or len(batches) <= keep:
        return 0
    kept = batches[-keep:]
    named = {(r["batch"], _leaf(r["path"])) for b in kept for r in spark.read.schema(ENTRY).parquet(f"{root}/manifest/batch={b}").select("batch", "path").collect()}
    fs, p = _fs(spark, f"{root}/rows")
    gone = 0
    for folder in fs.listStatus(p):
        b = int(folder.getPath().getName()[6:])
        leaves = [s.getPath() for s in fs.listStatus(folder.getPath()) if s.isDirectory()]
        drop = [x for x in leaves if b <= kept[-1] and (b, x.getName()[5:]) not in named]
        if len(drop) == len(leaves) and b not in kept:
            fs.delete(folder.getPath(), True)
        else:
            for x in drop:
                fs.delete(x, True)
        gone += len(drop)
    for b in batches[:-keep]:
        fs.delete(_fs(spark, f"{root}/manifest/batch={b}")[1], True)
    return gone
