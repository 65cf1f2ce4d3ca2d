"""A sharded projection kept up to date by Structured Streaming.

Every micro-batch reads only the shards that its changes touch and writes only those, under its batch number; a log says for each batch which shards it wrote or
deleted. The state before batch n is what the log says up to n - 1, so a repeated batch writes the same again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from sealwright.operators import projection

FIRST = -1


def start(rows: DataFrame, root: str, max_bytes: int) -> None:
    """Write the first snapshot of `rows` (id, line) below `root`."""
    placed = projection.placed(rows.select("id", "line"), max_bytes).select("id", "line", "path")
    placed.write.mode("overwrite").parquet(f"{root}/rows/batch={FIRST}")
    spark = rows.sparkSession
    written = spark.read.parquet(f"{root}/rows/batch={FIRST}")
    written.select("path").distinct().withColumn("action", F.lit("write")).write.mode("overwrite").parquet(f"{root}/log/batch={FIRST}")


def leaves(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """(path, batch) of the shards that exist; 65536 at most."""
    log = spark.read.parquet(f"{root}/log")
    log = log if before is None else log.where(F.col("batch") < before)
    return log.groupBy("path").agg(F.max_by("action", "batch").alias("action"), F.max("batch").alias("batch")).where("action = 'write'").drop("action")


def current(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """(id, line, path) of the projection, or of what it was before a batch."""
    rows = spark.read.parquet(f"{root}/rows")
    rows = rows if before is None else rows.where(F.col("batch") < before)  # a repeated batch must not read its own files
    return rows.join(F.broadcast(leaves(spark, root, before)), ["path", "batch"], "left_semi").select("id", "line", "path")


def apply_batch(changes: DataFrame, batch: int, root: str, max_bytes: int, order: str = "seq") -> None:
    """Apply `changes` (id, line, order); the last change of an id in the batch counts."""
    spark = changes.sparkSession
    last = changes.groupBy("id").agg(F.max_by("line", order).alias("line"), F.max(order).alias("o")).select("id", "line")
    known = leaves(spark, root, batch).select("path")
    touched = projection.affected(last.select("id"), known)
    projection.successor(current(spark, root, batch), known, last, max_bytes).write.mode("overwrite").parquet(f"{root}/rows/batch={batch}")
    made = spark.read.parquet(f"{root}/rows/batch={batch}").select("path").distinct()
    gone = touched.join(known, "path", "left_semi").join(made, "path", "left_anti")
    log = made.withColumn("action", F.lit("write")).unionByName(gone.withColumn("action", F.lit("delete")))
    log.write.mode("overwrite").parquet(f"{root}/log/batch={batch}")


def maintain(stream: DataFrame, root: str, checkpoint: str, max_bytes: int, order: str = "seq") -> DataStreamWriter:
    """A writer that applies every micro-batch of a stream of changes."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: apply_batch(df, n, root, max_bytes, order))
