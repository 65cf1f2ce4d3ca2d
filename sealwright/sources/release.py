"""Release trees as tables: listing, budgets, declarations and byte checks over Spark's binaryFile source.

Spark's file scans leave out files without bytes. They are absent from the tables here, and a declared file without bytes does not count
as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed default limits of a release: files, bytes of one file, bytes in all.
LIMITS = {"files": 200_000, "file_bytes": 128 << 20, "total_bytes": 256 << 20}


def _files(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)


def _relative(directory: str) -> Column:
    """The part of a file's path below `directory`."""
    root = directory.rstrip("/").split("://", 1)[-1]
    return F.expr(f"substring(path, locate('{root}/', path) + {len(root) + 1})")


def listing(spark: SparkSession, directory: str) -> DataFrame:
    """(path, bytes); contents are not read."""
    return _files(spark, directory).select(_relative(directory).alias("path"), F.col("length").alias("bytes"))


def budget_violations(files: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """(check_ordinal, code, path) of a listing that is beyond its limits."""
    whole = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"))
    none = F.lit(None).cast("string").alias("path")
    many = whole.where(F.col("n") > limits["files"]).select(F.lit(1).alias("check_ordinal"), F.lit("files").alias("code"), none)
    large = files.where(F.col("bytes") > limits["file_bytes"]).select(F.lit(2), F.lit("file_bytes"), "path")
    return many.union(large).union(whole.where(F.col("b") > limits["total_bytes"]).select(F.lit(3), F.lit("total_bytes"), none))


def declarations(spark: SparkSession, directory: str) -> DataFrame:
    """(path, sha256, bytes) of every file; check the budget of the listing first."""
    return _files(spark, directory).select(_relative(directory).alias("path"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"), F.col("length").alias("bytes"))


def byte_violations(present: DataFrame, declared: DataFrame) -> DataFrame:
    """(path, check_ordinal, code): undeclared and missing files, then other sizes, then other bytes."""
    p, d = (x.select("path", F.col("sha256").alias(f"{n}_sha"), F.col("bytes").alias(f"{n}_bytes")) for x, n in ((present, "p"), (declared, "d")))
    empty = (F.col("d_bytes") == 0) & (F.col("d_sha") == F.concat(F.lit("sha256:"), F.sha2(F.lit(""), 256)))
    both = p.join(d, "path", "full").where(~F.coalesce(F.col("p_sha").isNull() & empty, F.lit(False)))
    code = F.when(F.col("d_sha").isNull(), "undeclared").when(F.col("p_sha").isNull(), "missing").when(F.col("p_bytes") != F.col("d_bytes"), "size").when(F.col("p_sha") != F.col("d_sha"), "bytes")
    order = F.array_position(F.array(*[F.lit(x) for x in ("undeclared", "missing", "size", "bytes")]), F.col("code")).cast("int")
    return both.select("path", code.alias("code")).where("code is not null").select("path", order.alias("check_ordinal"), "code")


def git_blob_id(content: Column, algorithm: str = "sha1") -> Column:
    """The object id of a blob with these bytes."""
    content = content.cast("binary")
    framed = F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")), content)
    return F.sha1(framed) if algorithm == "sha1" else F.sha2(framed, 256)


def archive_url(origin: str, collection: str, prefix: str, digest: Column) -> Column:
    """The content-addressed address of an archive; null where `digest` is none."""
    from sealwright.functions.values import DIGEST, path_segment

    if not origin.startswith("https://") or "@" in origin or origin.count("/") != 2 or "#" in origin or "?" in origin:
        raise ValueError("an https origin without credentials is needed")
    named = path_segment(digest)
    return F.when(digest.rlike(DIGEST), F.concat(F.lit(f"{origin}/{collection}/"), named, F.lit(f"/{prefix}-"), named, F.lit(".tar.gz")))
