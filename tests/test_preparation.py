"""Stages bound by digests."""

import glob
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from sealwright.operators import preparation as P
from sealwright.sources import tree_sink


def test_digest_does_not_depend_on_partitions(spark):
    df = spark.range(500).select("id", F.concat(F.lit("t"), F.col("id") % 7).alias("t"), F.when(F.col("id") % 3 == 0, 1).alias("n"))
    one = P.table_digest(df)
    assert one == P.table_digest(df.orderBy(F.desc("id")).repartition(7)) and one[0] == 500
    assert one[1] != P.table_digest(df.where("id <> 3").unionByName(df.where("id = 4")))[1]
    assert one[1] != P.table_digest(df.withColumnRenamed("t", "u"))[1]
    assert P.table_digest(df.limit(0)) == P.table_digest(df.where("id < 0").repartition(3))
    nulls = spark.createDataFrame([(None, 1)], "a int, b int"), spark.createDataFrame([(1, None)], "a int, b int")
    assert P.table_digest(nulls[0]) != P.table_digest(nulls[1])


def test_a_known_stage_is_not_run_again(spark, tmp_path):
    root, runs = str(tmp_path), []

    def make():
        runs.append(1)
        return spark.range(100).withColumn("x", F.col("id") * 2)

    first, ran = P.stored(spark, root, "double", "v1", ["sha256:in"], make)
    assert ran and first.rows == 100 and first.digest == P.table_digest(make())[1]
    again, ran = P.stored(spark, root, "double", "v1", ["sha256:in"], make)
    assert not ran and again == first and len(runs) == 2
    other, ran = P.stored(spark, root, "double", "v2", ["sha256:in"], make)
    assert ran and other.digest == first.digest and other.folder != first.folder
    assert P.stored(spark, root, "double", "v1", ["sha256:else"], make)[1]
    assert P.proved(spark, first) == first


def test_a_failed_stage_leaves_no_record(spark, tmp_path):
    bad = spark.range(100).withColumn("x", F.when(F.col("id") == 99, F.raise_error("lost").cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        P.stored(spark, str(tmp_path), "s", "v", [], lambda: bad)
    out, ran = P.stored(spark, str(tmp_path), "s", "v", [], lambda: spark.range(3))
    assert ran and out.rows == 3


def test_changed_rows_stop_the_chain(spark, tmp_path):
    table, _ = P.stored(spark, str(tmp_path), "s", "v", [], lambda: spark.range(50))
    spark.range(1).write.mode("append").parquet(table.folder)
    with pytest.raises(P.Refused, match="other rows"):
        P.proved(spark, table)


def ports(spark, root, *, lie=None):
    """A builder that commits a release, a verifier that hashes it again, and its archive address."""
    bundle_of = lambda d: "sha256:" + hashlib.sha256(open(os.path.join(d, "bundle.json"), "rb").read()).hexdigest()

    def build(rows, verifier):
        tree_sink.write_release(rows, root, f'{{"verifier":"{verifier}"}}\n')
        return P.Built(rows.count(), root, bundle_of(root), "roots")

    def verify(directory, roots):
        n = tree_sink.release_digests(spark, directory).count()
        if lie == "late":
            tree_sink.write_release(spark.createDataFrame([("b", bytearray(b"2"))], "path string, content binary"), root, "{}\n")
            return P.Verified("sha256:" + hashlib.sha256(b'{"verifier":"v1"}\n').hexdigest(), "v1", n)
        return P.Verified("other" if lie == "bundle" else bundle_of(directory), "v2" if lie == "verifier" else "v1", n)

    return P.Preparation("v1", build, verify, lambda d: P.Delivery({"url": f"https://a.example/{bundle_of(d)}"}, bundle_of(d)))


def test_preparation_and_its_gates(spark, tmp_path):
    rows = spark.createDataFrame([("a", bytearray(b"1"))], "path string, content binary")
    out = ports(spark, str(tmp_path / "r"))(rows)
    assert out["built"] == 1 and out["verified"].result == 2 and out["url"].startswith("https://a.example/sha256:")
    for lie, what in (("bundle", "verifier"), ("verifier", "verifier"), ("late", "after")):
        with pytest.raises(P.Refused, match=what):
            ports(spark, str(tmp_path / lie), lie=lie)(rows)
    assert glob.glob(str(tmp_path / ".*")) == []
