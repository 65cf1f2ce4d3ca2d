"""Corpus preparation in five stages; each is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealwright.llm import decontaminate, mixing, passages, quality, simhash
from sealwright.llm.common import materialize, read


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier does not reject."""
    scored, name = quality.scored(docs, quality.train(docs, read(spark, sf_dir, "labels")))
    return scored.where(F.col(name) >= 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id, which is the group's component_id.

    Rows without a doc_id stay. Rows that share a doc_id are judged by their own texts; of those in one group one stays.
    """
    groups = materialize(simhash.grouped(docs.where("doc_id is not null").select("doc_id", "text")), "near-duplicates")
    many = materialize(groups.groupBy("id").count().where("count > 1").select(F.col("id").alias("doc_id")), "repeated-ids")
    gone = groups.where("component_id <> id").select(F.col("id").alias("doc_id"))
    if not many.limit(1).count():
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    once = docs.join(many.union(gone), "doc_id", "left_anti").select(*docs.columns)
    # the whole row is one column, so that its names meet no others
    rows = docs.join(many, "doc_id", "left_semi").select("doc_id", F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    several = rows.withColumn("own", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    texts = several.groupBy("own").agg(F.min("text").alias("text"))
    prints = simhash.fingerprints(texts, "own").withColumnRenamed("id", "own")
    own = groups.where("component_id = id").select(F.col("id").alias("doc_id"), "fp", "root").distinct()
    # of the rows of an id in one group, the one with the least text, then the least row as JSON
    order = F.struct(F.coalesce("text", F.lit("")), F.to_json("row"))
    kept = several.join(prints, "own").join(own, ["doc_id", "fp"]).groupBy("doc_id", "root").agg(F.min_by("row", order).alias("row"))
    return once.unionByName(kept.select("row.*"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in one document only."""
    return passages.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without benchmark passages."""
    return decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources flattened as far as no source is read more than twice."""
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("passages", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: SQL cannot express a trained classifier; the operators of the stages are tested on their own, and the stages on planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
