"""Change sets, hash chains, positions and ownership of paths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealwright.functions.values import canonical, sha256

#: Fixed grammars of release paths.
SEGMENT = r"[a-z0-9][a-z0-9._-]*"
PATH = rf"\A{SEGMENT}(?:/{SEGMENT})*\z"
INTEGER_LIKE = r"\A(?:0|[1-9][0-9]*)\z"


def sealed(changes: DataFrame, columns: list[str], ascii_only: bool = False) -> DataFrame:
    """`changes` with change_id, the digest of the canonical form of `columns`."""
    kind = changes.select(*columns).schema
    return changes.withColumn("change_id", sha256(canonical(F.struct(*columns), kind, ascii_only)))


def unsealed(changes: DataFrame, columns: list[str]) -> DataFrame:
    """The changes whose change_id is not the digest of the rest."""
    return sealed(changes.withColumnRenamed("change_id", "given"), columns).where("not change_id <=> given").drop("given")


def latest(changes: DataFrame, subject: list[str], order: list[Column]) -> DataFrame:
    """The last change of each subject."""
    return changes.withColumn("n_", F.row_number().over(Window.partitionBy(*subject).orderBy(*order))).where("n_ = 1").drop("n_")


def repeated_subjects(changes: DataFrame, subject: list[str]) -> DataFrame:
    return changes.groupBy(*subject).agg(F.count("*").alias("n_changes")).where("n_changes > 1")


def diff_digest(changes: DataFrame, group: list[str], order: list[str], line: str) -> DataFrame:
    """Digest of each group's lines in order, every line ended by a line feed. Bounded by the size of a group's log."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line))), lambda x: F.concat(x[line], F.lit("\n"))), "")
    return changes.groupBy(*group).agg(sha256(joined).alias("digest"), F.count("*").alias("n_changes"))


def position_violations(rows: DataFrame, chain: str, sequence: str, first: int = 1) -> DataFrame:
    """(chain, sequence, check_ordinal, code): a chain starts at `first` and goes up by one."""
    before = F.lag(sequence).over(Window.partitionBy(chain).orderBy(sequence))
    code = F.when(before.isNull() & (F.col(sequence) != first), "genesis").when(before == F.col(sequence), "repeated").when(before + 1 != F.col(sequence), "gap")
    at = F.when(F.col("code") == "genesis", 1).when(F.col("code") == "repeated", 2).otherwise(3)
    return rows.select(chain, sequence, code.alias("code")).where("code is not null").withColumn("check_ordinal", at)


def by_chain(rows: DataFrame, chain: str, order: list[str]) -> DataFrame:
    """`rows` with each chain together in one partition and in order: a fold streams over them, and a long chain spills instead of filling a row."""
    return rows.repartition(chain).sortWithinPartitions(chain, *order)


def chain_heads(rows: DataFrame, chain: str, order: list[str], payload: str, seed: Column) -> DataFrame:
    """(chain, head, length): sha256(previous hash + ':' + payload) folded along each chain. A chain is one task, which keeps one hash of it."""
    kind = rows.select(chain).schema
    kind.add("head", "string").add("length", "long")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, length = None, "", 0
        types = None
        for batch in batches:
            types = batch.schema.field(0).type
            done: list[tuple] = []
            for key, text, first in zip(*(c.to_pylist() for c in batch.columns)):
                if not length or key != now:
                    if length:
                        done.append((now, head, length))
                    now, head, length = key, first, 0
                head = hashlib.sha256(f"{head}:{text or ''}".encode()).hexdigest()
                length += 1
            yield made(done, types)
        if length:
            yield made([(now, head, length)], types)

    def made(done: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        keys, heads, lengths = zip(*done) if done else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(heads, pa.string()), pa.array(lengths, pa.int64())], [chain, "head", "length"])

    ordered = by_chain(rows.select(*dict.fromkeys([chain, *order, payload]), seed.alias("seed_")), chain, [*order, payload])
    return ordered.select(chain, F.col(payload).cast("string"), "seed_").mapInArrow(fold, kind)


def canonical_path(c: Column) -> Column:
    return c.rlike(PATH) & ~c.rlike(INTEGER_LIKE)


def ancestors(c: Column) -> Column:
    """A path's proper ancestors: a/b/c has a and a/b."""
    parts = F.split(c, "/")
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i > 0), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def path_violations(paths: DataFrame) -> DataFrame:
    """(path, check_ordinal, code): grammar, repeated paths, and files that contain another path. Containment is an equi-join on exploded ancestors."""
    bad = paths.where(~canonical_path(F.col("path"))).select("path", F.lit(1).alias("check_ordinal"), F.lit("grammar").alias("code")).distinct()
    twice = paths.groupBy("path").count().where("count > 1").select("path", F.lit(2), F.lit("repeated"))
    above = paths.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    inside = paths.select("path").distinct().join(above, "path", "left_semi").select("path", F.lit(3), F.lit("contains"))
    return bad.union(twice).union(inside)


def owners(paths: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, owner) of each distinct path: the owner of the entry that equals it or is its nearest ancestor; null if there is none."""
    steps = paths.select("path").distinct().select("path", F.explode(F.concat(F.array("path"), ancestors(F.col("path")))).alias("entry"))
    found = steps.join(entries, "entry").groupBy("path").agg(F.max_by("owner", F.length("entry")).alias("owner"))
    # paths are as many as the input: Spark would broadcast them up to its threshold, through the driver
    return paths.select("path").distinct().join(found.hint("merge"), "path", "left")


def shared_names(claims: DataFrame) -> DataFrame:
    """Names that more than one owner claims."""
    return claims.groupBy("name").agg(F.countDistinct("owner").alias("n_owners")).where("n_owners > 1")


def set_differences(present: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """(key, code): undeclared files and missing ones."""
    both = present.select(key, F.lit(1).alias("p")).distinct().join(declared.select(key, F.lit(1).alias("d")).distinct(), key, "full")
    return both.where("p is null or d is null").select(key, F.when(F.col("d").isNull(), "undeclared").otherwise("missing").alias("code"))
