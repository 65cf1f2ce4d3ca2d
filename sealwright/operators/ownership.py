"""Ownership of release paths: exclusive claims, overlaps among many of them, and the owner of a path.

An entry that ends in `/` claims a subtree, any other entry one file. Two entries overlap where one path could name, contain or be contained by the
other. Sorted by their segments, the entries below an entry follow it without a gap, so overlaps are nested intervals: one sweep over
range partitions keeps the stack of open entries, and what is open where a partition ends is carried over its edge. No path is exploded into its
ancestors, and no entry is compared with all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealwright.functions.values import IDENTIFIER
from sealwright.operators.changes import INTEGER_LIKE, ancestors, canonical_path
from sealwright.session import written

#: Fixed names of the files that every release has.
ENVELOPE = ("bundle.json", "manifest.json", "changes.ndjson", "release-diff.json", "release.json")
#: Sorts before every character of a path.
SEP = "\x01"


def entry_path(entry: Column) -> Column:
    return F.regexp_replace(entry, r"/\z", "")


def _below(path: str, top: str) -> bool:
    return path == top or path.startswith(top + SEP)


def overlaps(claims: DataFrame) -> DataFrame:
    """(owner, entry, within_owner, within_entry, n_containing) for each of `claims` (owner, entry) that lies inside another or equals it.

    within_* is the nearest claim around it; of equal paths, the claims that sort before it by (entry, owner) are around it. Repeated rows are claims
    of their own. Null entries are left out. Every overlapping pair is a row and one of the claims around it, so nothing is quadratic in the answer. A
    task keeps one entry with a count for each open path: no more than a path has segments, however often a claim is repeated. From
    each partition of the sort, the driver gathers what is open at its end.
    """
    rows = claims.where("entry is not null").select(F.replace(entry_path(F.col("entry")), F.lit("/"), F.lit(SEP)).alias("key"), "entry", F.coalesce(F.col("owner").cast("string"), F.lit("")).alias("owner"), F.col("owner").isNull().alias("none"))
    laid = rows.repartitionByRange("key", "entry", "owner", F.rand(0)).sortWithinPartitions("key", "entry", "owner", "none")
    kinds = [("part", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("key", pa.string()), ("entry", pa.string()), ("owner", pa.string()), ("none", pa.bool_()), ("w_entry", pa.string()), ("w_owner", pa.string()), ("w_none", pa.bool_())]
    names = [n for n, _ in kinds]

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), kinds)], names) if out else pa.RecordBatch.from_pylist([], pa.schema(kinds))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack, first = TaskContext.get().partitionId(), [], True  # stack: key, entry, owner, none, claims of this path, claims up to it
        for b in batches:
            out = []
            for key, entry, owner, none in zip(*[c.to_pylist() for c in b.columns]):
                while stack and not _below(key, stack[-1][0]):
                    stack.pop()
                if first:
                    out.append((part, 1, 0, key, entry, owner, none, None, None, None))
                    first = False
                top = stack[-1] if stack else (None, None, None, None, 0, 0)
                out.append((part, 0, top[5], key, entry, owner, none, *top[1:4]))
                again = stack.pop()[4] if top[0] == key else 0
                stack.append((key, entry, owner, none, again + 1, top[5] + 1))
            yield made(out)
        yield made([(part, 2, x[4], *x[:4], None, None, None) for x in stack])

    swept = written(laid.mapInArrow(sweep, "part long, kind int, n long, key string, entry string, owner string, none boolean, w_entry string, w_owner string, w_none boolean"), "claims")
    edges: dict[int, dict[int, list]] = {}
    for r in swept.where("kind > 0").select("part", "kind", "n", "key", "entry", "owner", "none").collect():
        edges.setdefault(r["part"], {1: [], 2: []})[r["kind"]].append((r["key"], r["entry"], r["owner"], r["none"], r["n"]))
    carried, open_ = [], []
    for part in sorted(edges):
        first = edges[part][1][0][0]
        open_ = [x for x in open_ if _below(first, x[0])]
        carried += [(part, *x) for x in open_]
        own = sorted(edges[part][2])  # a path sorts before those below it
        before = [x for x in open_ if _below(own[-1][0], x[0])]
        if before and before[-1][0] == own[0][0]:
            own[0] = (*own[0][:4], own[0][4] + before.pop()[4])
        open_ = before + own
    found = swept.where("kind = 0").drop("kind")
    if carried:
        spark = claims.sparkSession
        over = spark.createDataFrame(carried, "part long, c_key string, c_entry string, c_owner string, c_none boolean, c_n long")
        over = over.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("c_key", "c_entry", "c_owner", "c_none", "c_n"))).alias("around"))
        # what is open around the first path of each partition
        found = found.join(F.broadcast(over), "part", "left")
        mine = F.filter(F.coalesce("around", F.array()), lambda x: (F.col("key") == x["c_key"]) | F.startswith(F.col("key"), F.concat(x["c_key"], F.lit(SEP))))
        found = found.withColumn("around", mine).withColumn("top", F.try_element_at("around", F.lit(-1)))
        local = F.col("w_entry").isNotNull()
        more = F.aggregate("around", F.lit(0).cast("long"), lambda a, x: a + x["c_n"])
        found = found.select("entry", "owner", "none", (F.col("n") + more).alias("n"), *[F.when(local, F.col(f"w_{c}")).otherwise(F.col(f"top.c_{c}")).alias(f"w_{c}") for c in ("entry", "owner", "none")])
    named = lambda owner, none: F.when(~F.col(none), F.col(owner))
    return found.where("n > 0").select(named("owner", "none").alias("owner"), "entry", named("w_owner", "w_none").alias("within_owner"), F.col("w_entry").alias("within_entry"), F.col("n").alias("n_containing"))


def registry_faults(adapters: DataFrame, resources: DataFrame, subjects: DataFrame, objects: DataFrame) -> DataFrame:
    """(check_ordinal, code, adapter, name) of everything that keeps an instance's claims from being exclusive.

    adapters (adapter); resources and subjects (adapter, name); objects (adapter, entry). 1 adapter: grammar. 2 repeated_adapter. 3 resource: grammar, or like an integer.
    4 subject: grammar. 5 shared_resource and 6 shared_subject: claimed more than once, by one adapter too. 7 object: no canonical path, or one of the
    release's own files. 8 overlap: inside or equal to another claim (of the objects that pass 7). 9 unknown_adapter: a claim of none that is installed.
    """
    bad = lambda df, ordinal, code, name: df.select(F.lit(ordinal).alias("check_ordinal"), F.lit(code).alias("code"), F.col("adapter").cast("string").alias("adapter"), F.col(name).cast("string").alias("name"))
    no = lambda ok: ~F.coalesce(ok, F.lit(False))
    none = F.lit(None).cast("string")
    path = entry_path(F.col("entry"))
    good = F.coalesce(canonical_path(path) & ~path.isin(*ENVELOPE), F.lit(False))

    def shared(df: DataFrame, ordinal: int, code: str) -> DataFrame:
        many = df.groupBy("name").agg(F.count("*").alias("n"), F.min("adapter").alias("adapter")).where("n > 1 and name is not null")
        return bad(many, ordinal, code, "name")

    parts = [
        bad(adapters.where(no(F.col("adapter").rlike(IDENTIFIER))).withColumn("x_", none), 1, "adapter", "x_"),
        bad(adapters.groupBy("adapter").agg(F.count("*").alias("n")).where("n > 1").withColumn("x_", none), 2, "repeated_adapter", "x_"),
        bad(resources.where(no(F.col("name").rlike(IDENTIFIER) & ~F.col("name").rlike(INTEGER_LIKE))), 3, "resource", "name"),
        bad(subjects.where(no(F.col("name").rlike(IDENTIFIER))), 4, "subject", "name"),
        shared(resources, 5, "shared_resource"),
        shared(subjects, 6, "shared_subject"),
        bad(objects.where(~good), 7, "object", "entry"),
        bad(overlaps(objects.where(good).select(F.col("adapter").alias("owner"), "entry")).withColumnRenamed("owner", "adapter"), 8, "overlap", "entry"),
    ]
    claimed = resources.select("adapter").union(subjects.select("adapter")).union(objects.select("adapter")).distinct()
    parts.append(bad(claimed.join(adapters.select("adapter").distinct(), "adapter", "left_anti").withColumn("x_", none), 9, "unknown_adapter", "x_"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def owned(paths: DataFrame, objects: DataFrame) -> DataFrame:
    """(path, status, adapter) of each distinct path: `owned` by an exact file entry or a subtree around it, `no_owner`, or `not_canonical`.

    objects (adapter, entry) without overlaps. A path is looked up with its own ancestors, in one equi-join.
    """
    files = objects.where(~F.endswith("entry", F.lit("/"))).select(F.col("entry").alias("step"), F.lit(True).alias("whole"), "adapter")
    trees = objects.where(F.endswith("entry", F.lit("/"))).select(entry_path(F.col("entry")).alias("step"), F.lit(False).alias("whole"), "adapter")
    distinct = paths.select("path").distinct()
    good = F.coalesce(canonical_path(F.col("path")), F.lit(False))
    own = F.array(F.struct(F.col("path").alias("step"), F.lit(True).alias("whole")))
    above = F.transform(ancestors(F.col("path")), lambda s: F.struct(s.alias("step"), F.lit(False).alias("whole")))
    steps = distinct.where(good).select("path", F.inline(F.concat(own, above)))
    found = steps.join(files.unionByName(trees), ["step", "whole"]).groupBy("path").agg(F.min("adapter").alias("adapter"))
    status = F.when(~good, "not_canonical").when(F.col("adapter").isNull(), "no_owner").otherwise("owned")
    return distinct.join(found, "path", "left").select("path", status.alias("status"), "adapter")


def touched(paths: DataFrame, objects: DataFrame) -> DataFrame:
    """The distinct `paths` that an entry of `objects` equals, contains, or lies below."""
    distinct = paths.select("path").distinct().where("path is not null")
    claimed = objects.select(entry_path(F.col("entry")).alias("step")).where("step is not null").distinct()
    up = distinct.select("path", F.explode(F.concat(F.array("path"), ancestors(F.col("path")))).alias("step")).join(claimed, "step", "left_semi").select("path")
    down = claimed.select(F.explode(ancestors(F.col("step"))).alias("path")).distinct()
    return up.union(distinct.join(down, "path", "left_semi")).distinct()
