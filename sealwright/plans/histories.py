"""Queries over what goes on from an earlier state: successors of projections, identities, stages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sealwright.operators import identity, preparation, projection
from sealwright.plans.catalogue import _CHANGES, _ROWS, MAX_SHARD_BYTES, _base, _changed, _leaves_sql, query
from sealwright.plans.rules import _MATCHES_SQL, TRANSITION, _matches
from sealwright.session import shared_folder, table, written


@query(
    f"""WITH {_ROWS}, {_leaves_sql('r')}, {_CHANGES}, t AS (SELECT DISTINCT 'data/' || leaf || '.jsonl' AS path FROM l JOIN c ON l.id = c.id),
k AS (SELECT i.path, (strpos('0123456789abcdef', substr(i.path, length(i.path) - 6, 1)) - 1) % 4 AS k, t.path IS NOT NULL AS touched FROM i LEFT JOIN t ON i.path = t.path)
SELECT path, 9 AS check_ordinal, 'digest' AS code FROM k WHERE touched AND k = 1
UNION ALL SELECT path, 10, 'counts' FROM k WHERE touched AND k = 2
UNION ALL SELECT path, 7, 'missing' FROM k WHERE touched AND k = 3
UNION ALL SELECT path, 6, 'not_affected' FROM k WHERE NOT touched AND k IN (0, 2)
UNION ALL SELECT 'data/none.jsonl', 6, 'not_affected' UNION ALL SELECT NULL, 0, 'sequence' UNION ALL SELECT DISTINCT id, 4, 'repeated_change' FROM c WHERE line IS NULL"""
)
def q62_successor_refusals(spark, sf_dir):
    """A successor whose manifest and prior files are wrong in three of four shards; deletions are given twice."""
    base, changed = written(_base(spark, sf_dir), "projection"), written(_changed(spark, sf_dir), "changes")
    k = F.expr("locate(substring(path, -7, 1), '0123456789abcdef') - 1") % 4
    entries = written(projection.inventory(base).withColumn("k", k), "inventory")
    touched = projection.affected(changed.select("id"), entries.select("path")).withColumn("touched", F.lit(True))
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n"), F.lit("\n"))
    files = base.groupBy("path").agg(text.cast("binary").alias("content")).withColumn("k", k).join(touched, "path", "left")
    given = files.where("touched and k <> 3 or touched is null and k in (0, 2)").select("path", "content")
    given = given.unionByName(spark.createDataFrame([("data/none.jsonl", bytearray(b""))], "path string, content binary"))
    wrong = entries.select("path", F.when(F.col("k") == 1, F.concat(F.substring("digest", 1, 70), F.lit("x"))).otherwise(F.col("digest")).alias("digest"), "bytes", F.when(F.col("k") == 2, F.col("rows") + 1).otherwise(F.col("rows")).alias("rows"))
    twice = changed.unionByName(changed.where("line is null"))
    return projection.successor_violations(wrong, given, twice, previous_sequence=7, next_sequence=7)


def _edges(spark, sf_dir, pairs):
    """Successions between the subjects of each group of eight documents."""
    groups = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.expr("doc_id div 8").alias("g")).distinct()
    rows = groups.select("g", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])).alias("e"))
    name = lambda c: F.concat(F.lit("s"), F.col("g").cast("string"), F.lit("_"), F.col(c).cast("string"))
    return rows.select("g", name("e.a").alias("a"), name("e.b").alias("b"))


@query(
    """WITH g AS (SELECT DISTINCT doc_id // 8 AS g FROM documents), p AS (SELECT unnest([0, 1, 2, 3, 5, 6]) AS p)
SELECT 'resolves' AS state, 's' || g || '_' || p AS subject, 's' || g || '_7' AS other FROM g, p
UNION ALL SELECT 'branch', 's' || g || '_8', 's' || g || '_' || unnest([7, 9]) FROM g
UNION ALL SELECT 'retired', 's' || g || '_' || unnest([0, 1, 2, 3, 5, 6, 8]), NULL FROM g"""
)
def q63_identity_extension(spark, sf_dir):
    """Chains that new successions lengthen at their end, at their start and through other chains, on top of a flat prior projection."""
    prior = _edges(spark, sf_dir, [(1, 3), (2, 3), (5, 6)])
    resolved = prior.select(F.col("a").alias("src"), F.col("b").alias("root"))
    branches = _edges(spark, sf_dir, [(8, 6), (8, 9)]).select(F.col("a").alias("original"), F.col("b").alias("child"))
    retired = resolved.select(F.col("src").alias("subject")).union(branches.select("original")).distinct()
    new = _edges(spark, sf_dir, [(3, 5), (6, 7), (0, 1)])
    none = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in TRANSITION.split(", ")}
    columns = none | {"kind": F.lit("succession"), "predecessor": F.col("a"), "successor": F.col("b"), "predecessor_retires": F.lit(True)}
    t = written(new.select(*[v.alias(c) for c, v in columns.items()]), "transitions")
    moved = identity.moves(resolved, t)
    out = identity.extended_resolutions(resolved, moved).select(F.lit("resolves").alias("state"), F.col("src").alias("subject"), F.col("root").alias("other"))
    out = out.union(identity.extended_branches(resolved, branches, moved, t).select(F.lit("branch"), "original", "child"))
    return out.union(identity.extended_retired(retired, t).select(F.lit("retired"), "subject", F.lit(None).cast("string")))


@query(
    """WITH d AS (SELECT DISTINCT doc_id AS i, doc_id % 9 AS k FROM documents),
c AS (SELECT * FROM (VALUES (1, 2, 'not_historical'), (1, 7, 'retired_not_historical'), (1, 9, 'original_not_historical'), (2, 3, 'target_not_current'), (2, 13, 'child_not_current'), (3, 4, 'source_current'), (3, 8, 'retired_current'),
 (4, 5, 'source_not_retired'), (5, 1, 'cycle'), (6, 6, 'self'), (6, 3, 'target_not_current'), (6, 14, 'continuation'), (7, 10, 'no_children'), (7, 14, 'continuation'), (8, 12, 'repeated_child')) AS t(k, check_ordinal, code))
SELECT 's' || i AS subject, check_ordinal, code FROM d JOIN c USING (k)"""
)
def q64_projection_closure(spark, sf_dir):
    """Every document is a subject that went on under another name; eight in nine are not closed over history and the current subjects."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i")).distinct().withColumn("k", F.col("i") % 9)
    d = d.select("k", F.concat(F.lit("s"), F.col("i").cast("string")).alias("s"), F.concat(F.lit("c"), F.col("i").cast("string")).alias("c"))
    historical = d.where("k <> 1").select(F.col("s").alias("id"))
    current = d.where("k <> 2").select(F.col("c").alias("id")).union(d.where("k = 3").select("s"))
    resolved = d.select(F.col("s").alias("src"), F.when(F.col("k") == 6, F.col("s")).when(F.col("k") != 5, F.col("c")).alias("root"))
    children = F.when(F.col("k") == 8, F.array("c", "c")).otherwise(F.array(F.when(F.col("k") != 7, F.col("c"))))
    return identity.projection_violations(resolved, d.select(F.col("s").alias("original"), F.explode(children).alias("child")), d.where("k <> 4").select(F.col("s").alias("subject")), historical, current)


@query(
    f"""WITH {_MATCHES_SQL}
SELECT DISTINCT key_digest, 5 AS check_ordinal, 'other_parent' AS code FROM m WHERE doc_id % 4 = 0 AND doc_id % 8 <> 0
UNION ALL SELECT DISTINCT key_digest, 4, 'other_candidate' FROM m WHERE doc_id % 12 = 3 AND doc_id % 24 <> 3"""
)
def q65_other_parents(spark, sf_dir):
    """The matches of all documents, of which half of the published ones were read at another parent."""
    keys, matches = _matches(spark, sf_dir)
    matches = matches.withColumn("parent_id", F.when(F.col("doc_id") % 8 == 0, "here").otherwise("there"))
    return identity.conflict_violations(keys, matches, {"kind": "submission", "candidate_reference": "mine", "candidate_digest": "digest"}, live_parent="here")


def _digest_sql(rows: str, line: str) -> str:
    part = lambda at: f"coalesce(sum(CAST('0x' || substr(sha256({line}), {at}, 15) AS HUGEINT)), 0)"
    return f"SELECT count(*) AS rows, 'sha256:' || sha256(count(*) || ',' || {part(1)} || ',' || {part(16)}) AS digest FROM {rows}"


@query(
    f"""WITH a AS ({_digest_sql('documents', '''concat('{"doc_id":', doc_id, ',"lang":', coalesce('"' || lang || '"', 'null'), ',"bytes":', octet_length(encode(text)), '}')''')}),
g AS (SELECT lang, count(*) AS n, CAST(sum(octet_length(encode(text))) AS BIGINT) AS b FROM documents GROUP BY lang), b AS ({_digest_sql('g', '''concat('{"lang":', coalesce('"' || lang || '"', 'null'), ',"n":', n, ',"bytes":', b, '}')''')})
SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, a.digest AS sizes, b.digest AS languages, false AS again FROM documents, a, b"""
)
def q66_prepared_stages(spark, sf_dir):
    """Two stages over the documents, the second on the first one's digest; each is proved, and neither runs a second time: the rows of the first with both digests."""
    root = f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"

    def chain():
        sizes = preparation.stored(spark, root, "sizes", "1", [], lambda: table(spark, sf_dir, "documents").select("doc_id", "lang", F.octet_length("text").cast("long").alias("bytes")))
        langs = preparation.stored(spark, root, "languages", "1", [sizes[0].digest], lambda: sizes[0].read(spark).groupBy("lang").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")))
        return {"sizes": sizes, "languages": langs}

    first, second = chain(), chain()
    proofs = {name: preparation.proved(spark, t).digest for name, (t, _) in first.items()}
    again = any(ran for _, ran in second.values()) or not all(ran for _, ran in first.values())
    rows = second["sizes"][0].read(spark).select("doc_id", "bytes")
    return rows.select("*", *[F.lit(d).alias(n) for n, d in proofs.items()], F.lit(again).alias("again"))
