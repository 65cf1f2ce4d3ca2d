"""Queries over release trees: stored and read back, and the claims to their paths."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sealwright.operators import ownership, projection
from sealwright.plans.catalogue import _ROWS, MAX_SHARD_BYTES, _leaves_sql, query, record_rows
from sealwright.session import shared_folder, table, written
from sealwright.sources import tree_sink


@query(
    f"""WITH {_ROWS}, {_leaves_sql('r')}, f AS (SELECT path, bytes, digest AS sha256, rows FROM i),
b AS (SELECT '{{"files":{{' || string_agg('"' || path || '":{{"bytes":' || bytes || ',"sha256":"' || sha256 || '"}}', ',' ORDER BY path) || '}}}}' || chr(10) AS t FROM f)
SELECT path, bytes, sha256, CAST(rows AS BIGINT) AS rows FROM f UNION ALL SELECT 'bundle.json', CAST(octet_length(encode(t)) AS BIGINT), 'sha256:' || sha256(t), 1 FROM b WHERE t IS NOT NULL"""
)
def q58_release_tree(spark, sf_dir):
    """The shards of the projection, committed as a release tree with a bundle of their declarations, and read back from there."""
    rows = projection.placed(record_rows(spark, sf_dir), MAX_SHARD_BYTES)
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n"), F.lit("\n"))
    files = written(rows.groupBy("path").agg(text.cast("binary").alias("content")), "release-files")
    entry = F.concat(F.lit('"'), "path", F.lit('":{"bytes":'), F.octet_length("content").cast("string"), F.lit(',"sha256":"sha256:'), F.sha2("content", 256), F.lit('"}'))
    # one row a shard, of which there are 65536 at most
    bundle = files.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", entry.alias("e")))), lambda x: x["e"]), ",").alias("b")).first()["b"]
    root = f"{shared_folder(spark)}/release-{uuid.uuid4().hex}"
    tree_sink.write_release(files, root, f'{{"files":{{{bundle}}}}}\n', maxFiles=65536)
    lines = tree_sink.read_release(spark, root).groupBy("path").agg(F.sum(F.regexp_count(F.col("content").cast("string"), F.lit("\n"))).cast("long").alias("rows"))
    return tree_sink.release_digests(spark, root).join(lines, "path").select("path", "bytes", "sha256", "rows")


_CLAIMS = r"""c0 AS (SELECT page_id, CAST(page_id % 7 AS VARCHAR) AS owner, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS entry FROM pages),
c AS (SELECT *, regexp_replace(entry, '/$', '') AS path, row_number() OVER (ORDER BY replace(regexp_replace(entry, '/$', ''), '/', chr(1)), entry, owner, page_id) AS k FROM c0)"""


@query(
    rf"""WITH {_CLAIMS}, s AS (SELECT k, path, string_split(path, '/') AS p FROM c),
up AS (SELECT k, array_to_string(p[1:i], '/') AS path FROM (SELECT k, p, unnest(range(1, len(p))) AS i FROM s)),
around AS (SELECT up.k, b.k AS bk, b.path, b.entry, b.owner FROM up JOIN c b USING (path) UNION ALL SELECT a.k, b.k, b.path, b.entry, b.owner FROM c a JOIN c b ON a.path = b.path AND b.k < a.k),
n AS (SELECT k, count(*) AS n_containing, arg_max(entry, length(path) * 1000000000 + bk) AS within_entry, arg_max(owner, length(path) * 1000000000 + bk) AS within_owner FROM around GROUP BY k)
SELECT owner, entry, within_owner, within_entry, n_containing FROM n JOIN c USING (k)"""
)
def q59_overlapping_claims(spark, sf_dir):
    """Every page's address as a claim of one of seven owners: those that lie in another claim."""
    pages = table(spark, sf_dir, "pages")
    entry = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return ownership.overlaps(pages.select((F.col("page_id") % 7).cast("string").alias("owner"), entry.alias("entry")))


@query(
    """WITH d AS (SELECT DISTINCT lang, source FROM documents), r AS (SELECT lang AS adapter, source AS name FROM d),
s AS (SELECT lang AS adapter, upper(source) AS name FROM d),
o AS (SELECT DISTINCT lang AS adapter, lang || '/' || source || '/' AS entry FROM documents UNION ALL SELECT DISTINCT lang, lang || '/' || source || '/' || (doc_id % 10) FROM documents UNION ALL SELECT DISTINCT lang, 'release.json' FROM documents)
SELECT 2 AS check_ordinal, 'repeated_adapter' AS code, lang AS adapter, CAST(NULL AS VARCHAR) AS name FROM (SELECT DISTINCT lang, doc_id % 2 FROM documents WHERE lang IS NOT NULL) GROUP BY lang HAVING count(*) > 1
UNION ALL SELECT 4, 'subject', adapter, name FROM s
UNION ALL SELECT 5, 'shared_resource', min(adapter), name FROM r GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 6, 'shared_subject', min(adapter), name FROM s GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 7, 'object', adapter, entry FROM o WHERE entry = 'release.json'
UNION ALL SELECT 8, 'overlap', adapter, entry FROM o WHERE regexp_matches(entry, '/[0-9]$')"""
)
def q60_registry_faults(spark, sf_dir):
    """Languages as adapters, twice each, that claim sources as resources, subjects and subtrees, and files inside their own subtrees."""
    docs = table(spark, sf_dir, "documents")
    adapters = docs.where("lang is not null").select(F.col("lang").alias("adapter"), F.col("doc_id") % 2).distinct().select("adapter")
    both = docs.select(F.col("lang").alias("adapter"), F.col("source").alias("name")).distinct()
    tree = F.concat("lang", F.lit("/"), "source", F.lit("/"))
    objects = docs.select("lang", tree.alias("entry")).union(docs.select("lang", F.concat(tree, (F.col("doc_id") % 10).cast("string")))).union(docs.select("lang", F.lit("release.json"))).distinct()
    return ownership.registry_faults(adapters, both, both.withColumn("name", F.upper("name")), objects.withColumnRenamed("lang", "adapter"))


@query(
    r"""WITH d AS (SELECT DISTINCT lang, source FROM documents), p AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages),
g AS (SELECT path, regexp_matches(path, '^[a-z0-9][a-z0-9._-]*(/[a-z0-9][a-z0-9._-]*)*$') AS good, string_split(path, '/') AS s FROM p),
o AS (SELECT DISTINCT string_split(path, '/')[1] || '/' || string_split(path, '/')[2] AS step FROM g WHERE good AND len(s) > 2 AND length(path) % 2 = 0)
SELECT path, CASE WHEN NOT good THEN 'not_canonical' WHEN step IS NULL THEN 'no_owner' ELSE 'owned' END AS status, CASE WHEN good AND step IS NOT NULL THEN 'site' END AS adapter
FROM g LEFT JOIN o ON len(s) > 2 AND s[1] || '/' || s[2] = step"""
)
def q61_owned_paths(spark, sf_dir):
    """Page addresses as paths, owned by the subtrees of the second level that half of the addresses lie in."""
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    paths = table(spark, sf_dir, "pages").select(path.alias("path")).distinct()
    step = F.split("path", "/")
    trees = paths.where(ownership.canonical_path(F.col("path")) & (F.size(step) > 2) & (F.length("path") % 2 == 0)).select(F.lit("site").alias("adapter"), F.concat(step[0], F.lit("/"), step[1], F.lit("/")).alias("entry")).distinct()
    return ownership.owned(paths, trees)
