"""Query catalogue: name -> DataFrame program, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealwright.functions import values as V
from sealwright.operators import authority, changes, envelope, identity, projection
from sealwright.session import table, written
from sealwright.sources import release

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MAX_SHARD_BYTES = 16_384


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# -- projections -----------------------------------------------------------------------------------------------------

RECORD = T.StructType([T.StructField("id", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("source", T.StringType()), T.StructField("text_digest", T.StringType())])


def record_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, line, doc_id): documents as canonical lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), "lang", "n_chars", "source", V.sha256(F.col("text")).alias("text_digest"))
    return docs.select("doc_id", "id", V.canonical(F.struct(*RECORD.fieldNames()), RECORD, ascii_only=True).alias("line"))


_ROWS = """r AS (SELECT doc_id, 'doc_' || doc_id AS id, '{"id":"doc_' || doc_id || '","lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '","text_digest":"sha256:' || sha256(text) || '"}' AS line FROM documents)"""


def _leaves_sql(rows: str, tag: str = "") -> str:
    return f"""h{tag} AS (SELECT *, sha256(id) AS h, octet_length(encode(line)) + 1 AS b FROM {rows}),
d{tag} AS (SELECT h{tag}.*, substr(h, 1, k) AS p, k FROM h{tag}, (SELECT unnest([1, 2, 3, 4]) AS k)),
s{tag} AS (SELECT p, sum(b) AS s FROM d{tag} GROUP BY p),
l{tag} AS (SELECT id, line, min(k) AS depth, arg_min(p, k) AS leaf FROM d{tag} JOIN s{tag} USING (p) WHERE s <= {MAX_SHARD_BYTES} OR k = 4 GROUP BY id, line),
i{tag} AS (SELECT 'data/' || leaf || '.jsonl' AS path, 'sha256:' || sha256(string_agg(line, chr(10) ORDER BY id) || chr(10)) AS digest, CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS bytes, count(*) AS rows FROM l{tag} GROUP BY leaf)"""


@query(f"WITH {_ROWS}, {_leaves_sql('r')} SELECT path, digest, bytes, rows FROM i")
def q01_shard_inventory(spark, sf_dir):
    return projection.shards(record_rows(spark, sf_dir), MAX_SHARD_BYTES)


@query(f"WITH {_ROWS}, {_leaves_sql('r')} SELECT id, 'data/' || leaf || '.jsonl' AS path, CAST(depth AS INTEGER) AS depth FROM l")
def q02_shard_split(spark, sf_dir):
    placed = projection.placed(record_rows(spark, sf_dir), MAX_SHARD_BYTES)
    return placed.select("id", "path", (F.length("path") - len("data/.jsonl")).cast("int").alias("depth"))


@query(
    f"""WITH {_ROWS}, {_leaves_sql('r')},
m AS (SELECT path, digest, bytes, rows FROM i UNION ALL SELECT 'data/' || substr(h, 1, 3) || '.jsonl', 'none', 0, 0 FROM h WHERE doc_id < 3),
x AS (SELECT *, regexp_extract(path, 'data/([0-9a-f]+)', 1) AS p FROM m)
SELECT 2 AS check_ordinal, 'digest' AS code, path FROM m WHERE digest = 'none'
UNION ALL SELECT 3, 'count', path FROM m WHERE rows < 1
UNION ALL SELECT 5, 'duplicate', path FROM m GROUP BY path HAVING count(*) > 1
UNION ALL SELECT DISTINCT 6, 'overlap', a.path FROM x a JOIN x b ON length(b.p) < length(a.p) AND starts_with(a.p, b.p)"""
)
def q03_snapshot_closure(spark, sf_dir):
    """The inventory with three broken entries."""
    rows = record_rows(spark, sf_dir)
    broken = rows.where("doc_id < 3").select(F.concat(F.lit("data/"), F.substring(F.sha2("id", 256), 1, 3), F.lit(".jsonl")).alias("path"), F.lit("none").alias("digest"), F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("rows"))
    return projection.closure_violations(projection.shards(rows, MAX_SHARD_BYTES).unionByName(broken), MAX_SHARD_BYTES)


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.placed(record_rows(spark, sf_dir), MAX_SHARD_BYTES).select("id", "line", "path")


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as changes: toxic documents are deleted, documents of low quality get a longer line."""
    labels = table(spark, sf_dir, "labels").where("quality = 0 or toxic = 1").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = record_rows(spark, sf_dir).join(labels, "doc_id")
    return rows.select("id", F.when(F.col("toxic") == 0, F.concat(F.substring("line", F.lit(1), F.length("line") - 1), F.lit(',"withheld":true}'))).alias("line"))


_CHANGES = "c AS (SELECT r.id, CASE WHEN toxic = 0 THEN substr(line, 1, length(line) - 1) || ',\"withheld\":true}' END AS line FROM r JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels WHERE quality = 0 OR toxic = 1 GROUP BY doc_id) USING (doc_id))"


@query(f"WITH {_ROWS}, {_leaves_sql('r')}, {_CHANGES} SELECT DISTINCT 'data/' || leaf || '.jsonl' AS path FROM l JOIN c ON l.id = c.id")
def q04_affected_shards(spark, sf_dir):
    return projection.affected(_changed(spark, sf_dir).select("id"), _base(spark, sf_dir).select("path").distinct())


@query(
    f"""WITH {_ROWS}, {_leaves_sql('r')}, {_CHANGES},
t AS (SELECT DISTINCT leaf FROM l JOIN c ON l.id = c.id),
n AS (SELECT l.id, l.leaf, l.depth, CASE WHEN c.id IS NULL THEN l.line ELSE c.line END AS line FROM l LEFT JOIN c ON l.id = c.id WHERE leaf IN (SELECT leaf FROM t)),
n1 AS (SELECT *, sha256(id) AS h, octet_length(encode(line)) + 1 AS b FROM n WHERE line IS NOT NULL),
nd AS (SELECT n1.*, substr(h, 1, k) AS p, k FROM n1, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE k >= depth),
ns AS (SELECT p, sum(b) AS s FROM nd GROUP BY p),
nl AS (SELECT id, line, arg_min(p, k) AS leaf FROM nd JOIN ns USING (p) WHERE s <= {MAX_SHARD_BYTES} OR k = 4 GROUP BY id, line),
ni AS (SELECT 'data/' || leaf || '.jsonl' AS path, 'sha256:' || sha256(string_agg(line, chr(10) ORDER BY id) || chr(10)) AS digest, CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS bytes, count(*) AS rows FROM nl GROUP BY leaf)
SELECT coalesce(i.path, ni.path) AS path, CASE WHEN ni.path IS NULL AND 'data/' || t.leaf || '.jsonl' = i.path THEN 'delete' WHEN ni.path IS NULL OR ni.digest = i.digest THEN 'carry' ELSE 'write' END AS action,
       coalesce(ni.digest, i.digest) AS digest, coalesce(ni.bytes, i.bytes) AS bytes, coalesce(ni.rows, i.rows) AS rows
FROM i FULL JOIN ni ON i.path = ni.path LEFT JOIN t ON 'data/' || t.leaf || '.jsonl' = coalesce(i.path, ni.path)"""
)
def q05_successor_inventory(spark, sf_dir):
    base, changed = written(_base(spark, sf_dir), "projection"), written(_changed(spark, sf_dir), "changes")
    before = written(projection.inventory(base), "inventory")
    leaves = before.select("path")
    after = projection.inventory(projection.successor(base, leaves, changed, MAX_SHARD_BYTES))
    return projection.inventory_changes(before, after, projection.affected(changed.select("id"), leaves))


# -- digests and change sets -----------------------------------------------------------------------------------------


def _esc(x: str) -> str:
    short = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}
    x = f"replace(replace({x}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34))"
    for code in range(1, 32):
        x = f"replace({x}, chr({code}), chr(92) || '{short.get(code, f'u{code:04x}')}')"
    return f"(chr(34) || {x} || chr(34))"


CONTENT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("text", T.StringType())])


@query(f"""SELECT doc_id, 'sha256:' || sha256(text) AS text_digest, 'sha256:' || sha256('{{"lang":"' || lang || '","text":' || {_esc('nfc_normalize(text)')} || '}}') AS digest FROM documents""")
def q06_content_digest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", V.sha256(F.col("text")).alias("text_digest"), V.digest(F.struct("lang", "text"), CONTENT).alias("digest"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("subject_id"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return changes.sealed(e, ["event_id", "kind", "subject_id"], ascii_only=True)


_EVENTS = """e AS (SELECT event_id, event_type AS kind, 'user_' || user_id AS subject_id, strftime(ts, '%Y-%m-%d') AS day,
'sha256:' || sha256('{"event_id":' || event_id || ',"kind":"' || event_type || '","subject_id":"user_' || user_id || '"}') AS change_id FROM events)"""


@query(f"WITH {_EVENTS} SELECT event_id, change_id FROM e")
def q07_change_seal(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", "change_id")


@query(f"WITH {_EVENTS} SELECT subject_id, kind, change_id FROM e QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY event_id DESC) = 1")
def q08_change_order(spark, sf_dir):
    return changes.latest(_events(spark, sf_dir), ["subject_id"], [F.desc("event_id")]).select("subject_id", "kind", "change_id")


@query(f"WITH {_EVENTS} SELECT day, subject_id, 'sha256:' || sha256(string_agg(change_id || chr(10), '' ORDER BY kind, change_id)) AS digest, count(*) AS n_changes FROM e GROUP BY day, subject_id")
def q09_diff_digest_by_day(spark, sf_dir):
    return changes.diff_digest(_events(spark, sf_dir), ["day", "subject_id"], ["kind"], "change_id")


@query(
    """WITH RECURSIVE o AS (SELECT conv_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, count(*) OVER (PARTITION BY conv_id) AS k FROM conversations),
f AS (SELECT conv_id, n, k, sha256(sha256('genesis') || ':' || text) AS head FROM o WHERE n = 1
      UNION ALL SELECT o.conv_id, o.n, o.k, sha256(f.head || ':' || o.text) FROM f JOIN o ON o.conv_id = f.conv_id AND o.n = f.n + 1)
SELECT conv_id, head, k AS length FROM f WHERE n = k"""
)
def q11_hash_chain(spark, sf_dir):
    return changes.chain_heads(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role"], "text", F.sha2(F.lit("genesis"), 256))


# -- identities and references ---------------------------------------------------------------------------------------


@query("WITH g AS (SELECT sha256(text) AS d, min(doc_id) AS survivor, count(*) AS n FROM documents GROUP BY 1) SELECT doc_id, survivor, n AS n_members FROM documents JOIN g ON sha256(text) = d WHERE n > 1")
def q12_identity_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("d"))
    groups = docs.groupBy("d").agg(F.min("doc_id").alias("survivor"), F.count("*").alias("n_members")).where("n_members > 1")
    return docs.join(groups, "d").select("doc_id", "survivor", "n_members")


@query("SELECT doc_id AS src, min(doc_id) OVER w AS root, row_number() OVER (w ORDER BY doc_id) - 1 AS steps FROM documents WINDOW w AS (PARTITION BY sha256(text)) QUALIFY row_number() OVER (w ORDER BY doc_id) > 1")
def q13_identity_closure(spark, sf_dir):
    """Each copy resolves to the copy before it; the closure resolves it to the first."""
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("d"))
    edges = docs.select(F.col("doc_id").alias("src"), F.lag("doc_id").over(Window.partitionBy("d").orderBy("doc_id")).alias("dst")).where("dst is not null")
    return identity.closure(edges)


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        F.lit("one").alias("source_instance"),
        F.concat(F.lit("src"), (i % 20).cast("string")).alias("source_subject"),
        F.when(i % 13 == 0, "two").otherwise("one").alias("instance_id"),
        F.lit("document").alias("kind"),
        F.concat(F.lit("doc_"), F.when(i % 7 == 0, i + 1_000_000_000).otherwise(i).cast("string")).alias("id"),
        F.when(i % 5 == 0, "exact_revision").otherwise("current").alias("mode"),
        F.when(i % 5 == 0, F.when(i % 10 == 0, F.lit("old"))).alias("revision_digest"),
        (i % 2 == 0).alias("required"),
        F.when(F.col("quality") == 1, F.array(F.lit("public"), F.lit("members"))).otherwise(F.array(F.lit("public"))).alias("allowed_visibility"),
        (i % 11 == 0).alias("same_subject"),
    )


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("revision")).join(labels, "doc_id", "left")
    return docs.select(F.lit("one").alias("instance_id"), F.lit("document").alias("kind"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("subject_id"), "revision", F.when(F.col("toxic") == 1, "members").otherwise("public").alias("visibility"))


_REFS = """r AS (SELECT doc_id, 'src' || doc_id % 20 AS source_subject, CASE WHEN doc_id % 13 = 0 THEN 'two' ELSE 'one' END AS instance_id, 'doc_' || CASE WHEN doc_id % 7 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS id,
 doc_id % 5 = 0 AS exact, CASE WHEN doc_id % 10 = 0 THEN 'old' END AS rev, doc_id % 2 = 0 AS required, CASE WHEN quality = 1 THEN ['public', 'members'] ELSE ['public'] END AS allowed, doc_id % 11 = 0 AS same FROM labels),
t AS (SELECT 'one' AS instance_id, 'doc_' || d.doc_id AS id, d.source AS subject_id, sha256(text) AS revision, CASE WHEN toxic = 1 THEN 'members' ELSE 'public' END AS visibility, true AS found
      FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) x USING (doc_id)),
s AS (SELECT r.*, revision, CASE WHEN r.instance_id <> 'one' THEN 'other_instance' WHEN found IS NULL AND required THEN 'missing_required' WHEN found IS NULL THEN 'missing_optional' WHEN NOT list_contains(allowed, visibility) THEN 'visibility'
 WHEN same AND subject_id <> source_subject THEN 'other_subject' WHEN exact AND revision IS DISTINCT FROM rev THEN 'revision' ELSE 'resolved' END AS status FROM r LEFT JOIN t ON r.instance_id = t.instance_id AND r.id = t.id)"""


@query(f"""WITH {_REFS} SELECT doc_id, status, 'sha256:' || sha256('{{"id":"' || id || '","instanceId":"' || instance_id || '","kind":"document"}}') AS dependency_key FROM s""")
def q15_reference_resolution(spark, sf_dir):
    out = identity.resolved_references(_references(spark, sf_dir), _targets(spark, sf_dir))
    return out.select("doc_id", "status", identity.dependency_key(spark).alias("dependency_key"))


@query(
    f"""WITH {_REFS}, c AS (SELECT id, CASE WHEN visibility = 'public' THEN revision END AS cur FROM t WHERE substr(id, -1) IN ('0', '4', '5'))
SELECT doc_id, status AS prior_status FROM s JOIN c USING (id) WHERE instance_id = 'one' AND status IN ('resolved', 'missing_optional', 'revision')
AND CASE WHEN status = 'missing_optional' THEN cur IS NOT NULL ELSE NOT exact OR cur IS DISTINCT FROM rev END"""
)
def q16_reference_revalidation(spark, sf_dir):
    targets = _targets(spark, sf_dir)
    prior = identity.resolved_references(_references(spark, sf_dir), targets).where("status in ('resolved', 'missing_optional', 'revision')")
    changed = targets.where("right(id, 1) in ('0', '4', '5')").select("instance_id", "kind", "id", F.when(F.col("visibility") == "public", F.col("revision")).alias("current_revision"))
    refs = prior.select("doc_id", "instance_id", "kind", "id", "mode", "revision_digest", F.col("status").alias("prior_status"))
    return identity.to_revalidate(refs, changed).select("doc_id", "prior_status")


# -- authority -------------------------------------------------------------------------------------------------------

_KEYS = """VALUES ('key-a', 'O', NULL, TIMESTAMP '1996-01-01 00:00:00', NULL), ('key-b', 'O', TIMESTAMP '1996-01-01 00:00:00', TIMESTAMP '1998-06-01 00:00:00', 100000),
('key-c', 'O', TIMESTAMP '1998-03-01 00:00:00', NULL, NULL), ('key-d', 'F', TIMESTAMP '1995-06-01 00:00:00', NULL, 120000), ('key-e', 'F', NULL, TIMESTAMP '1995-06-01 00:00:00', NULL)"""


@query(
    f"""WITH k AS (SELECT * FROM ({_KEYS}) AS t(key_id, purpose, valid_from, valid_until, bad_from)),
j AS (SELECT o_orderkey, key_id FROM orders LEFT JOIN k ON o_orderstatus = purpose AND (valid_from IS NULL OR valid_from <= o_orderdate) AND (valid_until IS NULL OR o_orderdate < valid_until) AND NOT (bad_from IS NOT NULL AND o_orderkey >= bad_from))
SELECT o_orderkey, count(key_id) AS n_active, CASE WHEN count(key_id) = 1 THEN min(key_id) END AS key_id FROM j GROUP BY o_orderkey"""
)
def q17_active_key_range_join(spark, sf_dir):
    keys = spark.sql(f"SELECT * FROM ({_KEYS.replace('TIMESTAMP', 'TIMESTAMP_NTZ')}) AS t(key_id, purpose, valid_from, valid_until, compromised_after_sequence)")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    out = authority.active_keys(orders, keys, F.col("o_orderdate"), F.col("o_orderstatus"), F.col("o_orderkey"))
    return out.select("o_orderkey", "n_active", "key_id")


@query("SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_signers FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0 GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 3")
def q18_threshold_signers(spark, sf_dir):
    roots = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return authority.reached(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), "l_orderkey", "l_suppkey", roots, 3)


@query(
    """WITH s AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P'), p AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag <> 'R'),
a AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS p FROM lineitem WHERE l_linestatus = 'O' AND l_linenumber < 3)
SELECT DISTINCT CAST(s AS VARCHAR) AS id, 1 AS check_ordinal, 'no_start' AS code FROM a WHERE s NOT IN (SELECT id FROM s)
UNION ALL SELECT DISTINCT CAST(p AS VARCHAR), 2, 'no_attempt' FROM a WHERE p NOT IN (SELECT id FROM p)
UNION ALL SELECT CAST(s AS VARCHAR), 3, 'two_attempts' FROM a GROUP BY s HAVING count(DISTINCT p) > 1
UNION ALL SELECT CAST(id AS VARCHAR), 4, 'unproved_start' FROM s WHERE id NOT IN (SELECT s FROM a)
UNION ALL SELECT CAST(id AS VARCHAR), 5, 'unproved_attempt' FROM p WHERE id NOT IN (SELECT p FROM a)"""
)
def q20_attested_closure(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    starts = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("start_id"))
    attempts = lines.where("l_returnflag <> 'R'").select(F.col("l_partkey").alias("attempt_id")).distinct()
    attestations = lines.where("l_linestatus = 'O' and l_linenumber < 3").select(F.col("l_orderkey").alias("start_id"), F.col("l_partkey").alias("attempt_id"))
    return authority.attestation_violations(starts, attempts, attestations)


# -- paths, URLs and texts -------------------------------------------------------------------------------------------


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_extract(url, r"^https?://(.*)$", 1), r"/+$", "").alias("path"))


_PATHS = "p AS (SELECT page_id, regexp_replace(regexp_extract(url, '^https?://(.*)$', 1), '/+$', '') AS path FROM pages)"


@query(
    f"""WITH {_PATHS}, a AS (SELECT path, string_split(path, '/') AS s FROM p),
u AS (SELECT DISTINCT array_to_string(s[1:k], '/') AS path FROM (SELECT s, unnest(range(1, len(s))) AS k FROM a))
SELECT DISTINCT path, 1 AS check_ordinal, 'grammar' AS code FROM p WHERE NOT regexp_full_match(path, '[a-z0-9][a-z0-9._-]*(/[a-z0-9][a-z0-9._-]*)*') OR regexp_full_match(path, '0|[1-9][0-9]*')
UNION ALL SELECT path, 2, 'repeated' FROM p GROUP BY path HAVING count(*) > 1
UNION ALL SELECT DISTINCT path, 3, 'contains' FROM p WHERE path IN (SELECT path FROM u)"""
)
def q21_path_grammar(spark, sf_dir):
    return changes.path_violations(_paths(spark, sf_dir).select("path"))


@query(
    f"""WITH {_PATHS}, e AS (SELECT DISTINCT regexp_extract(path, '^([^/]+/[^/]+)', 1) AS entry, 'section' AS owner FROM p WHERE path LIKE '%/en/%' UNION ALL SELECT DISTINCT regexp_extract(path, '^([^/]+)', 1), 'host' FROM p WHERE path LIKE '%.com/%'),
d AS (SELECT DISTINCT path FROM p)
SELECT d.path, arg_max(owner, length(entry)) AS owner FROM d LEFT JOIN e ON d.path = entry OR starts_with(d.path, entry || '/') GROUP BY d.path"""
)
def q22_ownership_lookup(spark, sf_dir):
    paths = _paths(spark, sf_dir).select("path")
    sections = paths.where("path like '%/en/%'").select(F.regexp_extract("path", r"^([^/]+/[^/]+)", 1).alias("entry"), F.lit("section").alias("owner")).distinct()
    hosts = paths.where("path like '%.com/%'").select(F.regexp_extract("path", r"^([^/]+)", 1).alias("entry"), F.lit("host").alias("owner")).distinct()
    return changes.owners(paths, sections.unionByName(hosts))


@query("SELECT page_id, NOT regexp_matches(url, '#.') AS plain, starts_with(url, 'https://') AS secure, regexp_extract(url, '^([^#]*)', 1) AS target FROM pages")
def q24_plain_url(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", V.plain_url(url).alias("plain"), url.startswith("https://").alias("secure"), F.regexp_extract(url, r"^([^#]*)", 1).alias("target"))


_SP = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_LINES = r"regexp_replace(nfc_normalize(regexp_replace(text, '\r\n?', chr(10), 'g')), '(?m)[ \t]+$', '', 'g')"


@query(rf"WITH n AS (SELECT doc_id, regexp_replace(regexp_replace({_LINES}, '^{_SP}+', ''), '{_SP}+$', '') AS t FROM documents) SELECT doc_id, CASE WHEN t <> '' THEN 'sha256:' || sha256(t || chr(10)) END AS digest, length(t) AS n_chars FROM n")
def q25_normalize_text(spark, sf_dir):
    out = table(spark, sf_dir, "documents").select("doc_id", V.normal_text(F.col("text")).alias("t"))
    return out.select("doc_id", V.sha256(F.col("t")).alias("digest"), F.coalesce(F.length("t") - 1, F.lit(0)).cast("long").alias("n_chars"))


@query(
    """WITH i AS (SELECT event_id, CAST(event_id % 5 AS INTEGER) - 2 AS o, ts FROM events)
SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds, rtrim(lpad(CAST(CAST(epoch_us(ts) % 1000000 AS BIGINT) AS VARCHAR), 6, '0') || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0'), '0') AS fraction FROM i"""
)
def q26_instant_order(spark, sf_dir):
    """Event times as texts with nine digits and five offsets; the key restores one order."""
    hours = (F.col("event_id") % 5 - 2).cast("int")
    local = F.col("ts") + F.make_dt_interval(F.lit(0), hours, F.lit(0), F.lit(0))
    sign = F.when(hours < 0, "-").otherwise("+")
    offset = F.concat(sign, F.lpad(F.abs(hours).cast("string"), 2, "0"), F.lit(":00"))
    text = F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), offset)
    keyed = table(spark, sf_dir, "events").select("event_id", V.instant_key(text).alias("k"))
    return keyed.select("event_id", F.col("k.s").alias("seconds"), F.col("k.f").alias("fraction"))


@query(
    """WITH h AS (SELECT doc_id, sha256('{"operation_contract":"document.read/v1","value":{"doc_id":' || doc_id || '}}') AS h FROM documents),
b AS (SELECT doc_id, '00' || string_agg(lpad(format('{:b}', strpos('0123456789abcdef', substr(h, i, 1)) - 1), 4, '0'), '' ORDER BY i) AS b FROM (SELECT doc_id, h, unnest(range(1, 33)) AS i FROM h) GROUP BY doc_id),
c AS (SELECT doc_id, j, 16 * CAST(substr(b, 5 * j + 1, 1) AS INT) + 8 * CAST(substr(b, 5 * j + 2, 1) AS INT) + 4 * CAST(substr(b, 5 * j + 3, 1) AS INT) + 2 * CAST(substr(b, 5 * j + 4, 1) AS INT) + CAST(substr(b, 5 * j + 5, 1) AS INT) AS v FROM (SELECT doc_id, b, unnest(range(0, 26)) AS j FROM b))
SELECT doc_id, 'op_' || string_agg(substr('0123456789abcdefghjkmnpqrstvwxyz', v + 1, 1), '' ORDER BY j) AS operation_id FROM c GROUP BY doc_id"""
)
def q27_operation_id(spark, sf_dir):
    value = V.canonical(F.struct("doc_id"), T.StructType([T.StructField("doc_id", T.LongType())]))
    return table(spark, sf_dir, "documents").select("doc_id", V.operation_id("document.read/v1", value).alias("operation_id"))


@query(
    """WITH x AS (SELECT event_id, ts, ts + (event_id % 7 - 1) * INTERVAL 1 SECOND AS done, CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END AS method, event_id % 11 = 0 AS frag, event_id % 4 AS h, user_id % 2 AS body FROM events)
SELECT event_id, concat_ws(',', CASE WHEN done < ts THEN 'time_order' END, CASE WHEN frag THEN 'url' END, CASE WHEN h = 1 THEN 'header_order' END, CASE WHEN h = 2 THEN 'cookie' END, CASE WHEN method = 'GET' AND body > 0 THEN 'body' END) AS issues,
 CASE WHEN h = 3 THEN 'accept=x;host=y' ELSE 'accept=x' END AS headers FROM x"""
)
def q28_exchange_issues(spark, sf_dir):
    """Events as recorded exchanges, some of them against the rules."""
    i, h = F.col("event_id"), F.col("event_id") % 4
    names = F.when(h == 1, F.array(F.lit("host"), F.lit("accept"))).when(h == 2, F.array(F.lit("accept"), F.lit("cookie"))).otherwise(F.array(F.lit("accept"), F.lit("host")))
    finished = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), i % 7 - 1)
    url = F.concat(F.lit("https://host.example/"), i.cast("string"), F.when(i % 11 == 0, "#part").otherwise(F.lit("#")))
    raw = F.array(F.struct(F.lit(" Host ").alias("name"), F.when(h == 3, " y\t").otherwise(F.lit(" ")).alias("value")), F.struct(F.lit("ACCEPT").alias("name"), F.lit("x").alias("value")), F.struct(F.lit("accept").alias("name"), F.lit("x ").alias("value")))
    method = F.when(F.col("event_type") == "view", "GET").otherwise("POST")
    issues = authority.exchange_issues(F.col("ts"), finished, method, url, names, F.col("user_id") % 2)
    headers = F.transform(authority.recordable_headers(raw), lambda x: F.concat(x["name"], F.lit("="), x["value"]))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(issues, ",").alias("issues"), F.array_join(headers, ";").alias("headers"))


@query("SELECT doc_id, sha1(concat('blob ', octet_length(encode(text)), chr(0), text)) AS sha1_id, sha256(concat('blob ', octet_length(encode(text)), chr(0), text)) AS sha256_id FROM documents")
def q32_git_blob_ids(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", release.git_blob_id(text).alias("sha1_id"), release.git_blob_id(text, "sha256").alias("sha256_id"))


@query("SELECT doc_id, 'https://data.example/records/sha256-' || sha256(text) || '/document-sha256-' || sha256(text) || '.tar.gz' AS url FROM documents")
def q33_archive_urls(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", release.archive_url("https://data.example", "records", "document", V.sha256(F.col("text"))).alias("url"))


# -- releases --------------------------------------------------------------------------------------------------------

RELEASE_CONTRACTS = {n: f"catalogue.{n}/v1" for n in envelope.CONTRACTS}
RELEASE_DOCUMENTS = 500
_NONE = "sha256:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _release_inputs(spark: SparkSession, sf_dir: str, size: int = RELEASE_DOCUMENTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Heads, objects and changes: each source is a chain whose releases add `size` neighbouring documents each."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("chain"), F.floor(F.col("doc_id") / size).alias("block"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), V.sha256(text).alias("sha256"), F.octet_length(text).cast("long").alias("bytes"))
    blocks = docs.select("chain", "block").distinct().withColumn("sequence", F.row_number().over(Window.partitionBy("chain").orderBy("block")).cast("long"))
    docs = written(docs.join(blocks.hint("merge"), ["chain", "block"]), "release-documents")
    objects = docs.select("chain", "sequence", F.concat(F.lit("texts/"), "id", F.lit(".txt")).alias("path"), "sha256", "bytes")
    none = F.lit(None).cast("string")
    kind = envelope.change_type()
    added = {"kind": F.lit("text.added"), "subject_type": F.lit("text"), "subject_id": F.col("id"), "revision_digest": F.col("sha256"), "basis_event_ids": F.array().cast("array<string>")}
    core = [f for f in kind.fields if f.name != "change_id"]
    made = docs.select("chain", "sequence", *[added.get(f.name, none).alias(f.name) for f in core])
    made = made.withColumn("change_id", V.digest(F.struct(*[f.name for f in core]), T.StructType(core), True))
    empty = F.map_from_entries(F.array().cast("array<struct<key: string, value: string>>"))
    fixed = {"compiler_version": F.lit("catalogue/1"), "policy_as_of": F.lit("2026-01-01T00:00:00Z"), "trust_transition_digest": none, "resource_digests": empty, "bundle_resources": empty, "admitted_input_digests": F.array(F.lit(_NONE))}
    digests = ("input_set_digest", "artifact_digest", "root_set_digest", "signer_registry_digest", "verifier_digest")
    heads = blocks.select("chain", "sequence", *[c.alias(n) for n, c in fixed.items()], *[F.lit(_NONE).alias(n) for n in digests])
    return heads, objects, made


_RELEASE_OBJECTS = f"""o AS (SELECT coalesce(source, 'none') AS chain, dense_rank() OVER (PARTITION BY coalesce(source, 'none') ORDER BY doc_id // {RELEASE_DOCUMENTS}) AS sequence,
'd' || doc_id AS id, 'texts/d' || doc_id || '.txt' AS path, 'sha256:' || sha256(coalesce(text, '')) AS s, octet_length(encode(coalesce(text, ''))) AS b FROM documents)"""


def _optional_sql(x: str) -> str:
    return f"coalesce('\"' || {x} || '\"', 'null')"


def _file_sql(path: str, text: str) -> str:
    return f"""'"{path}":{{"bytes":' || octet_length(encode({text})) || ',"sha256":"sha256:' || sha256({text}) || '"}},'"""


@query(
    f"""WITH RECURSIVE {_RELEASE_OBJECTS},
c AS (SELECT *, '"kind":"text.added","revision_digest":"' || s || '","subject_id":"' || id || '","subject_type":"text"}}' AS tail FROM o),
k AS (SELECT *, '{{"basis_event_ids":[],"change_id":"sha256:' || sha256('{{"basis_event_ids":[],' || tail) || '",' || tail AS line FROM c),
g AS (SELECT chain, sequence, count(*) AS n_objects, string_agg('"' || path || '":{{"bytes":' || b || ',"sha256":"' || s || '"}}', ',' ORDER BY path) AS objects,
      string_agg(line, ',' ORDER BY id) AS array_, string_agg(line || chr(10), '' ORDER BY id) AS changes FROM k GROUP BY chain, sequence),
h AS (SELECT *, '{{"manifest_contract":"catalogue.manifest/v1","objects":{{' || objects || '}}}}' AS manifest, 'sha256:' || sha256(changes) AS diff_digest,
      '{{"artifact_contract":"catalogue.artifact/v1","artifact_digest":"{_NONE}","compiler_version":"catalogue/1","input_set_digest":"{_NONE}","policy_as_of":"2026-01-01T00:00:00Z","release_sequence":' || sequence
      || ',"resource_digests":{{}},"root_set_digest":"{_NONE}","signer_registry_digest":"{_NONE}","snapshot_contract":"catalogue.snapshot/v1","trust_transition_digest":null}}' AS snapshot FROM g),
i AS (SELECT *, 'sha256:' || sha256(snapshot) AS snapshot_id FROM h),
j AS (SELECT *, '"release_contract":"catalogue.release/v1","release_sequence":' || sequence || ',"snapshot_id":"' || snapshot_id || '"}}' AS tail FROM i),
r AS (SELECT chain, sequence, CAST(NULL AS VARCHAR) AS parent_release_id, CAST(NULL AS VARCHAR) AS parent_snapshot_id, snapshot_id, '{{"diff_digest":"' || diff_digest || '","parent_release_id":null,' || tail AS core FROM j WHERE sequence = 1
      UNION ALL SELECT j.chain, j.sequence, 'sha256:' || sha256(r.core), r.snapshot_id, j.snapshot_id, '{{"diff_digest":"' || j.diff_digest || '","parent_release_id":"sha256:' || sha256(r.core) || '",' || j.tail FROM r JOIN j ON j.chain = r.chain AND j.sequence = r.sequence + 1),
d AS (SELECT j.*, r.parent_release_id, 'sha256:' || sha256(core) AS release_id,
      '{{"changes":[' || array_ || '],"diff_contract":"catalogue.diff/v1","parent_snapshot_id":' || {_optional_sql("r.parent_snapshot_id")} || ',"snapshot_id":"' || j.snapshot_id || '"}}' AS diff,
      '{{"descriptor_contract":"catalogue.descriptor/v1","release_core":' || core || ',"release_id":"sha256:' || sha256(core) || '","snapshot_core":' || snapshot || ',"snapshot_id":"' || j.snapshot_id || '"}}' AS descriptor
      FROM j JOIN r ON j.chain = r.chain AND j.sequence = r.sequence)
SELECT chain, sequence, n_objects, snapshot_id, diff_digest, parent_release_id, release_id, 'sha256:' || sha256(manifest) AS manifest_digest,
'sha256:' || sha256('{{"admitted_input_digests":["{_NONE}"],"bundle_contract":"catalogue.bundle/v1","files":{{' || {_file_sql("changes.ndjson", "changes")} || {_file_sql("manifest.json", "(manifest || chr(10))")} || {_file_sql("release-diff.json", "(diff || chr(10))")} || {_file_sql("release.json", "(descriptor || chr(10))")} || objects
|| '}},"object_manifest_digest":"sha256:' || sha256(manifest) || '","release":' || descriptor || ',"resource_digests":{{}},"verifier_digest":"{_NONE}"}}') AS bundle_digest FROM d"""
)
def q34_release_seal(spark, sf_dir):
    heads, objects, made = _release_inputs(spark, sf_dir)
    sealed = envelope.seal(RELEASE_CONTRACTS, heads, objects, made, envelope.change_type())
    return sealed.select("chain", "sequence", "n_objects", "snapshot_id", "diff_digest", "parent_release_id", "release_id", "manifest_digest", "bundle_digest")


@query(
    f"""WITH {_RELEASE_OBJECTS}, e AS (SELECT DISTINCT chain, sequence FROM o WHERE sequence % 2 = 0)
SELECT chain, sequence, 3 AS check_ordinal, 'file_set' AS code, min(path) AS path FROM o WHERE sequence = 1 GROUP BY chain, sequence
UNION ALL SELECT chain, sequence, 4, 'file_bytes', 'changes.ndjson' FROM e
UNION ALL SELECT chain, sequence, 19, 'changes_digest', NULL FROM e
UNION ALL SELECT chain, sequence, 20, 'changes_encoding', NULL FROM e"""
)
def q35_release_checks(spark, sf_dir):
    """Stored releases of which every second has other changes, and the first of each chain has lost a file."""
    heads, objects, made = _release_inputs(spark, sf_dir)
    sealed = written(envelope.seal(RELEASE_CONTRACTS, heads, objects, made, envelope.change_type()), "sealed")
    even = F.col("sequence") % 2 == 0
    texts = envelope.files_of(sealed.withColumn("changes", F.when(even, F.replace("changes", F.lit("text.added"), F.lit("text.lost"))).otherwise(F.col("changes"))))
    own = texts.where(F.col("path") != envelope.FILES["bundle"]).select("chain", "sequence", "path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))
    lost = objects.where("sequence = 1").groupBy("chain", "sequence").agg(F.min("path").alias("path"))
    present = own.unionByName(objects.join(lost, ["chain", "sequence", "path"], "left_anti"))
    entries, resources = spark.createDataFrame([("texts", "texts")], "entry string, owner string"), spark.createDataFrame([], "name string, owner string")
    return envelope.violations(RELEASE_CONTRACTS, texts, present, envelope.change_type(), entries, resources)
