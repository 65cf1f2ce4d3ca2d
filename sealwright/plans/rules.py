"""More of the catalogue: canonical values of any shape, and the rules of records that list what they refuse."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealwright.functions import values as V
from sealwright.operators import authority, capture, changes, exchange, identity, projection
from sealwright.operators import keys as keys_
from sealwright.plans.catalogue import _ROWS, _SP, MAX_SHARD_BYTES, _esc, _leaves_sql, query, record_rows
from sealwright.session import table

# -- canonical values ------------------------------------------------------------------------------------------------

NESTED = T.StructType([T.StructField("weights", T.MapType(T.StringType(), T.DoubleType())), T.StructField("lines", T.ArrayType(T.StringType())), T.StructField("lang", T.StringType())])


def _double_sql(x: str) -> str:
    return f"regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"


@query(
    f"""SELECT doc_id, 'sha256:' || sha256('{{"lang":"' || lang || '","lines":[' || array_to_string(list_transform(string_split(nfc_normalize(text), chr(10)), lambda x: {_esc('x')}), ',')
 || '],"weights":{{"n":' || {_double_sql('CAST(n_chars AS DOUBLE) / 8')} || ',"é' || lang || '":' || {_double_sql('CAST(-n_chars AS DOUBLE)')} || '}}}}') AS digest FROM documents"""
)
def q36_nested_digest(spark, sf_dir):
    """Digests over arrays of texts and maps whose keys are not in normal form."""
    weights = F.create_map(F.concat(F.lit("é"), "lang"), -F.col("n_chars").cast("double"), F.lit("n"), F.col("n_chars") / 8)
    value = F.struct(weights.alias("weights"), F.split("text", "\n").alias("lines"), "lang")
    return table(spark, sf_dir, "documents").select("doc_id", V.digest(value, NESTED, normal_keys=True).alias("digest"))


@query(
    f"""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'syntax' WHEN 1 THEN 'number' WHEN 2 THEN 'colliding_keys' WHEN 3 THEN 'depth' END AS issue,
 CASE WHEN doc_id % 7 > 3 THEN sha256('{{"n":' || (10 * n_chars + 5) || ',"text":' || {_esc('nfc_normalize(text)')} || ',"é":[true,null,{{}},0]}}') END AS digest FROM documents"""
)
def q37_free_json(spark, sf_dir):
    """Documents as JSON texts in free layout, four in seven of them without a canonical form."""
    spoiled = [F.lit(""), F.lit('"x":1e999}'), F.lit('"é":1}'), F.concat(F.lit('"x":'), F.repeat(F.lit("["), 256), F.repeat(F.lit("]"), 256), F.lit("}"))]
    end = F.lit('"n":0}')
    for n, piece in enumerate(spoiled):
        end = F.when(F.col("doc_id") % 7 == n, piece).otherwise(end)
    number = F.concat(F.lit('"n": '), F.col("n_chars").cast("string"), F.lit(".50e1}"))
    end = F.when(F.col("doc_id") % 7 > 3, number).otherwise(end)
    text = F.concat(F.lit('{ "text" :'), V.json_string(F.col("text"), True), F.lit(',\t"é":[ true, null, {}, -0.0 ],\n '), end)
    out = table(spark, sf_dir, "documents").select("doc_id", V.canonical_json(text).alias("c"))
    return out.select("doc_id", "c.issue", F.sha2("c.text", 256).alias("digest"))


# -- exchanges -------------------------------------------------------------------------------------------------------

@query(
    """WITH e AS (SELECT event_id, event_id % 16 AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS t, 'sha256:' || sha256(event_type) AS d, octet_length(encode(event_type)) AS n FROM events),
i AS (SELECT *, CASE k WHEN 1 THEN 'time_order' WHEN 2 THEN 'url' WHEN 3 THEN 'header_order' WHEN 4 THEN 'credential_header' WHEN 5 THEN 'credential_form' WHEN 6 THEN 'credential_query'
 WHEN 7 THEN 'bodyless' WHEN 8 THEN 'unrecordable' WHEN 9 THEN 'response_order' WHEN 10 THEN 'outcome' WHEN 11 THEN 'status' WHEN 12 THEN 'https' WHEN 13 THEN 'credential_order' ELSE '' END AS issues FROM e)
SELECT event_id, issues, CASE WHEN issues = '' THEN 'sha256:' || sha256('{"finished_at":"' || t || 'Z","outcome":"' || CASE WHEN k = 15 THEN 'transport_error","reason":"tls_failure' ELSE 'responded' END
 || '","request":{"body":{"content_bytes":' || n || ',"content_digest":"' || d || '","media_type":"application/x-www-form-urlencoded"},"credentials":[{"field":"token","handle_digest":"' || d || '","scheme":"form"},{"handle_digest":"' || d
 || '","header_name":"authorization","scheme":"bearer"},{"handle_digest":"' || d || '","parameter":"key","scheme":"query"}],"header_names":["accept","authorization"],"method":"POST","url":"https://host.example/' || event_id || '?a=1&key=' || replace(d, ':', '%3A') || '"}'
 || CASE WHEN k = 15 THEN '' ELSE ',"response":{"body":{"content_bytes":' || n || ',"content_digest":"' || d || '","media_type":"text/plain"},"headers":[["content-type","text/plain"],["etag","é"]],"status":200}' END
 || ',"started_at":"' || t || '.0Z"}') END AS exchange_digest FROM i"""
)
def q38_exchange_seal(spark, sf_dir):
    """Events as records of exchanges: thirteen in sixteen break one rule each, the others are sealed."""
    k = F.col("event_id") % 16

    def but(n: int, other, usual):
        return F.when(k == n, other).otherwise(usual)

    def credential(scheme, **where):
        return F.struct(F.col("d").alias("handle_digest"), F.lit(scheme).alias("scheme"), *[F.lit(where.get(w)).cast("string").alias(w) for w in ("header_name", "field", "parameter")])

    def body(media_type):
        return F.struct(media_type.alias("media_type"), F.col("d").alias("content_digest"), F.octet_length("event_type").cast("long").alias("content_bytes"))

    def texts(*items):
        return F.array(*[F.lit(x) for x in items])

    form, bearer, by_query = credential("form", field="token"), credential("bearer", header_name="authorization"), credential("query", parameter="key")
    headers = F.array(texts("content-type", "text/plain"), texts("etag", "é"))
    headers = but(8, F.array(texts("content-type", "text/plain"), texts("set-cookie", "a=b")), but(9, F.array(texts("etag", "é"), texts("content-type", "text/plain")), headers))
    code = F.concat(F.col("event_id").cast("string"), F.lit("?a=1&key="), F.replace(F.col("d"), F.lit(":"), F.lit("%3A")))
    url = F.concat(but(12, F.lit("http"), F.lit("https")), F.lit("://host.example/"), code, but(2, F.lit("#x"), but(6, F.lit("&key=2"), F.lit(""))))
    sent = but(3, texts("authorization", "accept"), but(4, texts("accept"), texts("accept", "authorization")))
    request = F.struct(
        but(7, F.lit("GET"), F.lit("POST")).alias("method"),
        url.alias("url"),
        sent.alias("header_names"),
        but(13, F.array(bearer, form, by_query), F.array(form, bearer, by_query)).alias("credentials"),
        body(but(5, F.lit("text/plain"), F.lit(exchange.FORM))).alias("body"),
    )
    response = F.when(k != 15, F.struct(but(11, F.lit(99), F.lit(200)).alias("status"), headers.alias("headers"), body(F.lit("text/plain")).alias("body")))
    second = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    records = (
        table(spark, sf_dir, "events")
        .withColumn("d", V.sha256(F.col("event_type")))
        .select(
            "event_id",
            F.concat(second, but(1, F.lit(".1Z"), F.lit(".0Z"))).alias("started_at"),
            F.concat(second, F.lit("Z")).alias("finished_at"),
            but(15, F.lit("transport_error"), F.lit("responded")).alias("outcome"),
            request.alias("request"),
            response.alias("response"),
            F.when(k.isin(10, 15), "tls_failure").alias("reason"),
        )
    )
    return exchange.sealed(records).select("event_id", F.array_join("issues", ",").alias("issues"), "exchange_digest")


# -- identities ------------------------------------------------------------------------------------------------------

TRANSITION = "ord int, kind string, surviving string, retired array<string>, original string, continuing string, new array<string>, predecessor string, successor string, predecessor_retires boolean, subject string"
#: Transitions by case: one JSON array each, with {} for the number of the document.
REFUSED = [
    [{"kind": "merge", "surviving": "s{}a", "retired": ["s{}b"]}],
    [{"kind": "merge", "surviving": "s{}a", "retired": ["s{}b", "s{}b"]}],
    [{"kind": "merge", "surviving": "s{}a", "retired": ["s{}a", "s{}b"]}],
    [{"kind": "split", "original": "s{}a", "new": ["s{}a", "s{}b"]}],
    [{"kind": "split", "original": "s{}a", "continuing": "s{}x", "new": ["s{}b"]}],
    [{"kind": "succession", "predecessor": "s{}a", "successor": "s{}a", "predecessor_retires": True}],
    [{"kind": "succession", "predecessor": "s{}a", "successor": "s{}b", "predecessor_retires": True}, {"kind": "succession", "predecessor": "s{}a", "successor": "s{}c", "predecessor_retires": True}],
    [{"kind": "succession", "predecessor": "s{}a", "successor": "s{}b", "predecessor_retires": True}, {"kind": "succession", "predecessor": "s{}b", "successor": "s{}a", "predecessor_retires": True}],
    [{"kind": "split", "original": "s{}a", "new": ["s{}b"]}, {"kind": "split", "original": "s{}a", "new": ["s{}c"]}],
    [{"kind": "retirement", "subject": "S{}"}],
]
ACCEPTED = [
    [{"kind": "split", "original": "s{}a", "continuing": "s{}b", "new": ["s{}b", "s{}c"]}, {"kind": "merge", "surviving": "s{}d", "retired": ["s{}b"]}],
    [{"kind": "split", "original": "s{}a", "continuing": "s{}a", "new": ["s{}b", "s{}c"]}, {"kind": "succession", "predecessor": "s{}b", "successor": "s{}e", "predecessor_retires": True}],
    [{"kind": "succession", "predecessor": "s{}a", "successor": "s{}b", "predecessor_retires": False}, {"kind": "retirement", "subject": "s{}c"}],
]


def _transitions(spark, sf_dir, cases):
    """The case of each document, by its number modulo the number of cases."""
    n = F.col("doc_id") % len(cases)
    texts = F.element_at(F.array(*[F.lit(json.dumps(c)) for c in cases]), (n + 1).cast("int"))
    rows = F.from_json(F.replace(texts, F.lit("{}"), F.col("doc_id").cast("string")), f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in TRANSITION.split(', '))}>>")
    return table(spark, sf_dir, "documents").select(F.explode(rows).alias("t")).select("t.*")


@query(
    """WITH d AS (SELECT DISTINCT doc_id AS i, doc_id % 10 AS k FROM documents),
c AS (SELECT * FROM (VALUES (1, 'a', 1, 'not_distinct'), (2, 'a', 2, 'self_merge'), (2, 'a', 8, 'cycle'), (2, 'b', 8, 'cycle'), (3, 'a', 3, 'self_split'), (4, 'a', 5, 'not_new'), (5, 'a', 4, 'self_succession'),
 (5, 'a', 8, 'cycle'), (6, 'a', 7, 'two_resolutions'), (7, 'a', 8, 'cycle'), (7, 'b', 8, 'cycle'), (8, 'a', 6, 'other_split'), (9, '', 9, 'grammar')) AS t(k, s, check_ordinal, code))
SELECT CASE WHEN k = 9 THEN 'S' ELSE 's' END || i || s AS subject, check_ordinal, code FROM d JOIN c USING (k)"""
)
def q39_transition_violations(spark, sf_dir):
    """One refused case of transitions for each document, but for one in ten."""
    return identity.transition_violations(_transitions(spark, sf_dir, REFUSED))


@query(
    """WITH d AS (SELECT DISTINCT doc_id AS i, doc_id % 3 AS k FROM documents),
c AS (SELECT * FROM (VALUES (0, 'resolves', 'a', 'd'), (0, 'resolves', 'b', 'd'), (0, 'branch', 'a', 'c'), (0, 'branch', 'a', 'd'), (0, 'retired', 'a', NULL), (0, 'retired', 'b', NULL),
 (1, 'resolves', 'b', 'e'), (1, 'branch', 'a', 'e'), (1, 'branch', 'a', 'c'), (1, 'retired', 'b', NULL), (2, 'retired', 'c', NULL)) AS t(k, state, s, o))
SELECT state, 's' || i || s AS subject, 's' || i || o AS other FROM d JOIN c USING (k)"""
)
def q40_identity_states(spark, sf_dir):
    """What three kinds of histories come to: resolutions, branches of splits, retired subjects."""
    t = _transitions(spark, sf_dir, ACCEPTED)
    out = identity.resolutions(t).select(F.lit("resolves").alias("state"), F.col("src").alias("subject"), F.col("root").alias("other"))
    out = out.union(identity.split_branches(t).select(F.lit("branch"), "original", "child"))
    return out.union(identity.retired_subjects(t).select(F.lit("retired"), "subject", F.lit(None).cast("string")))


_MATCHES_SQL = """k AS (SELECT sha256(text) AS key_digest, 'doc_' || min(doc_id) AS ref, sha256(min(source)) AS ident FROM documents GROUP BY 1),
m AS (SELECT sha256(text) AS key_digest, doc_id, 'doc_' || doc_id AS target, sha256(source) AS t_ident FROM documents)"""


def _matches(spark, sf_dir):
    """Keys by text, and every document as a match of one of four kinds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("key_digest"))
    keys = docs.groupBy("key_digest").agg(F.concat(F.lit("doc_"), F.min("doc_id").cast("string")).alias("key_reference"), F.sha2(F.min("source"), 256).alias("key_identity_digest"))
    kinds = F.array(*[F.lit(k) for k in ("live", "merged_lineage", "open_pull_request", "pending_submission")])
    matches = docs.select(
        "doc_id",
        "key_digest",
        F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int")).alias("kind"),
        F.lit("main").alias("repository"),
        F.when(F.col("doc_id") % 4 == 2, F.col("doc_id")).alias("pull_request_number"),
        F.when(F.col("doc_id") % 8 == 2, "head").otherwise("other").alias("head_sha"),
        F.when(F.col("doc_id") % 4 == 3, F.when(F.col("doc_id") % 12 == 3, "mine").otherwise("theirs")).alias("candidate_reference"),
        F.when(F.col("doc_id") % 24 == 3, "digest").otherwise("other").alias("candidate_digest"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("target_reference"),
        F.sha2("source", 256).alias("target_identity_digest"),
    )
    return keys, matches


@query(
    f"""WITH {_MATCHES_SQL}, v AS (SELECT m.key_digest, CASE WHEN doc_id % 4 = 3 AND doc_id % 12 = 3 THEN 'skip' WHEN doc_id % 4 IN (0, 1) AND target = ref THEN CASE WHEN t_ident <> ident THEN 'changed' ELSE 'skip' END ELSE 'hold' END AS verdict FROM m JOIN k USING (key_digest))
SELECT key_digest, count(*) AS n_matches, bool_or(verdict = 'changed') AS identity_changed FROM v WHERE verdict <> 'skip' GROUP BY 1"""
)
def q41_submission_conflicts(spark, sf_dir):
    """The matches of all documents against the keys of a submission that is not a pull request."""
    keys, matches = _matches(spark, sf_dir)
    return identity.conflicts(keys, matches, {"kind": "submission", "candidate_reference": "mine", "candidate_digest": "digest"})


@query(
    f"""WITH {_MATCHES_SQL}, x AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'none' || doc_id ELSE key_digest END AS kd FROM m)
SELECT DISTINCT kd AS key_digest, 2 AS check_ordinal, 'unknown_key' AS code FROM x WHERE doc_id % 5 = 0
UNION ALL SELECT DISTINCT kd, 4, 'other_candidate' FROM x WHERE doc_id % 5 <> 0 AND doc_id % 12 = 3 AND doc_id % 24 <> 3
UNION ALL SELECT key_digest, 1, 'repeated_key' FROM k WHERE right(key_digest, 1) = '0'"""
)
def q42_conflict_violations(spark, sf_dir):
    """A sixteenth of the keys given twice, a fifth of the matches without a key, and half of the own submissions with another digest."""
    keys, matches = _matches(spark, sf_dir)
    keys = keys.union(keys.where("right(key_digest, 1) = '0'"))
    matches = matches.withColumn("key_digest", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("none"), F.col("doc_id").cast("string"))).otherwise(F.col("key_digest")))
    return identity.conflict_violations(keys, matches, {"kind": "submission", "candidate_reference": "mine", "candidate_digest": "digest"})


@query(
    """SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 11 = 1 THEN 'instance_id' END, CASE WHEN doc_id % 11 = 2 THEN 'kind' END, CASE WHEN doc_id % 11 = 3 THEN 'id' END, CASE WHEN doc_id % 11 = 4 THEN 'semantics' END,
 CASE WHEN doc_id % 11 IN (5, 6, 7) THEN 'visibility' END, CASE WHEN doc_id % 11 IN (8, 9) THEN 'binding' END) AS issues FROM documents"""
)
def q43_reference_issues(spark, sf_dir):
    """Documents as references to themselves; nine in eleven break a rule."""
    k = F.col("doc_id") % 11
    v = lambda *names: F.array(*[F.lit(n) for n in names])
    refs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(k == 1, "One").otherwise("one").alias("instance_id"),
        F.when(k == 2, "").otherwise("document").alias("kind"),
        F.when(k == 3, "no id\n").when(k == 10, V.sha256(F.col("text"))).otherwise(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))).alias("id"),
        F.when(k == 8, "latest").when(k.isin(9, 10), "exact_revision").otherwise("current").alias("mode"),
        F.when(k == 9, "sha256:1").when(k == 10, V.sha256(F.col("text"))).alias("revision_digest"),
        F.when(k == 4, F.lit(None)).otherwise(F.lit(True)).alias("required"),
        F.lit(False).alias("same_subject"),
        F.when(k == 5, v()).when(k == 6, v("public", "public")).when(k == 7, v("public", "nobody")).otherwise(v("public", "members")).alias("allowed_visibility"),
    )
    return refs.select("doc_id", F.array_join(identity.reference_issues(["public", "members"]), ",").alias("issues"))


# -- keys ------------------------------------------------------------------------------------------------------------


def _keys(spark, sf_dir):
    """Suppliers as signing keys, some of them against the rules; those of one nation are one issuer."""
    k = F.col("s_suppkey") % 9
    pem = F.concat(F.lit("-----BEGIN PUBLIC KEY-----\nMCowBQYDK2VwAyEA"), F.repeat(F.lit("A"), 43), F.when(k == 7, "!").otherwise("="), F.lit("\n-----END PUBLIC KEY-----\n"))
    keys = table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.concat(F.lit("key-"), F.col("s_suppkey").cast("string")).alias("key_id"),
        F.when(k == 1, "").otherwise(F.concat(F.lit("issuer-"), F.col("s_nationkey").cast("string"))).alias("issuer_id"),
        F.when(k == 2, F.array(F.lit("release"), F.lit("release"))).otherwise(F.array(F.lit("release"), F.lit("capture"))).alias("purposes"),
        pem.alias("public_key"),
        F.when(k == 3, "never").when(k == 4, "1999-01-01T00:00:00Z").otherwise("1994-01-01T00:00:00Z").alias("valid_from"),
        F.when(k == 5, F.lit(None)).otherwise("1997-01-01T01:00:00+01:00").alias("valid_until"),
        F.when(k == 6, 0).when(k == 8, 3).cast("long").alias("compromised_after_sequence"),
    )
    return keys.union(keys.where("s_suppkey % 10 = 0")).drop("s_suppkey")


@query(
    """WITH s AS (SELECT s_suppkey AS i, s_suppkey % 9 AS k FROM supplier), t AS (SELECT * FROM s UNION ALL SELECT * FROM s WHERE i % 10 = 0),
c AS (SELECT * FROM (VALUES (1, 2, 'issuer_id'), (2, 4, 'purposes'), (3, 5, 'instants'), (3, 6, 'interval'), (4, 6, 'interval'), (6, 7, 'sequence'), (7, 8, 'public_key')) AS v(k, check_ordinal, code))
SELECT 'key-' || i AS key_id, check_ordinal, code FROM t JOIN c USING (k) UNION ALL SELECT 'key-' || i, 1, 'named_twice' FROM s WHERE i % 10 = 0"""
)
def q44_key_registry(spark, sf_dir):
    return keys_.registry_violations(_keys(spark, sf_dir))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN s_suppkey IS NULL THEN 'unknown_key' WHEN l_linenumber = 7 AND n <> 0 THEN 'other_issuer' WHEN l_linenumber = 6 THEN 'purpose'
 WHEN l_shipdate < TIMESTAMP '1994-01-01' OR (l_shipdate >= TIMESTAMP '1997-01-01' AND l_suppkey % 9 <> 5) THEN 'interval' WHEN l_suppkey % 9 = 8 AND l_linenumber >= 3 THEN 'compromised' ELSE 'authorized' END AS verdict
FROM lineitem LEFT JOIN (SELECT s_suppkey, s_nationkey AS n FROM supplier WHERE s_suppkey % 10 <> 0 AND s_suppkey % 9 IN (0, 5, 8)) ON l_suppkey = s_suppkey"""
)
def q45_key_verdicts(spark, sf_dir):
    """Every line as a fact signed with its supplier's key; only keys that no rule refuses are held."""
    keys = _keys(spark, sf_dir)
    held = keys.join(keys_.registry_violations(keys).select("key_id"), "key_id", "left_anti")
    facts = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.concat(F.lit("key-"), F.col("l_suppkey").cast("string")).alias("key_id"),
        F.when(F.col("l_linenumber") == 7, "issuer-0").alias("issuer_id"),
        F.when(F.col("l_linenumber") == 6, "mail").otherwise("release").alias("purpose"),
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"),
        F.col("l_linenumber").cast("long").alias("sequence"),
    )
    return keys_.key_verdicts(facts, held).select("l_orderkey", "l_linenumber", "verdict")


# -- shard files and manifests ---------------------------------------------------------------------------------------

SNAPSHOT_CONTRACT = "catalogue.snapshot/v1"
_FILES = f"""WITH {_ROWS}, {_leaves_sql('r')}, f AS (SELECT leaf, count(*) AS n FROM l GROUP BY leaf)"""


@query(
    _FILES
    + """ SELECT 'data/' || CASE WHEN leaf[1] = '5' THEN 'X' || leaf[2:] ELSE leaf END || '.jsonl' AS path, check_ordinal, code
FROM f JOIN (VALUES ('0', 1, 'empty'), ('1', 2, 'encoding'), ('2', 3, 'final_newline'), ('3', 4, 'blank_row'), ('4', 5, 'row'), ('5', 6, 'misplaced'), ('6', 7, 'order'), ('7', 8, 'not_canonical')) AS v(d, check_ordinal, code) ON leaf[1] = d WHERE n > 1 OR d <> '6'"""
)
def q46_shard_reader(spark, sf_dir):
    """Every shard as a file; those of eight first digits are spoiled, each in another way."""
    rows = projection.placed(record_rows(spark, sf_dir), MAX_SHARD_BYTES)
    digit = F.substring("path", 6, 1)
    line = F.when(digit == "7", F.replace("line", F.lit(":"), F.lit(": "))).otherwise(F.col("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"])
    files = rows.groupBy("path").agg(lines.alias("lines")).withColumn("d", digit)
    text = F.concat(F.array_join(F.when(F.col("d") == "6", F.reverse("lines")).otherwise(F.col("lines")), "\n"), F.when(F.col("d") == "2", "").when(F.col("d") == "3", "\n\n").when(F.col("d") == "4", '\n{"id":1,\n').otherwise("\n"))
    content = F.when(F.col("d") == "0", F.unhex(F.lit(""))).when(F.col("d") == "1", F.concat(F.unhex(F.lit("ff")), F.encode(text, "utf-8"))).otherwise(F.encode(text, "utf-8"))
    path = F.when(F.col("d") == "5", F.concat(F.lit("data/X"), F.substring("path", 7, 99))).otherwise(F.col("path"))
    return projection.shard_violations(files.select(path.alias("path"), content.alias("content")))


def _manifest_sql(rows: str = "sum(rows)") -> str:
    return f"""'{{"contract":"{SNAPSHOT_CONTRACT}","maxShardBytes":{MAX_SHARD_BYTES},"projectorDigest":"' || d || '","rowCount":' || {rows} || ',"shards":[' || string_agg('{{"bytes":' || bytes || ',"digest":"' || digest || '","path":"' || path || '","rows":' || rows || '}}', ',' ORDER BY path) || '],"sourceReleaseId":"' || d || '","sourceSequence":1}}' || chr(10)"""


def _manifests(spark, sf_dir):
    d = V.sha256(F.lit("release"))
    entries = projection.shards(record_rows(spark, sf_dir), MAX_SHARD_BYTES).select(d.alias("source_release_id"), F.lit(1).cast("long").alias("source_sequence"), d.alias("projector_digest"), "*")
    return projection.manifest(entries, SNAPSHOT_CONTRACT, MAX_SHARD_BYTES)


@query(f"WITH {_ROWS}, {_leaves_sql('r')}, x AS (SELECT *, 'sha256:' || sha256('release') AS d FROM i) SELECT d AS source_release_id, sha256({_manifest_sql()}) AS manifest_sha256 FROM x GROUP BY d")
def q47_snapshot_manifest(spark, sf_dir):
    return _manifests(spark, sf_dir).select("source_release_id", F.sha2("manifest", 256).alias("manifest_sha256"))


@query(
    f"WITH {_ROWS}, {_leaves_sql('r')}, n AS (SELECT count(*) AS n FROM r) SELECT k, issue, CASE WHEN issue IS NULL THEN n END AS row_count FROM n, (VALUES (0, NULL), (1, 'not_canonical'), (2, 'not_canonical'), (3, 'shape'), (4, 'contract'), (5, 'digests'), (6, 'counts'), (7, 'size'), (8, 'total')) AS v(k, issue)"
)
def q48_manifest_reader(spark, sf_dir):
    """One manifest over all documents, read as it is and spoiled in eight ways."""
    m = F.col("manifest")
    spoiled = [
        m,
        F.concat(m, F.lit("\n")),
        F.replace(m, F.lit('"rows":'), F.lit('"rows": ')),
        F.replace(m, F.lit('"sourceSequence":1}'), F.lit('"sourceSequence":1,"x":1}')),
        F.replace(m, F.lit(SNAPSHOT_CONTRACT), F.lit("other/v1")),
        F.regexp_replace(m, '"projectorDigest":"sha256:.', '"projectorDigest":"sha256:'),
        F.replace(m, F.lit('"sourceSequence":1}'), F.lit('"sourceSequence":0}')),
        F.regexp_replace(m, f'"maxShardBytes":{MAX_SHARD_BYTES}', '"maxShardBytes":10'),
        F.regexp_replace(m, '"rowCount":', '"rowCount":1'),
    ]
    texts = _manifests(spark, sf_dir).select(F.posexplode(F.array(*spoiled)).alias("k", "manifest"))
    return projection.parsed_manifest(texts, SNAPSHOT_CONTRACT).select("k", "issue", F.col("snapshot.rowCount").alias("row_count"))


# -- captures --------------------------------------------------------------------------------------------------------


def _methods(spark):
    rows = "VALUES ('r', 'fetch', '1', array('direct')), ('r', 'render', '1', array('rendered-page')), ('r', 'manual', '1', array('manual-review')), ('r', 'archive', '1', array('history-only'))"
    return spark.sql(f"SELECT * FROM {rows} AS t(registry_digest, name, version, capabilities)")


@query(
    """WITH c AS (SELECT * FROM (VALUES (1, 1, 'method'), (2, 2, 'https'), (3, 3, 'plain_url'), (4, 3, 'plain_url'), (5, 4, 'lease_token'), (6, 5, 'lease')) AS v(k, check_ordinal, code))
SELECT page_id, check_ordinal, code FROM pages JOIN c ON page_id % 8 = k"""
)
def q49_capture_starts(spark, sf_dir):
    """Pages as reservations; six in eight break a rule."""
    k = F.col("page_id") % 8
    url = F.concat(F.lit("https://host.example/p/"), F.col("page_id").cast("string"))
    starts = table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(k == 2, F.replace(url, F.lit("https:"), F.lit("http:"))).when(k == 3, F.concat(url, F.lit("#part"))).otherwise(url).alias("source_url"),
        F.when(k == 4, F.replace(url, F.lit("//"), F.lit("//me@"))).otherwise(url).alias("requested_url"),
        F.lit("2026-01-01T00:00:00Z").alias("started_at"),
        F.when(k == 6, "2026-01-01T01:00:00.0+01:00").otherwise("2026-01-01T00:00:00.001Z").alias("lease_until"),
        F.when(k == 5, "").otherwise("token").alias("lease_token"),
        F.struct(F.lit("fetch").alias("name"), F.when(k == 1, "2").otherwise("1").alias("version")).alias("method"),
        F.lit("r").alias("registry_digest"),
    )
    return capture.start_violations(starts, _methods(spark), "page_id")


@query(
    """WITH c AS (SELECT * FROM (VALUES (1, 17, 'navigation'), (2, 14, 'chain_acyclic'), (2, 17, 'navigation'), (3, 12, 'chain_contiguous'), (4, 11, 'chain_start'), (5, 13, 'chain_https'), (6, 7, 'status'), (7, 3, 'reason'), (8, 16, 'manual'),
 (9, 18, 'archive_time'), (10, 19, 'archive_order'), (11, 5, 'content'), (12, 6, 'media_type'), (13, 15, 'chain_end')) AS v(k, check_ordinal, code))
SELECT page_id, check_ordinal, code FROM pages JOIN c ON page_id % 15 = k"""
)
def q50_capture_attempts(spark, sf_dir):
    """Pages as outcomes of captures; thirteen in fifteen break a rule, some of them two."""
    k = F.col("page_id") % 15
    a = F.concat(F.lit("https://host.example/p/"), F.col("page_id").cast("string"))
    b, c, plain = F.concat(a, F.lit("/b")), F.concat(a, F.lit("/c")), F.replace(F.concat(a, F.lit("/b")), F.lit("https:"), F.lit("http:"))

    def but(usual, **cases):
        out = usual
        for name, value in cases.items():
            out = F.when(k == int(name[1:]), value).otherwise(out)
        return out

    def hop(x, y):
        return F.struct(x.alias("from"), y.alias("to"))

    none, bytes_ = F.lit(None).cast("string"), ~k.isin(6, 7, 13)
    chain = but(F.array(hop(a, b)), k1=F.array(hop(a, b)), k2=F.array(hop(a, b), hop(b, a)), k3=F.array(hop(a, b), hop(plain, c)), k4=F.array(hop(c, b)), k5=F.array(hop(a, plain), hop(plain, b)), k6=F.array(hop(a, b)), k8=F.lit(None))
    attempts = table(spark, sf_dir, "pages").select(
        "page_id",
        but(F.lit("captured"), k6=F.lit("unreachable"), k7=F.lit("transport_error"), k8=F.lit("manual_imported"), k13=F.lit("redirected_outside_authority")).alias("outcome"),
        but(none, k6=F.lit("http_status"), k7=F.lit("dns_failure")).alias("reason"),
        a.alias("source_url"),
        a.alias("requested_url"),
        but(b, k1=c, k2=b, k3=c, k6=none, k7=none, k8=none, k13=c).alias("final_url"),
        F.lit("2026-01-02T00:00:00Z").alias("checked_at"),
        but(none, k9=F.lit("2026-01-01T00:00:00Z"), k10=F.lit("2026-01-02T00:00:00.1Z")).alias("archive_snapshot_at"),
        chain.alias("redirect_chain"),
        F.when(k == 6, 200).when(~k.isin(7, 8, 13), 200).alias("response_status_code"),
        F.when(~k.isin(6, 7, 8, 12, 13), "text/html").alias("media_type"),
        F.when(bytes_ & (k != 11), "digest").alias("content_digest"),
        F.when(bytes_, F.octet_length("html")).cast("long").alias("content_bytes"),
        F.struct(but(F.lit("fetch"), k10=F.lit("archive")).alias("name"), F.lit("1").alias("version")).alias("method"),
        F.lit("r").alias("registry_digest"),
    )
    return capture.attempt_violations(attempts, _methods(spark), "page_id")


@query(
    """WITH m AS (SELECT s_nationkey AS registry, s_suppkey AS k FROM supplier), l AS (SELECT registry, 'm' || k || ':1' AS o, '{"capabilities":["a","c' || (k % 3) || '"],"name":"m' || k || '","version":"1"}' AS line FROM m)
SELECT registry, 'sha256:' || sha256('{"methods":[' || string_agg(line, ',' ORDER BY o) || ']}') AS registry_digest, count(*) AS n_methods FROM l GROUP BY registry"""
)
def q51_method_registries(spark, sf_dir):
    """Suppliers as the methods that the registry of their nation declares."""
    k = F.col("s_suppkey").cast("string")
    methods = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("registry"), F.concat(F.lit("m"), k).alias("name"), F.lit("1").alias("version"), F.array(F.concat(F.lit("c"), (F.col("s_suppkey") % 3).cast("string")), F.lit("a")).alias("capabilities"))
    return capture.registry_digests(methods)


# -- whole tables with planted faults --------------------------------------------------------------------------------


@query(
    f"""WITH {_MATCHES_SQL}, v AS (SELECT m.key_digest, CASE WHEN doc_id % 4 = 2 AND doc_id >= 12 THEN 'skip' WHEN doc_id % 4 IN (0, 1) AND target = ref THEN CASE WHEN t_ident <> ident THEN 'changed' ELSE 'skip' END ELSE 'hold' END AS verdict FROM m JOIN k USING (key_digest))
SELECT key_digest, count(*) AS n_matches, bool_or(verdict = 'changed') AS identity_changed FROM v WHERE verdict <> 'skip' GROUP BY 1"""
)
def q52_pull_request_conflicts(spark, sf_dir):
    """The matches of all documents, of any language, against the keys of one pull request."""
    keys, matches = _matches(spark, sf_dir)
    return identity.conflicts(keys, matches, {"kind": "pull_request", "repository": "main", "pull_request_number": 12, "head_sha": "other"})


@query(
    """WITH t AS (SELECT conv_id, turn + (turn + 2) // 5 + CASE WHEN conv_id % 4 = 0 THEN 1 ELSE 0 END AS turn FROM conversations UNION ALL SELECT conv_id, 100 FROM conversations WHERE turn <= 1 AND conv_id % 3 = 0),
p AS (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM t)
SELECT conv_id, turn, CASE WHEN p IS NULL THEN 'genesis' WHEN p = turn THEN 'repeated' ELSE 'gap' END AS code, CASE WHEN p IS NULL THEN 1 WHEN p = turn THEN 2 ELSE 3 END AS check_ordinal
FROM p WHERE (p IS NULL AND turn <> 0) OR p + 1 <> turn"""
)
def q53_position_faults(spark, sf_dir):
    """All turns, renumbered with gaps; a quarter of the conversations starts late, a third has its first turns once more, far behind."""
    c = table(spark, sf_dir, "conversations")
    late = F.when(F.col("conv_id") % 4 == 0, 1).otherwise(0)
    turns = c.select("conv_id", (F.col("turn") + F.floor((F.col("turn") + 2) / 5) + late).alias("turn"))
    again = c.where("turn <= 1 and conv_id % 3 = 0").select("conv_id", F.lit(100).cast("long").alias("turn"))
    return changes.position_violations(turns.union(again), "conv_id", "turn", 0)


@query(
    """SELECT e.event_id, CASE WHEN s.event_id IS NULL THEN 'no_start' WHEN e.event_type <> s.event_type THEN 'method' WHEN e.user_id % 3 <> s.user_id % 3 THEN 'url' WHEN e.ts < s.ts THEN 'too_early' ELSE 'settled' END AS verdict
FROM events e LEFT JOIN events s ON e.event_id = CASE WHEN s.event_id % 3 = 0 THEN -1 - s.event_id ELSE s.event_id + 1 END"""
)
def q54_all_settlements(spark, sf_dir):
    """Every event is a result and a reservation: of the event after it, or, if its number is divisible by 3, of none that there is."""
    e = table(spark, sf_dir, "events")
    url = (F.col("user_id") % 3).cast("string").alias("url")
    results = e.select("event_id", F.col("event_type").alias("method"), url, F.col("ts").alias("checked_at"))
    reserved = F.when(F.col("event_id") % 3 == 0, -1 - F.col("event_id")).otherwise(F.col("event_id") + 1)
    starts = e.select(reserved.alias("event_id"), F.col("event_type").alias("method"), url, F.col("ts").alias("started_at"))
    return authority.settlements(results, starts, "event_id").select("event_id", "verdict")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'undeclared' ELSE 'missing' END AS code FROM (SELECT DISTINCT CASE WHEN doc_id % 9 = 0 THEN -1 - doc_id ELSE doc_id END AS doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def q55_all_declared(spark, sf_dir):
    """All documents against the labels; a ninth of the documents under another number."""
    docs = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 9 == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"))
    return changes.set_differences(docs, table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT source || '/' || lang AS name, count(DISTINCT doc_id % 7) AS n_owners FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 7) > 1")
def q56_shared_names(spark, sf_dir):
    """Names that more than one of seven owners claims."""
    claims = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("name"), (F.col("doc_id") % 7).alias("owner"))
    return changes.shared_names(claims)


@query(
    rf"""SELECT page_id, CAST(octet_length(encode(url)) AS INTEGER) AS ascii_units, 'sha256-' || sha256(url) AS segment, 'sha256:' || sha256(url) AS restored, page_id % 3 <> 1 AS html,
 sha256(regexp_replace(regexp_replace(nfc_normalize(html), '{_SP}+', ' ', 'g'), '^ | $', '', 'g')) AS inline_sha256, page_id % 2 = 0 AS ascending FROM pages"""
)
def q57_text_rules(spark, sf_dir):
    """Lengths, path segments, media types and orders over all pages."""
    url, k = F.col("url"), F.col("page_id")
    segment = V.path_segment(V.sha256(url))
    kind = F.when(k % 3 == 0, "text/html").when(k % 3 == 1, "application/xhtml").otherwise("TEXT/HTML")
    order = F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"), F.lit("b")))
    return table(spark, sf_dir, "pages").select("page_id", V.utf16_length(url).alias("ascii_units"), segment.alias("segment"), V.from_path_segment(segment).alias("restored"), V.media_type_matches(kind, "text/*").alias("html"), F.sha2(V.normal_inline(F.col("html")), 256).alias("inline_sha256"), V.strictly_ascending(order).alias("ascending"))
