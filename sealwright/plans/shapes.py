"""Queries over normal documents, strict records and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from sealwright.functions import values as V
from sealwright.operators import documents, intervals
from sealwright.plans.catalogue import _LINES, _SP, query
from sealwright.session import table


@query(
    rf"""WITH d AS (SELECT doc_id, doc_id % 8 AS k, text, n_chars FROM documents), n AS (SELECT doc_id, k, regexp_replace(regexp_replace({_LINES}, '^{_SP}+', ''), '{_SP}+$', '') AS t, n_chars FROM d)
SELECT doc_id, CASE WHEN k IN (2, 3) THEN 'json' WHEN k = 5 THEN 'html' WHEN k <> 4 THEN 'text' END AS kind,
 CASE k WHEN 3 THEN 'syntax' WHEN 4 THEN 'unsupported_media_type' WHEN 5 THEN 'html' WHEN 7 THEN 'encoding' ELSE CASE WHEN k <> 2 AND t = '' THEN 'empty_document' END END AS issue,
 CASE WHEN k = 2 THEN 'sha256:' || sha256('{{"a":"x","n":' || n_chars || '}}' || chr(10)) WHEN k IN (0, 1, 6) AND t <> '' THEN 'sha256:' || sha256(t || chr(10)) END AS digest FROM n"""
)
def q70_normal_documents(spark, sf_dir):
    """Documents under eight media types: text with and without a byte order mark, XML, JSON, and four that are refused."""
    k, text = F.col("doc_id") % 8, F.col("text")
    kinds = ["text/plain", "Text/Markdown; charset=utf-8", "application/ld+json", "application/json", "image/png", "text/html", "application/atom+xml", "text/plain"]
    plain = text.cast("binary")
    content = (
        F.when(k == 1, F.concat(F.lit("﻿"), text).cast("binary"))
        .when(k == 2, F.concat(F.lit('{"n": '), F.col("n_chars").cast("string"), F.lit(', "a" : "x"}')).cast("binary"))
        .when(k == 3, F.concat(F.lit("{"), text).cast("binary"))
        .when(k == 7, F.concat(plain, F.unhex(F.lit("FF"))))
        .otherwise(plain)
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", content.alias("content"), F.element_at(F.array(*[F.lit(x) for x in kinds]), (k + 1).cast("int")).alias("media_type"))
    out = documents.normal_documents(docs, ["application/json", "application/*+json"], ["application/*xml"])
    return out.select("doc_id", "normal.kind", "normal.issue", "normal.digest")


@query(
    """WITH d AS (SELECT doc_id, doc_id % 8 AS k FROM documents),
c AS (SELECT * FROM (VALUES (1, '$.note', 2, 'unknown_key'), (2, '$.kind', 3, 'missing'), (3, '$.basis_event_ids', 4, 'type'), (4, '$.subject_type', 5, 'value'), (5, '$', 1, 'syntax'), (6, '$.tombstone.when', 2, 'unknown_key'), (6, '$.tombstone.reason', 3, 'missing'), (7, '$.basis_event_ids[1]', 5, 'value')) AS t(k, path, check_ordinal, code))
SELECT doc_id, path, check_ordinal, code FROM d JOIN c USING (k)"""
)
def q71_strict_changes(spark, sf_dir):
    """A change record as JSON text for each document, seven in eight of them not of the strict shape."""
    k = F.col("doc_id") % 8
    sha = F.concat(F.lit('"sha256:'), F.sha2("text", 256), F.lit('"'))
    text = F.concat(
        F.lit("{"), F.when(k == 1, '"note":{"deep":[1]},').otherwise(""), F.when(k == 2, "").otherwise('"kind":"add",'), F.lit('"change_id":'), sha, F.lit(',"subject_type":'), F.when(k == 4, '"planet"').otherwise('"document"'),
        F.lit(',"subject_id":"d'), F.col("doc_id").cast("string"), F.lit('","basis_event_ids":'), F.when(k == 3, '{"a":1}').when(k == 7, F.concat(F.lit("["), sha, F.lit(',"none"]'))).otherwise(F.concat(F.lit("["), sha, F.lit("]"))),
        F.when(k == 6, ',"tombstone":{"when":"now"}').otherwise(""), F.when(k == 5, "").otherwise("}"),
    )
    shape = documents.change_shape(("add", "remove"), ("document",), (documents.Field(".reason", "string"),))
    return documents.strict_faults(table(spark, sf_dir, "documents").select("doc_id", text.alias("record")), "doc_id", "record", shape)


@query("""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n_active FROM lineitem JOIN (SELECT o_orderkey, o_custkey % 10 AS p, o_orderdate AS a FROM orders) o ON o.p = l_suppkey % 10 AND l_shipdate >= a AND l_shipdate < a + INTERVAL 1 DAY GROUP BY 1, 2""")
def q72_active_keys_of_a_large_registry(spark, sf_dir):
    """Every order as a key for one of ten purposes, valid for its day: those that are active when an item is shipped."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key_id"), (F.col("o_custkey") % 10).alias("p"), F.col("o_orderdate").cast("timestamp_ntz").alias("a"))
    keys = keys.select("p", "a", (F.col("a") + F.expr("INTERVAL 1 DAY")).alias("b"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), (F.col("l_suppkey") % 10).alias("p"), F.col("l_shipdate").cast("timestamp_ntz").alias("t"))
    active = intervals.counted(items, keys, ["p"], "t", "a", "b", "n_active").where("n_active > 0")
    return active.groupBy("l_orderkey", "l_linenumber").agg(F.sum("n_active").alias("n_active"))


@query(
    """WITH p AS (SELECT page_id, page_id % 8 AS k, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS u FROM pages)
SELECT page_id, CASE WHEN k IN (3, 4, 6) THEN NULL WHEN k = 5 THEN '/data/root/x' ELSE '/data/root/' || regexp_replace(u, '/$', '') END AS path FROM p"""
)
def q73_guarded_paths(spark, sf_dir):
    """Page addresses as paths below a folder: plain, with idle segments, absolute, escaping, the folder itself, and leaving it to come back."""
    k, u = F.col("page_id") % 8, F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    path = F.when(k == 1, F.concat(F.lit("./"), u)).when(k == 2, F.concat(F.lit("x/..//"), u)).when(k == 3, F.concat(F.lit("/"), u)).when(k == 4, F.concat(F.lit("../"), u)).when(k == 5, "../root/./x").when(k == 6, "x/..").otherwise(u)
    return table(spark, sf_dir, "pages").select("page_id", V.inside("/data/root/", path).alias("path"))


@query(
    """WITH l AS (SELECT doc_id, lang, n_chars, source FROM documents)
SELECT doc_id, 'sha256:' || sha256(concat('{', chr(10), '  "source": "', source, '",', chr(10), '  "sizes": [', chr(10), '    ', n_chars, ',', chr(10), '    {}', chr(10), '  ],', chr(10), '  "é": "', lang, '"', chr(10), '}', chr(10))) AS digest FROM l"""
)
def q74_pretty_records(spark, sf_dir):
    """Records for reading."""
    text = F.concat(F.lit('{"source":"'), "source", F.lit('","sizes":['), F.col("n_chars").cast("string"), F.lit('.0,{}],"é":"'), "lang", F.lit('"}'))
    return table(spark, sf_dir, "documents").select("doc_id", V.sha256(V.pretty_json(text)).alias("digest"))


@query(
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN sha1(text) WHEN 1 THEN sha256(text) END AS id FROM documents"""
)
def q75_object_ids(spark, sf_dir):
    """Digests as object ids: of both lengths, and four forms that are none."""
    k, a, b = F.col("doc_id") % 6, F.sha1("text"), F.sha2("text", 256)
    text = F.when(k == 0, a).when(k == 1, b).when(k == 2, F.upper(F.concat(F.lit("a"), F.substring(a, 2, 39)))).when(k == 3, F.substring(a, 1, 39)).when(k == 4, F.concat(a, F.lit("\n"))).otherwise(F.concat(F.lit("g"), F.substring(b, 2, 63)))
    return table(spark, sf_dir, "documents").select("doc_id", V.object_id(text).alias("id"))


@query(
    """WITH p AS (SELECT page_id, page_id % 7 AS k, split_part(url, '/', 3) AS host FROM pages)
SELECT page_id, CASE WHEN k = 1 THEN 4 WHEN k = 2 THEN 6 WHEN k = 4 AND page_id % 300 < 256 THEN 4 ELSE 0 END AS version FROM p"""
)
def q85_ip_hosts(spark, sf_dir):
    """Hosts of pages, and addresses of both versions made from their numbers: in brackets, out of range, with leading zeros, with a blank."""
    i, k = F.col("page_id"), F.col("page_id") % 7
    text = (
        F.when(k == 1, F.concat(F.lit("10."), (i % 256).cast("string"), F.lit(".0.1"))).when(k == 2, F.concat(F.lit("fe80::"), F.lower(F.hex(i % 65536)))).when(k == 3, "[::1]")
        .when(k == 4, F.concat(F.lit("1.2.3."), (i % 300).cast("string"))).when(k == 5, "010.1.1.1").when(k == 6, "127.0.0.1 ").otherwise(F.split("url", "/")[2])
    )
    return table(spark, sf_dir, "pages").select("page_id", V.ip_version(text).alias("version"))


@query(
    """WITH d AS (SELECT doc_id, doc_id % 5 AS k, lang, source, substr(text, 1, 40) AS t FROM documents),
a AS (SELECT doc_id, k, [nfc_normalize('e' || chr(769) || source), nfc_normalize('z' || lang), nfc_normalize('é' || t)] AS l, [nfc_normalize(lang), nfc_normalize(lang || t)] AS m FROM d)
SELECT doc_id, CASE WHEN k = 4 THEN NULL WHEN k = 3 THEN m[1] < m[2] WHEN k = 2 THEN false ELSE l[1] < l[2] AND l[2] < l[3] END AS ascending FROM a"""
)
def q86_canonical_order(spark, sf_dir):
    """Arrays of texts of documents, decomposed, repeated, ASCII or with a null: which of them ascend in canonical order."""
    k, t = F.col("doc_id") % 5, F.substring("text", 1, 40)
    usual = F.array(F.concat(F.lit("é"), "source"), F.concat(F.lit("z"), "lang"), F.concat(F.lit("é"), t))
    arrays = F.when(k == 4, F.array(F.lit("a"), F.lit(None))).when(k == 3, F.array("lang", F.concat("lang", t))).when(k == 2, F.array(F.lit("é"), F.lit("é"))).otherwise(usual)
    return table(spark, sf_dir, "documents").select("doc_id", V.canonically_ascending(arrays).alias("ascending"))
