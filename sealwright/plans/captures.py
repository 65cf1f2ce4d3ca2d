"""Queries over sealed captures, their attestations, and normal forms of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sealwright.operators import attestation, capture
from sealwright.plans.catalogue import query
from sealwright.session import table, written

CONTRACT, PURPOSE, DOMAIN = "sealwright.attestation/v1", "sealwright-capture", "sealwright.signature/v1"
_REGISTRY = "'sha256:' || sha256('{\"methods\":[{\"capabilities\":[\"network\"],\"name\":\"web\",\"version\":\"1\"}]}')"
#: e: an event as a capture; start and attempt: their canonical texts.
_SEALED = f"""e AS (SELECT event_id, event_id % 16 AS k, 'https://h.example/' || user_id AS u, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS t, 'sha256:' || sha256(event_type) AS ck, 'sha256:' || sha256(CAST(event_id AS VARCHAR)) AS rd, octet_length(encode(event_type)) AS n, {_REGISTRY} AS reg FROM events),
x AS (SELECT *, '{{"capture_key":"' || ck || '","lease_token":"t' || event_id || '","lease_until":"9999-12-31T00:00:00Z","method":{{"name":"web","version":"1"}},"method_registry_digest":"' || reg || '","request_digest":"' || rd || '","requested_url":"' || u || '","source_url":"' || u || '","started_at":"' || t || '"}}' AS start,
 '{{"checked_at":"' || t || '","content_bytes":' || n || ',"content_digest":"' || ck || '","final_url":"' || u || '","media_type":"text/html","method":{{"name":"web","version":"1"}},"method_registry_digest":"' || reg || '","outcome":"captured","redirect_chain":[],"requested_url":"' || u || '","response_status_code":200,"source_url":"' || u || '"}}' AS attempt FROM e)"""


def _methods(spark):
    declared = spark.createDataFrame([("r", "web", "1", ["network"])], "registry string, name string, version string, capabilities array<string>")
    return declared.join(capture.registry_digests(declared), "registry").select("registry_digest", "name", "version", "capabilities")


def _events(spark, sf_dir):
    """Events as captures; k deals the cases. They are few bytes and much work, so they are dealt over all tasks, however few files hold them."""
    named = "sha256:" + __import__("hashlib").sha256(b'{"methods":[{"capabilities":["network"],"name":"web","version":"1"}]}').hexdigest()
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "ts").repartition("event_id").select("event_id", "event_type", (F.col("event_id") % 16).alias("k"), F.concat(F.lit("https://h.example/"), F.col("user_id").cast("string")).alias("u"), at.alias("t"))
    return e.select("event_id", "k", "u", "t", F.concat(F.lit("sha256:"), F.sha2("event_type", 256)).alias("ck"), F.octet_length("event_type").cast("long").alias("n"), F.lit(named).alias("reg"), F.concat(F.lit("sha256:"), F.sha2(F.col("event_id").cast("string"), 256)).alias("rd"))


def _start_columns():
    method = F.struct(F.lit("web").alias("name"), F.lit("1").alias("version"))
    return {
        "capture_key": F.col("ck"), "request_digest": F.col("rd"), "lease_token": F.concat(F.lit("t"), F.col("event_id").cast("string")), "source_url": F.col("u"), "requested_url": F.col("u"), "started_at": F.col("t"),
        "lease_until": F.lit("9999-12-31T00:00:00Z"), "method": method, "method_registry_digest": F.col("reg"),
    }


def _attempt_columns():
    none = F.lit(None).cast("string")
    return {
        "source_url": F.col("u"), "requested_url": F.col("u"), "checked_at": F.col("t"), "method": F.struct(F.lit("web").alias("name"), F.lit("1").alias("version")), "method_registry_digest": F.col("reg"), "outcome": F.lit("captured"), "reason": none,
        "final_url": F.col("u"), "redirect_chain": F.array().cast("array<struct<from: string, to: string>>"), "response_status_code": F.lit(200), "media_type": F.lit("text/html"), "content_digest": F.col("ck"), "content_bytes": F.col("n"), "archive_snapshot_at": none,
    }


@query(
    f"""WITH {_SEALED} SELECT event_id, CASE k WHEN 1 THEN 'https' WHEN 2 THEN 'plain_url' WHEN 3 THEN 'lease' WHEN 4 THEN 'method' WHEN 5 THEN 'lease_token' WHEN 6 THEN 'digests' ELSE '' END AS start_issues,
 CASE WHEN k = 0 OR k > 6 THEN 'sha256:' || sha256(start) END AS start_digest, CASE k WHEN 8 THEN 'redirect_count' WHEN 9 THEN 'status' WHEN 10 THEN 'digests' WHEN 11 THEN 'instants' WHEN 12 THEN 'navigation' ELSE '' END AS attempt_issues,
 CASE WHEN k < 8 OR k > 12 THEN 'sha256:' || sha256(attempt) END AS attempt_digest FROM x"""
)
def q67_sealed_captures(spark, sf_dir):
    """Every event as a reservation and as an outcome; eleven in sixteen break a rule of one of them and are not sealed."""
    e, k, methods = _events(spark, sf_dir), F.col("k"), _methods(spark)
    s = _start_columns()
    s["source_url"] = F.when(k == 1, F.replace("u", F.lit("https"), F.lit("http"))).when(k == 2, F.concat("u", F.lit("#x"))).otherwise(F.col("u"))
    s["lease_until"] = F.when(k == 3, F.col("t")).otherwise(s["lease_until"])
    s["method"] = F.struct(F.lit("web").alias("name"), F.when(k == 4, "2").otherwise("1").alias("version"))
    s["lease_token"] = F.when(k == 5, "").otherwise(s["lease_token"])
    s["request_digest"] = F.when(k == 6, "none").otherwise(s["request_digest"])
    a = _attempt_columns()
    a["redirect_chain"] = F.when(k != 8, a["redirect_chain"])
    a["response_status_code"] = F.when(k == 9, 404).otherwise(200)
    a["content_digest"] = F.when(k == 10, "none").otherwise(F.col("ck"))
    a["checked_at"] = F.when(k == 11, "yesterday").otherwise(F.col("t"))
    a["final_url"] = F.when(k == 12, "https://h.example/elsewhere").otherwise(F.col("u"))
    starts = attestation.sealed_starts(e.select("event_id", *[v.alias(n) for n, v in s.items()]), methods)
    attempts = attestation.sealed_attempts(e.select("event_id", *[v.alias(n) for n, v in a.items()]), methods)
    one = starts.select("event_id", F.array_join("issues", ",").alias("start_issues"), "start_digest")
    return one.join(attempts.select("event_id", F.array_join("issues", ",").alias("attempt_issues"), "attempt_digest"), "event_id")


@query(
    """SELECT event_id, CASE event_id % 16 WHEN 1 THEN 'signature' WHEN 2 THEN 'digest' WHEN 3 THEN 'too_early' WHEN 4 THEN 'core' WHEN 5 THEN 'no_start' WHEN 6 THEN 'no_attempt' WHEN 7 THEN 'url' WHEN 8 THEN 'start' WHEN 9 THEN 'algorithm'
 WHEN 10 THEN 'repeated' WHEN 11 THEN 'attempt' WHEN 12 THEN 'contract' WHEN 13 THEN 'before_start' WHEN 14 THEN 'purpose' ELSE 'proved' END AS verdict FROM events
UNION ALL SELECT event_id, 'repeated' FROM events WHERE event_id % 16 = 10"""
)
def q68_attestation_verdicts(spark, sf_dir):
    """Every event as a sealed reservation, a sealed outcome and their attestation, fourteen in sixteen of which do not prove a capture."""
    e, k, methods = _events(spark, sf_dir), F.col("k"), _methods(spark)
    a = _attempt_columns()
    other = F.when(k == 7, F.concat("u", F.lit("/other"))).otherwise(F.col("u"))
    a |= {"requested_url": other, "final_url": other, "checked_at": F.when(k == 13, "1999-01-01T00:00:00Z").otherwise(F.col("t"))}
    starts = written(attestation.sealed_starts(e.select("event_id", "k", *[v.alias(n) for n, v in _start_columns().items()]), methods).drop("issues"), "starts")
    # the number of the event as the size of its bytes keeps outcomes apart
    outcomes = attestation.sealed_attempts(e.select("event_id", "k", *[v.alias(n) for n, v in (a | {"content_bytes": F.col("event_id")}).items()]), methods).drop("issues")
    attempts = written(outcomes, "attempts")
    both = starts.select("event_id", "k", F.struct("capture_key", "start_digest", "method_registry_digest", "started_at").alias("s")).join(attempts.select("event_id", F.struct("attempt_digest").alias("r")), "event_id")
    signed = F.when(k == 3, "1999-01-01T00:00:00Z").otherwise("2999-01-01T00:00:00+01:00")
    core = both.select("event_id", "k", attestation.core(CONTRACT, F.col("s"), F.col("r"), signed).alias("c")).select("event_id", "k", "c.*")
    core = core.withColumn("capture_key", F.when(k == 4, F.concat(F.lit("sha256:"), F.sha2(F.lit("x"), 256))).otherwise(F.col("capture_key"))).withColumn("attestation_contract", F.when(k == 12, "other").otherwise(F.lit(CONTRACT)))
    own = attestation.digest(F.struct(*attestation.CORE.fieldNames()), attestation.CORE)
    core = core.withColumn("attestation_digest", F.when(k == 2, F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("y"), F.col("event_id").cast("string")), 256))).otherwise(own))
    signature = F.concat(F.repeat(F.lit("A"), 85), F.when(k == 1, "B").otherwise("A"), F.lit("=="))
    header = F.struct(F.when(k == 9, "rsa").otherwise("ed25519").alias("algorithm"), F.lit("issuer").alias("issuer_id"), F.lit("key").alias("key_id"), F.when(k == 14, "other").otherwise(PURPOSE).alias("signature_purpose"), F.lit("sha256:" + "0" * 64).alias("signer_registry_digest"), signature.alias("signature"))
    made = written(core.withColumn("protected", header), "attestations")
    given = made.unionByName(made.where("k = 10")).drop("event_id", "k")
    held = starts.where("k <> 5").withColumn("lease_token", F.when(k == 8, "stolen").otherwise(F.col("lease_token"))).drop("event_id", "k")
    results = attempts.where("k <> 6").withColumn("media_type", F.when(k == 11, "text/plain").otherwise(F.col("media_type"))).drop("event_id", "k")
    judged = attestation.verdicts(held, results, given, methods, CONTRACT, PURPOSE)
    return judged.join(made.select("attestation_digest", "event_id"), "attestation_digest").select("event_id", "verdict")


@query(
    f"""WITH h AS (SELECT event_id, '{{"attestation_digest":"sha256:' || sha256(CAST(event_id AS VARCHAR)) || '","protected":{{"algorithm":"ed25519","issuer_id":"' || lower(event_type) || '","key_id":"k' || user_id || '","signature_purpose":"{PURPOSE}","signer_registry_digest":"sha256:' || sha256(event_type) || '"}}}}' AS p FROM events),
f AS (SELECT event_id, encode('{DOMAIN}' || chr(1) || p) AS framed FROM h),
b AS (SELECT event_id, 'sha256:' || sha256(unhex(replace(hex(framed), hex(encode('{DOMAIN}')) || '01', hex(encode('{DOMAIN}')) || '00'))) AS preimage_digest, unhex(replace(hex(framed), hex(encode('{DOMAIN}')) || '01', hex(encode('{DOMAIN}')) || '00')) AS z FROM f)
SELECT event_id, preimage_digest, CASE WHEN event_id % 5 <> 1 THEN 'sha256:' || sha256(z) END AS from_text, CASE WHEN event_id % 5 NOT IN (2, 3) THEN 'sha256:' || sha256(z) END AS from_url_text FROM b"""
)
def q69_framed_bytes(spark, sf_dir):
    """The bytes to sign of every event, and what their base-64 texts give back; some texts are padded, cut or of the other alphabet."""
    k = F.col("event_id") % 5
    sha = lambda c: F.concat(F.lit("sha256:"), F.sha2(c, 256))
    header = F.struct(F.lit("ed25519").alias("algorithm"), F.lower("event_type").alias("issuer_id"), F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key_id"), F.lit(PURPOSE).alias("signature_purpose"), sha(F.col("event_type")).alias("signer_registry_digest"))
    rows = table(spark, sf_dir, "events").select("event_id", attestation.signature_preimage(DOMAIN, sha(F.col("event_id").cast("string")), header).alias("z"))
    rows = rows.withColumn("text", F.regexp_replace(F.base64("z"), r"[\r\n]", ""))
    url = F.rtrim(F.translate("text", "+/", "-_"), F.lit("="))
    text = F.when(k == 1, F.concat("text", F.lit("="))).otherwise(F.col("text"))
    url = F.when(k == 2, F.concat(url, F.lit("="))).when(k == 3, F.concat(F.lit("+"), F.substring(url, 2, 1 << 20))).otherwise(url)
    return rows.select("event_id", sha(F.col("z")).alias("preimage_digest"), sha(attestation.from_base64(text)).alias("from_text"), sha(attestation.from_base64url(url)).alias("from_url_text"))
