"""Sealed captures, framed bytes and attestations against plain readings."""

import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealwright.functions import values
from sealwright.operators import attestation as A

REG = "sha256:" + "a" * 64
D = "sha256:" + "b" * 64


def sha(value):
    return "sha256:" + hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def methods(spark):
    return spark.createDataFrame([(REG, "web", "1", ["network"]), (REG, "desk", "1", ["manual-review"]), (REG, "web", "1", ["network"])], "registry_digest string, name string, version string, capabilities array<string>")


START = {"capture_key": D, "request_digest": D, "lease_token": "t é", "source_url": "https://a.example/", "requested_url": "https://a.example/x", "started_at": "2024-01-01T00:00:00Z", "lease_until": "2024-01-01T01:00:00Z", "method": {"name": "web", "version": "1"}, "method_registry_digest": REG}
ATTEMPT = {"source_url": "https://a.example/", "requested_url": "https://a.example/x", "checked_at": "2024-01-01T00:10:00Z", "method": {"name": "web", "version": "1"}, "method_registry_digest": REG, "outcome": "captured", "final_url": "https://a.example/y", "redirect_chain": [{"from": "https://a.example/x", "to": "https://a.example/y"}], "response_status_code": 200, "media_type": "text/html", "content_digest": D, "content_bytes": 7}
OUTSIDE = {k: v for k, v in ATTEMPT.items() if k in ("source_url", "requested_url", "checked_at", "method", "method_registry_digest")}


def df(spark, rows, kind):
    return spark.createDataFrame([tuple(r.get(f) for f in kind.fieldNames()) for r in rows], kind)


def test_sealed_starts_and_attempts(spark):
    rows = [START, START | {"lease_until": START["started_at"]}, START | {"method": {"name": "web", "version": "9"}}, START | {"capture_key": "no"}, START | {"method_registry_digest": None}, {}]
    got = A.sealed_starts(df(spark, rows, A.START), methods(spark)).collect()
    by = {tuple(r["issues"]): r["start_digest"] for r in got}
    assert by[()] == sha(START) and len(got) == 6
    assert {("lease",), ("method",), ("digests",), ("method", "digests")} <= set(by) and sum(d is not None for d in by.values()) == 1
    outs = [
        ATTEMPT,
        OUTSIDE | {"outcome": "transport_error", "reason": "tls_failure", "redirect_chain": []},
        OUTSIDE | {"outcome": "manual_imported", "method": {"name": "desk", "version": "1"}, "content_digest": D, "content_bytes": 0},
        ATTEMPT | {"redirect_chain": None, "final_url": ATTEMPT["requested_url"]},
        OUTSIDE | {"outcome": "transport_error", "reason": "tls_failure"},
        ATTEMPT | {"final_url": "https://b.example/"},
    ]
    got = A.sealed_attempts(df(spark, outs, A.ATTEMPT), methods(spark)).collect()
    sealed = {r["attempt_digest"] for r in got if r["attempt_digest"]}
    assert sealed == {sha(x) for x in outs[:3]}
    assert sorted(tuple(r["issues"]) for r in got if not r["attempt_digest"]) == [("navigation",), ("redirect_count",), ("redirect_count",)]


def test_unsealed(spark):
    s = A.sealed_starts(df(spark, [START, START | {"lease_token": "u"}], A.START), methods(spark)).drop("issues")
    assert A.unsealed(s, methods(spark), "start").count() == 0
    forged = s.withColumn("source_url", F.when(F.col("lease_token") == "u", "https://other.example/").otherwise(F.col("source_url")))
    assert [r["lease_token"] for r in A.unsealed(forged, methods(spark), "start").collect()] == ["u"]
    a = A.sealed_attempts(df(spark, [ATTEMPT], A.ATTEMPT), methods(spark)).drop("issues")
    assert A.unsealed(a, methods(spark), "attempt").count() == 0
    assert A.unsealed(a.withColumn("content_bytes", F.lit(8).cast("long")), methods(spark), "attempt").count() == 1


def test_framing_and_texts_of_bytes(spark):
    one = spark.range(1).select(A.preimage(["d.example", "v1"], F.lit('{"a":"é"}')).alias("p")).first()["p"]
    assert bytes(one) == b"d.example\0v1\0" + '{"a":"é"}'.encode()
    for bad in ([], [""], ["a\0b"]):
        with pytest.raises(ValueError):
            A.preimage(bad, F.lit("{}"))
    data = [bytes(range(n)) for n in range(70)] + [b"\xfb\xff\xfe" * 40]
    texts = [(base64.b64encode(x).decode(), base64.urlsafe_b64encode(x).decode().rstrip("="), bytearray(x)) for x in data]
    rows = spark.createDataFrame(texts, "t string, u string, x binary").select((A.from_base64(F.col("t")) == F.col("x")).alias("a"), (A.from_base64url(F.col("u")) == F.col("x")).alias("b")).collect()
    assert all(r["a"] and r["b"] for r in rows)
    bad = ["AB==", "AA=", "A", "AAA", "AA\n==", "A-==", "====", "AAAA=", None, " AAAA"]
    assert all(r[0] is None for r in spark.createDataFrame([(x,) for x in bad], "t string").select(A.from_base64(F.col("t"))).collect())
    bad = ["AB", "A", "AA==", "AA+A", "AAAAA", None, "AA\n"]
    assert all(r[0] is None for r in spark.createDataFrame([(x,) for x in bad], "t string").select(A.from_base64url(F.col("t"))).collect())


HEADER = {"algorithm": "ed25519", "issuer_id": "me", "key_id": "k1", "signature_purpose": "p", "signer_registry_digest": D, "signature": "A" * 86 + "=="}
PROTECTED = ", ".join(f"{k}: string" for k in HEADER)


def test_preimage_of_an_attestation_and_header_faults(spark):
    faults = {None: {}, "purpose": {"signature_purpose": "q"}, "names": {"issuer_id": "Me"}, "registry": {"signer_registry_digest": "x"}, "algorithm": {"algorithm": None}, "signature": {"signature": "A" * 85 + "B=="}}
    rows = spark.createDataFrame([(k, tuple((HEADER | v).values())) for k, v in faults.items()], f"want string, h struct<{PROTECTED}>")
    assert all(r["want"] == r["got"] for r in rows.select("want", A.header_fault(F.col("h"), "p").alias("got")).collect())
    got = rows.where("want is null").select(A.signature_preimage("dom", F.lit(D), F.col("h")).alias("z")).first()["z"]
    plain = {k: v for k, v in HEADER.items() if k != "signature"}
    assert bytes(got) == b"dom\0" + json.dumps({"attestation_digest": D, "protected": plain}, sort_keys=True, separators=(",", ":")).encode()


def test_signing_requests(spark):
    core = {"attempt_digest": D, "attestation_contract": "c", "capture_key": D, "method_registry_digest": D, "signed_at": "2024-01-01T00:00:00Z", "start_digest": D}
    rows = [("s", core, sha(core)), ("x", core, sha(core)), ("s", core | {"attestation_contract": "d"}, sha(core | {"attestation_contract": "d"})), ("s", core | {"capture_key": "no"}, sha(core)), ("s", core, D)]
    kind = "signing_contract string, core struct<" + ", ".join(f"{k}: string" for k in core) + ">, attestation_digest string"
    got = [r[0] for r in spark.createDataFrame([(a, tuple(b.values()), c) for a, b, c in rows], kind).coalesce(1).select(A.signing_request_issues("s", "c")).collect()]
    assert got == [[], ["contract"], ["core_contract"], ["core", "digest"], ["digest"]]


def test_trust_of_a_registry(spark):
    keys = spark.createDataFrame([("k1", "me", ["p"], "2024-01-01T00:00:00Z", None, 5)], "key_id string, issuer_id string, purposes array<string>, valid_from string, valid_until string, compromised_after_sequence long")
    rows = [("a", HEADER, "2024-06-01T00:00:00Z"), ("b", HEADER | {"signer_registry_digest": REG}, "2024-06-01T00:00:00Z"), ("c", HEADER | {"issuer_id": "you"}, "2024-06-01T00:00:00Z"), ("d", HEADER, "2023-12-31T23:59:59Z"), ("e", HEADER | {"key_id": "k2"}, "2024-06-01T00:00:00Z")]
    att = spark.createDataFrame([(i, tuple(h.values()), t) for i, h, t in rows], f"id string, protected struct<{PROTECTED}>, signed_at string")
    at = lambda n: {r["id"]: r["trust"] for r in A.trusted(att, keys, D, "p", n).collect()}
    assert at(4) == {"a": "authorized", "b": "other_registry", "c": "other_issuer", "d": "interval", "e": "unknown_key"}
    assert at(5)["a"] == at(None)["a"] == "compromised"


def test_one_start_that_settles_two_attempts(spark):
    start = A.sealed_starts(df(spark, [START], A.START), methods(spark)).drop("issues").cache()
    attempts = A.sealed_attempts(df(spark, [ATTEMPT, ATTEMPT | {"content_bytes": 8}], A.ATTEMPT), methods(spark)).drop("issues").cache()
    sd, ads = start.first()["start_digest"], sorted(r["attempt_digest"] for r in attempts.collect())
    made = []
    for a in ads:
        core = {"attempt_digest": a, "attestation_contract": "c", "capture_key": D, "method_registry_digest": REG, "signed_at": "2024-01-02T00:00:00Z", "start_digest": sd}
        made.append((*core.values(), sha(core), tuple(HEADER.values())))
    kind = "attempt_digest string, attestation_contract string, capture_key string, method_registry_digest string, signed_at string, start_digest string, attestation_digest string, protected struct<" + PROTECTED + ">"
    att = spark.createDataFrame(made, kind)
    judge = lambda a, s=start: [r["verdict"] for r in A.verdicts(s, attempts, a, methods(spark), "c", "p").collect()]
    assert judge(att) == ["two_attempts"] * 2
    assert judge(att.limit(1)) == ["proved"]
    assert judge(att.limit(1), start.union(start)) == ["repeated_start"]
    assert judge(att.limit(0)) == []


def test_ports_of_urls(spark):
    urls = {"https://h:80/": True, "https://h:0000080/": True, "https://h:65536/": False, "https://h:99999999999/": False}
    got = {r["u"]: r["p"] for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", values.plain_url(F.col("u")).alias("p")).collect()}
    assert got == urls


def test_records_of_all_characters_and_whole_rows_that_are_not_sorted(spark):
    kind = T.StructType([T.StructField("a", T.StringType()), T.StructField("l", T.ArrayType(T.StructType([T.StructField("x", T.StringType())]))), T.StructField("m", T.MapType(T.StringType(), T.LongType())), T.StructField("n", T.LongType()), T.StructField("t", T.BooleanType())])
    want = [{"a": t, "l": [{"x": t}, {"x": None}, None], "m": {t: 2**60}, "n": None, "t": True} for t in ("", "plain ~", 'q"\\', "\n\x01\x7f", "é", '中"\n')]
    want.append({"a": None, "l": None, "m": None, "n": -1, "t": None})
    rows = spark.createDataFrame([(json.dumps(w, sort_keys=True, separators=(",", ":"), ensure_ascii=False), w) for w in want], T.StructType().add("want", "string").add("c", kind))
    got = rows.select("want", values.canonical(F.col("c"), kind).alias("got"))
    assert all(r["want"] == r["got"] for r in got.collect())
    text = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" in text(got) or "StructsToJson" in text(got)
    start = A.sealed_starts(df(spark, [START], A.START), methods(spark)).drop("issues")
    attempt = A.sealed_attempts(df(spark, [ATTEMPT], A.ATTEMPT), methods(spark)).drop("issues")
    kind = ", ".join(f"{n}: string" for n in (*A.CORE.fieldNames(), "attestation_digest"))
    none = spark.createDataFrame([], f"{kind}, protected struct<{PROTECTED}>")
    plan = text(A.verdicts(start, attempt, none.unionByName(none), methods(spark), "c", "p"))
    assert "first(struct" not in plan and "first(named_struct" not in plan
    assert "array_compact" not in str(A.issues_of({"a": F.lit(False)}))
