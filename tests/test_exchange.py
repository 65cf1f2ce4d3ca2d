import hashlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealwright.operators import exchange

D = "sha256:" + "a" * 64
BODY = ("text/plain", D, 3)
SCHEMA = T.StructType([T.StructField("id", T.StringType()), *exchange.RECORD.fields])


def record(name, outcome="responded", response=(200, [["etag", "x"]], BODY), reason=None, times=("2026-01-01T00:00:00Z", "2026-01-01T00:00:00.5Z"), method="GET", url="https://h.org/a", names=(), credentials=(), body=None):
    return (name, *times, outcome, (method, url, list(names), list(credentials), body), response, reason)


CASES = {
    "plain": (record("plain"), []),
    "failed": (record("failed", "transport_error", None, "dns_failure"), []),
    "unheard": (record("unheard", "transport_error", None, "bad_luck"), ["outcome"]),
    "times": (record("times", times=("never", "2026-01-01T00:00:00Z")), ["instants", "time_order"]),
    "names": (record("names", names=["a b"]), ["header_names"]),
    "twice": (record("twice", names=["a", "a"]), ["header_order"]),
    "scheme": (record("scheme", names=["a"], credentials=[(D, "basic", "a", "f", None)]), ["credentials", "credential_form"]),
    "many": (record("many", names=list("abcde"), credentials=[(D, "basic", x, None, None) for x in "abcde"]), ["credentials"]),
    "query_twice": (record("query_twice", url=f"https://h.org/?k={D}&k={D}", credentials=[(D, "query", None, None, "k")]), ["credential_query"]),
    "query_plus": (record("query_plus", url=f"https://h.org/?k={D}", credentials=[(D, "query", None, None, "k")]), []),
    "method": (record("method", method="TRACE"), ["method"]),
    "longest": (record("longest", response=(200, [["a", "\U0001f600" * 512]], BODY)), []),
    "longer": (record("longer", response=(200, [["a", "\U0001f600" * 512 + "x"]], BODY)), ["response_headers"]),
    "empty": (record("empty", response=(1000, [["a", ""]], ("", "d", -1))), ["status", "response_body", "response_headers"]),
    "most": (record("most", response=(200, [[f"h{i:02}", "x"] for i in range(33)], BODY)), ["response_headers"]),
}


def test_issues_and_seal(spark):
    df = exchange.sealed(spark.createDataFrame([r for r, _ in CASES.values()], SCHEMA))
    got = {r["id"]: (r["issues"], r["exchange_digest"]) for r in df.collect()}
    assert {k: v[0] for k, v in got.items()} == {k: codes for k, (_, codes) in CASES.items()}
    assert all((d is None) == bool(issues) for issues, d in got.values())
    text = '{"finished_at":"2026-01-01T00:00:00.5Z","outcome":"transport_error","reason":"dns_failure","request":{"body":null,"credentials":[],"header_names":[],"method":"GET","url":"https://h.org/a"},"started_at":"2026-01-01T00:00:00Z"}'
    assert got["failed"][1] == "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def test_unsealed(spark):
    df = exchange.sealed(spark.createDataFrame([r for r, _ in CASES.values()], SCHEMA)).where("size(issues) = 0").drop("issues")
    assert exchange.unsealed(df).count() == 0
    assert exchange.unsealed(df.withColumn("finished_at", F.lit("2027-01-01T00:00:00Z"))).count() == df.count()
    nothing = spark.createDataFrame([(None,) * len(SCHEMA)], SCHEMA)
    assert exchange.sealed(nothing).first()["exchange_digest"] is None
