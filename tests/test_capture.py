import hashlib

from sealwright.operators import capture

ATTEMPT = """attempt_digest string, outcome string, reason string, source_url string, requested_url string, final_url string, checked_at string, archive_snapshot_at string,
redirect_chain array<struct<`from`: string, `to`: string>>, response_status_code int, media_type string, content_digest string, content_bytes long,
method struct<name: string, version: string>, registry_digest string"""
A, B, D = "https://h.org/a", "https://h.org/b", "https://other.org/"


def methods(spark):
    rows = [("r", "fetch", "1", ["direct"]), ("r", "render", "1", ["rendered-page"]), ("r", "manual", "1", ["manual-review"]), ("r", "archive", "1", ["history-only"])]
    return spark.createDataFrame(rows, "registry_digest string, name string, version string, capabilities array<string>")


def attempt(outcome="captured", **more):
    base = {"outcome": outcome, "reason": None, "source_url": A, "requested_url": A, "final_url": None, "checked_at": "2026-01-02T00:00:00Z", "archive_snapshot_at": None, "redirect_chain": [], "response_status_code": None, "media_type": None, "content_digest": None, "content_bytes": None, "method": ("fetch", "1"), "registry_digest": "r"}
    if outcome == "captured":
        base |= {"final_url": A, "response_status_code": 200, "media_type": "text/html", "content_digest": "d", "content_bytes": 1}
    return base | more


CASES = {
    "plain": (attempt(), set()),
    "redirected": (attempt(redirect_chain=[(A, B)], final_url=B), set()),
    "navigated": (attempt(final_url=B), {"navigation"}),
    "rendered": (attempt(final_url=B, method=("render", "1")), set()),
    "rendered_far": (attempt(final_url=D, method=("render", "1")), {"navigation"}),
    "cycle": (attempt(redirect_chain=[(A, B), (B, A)]), {"chain_acyclic"}),
    "gap": (attempt(redirect_chain=[(A, B), (D, "https://h.org/c")], final_url="https://h.org/c"), {"chain_contiguous"}),
    "other_start": (attempt(redirect_chain=[(B, D)], final_url=D), {"chain_start"}),
    "http_inside": (attempt(redirect_chain=[(A, "http://h.org/b"), ("http://h.org/b", B)], final_url=B), {"chain_https"}),
    "outside": (attempt("redirected_outside_authority", redirect_chain=[(A, "http://x.org/")], final_url="http://x.org/"), set()),
    "outside_elsewhere": (attempt("redirected_outside_authority", redirect_chain=[(A, B)], final_url=D), {"chain_end"}),
    "outside_alone": (attempt("redirected_outside_authority", final_url=D), {"redirect_count", "chain_end"}),
    "long": (attempt(redirect_chain=[(A if i == 0 else f"{A}{i}", f"{A}{i + 1}") for i in range(6)], final_url=f"{A}6"), {"redirect_count"}),
    "fragment": (attempt(source_url=A + "#x"), {"plain_url"}),
    "user": (attempt(source_url="https://me@h.org/"), {"plain_url"}),
    "unreachable": (attempt("unreachable", reason="http_status", response_status_code=404), set()),
    "unreachable_dns": (attempt("unreachable", reason="dns_failure", response_status_code=404), {"status"}),
    "other_reason": (attempt("transport_error", reason="dns_failure"), {"reason"}),
    "manual": (attempt("manual_imported", redirect_chain=None, content_digest="d", content_bytes=0, method=("manual", "1")), set()),
    "manual_fetch": (attempt("manual_imported", redirect_chain=None, content_digest="d", content_bytes=0), {"manual"}),
    "archive": (attempt(archive_snapshot_at="2026-01-01T00:00:00Z", method=("archive", "1")), set()),
    "archive_late": (attempt(archive_snapshot_at="2026-01-02T00:00:00.001Z", method=("archive", "1")), {"archive_order"}),
    "archive_none": (attempt(method=("archive", "1")), {"archive_time"}),
    "unknown_method": (attempt(registry_digest="other"), {"method", "manual", "archive_time"}),
    "nothing": (attempt("unheard"), {"outcome", "reason"}),
}


def test_outcomes(spark):
    names = "outcome reason source_url requested_url final_url checked_at archive_snapshot_at redirect_chain response_status_code media_type content_digest content_bytes method registry_digest".split()
    rows = [(k, *[v[n] for n in names]) for k, (v, _) in CASES.items()]
    found = {}
    for r in capture.attempt_violations(spark.createDataFrame(rows, ATTEMPT), methods(spark)).collect():
        found.setdefault(r["attempt_digest"], set()).add(r["code"])
    want = {k: codes for k, (_, codes) in CASES.items() if codes}
    assert found == want


def test_reservations(spark):
    schema = "start_digest string, source_url string, requested_url string, started_at string, lease_until string, lease_token string, method struct<name: string, version: string>, registry_digest string"
    early, late = "2026-01-01T00:00:00Z", "2026-01-01T00:00:00.5Z"
    rows = [("ok", A, B, early, late, "t", ("fetch", "1"), "r"), ("late", A, B, late, early, "t", ("fetch", "1"), "r"), ("same", A, B, late, late, "t", ("fetch", "1"), "r"), ("http", "http://h.org/", B, early, late, "", ("fetch", "2"), "r"), ("null", None, None, None, None, None, None, None)]
    found = {}
    for r in capture.start_violations(spark.createDataFrame(rows, schema), methods(spark)).collect():
        found.setdefault(r["start_digest"], set()).add(r["code"])
    assert found["late"] == found["same"] == {"lease"} and found["http"] == {"https", "lease_token", "method"} and "ok" not in found and {"method", "https", "lease"} <= found["null"]


def test_registries(spark):
    rows = [("r", "b", "1", ["y", "x"]), ("r", "a", "1", ["z"]), ("bad", "A", "1", ["x"]), ("bad", "a", "1", []), ("bad", "a", "1", ["x", "x"])]
    df = spark.createDataFrame(rows, "registry string, name string, version string, capabilities array<string>")
    text = '{"methods":[{"capabilities":["z"],"name":"a","version":"1"},{"capabilities":["x","y"],"name":"b","version":"1"}]}'
    got = {r["registry"]: r["registry_digest"] for r in capture.registry_digests(df).collect()}
    assert got["r"] == "sha256:" + hashlib.sha256(text.encode()).hexdigest()
    found = sorted((r["name"], r["code"]) for r in capture.method_violations(df).collect())
    assert found == [("A", "grammar"), ("a", "capabilities"), ("a", "capabilities"), ("a", "declared_twice")]
