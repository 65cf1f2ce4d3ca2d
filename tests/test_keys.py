from sealwright.operators import keys as K

PEM = "-----BEGIN PUBLIC KEY-----\nMCowBQYDK2VwAyEA" + "A" * 43 + "=\n-----END PUBLIC KEY-----\n"
SCHEMA = "key_id string, issuer_id string, purposes array<string>, public_key string, valid_from string, valid_until string, compromised_after_sequence long"
EARLY, LATE = "2026-01-01T00:00:00Z", "2026-01-01T01:00:00.5+01:00"


def test_registry_rules(spark):
    rows = [("ok", "i", ["a"], PEM, EARLY, LATE, 1), ("two", "i", ["a"], PEM, None, None, None), ("two", "i", ["a"], PEM, None, None, None), ("many", "", ["a", "a"], PEM[:-1], LATE, EARLY, 0), ("empty", "x" * 257, [], PEM.replace("A=", "B="), "never", None, None), ("same", "i", ["a"], PEM, EARLY, EARLY, None)]
    found = {}
    for r in K.registry_violations(spark.createDataFrame(rows, SCHEMA)).collect():
        found.setdefault(r["key_id"], set()).add(r["code"])
    assert found == {"two": {"named_twice"}, "many": {"issuer_id", "purposes", "interval", "sequence", "public_key"}, "empty": {"issuer_id", "purposes", "instants", "public_key"}, "same": {"interval"}}


def test_verdicts(spark):
    held = spark.createDataFrame([("k", "i", ["a"], PEM, EARLY, LATE, 5), ("free", "i", ["a"], PEM, None, None, None)], SCHEMA)
    cases = [("x", None, "a", None, None, "unknown_key"), ("k", "j", "a", EARLY, 1, "other_issuer"), ("k", None, "b", EARLY, 1, "purpose"), ("k", "i", "a", LATE, 1, "interval"), ("k", "i", "a", EARLY, 5, "compromised"), ("k", "i", "a", EARLY, 4, "authorized"), ("k", "i", "a", None, 4, "authorized"), ("k", "i", "a", EARLY, None, "compromised"), ("free", "i", "a", "never", None, "interval"), ("free", None, "a", None, None, "authorized"), (None, None, None, None, None, "unknown_key")]
    facts = spark.createDataFrame(cases, "key_id string, issuer_id string, purpose string, at string, sequence long, want string")
    assert all(r["verdict"] == r["want"] for r in K.key_verdicts(facts, held).collect()) and K.key_verdicts(facts, held).count() == len(cases)
