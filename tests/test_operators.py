import hashlib
import random

from pyspark.sql import functions as F

from sealwright.operators import authority, changes, identity, projection


def split(rows, limit, prefix=""):
    """Direct recursion, as a model of the layout."""
    if prefix and (sum(len(x[1]) + 1 for x in rows) <= limit or len(prefix) == 4):
        return {x[0]: prefix for x in rows}
    out = {}
    for digit in "0123456789abcdef":
        own = [x for x in rows if hashlib.sha256(x[0].encode()).hexdigest().startswith(prefix + digit)]
        if own:
            out |= split(own, limit, prefix + digit)
    return out


def test_layout_equals_recursion(spark):
    rng = random.Random(1)
    rows = [(f"record_{i}", "x" * rng.randint(5, 60)) for i in range(300)]
    for limit in (200, 900):
        got = {r["id"]: r["path"] for r in projection.placed(spark.createDataFrame(rows, "id string, line string"), limit).collect()}
        assert got == {k: f"data/{p}.jsonl" for k, p in split(rows, limit).items()}


def test_successor_keeps_the_rows(spark):
    rows = {f"r{i}": f"line {i}" * 3 for i in range(200)}
    base = projection.placed(spark.createDataFrame(list(rows.items()), "id string, line string"), 400).select("id", "line", "path")
    change = {"r3": None, "r5": "much longer " * 20, "new": "n", "unknown": None}
    df = spark.createDataFrame(list(change.items()), "id string, line string")
    leaves = base.select("path").distinct()
    touched = {r["path"] for r in projection.affected(df.select("id"), leaves).collect()}
    after = {r["id"]: r["line"] for r in projection.successor(base, leaves, df, 400).collect()}
    rest = {r["id"]: r["line"] for r in base.collect() if r["path"] not in touched}
    want = {k: v for k, v in (rows | change).items() if v is not None}
    assert not set(after) & set(rest) and after | rest == want


def test_closure_depth_and_cycles(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(200)] + [("x", "y"), ("y", "z"), ("z", "x"), ("tail", "x")]
    got = {r["src"]: (r["root"], r["steps"]) for r in identity.closure(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got["n0"] == ("n200", 200) and got["n199"] == ("n200", 1)
    assert all(got[k] == (None, None) for k in ("x", "y", "z", "tail"))


def test_ambiguous_and_closure_violations(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("d", "b")], "src string, dst string")
    assert [r["src"] for r in identity.ambiguous(edges).collect()] == ["a"]
    resolved = identity.closure(edges.where("dst = 'b'"))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    found = {(r["src"], r["code"]) for r in identity.closure_violations(resolved, ids("a"), ids("c")).collect()}
    assert found == {("d", "not_historical"), ("a", "not_current"), ("d", "not_current")}


def test_paths(spark):
    paths = spark.createDataFrame([("places.json",), ("places.json/one",), ("A",), ("7",), ("a",), ("a",)], "path string")
    found = {(r["path"], r["code"]) for r in changes.path_violations(paths).collect()}
    assert found == {("A", "grammar"), ("7", "grammar"), ("a", "repeated"), ("places.json", "contains")}
    entries = spark.createDataFrame([("a", "one"), ("places.json", "two")], "entry string, owner string")
    owned = {r["path"]: r["owner"] for r in changes.owners(spark.createDataFrame([("a/x.json",), ("ab/x.json",), ("places.json",)], "path string"), entries).collect()}
    assert owned == {"a/x.json": "one", "ab/x.json": None, "places.json": "two"}


def test_key_intervals_are_half_open_on_both_ways(spark, monkeypatch):
    keys = spark.createDataFrame([("a", "sign", None, 10, None), ("b", "sign", 10, None, 5)], "key_id string, purpose string, valid_from long, valid_until long, compromised_after_sequence long")
    facts = spark.createDataFrame([(1, 9, 1), (2, 10, 4), (3, 10, 5), (4, 11, None)], "i int, at long, seq long")
    ask = lambda: {r["i"]: r["key_id"] for r in authority.active_keys(facts, keys, F.col("at"), F.lit("sign"), F.col("seq")).collect()}
    assert ask() == {1: "a", 2: "b", 3: None, 4: None}
    monkeypatch.setattr(authority, "MOST_KEYS", 1)
    assert ask() == {1: "a", 2: "b", 3: None, 4: None}


def test_conflict_rules(spark):
    keys = spark.createDataFrame([("k", "me", "id1")], "key_digest string, key_reference string, key_identity_digest string")
    schema = "key_digest string, kind string, repository string, pull_request_number long, head_sha string, target_reference string, target_identity_digest string"
    rows = [("k", "live", None, None, None, "me", "id1"), ("k", "live", None, None, None, "me", "id2"), ("k", "open_pull_request", "r", 5, "h", "x", None), ("k", "open_pull_request", "r", 9, "h", "x", None), ("k", "open_pull_request", "r", 3, "h", "x", None), ("k", "open_pull_request", "other", 9, "h", "x", None)]
    got = identity.conflicts(keys, spark.createDataFrame(rows, schema), {"kind": "pull_request", "repository": "r", "pull_request_number": 5, "head_sha": "h"}).first()
    assert (got["n_matches"], got["identity_changed"]) == (3, True)


def test_contradicting_matches(spark):
    keys = spark.createDataFrame([("k", "me", "id1"), ("two", "me", "id1"), ("two", "me", "id2")], "key_digest string, key_reference string, key_identity_digest string")
    schema = "key_digest string, kind string, repository string, pull_request_number long, head_sha string, candidate_reference string, candidate_digest string, target_reference string, target_identity_digest string"
    rows = [("gone", "live", None, None, None, None, None, "x", "id"), ("k", "open_pull_request", "r", 5, "other", None, None, "x", None), ("k", "pending_submission", None, None, None, "cand", "d2", "x", None)]
    matches = spark.createDataFrame(rows, schema)
    asked = {"kind": "pull_request", "repository": "r", "pull_request_number": 5, "head_sha": "h"}
    assert {(r["key_digest"], r["code"]) for r in identity.conflict_violations(keys, matches, asked).collect()} == {("gone", "unknown_key"), ("k", "other_head"), ("two", "repeated_key")}
    asked = {"kind": "candidate", "candidate_reference": "cand", "candidate_digest": "d1"}
    assert {(r["key_digest"], r["code"]) for r in identity.conflict_violations(keys, matches, asked).collect()} == {("gone", "unknown_key"), ("k", "other_candidate"), ("two", "repeated_key")}


def test_refused_headers(spark):
    many = [(f"x-{i}", "v") for i in range(33)]
    rows = [(0, many), (1, many[:32]), (2, many[:32] + [("X-0", " v ")]), *[(3 + i, [(n, ""), ("a", "b")]) for i, n in enumerate(authority.UNRECORDABLE)], (9, [("Set-Cookie", "x"), *many]), (10, [])]
    df = spark.createDataFrame(rows, "i int, h array<struct<name string, value string>>")
    got = {r["i"]: (r["issues"], r["n"]) for r in df.select("i", authority.header_issues(F.col("h")).alias("issues"), F.size(F.coalesce(authority.recordable_headers(F.col("h")), F.lit(None))).alias("n")).collect()}
    assert got[0] == (["too_many"], -1) or got[0] == (["too_many"], None)
    assert got[1] == ([], 32) and got[2] == ([], 32) and got[10] == ([], 0)
    assert all(got[3 + i][0] == ["unrecordable"] for i in range(6)) and got[9][0] == ["unrecordable", "too_many"]


def test_headers(spark):
    df = spark.createDataFrame([([("X-RateLimit-Remaining", "99"), ("Content-Type", " application/json "), ("content-type", "application/json"), ("Empty", " ")],)], "h array<struct<name string, value string>>")
    assert [tuple(x) for x in df.select(authority.recordable_headers(F.col("h")).alias("h")).first()["h"]] == [("content-type", "application/json"), ("x-ratelimit-remaining", "99")]


def test_chain_and_seal(spark):
    df = spark.createDataFrame([("c", 2, "b"), ("c", 1, "a")], "chain string, n int, text string")
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert changes.chain_heads(df, "chain", ["n"], "text", F.lit("seed")).first()["head"] == h(h("seed:a") + ":b")
    sealed = changes.sealed(df, ["chain", "n"])
    assert changes.unsealed(sealed, ["chain", "n"]).count() == 0
    assert changes.unsealed(sealed.withColumn("n", F.col("n") + 1), ["chain", "n"]).count() == 2


TRANSITIONS = "ord int, kind string, surviving string, retired array<string>, original string, continuing string, new array<string>, predecessor string, successor string, predecessor_retires boolean, subject string"


def test_transitions(spark):
    rows = [
        (1, "merge", "b", ["a"], None, None, None, None, None, None, None),
        (2, "split", None, None, "s", "c", ["b", "c"], None, None, None, None),
        (3, "merge", "d", ["b"], None, None, None, None, None, None, None),
        (4, "succession", None, None, None, None, None, "d", "e", True, None),
        (5, "succession", None, None, None, None, None, "g", "h", False, None),
        (6, "retirement", None, None, None, None, None, None, None, None, "r"),
    ]
    t = spark.createDataFrame(rows, TRANSITIONS)
    assert {r["src"]: r["root"] for r in identity.resolutions(t).collect()} == {"a": "e", "b": "e", "d": "e", "s": "c"}
    assert {(r["original"], r["child"]) for r in identity.split_branches(t).collect()} == {("s", "c"), ("s", "e")}
    assert {r["subject"] for r in identity.retired_subjects(t).collect()} == {"a", "b", "d", "r", "s"}
    assert identity.transition_violations(t).count() == 0
    kept = spark.createDataFrame([(1, "split", None, None, "a", "a", ["b"], None, None, None, None), (2, "split", None, None, "x", None, ["y", "z"], None, None, None, None)], TRANSITIONS)
    assert {(r["original"], r["child"]) for r in identity.split_branches(kept).collect()} == {("a", "b"), ("x", "y"), ("x", "z")}
    assert {r["subject"] for r in identity.retired_subjects(kept).collect()} == {"x"} and identity.resolutions(kept).count() == 0


def test_refused_transitions(spark):
    def row(kind, surviving=None, retired=None, original=None, continuing=None, new=None, predecessor=None, successor=None):
        return (1, kind, surviving, retired, original, continuing, new, predecessor, successor, True if kind == "succession" else None, None)

    rows = [
        row("merge", "a", ["b", "b"]),
        row("merge", "a2", []),
        row("merge", "c", ["c", "d"]),
        row("split", original="e", new=["e", "f"]),
        row("succession", predecessor="g", successor="g"),
        row("split", original="h", continuing="x", new=["i"]),
        row("split", original="j", continuing="j", new=["k"]),
        row("split", original="j", continuing="j", new=["l"]),
        row("merge", "m", ["o"]),
        row("merge", "n", ["o"]),
        row("succession", predecessor="p", successor="q"),
        row("succession", predecessor="q", successor="p"),
        row("split", original="r", continuing="r", new=["t", "s"]),
        row("split", original="r", continuing="r", new=["s", "t"]),
    ]
    got = {(r["subject"], r["code"]) for r in identity.transition_violations(spark.createDataFrame(rows, TRANSITIONS)).collect()}
    want = {("a", "not_distinct"), ("a2", "not_distinct"), ("c", "self_merge"), ("e", "self_split"), ("g", "self_succession"), ("h", "not_new"), ("j", "other_split"), ("o", "two_resolutions"), ("p", "cycle"), ("q", "cycle"), ("d", "cycle")}
    assert want <= got and {s for s, _ in got} == {s for s, _ in want}


def test_dataset_card():
    import pytest
    from pyspark.sql import types as T

    from sealwright.sources.cards import dataset_features

    schema = T.StructType([T.StructField("record_id", T.StringType(), False), T.StructField("website", T.StringType()), T.StructField("details", T.StructType([T.StructField("amount", T.DoubleType())]))])
    assert dataset_features(schema) == "dataset_info:\n  config_name: default\n  features:\n  - name: record_id\n    dtype: string\n  - name: website\n    dtype: json\n  - name: details\n    dtype: json\n"
    for bad in (T.StructType([]), T.StructType([T.StructField("bad:key", T.StringType())])):
        with pytest.raises(ValueError):
            dataset_features(bad)


def test_current_record_issues(spark):
    d = "sha256:" + "0" * 64
    rows = [("one", "document", "a", "s", d), ("one", "document", d, "s", d), ("One", "", "a b", "S", "d"), (None,) * 5]
    df = spark.createDataFrame(rows, "instance_id string, kind string, id string, subject_id string, revision string")
    everything = ["instance_id", "kind", "id", "subject_id", "revision"]
    assert [r[0] for r in df.select(identity.current_record_issues()).collect()] == [[], [], everything, everything]


def test_shard_reader(spark):
    path = {i: projection.shard_path(F.lit(i), 1) for i in ("a", "b")}
    own = {i: spark.range(1).select(p.alias("p")).first()["p"] for i, p in path.items()}
    files = spark.createDataFrame([(own["a"], bytearray(b'{"id":"a"}\n')), (own["b"], None), ("data/0.jsonl", bytearray(b"[]\n")), ("data/1.jsonl", bytearray(b"\n"))], "path string, content binary")
    assert {(r["path"], r["code"]) for r in projection.shard_violations(files).collect()} == {("data/0.jsonl", "row"), ("data/1.jsonl", "blank_row")}
    assert [(r["path"], r["id"]) for r in projection.shard_rows(files.where("content = cast('{\"id\":\"a\"}\n' as binary)")).collect()] == [(own["a"], "a")]


def test_manifest_rules(spark):
    d = "sha256:" + "0" * 64
    schema = "source_release_id string, source_sequence long, projector_digest string, path string, digest string, bytes long, rows long"

    def issue(*entries, release=d):
        m = projection.manifest(spark.createDataFrame([(release, 1, d, *e) for e in entries], schema), "c/v1", 100)
        return projection.parsed_manifest(m, "c/v1").first()["issue"]

    assert issue(("data/1.jsonl", d, 5, 1), ("data/2.jsonl", d, 100, 2)) is None
    assert issue(("data/1.jsonl", d, 5, 1), ("data/12.jsonl", d, 5, 1)) == "overlap"
    assert issue(("data/1.jsonl", d, 5, 1), ("data/1.jsonl", d, 5, 1)) == "order"
    assert issue(("data/g.jsonl", d, 5, 1)) == "path" and issue(("data/1.jsonl", d, 101, 1)) == "size"
    assert issue(("data/1.jsonl", d, 5, 1), release="d") == "not_canonical"


def test_long_chains(spark):
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = [("long", i, f"t{i}") for i in range(25_000)] + [(None, 2, "b"), (None, 1, None), ("one", 1, "é")]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "chain string, n int, text string")
    got = {r["chain"]: (r["head"], r["length"]) for r in changes.chain_heads(df, "chain", ["n"], "text", F.lit("seed")).collect()}
    want = "seed"
    for i in range(25_000):
        want = h(f"{want}:t{i}")
    assert got == {"long": (want, 25_000), None: (h(h("seed:") + ":b"), 2), "one": (h("seed:é"), 1)}
    assert changes.chain_heads(df.limit(0), "chain", ["n"], "text", F.lit("seed")).count() == 0


def test_a_manifest_of_many_shards_is_read_in_linear_time(spark):
    """A shard below another is found in a set; comparing all prefixes with one another took minutes for these."""
    import time

    def read(paths):
        d = "sha256:" + "0" * 64
        entries = ",".join(f'{{"bytes":9,"digest":"{d}","path":"data/{p}.jsonl","rows":1}}' for p in paths)
        text = f'{{"contract":"c/v1","maxShardBytes":10,"projectorDigest":"{d}","rowCount":{len(paths)},"shards":[{entries}],"sourceReleaseId":"{d}","sourceSequence":1}}\n'
        return projection.parsed_manifest(spark.createDataFrame([(text,)], "manifest string"), "c/v1").first()["issue"]

    many = [f"{i:04x}" for i in range(40000)]
    began = time.time()
    assert read(many) is None
    assert read(sorted([*many, "9c3"])) == "overlap"
    assert time.time() - began < 90
    assert read(["0", "00"]) == "overlap" == read(["00", "0001"]) == read(["0", "0001"]) and read(["0001", "001", "01", "1"]) is None
