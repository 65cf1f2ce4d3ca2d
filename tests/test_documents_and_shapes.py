"""Normal forms by media type, and strict records, against plain readings."""

import copy
import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from sealwright.functions.values import visited_strings
from sealwright.operators import documents as D

DIG = "sha256:" + "c" * 64


def test_normal_documents(spark):
    rows = {
        "plain": (b"a \r\nb\t\rc\n\n", "text/plain", ("text", None, "a\nb\nc\n")),
        "charset": ("\ufeff\ufeffe\u0301 x".encode(), " TEXT/Markdown ; charset=utf-8", ("text", None, "é x\n")),
        "json": (b'{"b": 1.0, "a": [true, null]}', "application/json", ("json", None, '{"a":[true,null],"b":1}\n')),
        "json_bom": (b"\xef\xbb\xbf[1]", "application/ld+json;x=y", ("json", None, "[1]\n")),
        "bad_json": (b"{", "application/json", ("json", "syntax", None)),
        "text_json": (b"[]", "text/json", ("json", None, "[]\n")),
        "xml": (b"<a/> \n", "application/atom+xml", ("text", None, "<a/>\n")),
        "html": (b"<p>", "text/HTML", ("html", "html", None)),
        "png": (b"\x89PNG", "image/png", (None, "unsupported_media_type", None)),
        "none": (b"x", None, (None, "unsupported_media_type", None)),
        "bytes": (b"\xff\xfe", "text/plain", ("text", "encoding", None)),
        "json_bytes": (b"\xff", "application/json", ("json", "encoding", None)),
        "blank": (b" \n\t", "text/plain", ("text", "empty_document", None)),
        "null": (None, "text/plain", ("text", "empty_document", None)),
        "null_json": (None, "application/json", ("json", "syntax", None)),
        "surrogate": ("\U0001f600".encode(), "text/x", ("text", None, "\U0001f600\n")),
    }
    df = spark.createDataFrame([(k, bytearray(b) if b is not None else None, m) for k, (b, m, _) in rows.items()], "id string, content binary, media_type string").withColumn("kind", F.lit("mine"))
    got = {r["id"]: r["normal"] for r in D.normal_documents(df, ["application/json", "application/*+json", "text/json"], ["application/*xml"]).collect()}
    for k, (_, _, (kind, issue, text)) in rows.items():
        n = got[k]
        assert (n["kind"], n["issue"], n["text"]) == (kind, issue, text), k
        assert n["digest"] == (text and "sha256:" + hashlib.sha256(text.encode()).hexdigest()) and n["bytes"] == (len(text.encode()) if text is not None else None)


def test_wildcards(spark):
    kinds = [("a/b",), ("a/xb",), ("a/b+c",), ("A/b",), (None,)]
    got = [r[0] for r in spark.createDataFrame(kinds, "k string").coalesce(1).select(D.matches(F.col("k"), ["a/b*b", "*+c"])).collect()]
    assert got == [True, False, True, False, False]


def values_of(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 4)
    if kind < 2:
        return rng.choice(["é", "", "a.b", "x" * 50, "[0]"])
    if kind == 2:
        return rng.choice([1, -5, True, None, 2.5])
    if kind == 3:
        return rng.choice([[], {}])
    if kind < 5:
        return [values_of(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b", "ü", "long key", "c"]): values_of(rng, depth + 1) for _ in range(rng.randrange(4))}


def test_visited_equals_the_recursive_reading(spark):
    rng = random.Random(9)
    rows = [(i, json.dumps(values_of(rng))) for i in range(120)] + [(900, "{"), (901, None), (902, "")]
    got: dict = {}
    for r in D.visited(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect():
        if r["type"] == "STRING":
            got.setdefault(r["id"], []).append((r["path"], r["text"]))
    for i, t in rows[:120]:
        assert sorted(got.get(i, [])) == sorted(visited_strings(json.loads(t)))
    assert not {900, 901, 902} & set(got)


KINDS, TYPES = ("add", "remove"), ("person", "place")
CHANGE = {"change_id": DIG, "kind": "add", "subject_type": "person", "subject_id": "p1", "revision_digest": DIG, "basis_event_ids": [DIG], "tombstone": {"reason": "gone"}}


def edited(record, path, value=...):
    out = copy.deepcopy(record)
    *steps, last = path
    at = out
    for s in steps:
        at = at[s]
    if value is ...:
        del at[last]
    else:
        at[last] = value
    return out


def faults(spark, records, shape):
    rows = [(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(records)]
    got: dict = {i: set() for i, _ in rows}
    for r in D.strict_faults(spark.createDataFrame(rows, "id int, t string"), "id", "t", shape).collect():
        got[r["id"]].add((r["path"], r["code"]))
    return [got[i] for i, _ in rows]


def test_changes(spark):
    shape = D.change_shape(KINDS, TYPES, (D.Field(".reason", "string", pattern="."),))
    cases = [
        (CHANGE, set()),
        (edited(CHANGE, ["revision_digest"]), set()),
        (edited(CHANGE, ["subject_id"], DIG), set()),
        ("{", {("$", "syntax")}),
        (None, {("$", "syntax")}),
        ([], {("$", "type")}),
        (edited(CHANGE, ["more"], {"x": 1}), {("$.more", "unknown_key")}),
        (edited(CHANGE, ["tombstone", "why"], 1), {("$.tombstone.why", "unknown_key")}),
        (edited(CHANGE, ["tombstone", "reason"]), {("$.tombstone.reason", "missing")}),
        (edited(edited(CHANGE, ["kind"]), ["subject_type"], "thing"), {("$.kind", "missing"), ("$.subject_type", "value")}),
        (edited(CHANGE, ["basis_event_ids"], [DIG, "x", 3]), {("$.basis_event_ids[1]", "value"), ("$.basis_event_ids[2]", "type")}),
        (edited(CHANGE, ["basis_event_ids"], {"a": 1}), {("$.basis_event_ids", "type")}),
        (edited(CHANGE, ["tombstone"], None), {("$.tombstone", "type")}),
        (edited(CHANGE, ["subject_id"], "Bad Id"), {("$.subject_id", "value")}),
        ({}, {(f"$.{k}", "missing") for k in ("change_id", "kind", "subject_type", "subject_id", "basis_event_ids")}),
    ]
    assert faults(spark, [c for c, _ in cases], shape) == [w for _, w in cases]


def test_envelopes(spark):
    names = {c: f"x.{c}/v1" for c in D.CONTRACTS}
    shapes = D.envelope_shapes(names, D.change_shape(KINDS, TYPES))
    for bad in ({k: v for k, v in names.items() if k != "diff"}, names | {"diff": names["bundle"]}, names | {"diff": ""}, names | {"more": "y"}):
        with pytest.raises(ValueError):
            D.envelope_shapes(bad, D.change_shape(KINDS, TYPES))
    descriptor = {
        "descriptor_contract": names["descriptor"], "snapshot_id": DIG, "release_id": DIG,
        "snapshot_core": {"snapshot_contract": names["snapshot"], "release_sequence": 1, "compiler_version": "1", "artifact_contract": names["artifact"], "input_set_digest": DIG, "artifact_digest": DIG, "resource_digests": {"rules": DIG}, "root_set_digest": DIG, "signer_registry_digest": DIG, "trust_transition_digest": None, "policy_as_of": "2024-01-01T00:00:00Z"},
        "release_core": {"release_contract": names["release"], "release_sequence": 1, "snapshot_id": DIG, "parent_release_id": None, "diff_digest": DIG},
    }
    bundle = {"bundle_contract": names["bundle"], "admitted_input_digests": [DIG], "verifier_digest": DIG, "object_manifest_digest": DIG, "bundle_digest": DIG, "release": descriptor, "resource_digests": {}, "files": {"data/a.b-c/x": {"sha256": DIG, "bytes": 0}}}
    cases = [
        (bundle, set()),
        (edited(bundle, ["admitted_input_digests"], []), {("$.admitted_input_digests", "too_few")}),
        (edited(bundle, ["files", "Data"], {"sha256": DIG, "bytes": 1}), {("$.files.Data", "open_key")}),
        (edited(bundle, ["files", "d"], {"sha256": DIG, "bytes": -1}), {("$.files.d.bytes", "value")}),
        (edited(bundle, ["files", "d"], {"sha256": DIG, "bytes": 1.5}), {("$.files.d.bytes", "type")}),
        (edited(bundle, ["files", "d"], {"sha256": DIG}), {("$.files.d.bytes", "missing")}),
        (edited(bundle, ["release", "snapshot_core", "release_sequence"], 0), {("$.release.snapshot_core.release_sequence", "value")}),
        (edited(bundle, ["release", "snapshot_core", "resource_digests", "a"], "x"), {("$.release.snapshot_core.resource_digests.a", "value")}),
        (edited(bundle, ["release", "extra"], []), {("$.release.extra", "unknown_key")}),
        (edited(bundle, ["release", "release_core", "diff_digest"], None), {("$.release.release_core.diff_digest", "type")}),
    ]
    assert faults(spark, [c for c, _ in cases], shapes["bundle"]) == [w for _, w in cases]
    assert faults(spark, [descriptor, edited(descriptor, ["descriptor_contract"], "y")], shapes["descriptor"]) == [set(), {("$.descriptor_contract", "value")}]
    change = {k: v for k, v in CHANGE.items() if k != "tombstone"}
    diff = {"diff_contract": names["diff"], "parent_snapshot_id": None, "snapshot_id": DIG, "changes": [change, edited(change, ["kind"], "other")]}
    assert faults(spark, [diff], shapes["diff"]) == [{("$.changes[1].kind", "value")}]
    manifest = {"manifest_contract": names["manifest"], "objects": {"a": {"sha256": DIG, "bytes": 3, "more": 1}}}
    assert faults(spark, [manifest], shapes["manifest"]) == [{("$.objects.a.more", "unknown_key")}]
    assert re.match(r"\$", "$")
