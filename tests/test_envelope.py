import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealwright.operators import changes as C
from sealwright.operators import envelope as E

CONTRACTS = {n: f"example.{t}/v1" for n, t in {"manifest": "object-manifest", "snapshot": "snapshot", "artifact": "artifact", "release": "release", "descriptor": "descriptor", "diff": "diff", "bundle": "bundle", "resourceTransition": "resource-transition"}.items()}
KIND = E.change_type()
CORE = [f for f in KIND.fieldNames() if f != "change_id"]


def sha(text):
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def of(value):
    return sha(json.dumps(value, sort_keys=True, separators=(",", ":")))


def changed(spark, rows):
    """rows: chain, sequence, kind, subject_type, subject_id, revision_digest."""
    df = spark.createDataFrame(rows, "chain string, sequence long, kind string, subject_type string, subject_id string, revision_digest string")
    none = F.lit(None).cast("string")
    df = df.withColumns({"previous_revision_digest": none, "projection_digest": none, "previous_projection_digest": none, "basis_event_ids": F.array().cast("array<string>")})
    kind = T.StructType([f for f in KIND.fields if f.name != "change_id"])
    return df.withColumn("change_id", E.sha256(E.canonical(F.struct(*CORE), kind, True)))


HEAD = T.StructType([T.StructField(n, T.StringType()) for n in ("chain", "compiler_version", "input_set_digest", "artifact_digest", "root_set_digest", "signer_registry_digest", "trust_transition_digest", "policy_as_of", "verifier_digest")])
HEAD = HEAD.add("sequence", "long").add("resource_digests", E.RESOURCES).add("bundle_resources", E.RESOURCES).add("admitted_input_digests", T.ArrayType(T.StringType()))


def head(sequence=1, **more):
    note = {"id": "n1", "text": "A verifiable note"}
    base = {"chain": "c", "sequence": sequence, "compiler_version": "example/1", "input_set_digest": of({"input": note}), "artifact_digest": of(note), "root_set_digest": of({"trusted_roots": ["example"]}), "signer_registry_digest": of({"signers": ["example"]}), "trust_transition_digest": None, "policy_as_of": "2026-01-01T00:00:00Z", "verifier_digest": of({"verifier": "example/1"}), "resource_digests": {}, "bundle_resources": {}, "admitted_input_digests": [of({"input": note})]}
    return base | more


def headed(spark, *rows):
    return spark.createDataFrame([tuple(r[f] for f in HEAD.fieldNames()) for r in rows], HEAD)


@pytest.fixture(scope="module")
def one(spark):
    """A release of one note, whose digests are pinned."""
    note = '{"id":"n1","text":"A verifiable note"}'
    change = changed(spark, [("c", 1, "note.added", "note", "n1", sha(note))]).cache()
    line = "[" + change.select(E.canonical(F.struct(*KIND.fieldNames()), KIND, True)).first()[0] + "]"
    index = spark.range(1).select(E.transition_digest(CONTRACTS["resourceTransition"], F.lit("note-index"), F.lit(of({"notes": []})), F.lit(line))).first()[0]
    objects = spark.createDataFrame([("c", 1, "notes/n1.json", sha(note + "\n"), len(note) + 1)], "chain string, sequence long, path string, sha256 string, bytes long")
    heads = headed(spark, head(resource_digests={"note-index": index}))
    return heads, objects, change, E.seal(CONTRACTS, heads, objects, change, KIND).cache()


def entries(spark):
    return spark.createDataFrame([("notes", "notes")], "entry string, owner string"), spark.createDataFrame([("note-index", "notes")], "name string, owner string")


def stored(sealed, objects):
    texts = E.files_of(sealed)
    declared = texts.where(F.col("path") != "bundle.json").select(*E.KEY, "path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))
    return texts, declared.unionByName(objects)


def test_pinned_release(spark, one):
    row = one[3].first()
    assert row["bundle_digest"] == "sha256:78fa2c913c408cf23b606e157be086af340a2b062fe6e2bc2a55fef928aae8f0"
    assert row["release_id"] == "sha256:bc9094614426c3b2912b43042258f0e39fbf7657a140b88b1db7dfe6848b627f"
    assert row["n_objects"] == 1


CHANGED = [
    ("bundle.json", '"bytes":39', '"bytes":40', {"bundle_digest", "file_bytes", "manifest_bytes"}),
    ("bundle.json", '{"admitted', '{ "admitted', {"bundle_rendering"}),
    ("bundle.json", '{"admitted', '{"a":1,"admitted', {"bundle_rendering"}),
    ("release.json", "example/1", "example/2", {"descriptor_bound", "descriptor_ids", "file_bytes"}),
    ("manifest.json", "n1.json", "n2.json", {"manifest_bound", "manifest_closure", "file_bytes"}),
    ("changes.ndjson", "note.added", "note.other", {"changes_digest", "changes_encoding", "file_bytes"}),
    ("release-diff.json", "note.added", "note.other", {"changes_encoding", "change_unsealed", "file_bytes"}),
    ("release-diff.json", "example.diff", "example.gap", {"contracts", "file_bytes"}),
]


def test_a_sealed_release_verifies_and_each_changed_text_is_found(spark, one):
    heads, objects, change, sealed = one
    assert E.input_violations(heads, objects, change, KIND, *entries(spark)).collect() == []
    row = sealed.first().asDict()
    rows = [row | {"chain": "whole"}]
    for i, (path, old, new, _) in enumerate(CHANGED):
        column = next(n for n, p in E.FILES.items() if p == path)
        assert old in row[column]
        rows.append(row | {"chain": f"c{i}", column: row[column].replace(old, new)})
    rows += [row | {"chain": "foreign"}, row | {"chain": "lost"}]
    every = objects.drop("chain").crossJoin(spark.createDataFrame([(r["chain"],) for r in rows], "chain string"))
    every = every.withColumn("path", F.when(F.col("chain") == "foreign", "other/n1.json").otherwise(F.col("path"))).select(*objects.columns)
    texts, present = stored(spark.createDataFrame([tuple(r[c] for c in sealed.columns) for r in rows], sealed.schema), every)
    gone = "chain <> 'lost' or path <> 'release.json'"
    found = {}
    for r in E.violations(CONTRACTS, texts.where(gone), present.where(gone), KIND, *entries(spark)).collect():
        found.setdefault(r["chain"], set()).add(r["code"])
    assert {"file_set", "descriptor_rendering", "descriptor_ids"} <= found.pop("lost")
    assert found == {f"c{i}": codes for i, (*_, codes) in enumerate(CHANGED)} | {"foreign": {"file_set"}}


def test_chain_of_releases_and_its_continuation(spark):
    heads = headed(spark, *[head(i, policy_as_of=f"2026-01-0{i}T00:00:00Z") for i in (1, 2, 3)])
    objects = spark.createDataFrame([], "chain string, sequence long, path string, sha256 string, bytes long")
    change = changed(spark, [("c", 2, "note.added", "note", "b", of(1)), ("c", 2, "note.added", "note", "a", of(1))])
    rows = {r["sequence"]: r for r in E.seal(CONTRACTS, heads, objects, change, KIND).collect()}
    assert [rows[i]["parent_release_id"] for i in (1, 2, 3)] == [None, rows[1]["release_id"], rows[2]["release_id"]]
    assert [json.loads(x)["subject_id"] for x in rows[2]["changes"].splitlines()] == ["a", "b"] and rows[1]["changes"] == ""
    first = spark.createDataFrame([("c", 1, rows[1]["release_id"], rows[1]["snapshot_id"], "2026-01-01T00:00:00Z")], "chain string, sequence long, release_id string, snapshot_id string, policy_as_of string")
    again = E.seal(CONTRACTS, heads.where("sequence > 1"), objects, change, KIND, parents=first)
    assert {r["sequence"]: r["bundle_digest"] for r in again.collect()} == {i: rows[i]["bundle_digest"] for i in (2, 3)}
    after = again.join(heads.select(*E.KEY, "policy_as_of"), E.KEY)
    assert E.successor_violations(after.where("sequence = 2"), first).collect() == []
    assert {r["code"] for r in E.successor_violations(after.where("sequence = 3"), first).collect()} == {"parent", "sequence"}
    assert E.unordered_policy(heads.where("sequence > 1"), first).collect() == []


def test_refused_inputs(spark):
    heads = headed(spark, head(1, policy_as_of="2026-01-02T00:00:00Z", resource_digests={"x": of(1)}), head(2, admitted_input_digests=[of(2), of(2)]), head(4, policy_as_of="never"))
    objects = spark.createDataFrame([("c", 1, p, of(1), 1) for p in ("notes/a", "notes/a/b", "notes/c", "notes/c", "notes/D", "free/x", "bundle.json")], "chain string, sequence long, path string, sha256 string, bytes long")
    change = changed(spark, [("c", 1, "note.added", "note", "a", of(1)), ("c", 1, "note.gone", "note", "a", of(1))]).withColumn("change_id", F.when(F.col("kind") == "note.gone", F.lit(of(0))).otherwise(F.col("change_id")))
    found = {(r["sequence"], r["code"], r["path"]) for r in E.input_violations(heads, objects, change, KIND, *entries(spark)).collect()}
    assert found == {
        (4, "sequence", None), (4, "policy_instant", None), (2, "policy_backwards", None), (2, "admitted_order", None), (1, "resource_digests_unregistered", "x"),
        (1, "reserved_path", "bundle.json"), (1, "path_unowned", "bundle.json"), (1, "path_unowned", "free/x"), (1, "path_repeated", "notes/c"), (1, "path_grammar", "notes/D"), (1, "path_contains", "notes/a"),
        (1, "subject_repeated", "a"), (1, "change_unsealed", of(0)),
    }
    assert C.repeated_subjects(change, ["subject_id"]).count() == 1


def test_checks_of_inputs_broadcast_no_table_of_releases(spark):
    """Only what an instance declares may go through the driver: its object entries and its resources."""
    from sealwright.plans import release_rules

    plan = release_rules.q77_release_inputs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    kept = [j for j in plan.splitlines() if "BroadcastHashJoin" in j and ("path" in j or "subject_id" in j or "block" in j)]
    assert not kept
