"""Release envelopes as tables: manifests, ordered diffs, descriptors and bundles of many releases at once, and their checks.

A release is named by (chain, sequence). Its manifest, diff and bundle are one text each, so its declarations and changes meet in one group,
bounded by the limits of a release; releases are spread over the cluster. All values are ASCII or NFC already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealwright.functions.values import DIGEST, canonical, instant_key, json_literal, json_string, sha256
from sealwright.operators import changes as C
from sealwright.session import written

#: Fixed names of the files that a release has besides its objects.
FILES = {"bundle": "bundle.json", "manifest": "manifest.json", "changes": "changes.ndjson", "diff": "release-diff.json", "descriptor": "release.json"}
#: Fixed names of the contracts that an instance chooses.
CONTRACTS = ("manifest", "snapshot", "artifact", "release", "descriptor", "diff", "bundle", "resourceTransition")
KEY = ["chain", "sequence"]
CHANGE_ORDER = ["subject_type", "subject_id", "kind", "change_id"]


def _type(names: str, optional: tuple[str, ...] = (), **other: T.DataType) -> T.StructType:
    """A struct of `names`, strings but for those in `other`."""
    return T.StructType([T.StructField(n, other.get(n, T.StringType()), True, {"presence": "optional"} if n in optional else None) for n in names.split()])


def change_type(tombstone: T.StructType | None = None) -> T.StructType:
    """The record of a change; absent digests and tombstones are left out of its canonical form."""
    digests = ("revision_digest", "previous_revision_digest", "projection_digest", "previous_projection_digest")
    base = _type(f"change_id kind subject_type subject_id {' '.join(digests)} basis_event_ids", digests, basis_event_ids=T.ArrayType(T.StringType()))
    return base if tombstone is None else base.add(T.StructField("tombstone", tombstone, True, {"presence": "optional"}))


DECLARATIONS = T.MapType(T.StringType(), _type("sha256 bytes", bytes=T.LongType()))
RESOURCES = T.MapType(T.StringType(), T.StringType())
SNAPSHOT = _type(
    "snapshot_contract release_sequence compiler_version artifact_contract input_set_digest artifact_digest resource_digests root_set_digest "
    "signer_registry_digest trust_transition_digest policy_as_of",
    release_sequence=T.LongType(),
    resource_digests=RESOURCES,
)
RELEASE = _type("release_contract release_sequence snapshot_id parent_release_id diff_digest", release_sequence=T.LongType())
DESCRIPTOR = T.StructType().add("descriptor_contract", "string").add("snapshot_core", SNAPSHOT).add("snapshot_id", "string").add("release_core", RELEASE).add("release_id", "string")
MANIFEST = T.StructType().add("manifest_contract", "string").add("objects", DECLARATIONS)
BUNDLE_CORE = _type(
    "bundle_contract admitted_input_digests verifier_digest object_manifest_digest release resource_digests files",
    admitted_input_digests=T.ArrayType(T.StringType()),
    release=DESCRIPTOR,
    resource_digests=RESOURCES,
    files=DECLARATIONS,
)
BUNDLE = T.StructType([*BUNDLE_CORE.fields, T.StructField("bundle_digest", T.StringType())])


def checked_contracts(contracts: dict[str, str]) -> dict[str, str]:
    if set(contracts) != set(CONTRACTS) or not all(contracts.values()) or len(set(contracts.values())) != len(CONTRACTS):
        raise ValueError("an instance needs eight different contract names")
    return contracts


def _object(**members: Column) -> Column:
    """A JSON object of members that are JSON already."""
    parts = [F.concat(F.lit(f'{"," if i else "{"}"{name}":'), members[name]) for i, name in enumerate(sorted(members))]
    return F.concat(*parts, F.lit("}"))


def _quoted(c: Column | str) -> Column:
    return F.lit(json_literal(c)) if isinstance(c, str) else F.coalesce(json_string(c, True), F.lit("null"))


def transition_digest(contract: str, resource: Column, parent: Column, changes_json: Column) -> Column:
    """The next state of a chained resource; `changes_json` is canonical JSON."""
    return sha256(_object(transition_contract=_quoted(contract), projection=_quoted(resource), parent_digest=_quoted(parent), changes=changes_json))


def logs(changes: DataFrame, kind: T.StructType) -> DataFrame:
    """(chain, sequence, changes_json, changes_text): the changes of each release in canonical order, as an array and as lines."""
    line = canonical(F.struct(*kind.fieldNames()), kind, True).alias("line_")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*CHANGE_ORDER, line))), lambda x: x["line_"])
    grouped = changes.groupBy(*KEY).agg(ordered.alias("lines_"))
    return grouped.select(*KEY, F.concat(F.lit("["), F.array_join("lines_", ","), F.lit("]")).alias("changes_json"), F.concat(F.array_join("lines_", "\n"), F.lit("\n")).alias("changes_text"))


def manifests(contracts: dict[str, str], objects: DataFrame) -> DataFrame:
    """(chain, sequence, objects, manifest): the declarations of each release and their canonical text."""
    held = F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", F.struct("sha256", "bytes")))))
    grouped = objects.groupBy(*KEY).agg(held.alias("objects"))
    return grouped.withColumn("manifest", _object(manifest_contract=_quoted(contracts["manifest"]), objects=canonical(F.col("objects"), DECLARATIONS, True)))


def _release_core(contracts: dict[str, str], sequence: Column, snapshot_id: Column, parent: Column, diff_digest: Column) -> Column:
    return _object(**_release_members(contracts, sequence, snapshot_id, diff_digest), parent_release_id=_quoted(parent))


def _release_members(contracts: dict[str, str], sequence: Column, snapshot_id: Column, diff_digest: Column) -> dict[str, Column]:
    """All but the parent."""
    return {"release_contract": _quoted(contracts["release"]), "release_sequence": sequence.cast("string"), "snapshot_id": _quoted(snapshot_id), "diff_digest": _quoted(diff_digest)}


#: Stands for the parent in a release core until the fold knows it; no text holds it.
PARENT = "\x00parent\x00"


def _chained(contracts: dict[str, str], rows: DataFrame, parents: DataFrame | None) -> DataFrame:
    """(chain, sequence, parent_release_id, parent_snapshot_id, release_id). An id covers its parent's, so a chain's releases are folded in one task, which keeps the last of them."""
    none = F.lit(None).cast("string")
    rows = rows.withColumns({"p_r": none, "p_s": none}) if parents is None else rows.join(parents.select("chain", F.col("release_id").alias("p_r"), F.col("snapshot_id").alias("p_s")), "chain", "left")
    core = _object(**_release_members(contracts, F.col("sequence"), F.col("snapshot_id"), F.col("diff_digest")), parent_release_id=F.lit(PARENT))
    rows = rows.select("chain", "sequence", "snapshot_id", core.alias("core_"), "p_r", "p_s", _quoted(F.col("p_r")).alias("q_r"), "diff_digest")
    names = ["chain", "sequence", "parent_release_id", "parent_snapshot_id", "release_id"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, now, release, snapshot = False, None, None, None
        for batch in batches:
            out: list[tuple] = []
            for chain, sequence, own, text, p_r, p_s, q_r in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or chain != now:
                    begun, now, release, snapshot = True, chain, None, None
                parent, quoted = (p_r, q_r) if release is None else (release, f'"{release}"')
                parent_snapshot = p_s if snapshot is None else snapshot
                release, snapshot = None if text is None else "sha256:" + hashlib.sha256(text.replace(PARENT, quoted).encode()).hexdigest(), own
                out.append((chain, sequence, parent, parent_snapshot, release))
            columns = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field(0).type, batch.schema.field(1).type, pa.string(), pa.string(), pa.string()))], names)

    kind = rows.select("chain", "sequence").schema
    for name in names[2:]:
        kind.add(name, "string")
    return C.by_chain(rows, "chain", ["sequence", "snapshot_id", "diff_digest"]).drop("diff_digest").mapInArrow(fold, kind)


def seal(contracts: dict[str, str], heads: DataFrame, objects: DataFrame, changes: DataFrame, kind: T.StructType, state: DataFrame | None = None, parents: DataFrame | None = None) -> DataFrame:
    """One row for each of `heads`: ids, digests and the texts of its five files (columns named as in FILES; each ends with a line feed).

    heads: chain, sequence, the columns of SNAPSHOT but the contracts and the sequence, admitted_input_digests, verifier_digest, bundle_resources.
    objects and state: chain, sequence, path, sha256, bytes. changes: chain, sequence and the columns of `kind`, sealed.
    parents: chain, sequence, release_id, snapshot_id that the first release of a chain follows; without a row a chain starts at 1.
    Check the inputs with `input_violations` first: this does not refuse.
    """
    contracts = checked_contracts(contracts)
    rows = heads.join(manifests(contracts, objects), KEY, "left").join(logs(changes, kind), KEY, "left")
    no_entries = F.array().cast("array<struct<key: string, value: struct<sha256: string, bytes: bigint>>>")
    rows = rows.withColumns({"objects": F.coalesce("objects", F.map_from_entries(no_entries)), "manifest": F.coalesce("manifest", _object(manifest_contract=_quoted(contracts["manifest"]), objects=F.lit("{}"))), "changes_json": F.coalesce("changes_json", F.lit("[]")), "changes": F.coalesce("changes_text", F.lit(""))})
    fixed = {"snapshot_contract": F.lit(contracts["snapshot"]), "artifact_contract": F.lit(contracts["artifact"]), "release_sequence": F.col("sequence")}
    core = F.struct(*[fixed.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in SNAPSHOT.fields])
    rows = rows.withColumn("snapshot_", canonical(core, SNAPSHOT, True)).withColumn("snapshot_id", sha256(F.col("snapshot_"))).withColumn("diff_digest", sha256(F.col("changes")))
    rows = written(rows, "release-heads")
    rows = rows.join(_chained(contracts, rows.select(*KEY, "snapshot_id", "diff_digest"), parents), KEY)
    release = _release_core(contracts, F.col("sequence"), F.col("snapshot_id"), F.col("parent_release_id"), F.col("diff_digest"))
    rows = rows.withColumn("descriptor_", _object(descriptor_contract=_quoted(contracts["descriptor"]), snapshot_core=F.col("snapshot_"), snapshot_id=_quoted(F.col("snapshot_id")), release_core=release, release_id=_quoted(F.col("release_id"))))
    rows = rows.withColumn("diff_", _object(diff_contract=_quoted(contracts["diff"]), parent_snapshot_id=_quoted(F.col("parent_snapshot_id")), snapshot_id=_quoted(F.col("snapshot_id")), changes=F.col("changes_json")))
    ended = lambda c: F.concat(c, F.lit("\n"))
    rows = rows.withColumns({"manifest_digest": sha256(F.col("manifest")), "manifest": ended(F.col("manifest")), "diff": ended(F.col("diff_")), "descriptor": ended(F.col("descriptor_"))})
    rows = written(rows, "release-texts")
    own = [F.struct(F.lit(FILES[n]).alias("key"), F.struct(sha256(F.col(n)).alias("sha256"), F.octet_length(n).cast("long").alias("bytes")).alias("value")) for n in ("manifest", "changes", "diff", "descriptor")]
    entries = F.concat(F.map_entries("objects"), F.array(*own))
    if state is not None:
        rows = rows.join(state.groupBy(*KEY).agg(F.collect_list(F.struct(F.col("path").alias("key"), F.struct("sha256", "bytes").alias("value"))).alias("state_")), KEY, "left")
        entries = F.concat(entries, F.coalesce("state_", no_entries))
    members = {
        "bundle_contract": _quoted(contracts["bundle"]),
        "admitted_input_digests": canonical(F.col("admitted_input_digests"), T.ArrayType(T.StringType()), True),
        "verifier_digest": _quoted(F.col("verifier_digest")),
        "object_manifest_digest": _quoted(F.col("manifest_digest")),
        "release": F.col("descriptor_"),
        "resource_digests": canonical(F.col("bundle_resources"), RESOURCES, True),
        "files": canonical(F.map_from_entries(entries), DECLARATIONS, True),
    }
    rows = written(rows.withColumn("files_", members["files"]), "release-files")
    members["files"] = F.col("files_")
    rows = rows.withColumn("bundle_digest", sha256(_object(**members)))
    rows = rows.withColumn("bundle", ended(_object(**members, bundle_digest=_quoted(F.col("bundle_digest")))))
    return rows.select(*KEY, "snapshot_id", "parent_release_id", "parent_snapshot_id", "diff_digest", "release_id", "manifest_digest", "bundle_digest", F.size("objects").cast("long").alias("n_objects"), *FILES)


def _found(rows: DataFrame, ordinal: int, code: str, path: Column | None = None) -> DataFrame:
    return rows.select(*KEY, F.lit(ordinal).alias("check_ordinal"), F.lit(code).alias("code"), (F.lit(None).cast("string") if path is None else path).alias("path")).distinct()


def _found_either(rows: DataFrame, path: Column, *cases: tuple[int, str, str]) -> DataFrame:
    """`_found` for conditions that exclude each other, in one pass: a union would compute the join below it for each."""
    code = reduce(lambda a, x: a.when(F.expr(x[2]), F.struct(F.lit(x[0]).alias("check_ordinal"), F.lit(x[1]).alias("code"))), cases, F)
    return rows.select(*KEY, code.alias("x"), path.alias("path")).where("x is not null").select(*KEY, "x.check_ordinal", "x.code", "path").distinct()


def unordered_policy(rows: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Releases whose place is wrong (columns chain, sequence, policy_as_of): a chain starts at 1 or after its parent, goes up by one, and its policy time never goes back."""
    one = rows.select(*KEY, "policy_as_of", F.lit(False).alias("given_"))
    if parents is not None:
        one = one.unionByName(parents.select(*KEY, "policy_as_of", F.lit(True).alias("given_")))
    w = Window.partitionBy("chain").orderBy("sequence", F.desc("given_"), instant_key(F.col("policy_as_of")))
    seen = one.withColumns({"s_": F.lag("sequence").over(w), "p_": F.lag(instant_key(F.col("policy_as_of"))).over(w), "k_": instant_key(F.col("policy_as_of"))}).where("not given_")
    sequence = _found(seen.where(F.col("sequence") != F.coalesce("s_", F.lit(0)) + 1), 1, "sequence")
    return sequence.union(_found(seen.where("k_ is null"), 2, "policy_instant")).union(_found(seen.where("k_ < p_"), 3, "policy_backwards"))


def input_violations(heads: DataFrame, objects: DataFrame, changes: DataFrame, kind: T.StructType, entries: DataFrame, resources: DataFrame, state_files: tuple[str, ...] = (), parents: DataFrame | None = None) -> DataFrame:
    """(chain, sequence, check_ordinal, code, path) of what a seal must refuse.

    entries: entry, owner of object subtrees; resources: name, owner.
    """
    reserved = [*FILES.values(), *state_files]
    path = F.col("path")
    out = [unordered_policy(heads, parents)]
    out.append(_found(objects.where(path.isin(reserved)), 4, "reserved_path", path))
    out.append(_found(objects.where(~C.canonical_path(path)), 5, "path_grammar", path))
    out.append(_found(objects.groupBy(*KEY, "path").count().where("count > 1"), 6, "path_repeated", path))
    above = objects.select(*KEY, F.explode(C.ancestors(path)).alias("path")).distinct()
    out.append(_found(objects.join(above.hint("merge"), [*KEY, "path"], "left_semi"), 7, "path_contains", path))
    unowned = C.owners(objects, F.broadcast(entries)).where("owner is null").select("path")
    out.append(_found(objects.join(unowned.hint("merge"), "path", "left_semi"), 8, "path_unowned", path))
    for n, name in ((9, "resource_digests"), (10, "bundle_resources")):
        named = heads.select(*KEY, F.explode(F.map_keys(name)).alias("name"))
        out.append(_found(named.join(resources.select("name"), "name", "left_anti"), n, f"{name}_unregistered", F.col("name")))
    admitted = F.col("admitted_input_digests")
    out.append(_found(heads.where((F.size(admitted) < 1) | (admitted != F.array_sort(F.array_distinct(admitted)))), 11, "admitted_order"))
    core = [f for f in kind.fieldNames() if f != "change_id"]
    core_type = T.StructType([f for f in kind.fields if f.name != "change_id"])
    out.append(_found(changes.where(~F.col("change_id").eqNullSafe(sha256(canonical(F.struct(*core), core_type, True)))), 12, "change_unsealed", F.col("change_id")))
    out.append(_found(changes.groupBy(*KEY, "subject_type", "subject_id").count().where("count > 1"), 13, "subject_repeated", F.col("subject_id")))
    return reduce(DataFrame.union, out)


def files_of(sealed: DataFrame) -> DataFrame:
    """(chain, sequence, path, content) of the five files of each sealed release."""
    pairs = F.array(*[F.struct(F.lit(p).alias("path"), F.col(n).cast("binary").alias("content")) for n, p in FILES.items()])
    return sealed.select(*KEY, F.explode(pairs).alias("x")).select(*KEY, "x.path", "x.content")


def violations(contracts: dict[str, str], texts: DataFrame, present: DataFrame, kind: T.StructType, entries: DataFrame, resources: DataFrame, state_files: tuple[str, ...] = ()) -> DataFrame:
    """(chain, sequence, check_ordinal, code, path): every binding of stored releases that does not hold; a reader refuses at the smallest ordinal.

    texts: chain, sequence, path, content of the five envelope files. present: chain, sequence, path, sha256, bytes of all files but the bundle.
    A text is valid only if it equals the canonical rendering of what it parses to, so unknown, repeated and unordered keys show up as 'rendering'.
    """
    contracts = checked_contracts(contracts)
    wide = texts.groupBy(*KEY).agg(*[F.max(F.when(F.col("path") == p, F.col("content").cast("string"))).alias(n) for n, p in FILES.items()])
    diff_type = T.StructType([T.StructField(n, T.StringType()) for n in ("diff_contract", "parent_snapshot_id", "snapshot_id")] + [T.StructField("changes", T.ArrayType(kind))])
    types = {"bundle": BUNDLE, "manifest": MANIFEST, "diff": diff_type, "descriptor": DESCRIPTOR}
    # Each step is written, so that a text is parsed and rendered once and no plan holds one expression many times.
    rows = written(wide.withColumns({f"{n}_": F.from_json(n, t) for n, t in types.items()}), "release-parsed")
    b, d = F.col("bundle_"), F.col("descriptor_")
    snapshot, release = d["snapshot_core"], d["release_core"]
    change_core = T.StructType([f for f in kind.fields if f.name != "change_id"])
    core = F.struct(*[b[f.name].alias(f.name) for f in BUNDLE_CORE.fields])
    sealed_id = lambda c: sha256(canonical(F.struct(*[c[f.name].alias(f.name) for f in change_core.fields]), change_core, True))
    rows = written(
        rows.select(
            "*",
            *[F.concat(canonical(F.col(f"{n}_"), t, True), F.lit("\n")).alias(f"{n}_r") for n, t in types.items()],
            F.concat(canonical(b["release"], DESCRIPTOR, True), F.lit("\n")).alias("release_r"),
            sha256(canonical(core, BUNDLE_CORE, True)).alias("bundle_d"),
            sha256(canonical(snapshot, SNAPSHOT, True)).alias("snapshot_d"),
            sha256(canonical(release, RELEASE, True)).alias("release_d"),
            F.transform("diff_.changes", lambda c: F.concat(canonical(c, kind, True), F.lit("\n"))).alias("lines_"),
            F.transform("diff_.changes", sealed_id).alias("ids_"),
        ),
        "release-rendered",
    )
    holds = lambda c: F.coalesce(c, F.lit(False))
    admitted = b["admitted_input_digests"]
    exact = (
        d["snapshot_id"].eqNullSafe(F.col("snapshot_d"))
        & d["release_id"].eqNullSafe(F.col("release_d"))
        & release["snapshot_id"].eqNullSafe(d["snapshot_id"])
        & (release["parent_release_id"].isNull() | release["parent_release_id"].rlike(DIGEST))
        & (snapshot["release_sequence"] >= 1)
        & release["release_sequence"].eqNullSafe(snapshot["release_sequence"])
        & (release["parent_release_id"].isNull() == (release["release_sequence"] == 1))
        & instant_key(snapshot["policy_as_of"]).isNotNull()
    )
    names = [(b["bundle_contract"], "bundle"), (d["descriptor_contract"], "descriptor"), (snapshot["snapshot_contract"], "snapshot"), (snapshot["artifact_contract"], "artifact"), (release["release_contract"], "release"), (F.col("manifest_.manifest_contract"), "manifest"), (F.col("diff_.diff_contract"), "diff")]
    keys = F.transform("diff_.changes", lambda c: F.struct(*[c[n].alias(n) for n in CHANGE_ORDER]))
    subjects = F.transform("diff_.changes", lambda c: F.struct(c["subject_type"].alias("t"), c["subject_id"].alias("i")))
    checks = {
        (1, "bundle_rendering"): F.col("bundle") == F.col("bundle_r"),
        (2, "bundle_digest"): b["bundle_digest"] == F.col("bundle_d"),
        (7, "admitted_order"): (F.size(admitted) > 0) & (admitted == F.array_sort(F.array_distinct(admitted))),
        (8, "descriptor_rendering"): F.col("descriptor") == F.col("descriptor_r"),
        (9, "descriptor_bound"): F.col("descriptor") == F.col("release_r"),
        (10, "descriptor_ids"): exact,
        (11, "contracts"): reduce(Column.__and__, [c.eqNullSafe(F.lit(contracts[n])) for c, n in names]),
        (12, "manifest_rendering"): F.col("manifest") == F.col("manifest_r"),
        (13, "manifest_bound"): b["object_manifest_digest"] == sha256(F.rtrim("manifest", F.lit("\n"))),
        (17, "diff_rendering"): F.col("diff") == F.col("diff_r"),
        (18, "diff_bound"): F.col("diff_.snapshot_id").eqNullSafe(d["snapshot_id"]) & (F.col("diff_.parent_snapshot_id").isNull() == release["parent_release_id"].isNull()),
        (19, "changes_digest"): release["diff_digest"] == sha256(F.col("changes")),
        (20, "changes_encoding"): F.col("changes") == F.array_join("lines_", ""),
        (21, "change_order"): (keys == F.array_sort(keys)) & (F.size(F.array_distinct(subjects)) == F.size(subjects)),
        (22, "change_unsealed"): F.transform("diff_.changes", lambda c: c["change_id"]) == F.col("ids_"),
    }
    broken = F.array_compact(F.array(*[F.when(~holds(c), F.struct(F.lit(n).alias("check_ordinal"), F.lit(code).alias("code"))) for (n, code), c in checks.items()]))
    out = [rows.select(*KEY, F.explode(broken).alias("x")).select(*KEY, "x.check_ordinal", "x.code", F.lit(None).cast("string").alias("path"))]
    path = F.col("path")
    declared = rows.select(*KEY, F.explode(b["files"]).alias("path", "d")).select(*KEY, "path", F.col("d.sha256").alias("d_sha"), F.col("d.bytes").alias("d_bytes"))
    both = present.select(*KEY, "path", F.col("sha256").alias("p_sha"), F.col("bytes").alias("p_bytes")).join(declared, [*KEY, "path"], "full")
    out.append(_found_either(both, path, (3, "file_set", "p_sha is null or d_sha is null"), (4, "file_bytes", "p_sha <> d_sha or p_bytes <> d_bytes")))
    for n, name, map_ in ((5, "resource_digests", b["resource_digests"]), (6, "snapshot_resources", b["release"]["snapshot_core"]["resource_digests"])):
        named = rows.select(*KEY, F.explode(F.map_keys(map_)).alias("name"))
        out.append(_found(named.join(resources.select("name"), "name", "left_anti"), n, f"{name}_unregistered", F.col("name")))
    listed = rows.select(*KEY, F.explode("manifest_.objects").alias("path", "m")).select(*KEY, "path", F.col("m.sha256").alias("m_sha"), F.col("m.bytes").alias("m_bytes"))
    payload = declared.where(~path.isin([*FILES.values(), *state_files]))
    matched = payload.join(listed, [*KEY, "path"], "full")
    out.append(_found_either(matched, path, (14, "manifest_closure", "m_sha is null or d_sha is null"), (15, "manifest_bytes", "m_sha <> d_sha or m_bytes <> d_bytes")))
    unowned = C.owners(payload, F.broadcast(entries)).where("owner is null").select("path")
    out.append(_found(payload.join(unowned.hint("merge"), "path", "left_semi"), 16, "path_unowned", path))
    return reduce(DataFrame.union, out)


def successor_violations(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """(chain, sequence, check_ordinal, code, path) of releases that do not follow the release before them.

    rows: chain, sequence, parent_release_id, parent_snapshot_id, policy_as_of. parents: chain, sequence, release_id, snapshot_id, policy_as_of.
    """
    before = parents.select("chain", (F.col("sequence") + 1).alias("sequence"), "release_id", "snapshot_id", F.col("policy_as_of").alias("p_policy"))
    joined = rows.select(*KEY, "parent_release_id", "parent_snapshot_id", "policy_as_of").join(before, KEY, "left")
    other = ~(F.col("parent_release_id").eqNullSafe(F.col("release_id")) & F.col("parent_snapshot_id").eqNullSafe(F.col("snapshot_id")))
    lost = F.col("release_id").isNull() & (F.col("sequence") != 1)
    back = instant_key(F.col("policy_as_of")) < instant_key(F.col("p_policy"))
    return _found(joined.where(other), 1, "parent").union(_found(joined.where(lost), 2, "sequence")).union(_found(joined.where(back), 3, "policy_backwards"))
