"""Queries over what releases refuse: all checks of a stored release, of a seal's inputs and of a successor, and the grammars of names."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sealwright.functions import values as V
from sealwright.operators import changes, envelope, identity
from sealwright.plans.catalogue import _NONE, _RELEASE_OBJECTS, RELEASE_CONTRACTS, RELEASE_DOCUMENTS, _release_inputs, query
from sealwright.session import shared_folder, table, written
from sealwright.sources import tree_sink

ZERO = "sha256:" + "0" * 64
#: Documents of a release: small, so that chains are long enough for every case.
SIZE = 40
_OBJECTS = _RELEASE_OBJECTS.replace(f"doc_id // {RELEASE_DOCUMENTS}", f"doc_id // {SIZE}")
CASES = [
    "bundle_rendering", "bundle_digest", "file_set", "file_bytes", "resource_digests_unregistered", "snapshot_resources_unregistered", "admitted_order", "descriptor_rendering", "descriptor_bound", "descriptor_ids", "contracts",
    "manifest_rendering", "manifest_bound", "manifest_closure", "manifest_bytes", "path_unowned", "diff_rendering", "diff_bound", "changes_digest", "changes_encoding", "change_order", "change_unsealed",
]


def _case(n: str, other, usual):
    return F.when(F.col("k") == CASES.index(n) + 1, other).otherwise(usual)


def _swap(c, old, new):
    return F.replace(c, F.lit(old) if isinstance(old, str) else old, F.lit(new) if isinstance(new, str) else new)


def _declared(path: str, text):
    return F.concat(F.lit(f'"{path}":{{"bytes":'), F.octet_length(text).cast("string"), F.lit(',"sha256":'), F.lit('"'), V.sha256(text), F.lit('"}'))


def spoiled(sealed):
    """`sealed` releases with k, of which case k has one fault, whatever else binds it being sealed again: the texts, and the files of the objects as they are declared."""
    s = sealed
    old = {n: F.col(f"o_{n}") for n in ("manifest", "changes", "diff", "descriptor")}
    s = s.withColumns({f"o_{n}": F.col(n) for n in old})
    line = F.concat(F.substring_index("changes", "\n", 1), F.lit("\n"))
    s = s.withColumn("first", F.substring_index("changes", "\n", 1))
    spaced = lambda n: F.regexp_replace(n, r"\n\z", " \n")
    extra = f'"aaa/x":{{"bytes":1,"sha256":"{ZERO}"}}'
    more = lambda n: _case("manifest_closure", _swap(n, '"objects":{', '"objects":{' + extra + ","), _case("path_unowned", _swap(n, '"objects":{', '"objects":{' + extra + ","), n))
    manifest = _case("manifest_rendering", spaced("manifest"), _case("manifest_bytes", F.regexp_replace("manifest", r'("objects":\{"[^"]*":\{"bytes":)([0-9]+)', "$19$2"), more(F.col("manifest"))))
    moved = lambda n: _swap(n, "text.added", "text.moved")
    text = _case("file_bytes", moved("changes"), _case("changes_digest", moved("changes"), _case("change_unsealed", moved("changes"), _case("change_order", F.concat(line, "changes"), F.col("changes")))))
    diff = _case("diff_rendering", spaced("diff"), _case("diff_bound", _swap("diff", F.concat(F.lit('"snapshot_id":"'), "snapshot_id"), F.lit(f'"snapshot_id":"{ZERO}')), _case("changes_encoding", moved("diff"), _case("change_unsealed", moved("diff"), _case("change_order", _swap("diff", '"changes":[', F.concat(F.lit('"changes":['), "first", F.lit(","))), F.col("diff"))))))
    s = written(s.withColumns({"manifest": manifest, "changes": text, "diff": diff}), "spoiled-parts")
    # what covers the changes: their digest in the descriptor, and through it the release's id
    sealed_again = F.col("k").isin(CASES.index("change_order") + 1, CASES.index("change_unsealed") + 1)
    s = s.withColumn("new_digest", F.when(sealed_again, V.sha256(F.col("changes"))).otherwise(F.col("diff_digest")))
    s = s.withColumn("d1", _swap("descriptor", F.col("diff_digest"), F.col("new_digest")))
    s = s.withColumn("new_id", F.when(sealed_again, V.sha256(F.regexp_extract("d1", r'"release_core":(\{[^{}]*\})', 1))).otherwise(F.col("release_id")))
    s = s.withColumn("d2", _swap("d1", F.col("release_id"), F.col("new_id")))
    other = _case("descriptor_ids", _swap("d2", "catalogue/1", "catalogue/2"), _case("contracts", _swap("d2", "catalogue.descriptor/v1", "catalogue.descriptor/v2"), F.col("d2")))
    s = s.withColumn("inner", F.regexp_replace(other, r"\n\z", ""))
    s = s.withColumn("descriptor", _case("descriptor_rendering", spaced(F.col("d2")), _case("descriptor_bound", _swap("d2", "catalogue/1", "catalogue/3"), other)))
    bundle = _swap("bundle", F.regexp_replace("o_descriptor", r"\n\z", ""), F.col("inner"))
    for n in old:
        # a file that is not declared anew differs from its declaration
        declared = F.when(F.col("k") == CASES.index("file_bytes") + 1, F.col(f"o_{n}")).otherwise(F.col(n))
        bundle = _swap(bundle, _declared(envelope.FILES[n], F.col(f"o_{n}")), _declared(envelope.FILES[n], declared))
    bound = lambda n: V.sha256(F.regexp_replace(n, r"\n\z", ""))
    named = _case("manifest_bound", F.lit(ZERO), bound(F.col("manifest")))
    bundle = _swap(bundle, F.concat(F.lit('"object_manifest_digest":"'), bound(F.col("o_manifest"))), F.concat(F.lit('"object_manifest_digest":"'), named))
    bundle = _case("resource_digests_unregistered", _swap(bundle, '"resource_digests":{},"verifier', f'"resource_digests":{{"ghost":"{ZERO}"}},"verifier'), bundle)
    bundle = _case("snapshot_resources_unregistered", _swap(bundle, '"resource_digests":{},"root', f'"resource_digests":{{"ghost":"{ZERO}"}},"root'), bundle)
    bundle = _case("admitted_order", _swap(bundle, f'["{_NONE}"]', f'["{_NONE}","{_NONE}"]'), bundle)
    bundle = _case("path_unowned", _swap(bundle, '"files":{', '"files":{' + extra + ","), bundle)
    s = written(s.withColumn("b1", bundle).drop("bundle"), "spoiled")
    core = F.regexp_replace(F.regexp_replace("b1", r'"bundle_digest":"[^"]*",', ""), r"\n\z", "")
    digest = F.when(F.col("k") == CASES.index("bundle_digest") + 1, F.lit(ZERO)).otherwise(V.sha256(core))
    whole = F.regexp_replace("b1", r'"bundle_digest":"[^"]*"', F.concat(F.lit('"bundle_digest":"'), digest, F.lit('"')))
    return s.withColumn("bundle", _case("bundle_rendering", spaced(whole), whole))


@query(
    f"""WITH {_OBJECTS}, e AS (SELECT DISTINCT chain, sequence, sequence % 23 AS k FROM o), c AS (SELECT unnest({CASES}) AS code, unnest(range(1, 23)) AS k)
SELECT chain, sequence, CAST(k AS INTEGER) AS check_ordinal, code FROM e JOIN c USING (k)"""
)
def q76_release_first_faults(spark, sf_dir):
    """The check at which a reader stops, for stored releases of which all but one in twenty-three have a fault, in turn each of the twenty-two."""
    heads, objects, made = _release_inputs(spark, sf_dir, SIZE)
    sealed = written(envelope.seal(RELEASE_CONTRACTS, heads, objects, made, envelope.change_type()), "sealed")
    bad = written(spoiled(sealed.withColumn("k", (F.col("sequence") % 23).cast("int"))).select(*envelope.KEY, "k", *envelope.FILES), "spoiled-releases")
    texts = envelope.files_of(bad)
    own = texts.where(F.col("path") != envelope.FILES["bundle"]).select("chain", "sequence", "path", V.sha256(F.col("content")).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))
    lost = bad.where(F.col("k") == CASES.index("file_set") + 1).select("chain", "sequence", F.lit(envelope.FILES["changes"]).alias("path"))
    more = bad.where(F.col("k") == CASES.index("path_unowned") + 1).select("chain", "sequence", F.lit("aaa/x").alias("path"), F.lit(ZERO).alias("sha256"), F.lit(1).cast("long").alias("bytes"))
    present = own.join(lost, ["chain", "sequence", "path"], "left_anti").unionByName(objects).unionByName(more)
    entries, resources = spark.createDataFrame([("texts", "texts")], "entry string, owner string"), spark.createDataFrame([], "name string, owner string")
    found = envelope.violations(RELEASE_CONTRACTS, texts, present, envelope.change_type(), entries, resources)
    first = found.groupBy("chain", "sequence").agg(F.min(F.struct("check_ordinal", "code")).alias("x"))
    return first.select("chain", "sequence", F.col("x.check_ordinal").alias("check_ordinal"), F.col("x.code").alias("code"))


@query(
    f"""WITH {_OBJECTS}, e AS (SELECT chain, sequence, sequence % 12 AS k, min(path) AS path, min(id) AS id FROM o GROUP BY chain, sequence),
s AS (SELECT chain, sequence, id, s AS sha FROM o)
SELECT chain, sequence, 4 AS check_ordinal, 'reserved_path' AS code, 'manifest.json' AS path FROM e WHERE k = 1 UNION ALL SELECT chain, sequence, 8, 'path_unowned', 'manifest.json' FROM e WHERE k = 1
UNION ALL SELECT chain, sequence, 5, 'path_grammar', 'Texts/x' FROM e WHERE k = 2 UNION ALL SELECT chain, sequence, 8, 'path_unowned', 'Texts/x' FROM e WHERE k = 2
UNION ALL SELECT chain, sequence, 6, 'path_repeated', path FROM e WHERE k = 3 UNION ALL SELECT chain, sequence, 7, 'path_contains', 'texts' FROM e WHERE k = 4
UNION ALL SELECT chain, sequence, 8, 'path_unowned', 'other/x' FROM e WHERE k = 5 UNION ALL SELECT chain, sequence, 9, 'resource_digests_unregistered', 'ghost' FROM e WHERE k = 6
UNION ALL SELECT chain, sequence, 10, 'bundle_resources_unregistered', 'ghost' FROM e WHERE k = 7 UNION ALL SELECT chain, sequence, 11, 'admitted_order', NULL FROM e WHERE k = 8
UNION ALL SELECT chain, sequence, 12, 'change_unsealed', '{ZERO}' FROM e WHERE k = 9 UNION ALL SELECT chain, sequence, 13, 'subject_repeated', id FROM e WHERE k = 10
UNION ALL SELECT chain, sequence, 3, 'policy_backwards', NULL FROM e WHERE k = 11"""
)
def q77_release_inputs(spark, sf_dir):
    """What a seal refuses: releases of which eleven in twelve have an input that is wrong."""
    heads, objects, made = _release_inputs(spark, sf_dir, SIZE)
    k = F.col("sequence") % 12
    ghost = F.create_map(F.lit("ghost"), F.lit(ZERO))
    heads = heads.withColumns({"resource_digests": F.when(k == 6, ghost).otherwise(F.col("resource_digests")), "bundle_resources": F.when(k == 7, ghost).otherwise(F.col("bundle_resources")), "admitted_input_digests": F.when(k == 8, F.array(F.lit(_NONE), F.lit(_NONE))).otherwise(F.col("admitted_input_digests")), "policy_as_of": F.when(k == 11, "2025-12-31T23:59:59Z").otherwise(F.col("policy_as_of"))})
    one = objects.groupBy("chain", "sequence").agg(F.min("path").alias("path"), F.min("sha256").alias("sha256"), F.min("bytes").alias("bytes"))
    path = F.when(k == 1, "manifest.json").when(k == 2, "Texts/x").when(k == 3, F.col("path")).when(k == 4, "texts").when(k == 5, "other/x")
    objects = objects.unionByName(one.withColumn("path", path).where("path is not null"))
    first = made.groupBy("chain", "sequence").agg(F.min("subject_id").alias("subject_id"))
    made = made.join(first.withColumn("first", F.lit(True)).hint("merge"), ["chain", "sequence", "subject_id"], "left").select(*made.columns, "first")
    twice = made.unionByName(made.where((k == 10) & F.col("first"))).withColumn("change_id", F.when((k == 9) & F.col("first"), ZERO).otherwise(F.col("change_id"))).drop("first")
    entries, resources = spark.createDataFrame([("texts", "texts")], "entry string, owner string"), spark.createDataFrame([], "name string, owner string")
    return envelope.input_violations(heads, objects, twice, envelope.change_type(), entries, resources)


@query(
    """WITH d AS (SELECT DISTINCT doc_id AS i FROM documents)
SELECT i AS chain, 2 AS sequence, 1 AS check_ordinal, 'parent' AS code FROM d WHERE i % 5 IN (1, 2, 3) UNION ALL SELECT i, 2, 2, 'sequence' FROM d WHERE i % 5 = 3 UNION ALL SELECT i, 2, 3, 'policy_backwards' FROM d WHERE i % 5 = 4"""
)
def q78_release_successors(spark, sf_dir):
    """A chain of two releases for each document, whose second names another parent, another snapshot, none that there is, or an earlier policy."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chain")).distinct()
    k, rid = F.col("chain") % 5, V.sha256(F.concat(F.lit("r"), F.col("chain").cast("string")))
    sid = V.sha256(F.concat(F.lit("s"), F.col("chain").cast("string")))
    rows = d.select("chain", F.lit(2).alias("sequence"), F.when(k == 1, ZERO).otherwise(rid).alias("parent_release_id"), F.when(k == 2, ZERO).otherwise(sid).alias("parent_snapshot_id"), F.when(k == 4, "2023-12-31T23:59:59.9Z").otherwise("2024-01-01T01:00:00+01:00").alias("policy_as_of"))
    parents = d.where(k != 3).select("chain", F.lit(1).alias("sequence"), rid.alias("release_id"), sid.alias("snapshot_id"), F.lit("2024-01-01T00:00:00Z").alias("policy_as_of"))
    return envelope.successor_violations(rows, parents).select("chain", "sequence", "check_ordinal", "code")


@query(
    """SELECT doc_id, 'sha256:' || sha256('{"changes":[{"n":' || n_chars || '}],"parent_digest":' || CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE '"sha256:' || sha256(text) || '"' END || ',"projection":"' || source || '","transition_contract":"catalogue.transition/v1"}') AS digest FROM documents"""
)
def q79_resource_transitions(spark, sf_dir):
    """One step of a chained resource for each document, a third of them the first of their chain."""
    parent = F.when(F.col("doc_id") % 3 != 0, V.sha256(F.col("text")))
    changed = F.concat(F.lit('[{"n":'), F.col("n_chars").cast("string"), F.lit("}]"))
    return table(spark, sf_dir, "documents").select("doc_id", envelope.transition_digest("catalogue.transition/v1", F.col("source"), parent, changed).alias("digest"))


@query(
    r"""WITH d AS (SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN lang || '-' || doc_id WHEN 1 THEN lang || '.' || source WHEN 2 THEN upper(lang) WHEN 3 THEN lang || '--' || doc_id WHEN 4 THEN 'sha256:' || sha256(text) WHEN 5 THEN 'sha256:' || upper(sha256(text)) WHEN 6 THEN 'op_' || substr(sha256(text), 1, 26)
 WHEN 7 THEN '2024-01-0' || (1 + doc_id % 9) || 'T00:00:00.' || doc_id || '+01:00' WHEN 8 THEN lang || chr(10) ELSE lang || '_' || doc_id END AS t FROM documents)
SELECT doc_id, regexp_matches(t, '\A[a-z0-9][a-z0-9_-]*\z') AS identifier, regexp_matches(t, '\A[a-z0-9][a-z0-9_-]*([.][a-z0-9][a-z0-9_-]*)*\z') AS actor, regexp_matches(t, '\A[a-z0-9]+(-[a-z0-9]+)*\z') AS slug, regexp_matches(t, '\Asha256:[a-f0-9]{64}\z') AS digest,
 regexp_matches(t, '\Aop_[0-9a-hjkmnp-tv-z]{26}\z') AS operation, regexp_matches(t, '\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.]\d+)?(Z|[+-]\d{2}:\d{2})\z') AS instant FROM d"""
)
def q80_grammars(spark, sf_dir):
    """Ten forms of names made from documents, against all grammars."""
    i, k, lang = F.col("doc_id").cast("string"), F.col("doc_id") % 10, F.col("lang")
    sha = F.sha2("text", 256)
    forms = [F.concat(lang, F.lit("-"), i), F.concat(lang, F.lit("."), "source"), F.upper(lang), F.concat(lang, F.lit("--"), i), F.concat(F.lit("sha256:"), sha), F.concat(F.lit("sha256:"), F.upper(sha)), F.concat(F.lit("op_"), F.substring(sha, 1, 26))]
    forms += [F.concat(F.lit("2024-01-0"), (1 + F.col("doc_id") % 9).cast("string"), F.lit("T00:00:00."), i, F.lit("+01:00")), F.concat(lang, F.lit("\n")), F.concat(lang, F.lit("_"), i)]
    t = forms[0]
    for n, form in enumerate(forms):
        t = F.when(k == n, form).otherwise(t)
    names = {"identifier": V.IDENTIFIER, "actor": V.ACTOR_IDENTIFIER, "slug": V.SLUG, "digest": V.DIGEST, "operation": V.OPERATION_ID, "instant": V.INSTANT}
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", *[F.col("t").rlike(p).alias(n) for n, p in names.items()])


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 4 = 1")
def q81_unsealed_changes(spark, sf_dir):
    """Documents as sealed changes; one in four was changed after that."""
    sealed = changes.sealed(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.lit("x").alias("note")), ["doc_id", "lang", "n_chars", "note"])
    return changes.unsealed(sealed.withColumn("note", F.when(F.col("doc_id") % 4 == 1, "y").otherwise(F.col("note"))), ["doc_id", "lang", "n_chars", "note"]).select("doc_id", "lang")


@query(
    """SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN 'instance_id' WHEN 2 THEN 'kind' WHEN 3 THEN 'id' WHEN 4 THEN 'subject_id' WHEN 5 THEN 'revision' ELSE '' END AS issues FROM documents"""
)
def q82_current_records(spark, sf_dir):
    """Documents as current records; five in six break a rule."""
    k, digest = F.col("doc_id") % 6, V.sha256(F.col("text"))
    columns = {
        "instance_id": F.when(k == 1, F.upper("lang")).otherwise(F.col("lang")), "kind": F.when(k == 2, "").otherwise("text"), "id": F.when(k == 3, "a b").when(k == 0, digest).otherwise(F.concat(F.lit("d"), F.col("doc_id").cast("string"))),
        "subject_id": F.when(k != 4, F.col("source")), "revision": F.when(k == 5, F.substring(digest, 1, 70)).otherwise(digest),
    }
    rows = table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in columns.items()])
    return rows.select("doc_id", F.array_join(identity.current_record_issues(), ",").alias("issues"))


@query(
    """WITH p AS (SELECT DISTINCT page_id AS i FROM pages)
SELECT 'pages/p' || i || '.html' AS path, CASE i % 5 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 END AS check_ordinal, CASE i % 5 WHEN 1 THEN 'undeclared' WHEN 2 THEN 'missing' WHEN 3 THEN 'size' WHEN 4 THEN 'bytes' END AS code FROM p WHERE i % 5 > 0"""
)
def q83_stored_bytes(spark, sf_dir):
    """All pages as the files of a stored release, four in five of which are not what was declared."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha2("html", 256))
    k, path = F.col("page_id") % 5, F.concat(F.lit("pages/p"), F.col("page_id").cast("string"), F.lit(".html"))
    # of the rows of one number the one with the largest digest; its file and its declaration are taken apart, so that texts are shuffled once
    files = pages.where(k != 2).groupBy("page_id").agg(F.max_by("html", "sha").alias("html")).select(path.alias("path"), F.col("html").cast("binary").alias("content"))
    root = f"{shared_folder(spark)}/release-{uuid.uuid4().hex}"
    tree_sink.write_release(files, root, "{}\n", together=True)
    named = pages.where(k != 1).groupBy("page_id").agg(F.max(F.struct("sha", F.octet_length("html").cast("long").alias("n"))).alias("x"))
    declared = named.select(path.alias("path"), F.when(k == 4, ZERO).otherwise(F.concat(F.lit("sha256:"), "x.sha")).alias("sha256"), F.when(k == 3, F.col("x.n") + 1).otherwise(F.col("x.n")).alias("bytes"))
    return tree_sink.release_faults(spark, root, declared, "{}\n")



@query("SELECT lang AS subject_type, source AS subject_id, count(*) AS n_changes FROM documents GROUP BY lang, source HAVING count(*) > 1")
def q84_repeated_subjects(spark, sf_dir):
    """Documents as changes of their language and source: the subjects with more than one."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("subject_type"), F.col("source").alias("subject_id"))
    return changes.repeated_subjects(docs, ["subject_type", "subject_id"])
