"""Deterministic sharded projections: layout, inventory, routing, closure checks and incremental maintenance.

A row (id, line) belongs to the shard named by a prefix of the SHA-256 of its id. The layout gives every row the
shallowest prefix of 1 to 4 hex digits whose rows fit `max_bytes`. Prefix totals are summed once at four digits, so that
everything after that works on 65536 rows at most, whatever the size of the projection; the leaf table is broadcast on that bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealwright.functions.values import DIGEST, canonical_json, json_string, sha256, utf16_key
from sealwright.session import written

DEPTH = 4


def shard_path(id_: Column, depth: int | Column = 1) -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.concat(F.lit("data/"), F.substring(F.sha2(id_, 256), F.lit(1), depth), F.lit(".jsonl"))


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("p4", F.substring(F.sha2("id", 256), 1, DEPTH))


def layout(rows: DataFrame, max_bytes: int) -> DataFrame:
    """(p4, depth, bytes): the depth of the leaf that holds each four-digit prefix. A leaf over the limit has depth 4 and too many bytes."""
    fine = _hashed(rows).groupBy("p4").agg(F.sum(F.octet_length("line") + 1).alias("b"))
    every = fine.select("p4", "b", F.explode(F.sequence(F.lit(1), F.lit(DEPTH))).alias("depth"))
    total = F.sum("b").over(Window.partitionBy("depth", F.expr("substring(p4, 1, depth)")))
    sized = every.withColumn("bytes", total)
    return sized.where((F.col("bytes") <= max_bytes) | (F.col("depth") == DEPTH)).groupBy("p4").agg(F.min(F.struct("depth", "bytes")).alias("x")).select("p4", "x.depth", "x.bytes")


def placed(rows: DataFrame, max_bytes: int) -> DataFrame:
    """`rows` with the path of their shard."""
    leaves = layout(rows, max_bytes).select("p4", "depth")
    return _hashed(rows).join(F.broadcast(leaves), "p4").withColumn("path", F.expr("concat('data/', substring(p4, 1, depth), '.jsonl')")).drop("p4", "depth")


def inventory(placed_rows: DataFrame) -> DataFrame:
    """(path, digest, bytes, rows) of each shard; a shard's rows are in the order of their ids. Its size is bounded by the layout."""
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n"), F.lit("\n"))
    out = placed_rows.groupBy("path").agg(text.alias("text"), F.count("*").alias("rows"))
    return out.select("path", sha256(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("bytes"), "rows")


def shards(rows: DataFrame, max_bytes: int) -> DataFrame:
    return inventory(placed(rows, max_bytes))


def shard_rows(files: DataFrame) -> DataFrame:
    """(path, n, id, line): the rows of shard files (path, content: bytes or null) by line; nothing for a shard that is missing."""
    text = F.decode(F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content")), "utf-8")
    lines = files.select("path", F.posexplode(F.split(F.regexp_replace(text, r"\n\z", ""), "\n")).alias("n", "line"))
    return lines.select("path", "n", F.get_json_object("line", "$.id").alias("id"), "line")


def _found(ordinal: int, code: str) -> Column:
    return F.struct(F.lit(ordinal).alias("check_ordinal"), F.lit(code).alias("code"))


def shard_violations(files: DataFrame) -> DataFrame:
    """(path, check_ordinal, code) of shard files (path, content: bytes or null, a missing shard is empty): what a strict reader refuses.

    1 empty: stored without bytes. 2 encoding: not UTF-8. 3 final_newline. 4 blank_row. 5 row: no canonical form, or no text as id. 6 misplaced: the id
    belongs elsewhere. 7 order: ids repeat or descend. 8 not_canonical. A file is bounded by the layout's limit, so its rows meet in one group.
    """
    stored = files.where("content is not null")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    whole = F.array_compact(
        F.array(
            F.when(F.octet_length("content") == 0, _found(1, "empty")),
            F.when(~valid, _found(2, "encoding")),
            F.when(valid & (F.octet_length("content") > 0) & (F.expr("right(hex(content), 2)") != "0A"), _found(3, "final_newline")),
        )
    )
    rows = shard_rows(stored.where(F.octet_length("content") > 0)).withColumn("c", canonical_json(F.col("line")))
    before = F.lag("id").over(Window.partitionBy("path").orderBy("n"))
    depth = F.length("path") - F.lit(len("data/.jsonl"))
    text, known = F.col("c.text"), F.col("id").isNotNull()
    by_row = F.array_compact(
        F.array(
            F.when(F.col("line") == "", _found(4, "blank_row")),
            F.when((F.col("line") != "") & (text.isNull() | ~known), _found(5, "row")),
            F.when(known & (shard_path(F.col("id"), depth) != F.col("path")), _found(6, "misplaced")),
            F.when(known & (utf16_key(F.col("before")) >= utf16_key(F.col("id"))), _found(7, "order")),
            F.when(text != F.col("line"), _found(8, "not_canonical")),
        )
    )
    found = rows.withColumn("before", before).select("path", F.explode(by_row).alias("x"))
    return stored.select("path", F.explode(whole).alias("x")).union(found).select("path", "x.check_ordinal", "x.code").distinct()


def manifest(inventories: DataFrame, contract: str, max_bytes: int) -> DataFrame:
    """(source_release_id, manifest) from shard entries (source_release_id, source_sequence, projector_digest, path, digest, bytes, rows).

    The manifest is the canonical text of the closed snapshot with a final line feed. A snapshot has 65536 shards at most, so its entries meet in one row.
    Release and projector must be digests and the sequence positive, else the manifest is null.
    """
    entry = F.concat(F.lit('{"bytes":'), F.col("bytes").cast("string"), F.lit(',"digest":'), json_string(F.col("digest"), True), F.lit(',"path":'), json_string(F.col("path"), True), F.lit(',"rows":'), F.col("rows").cast("string"), F.lit("}"))
    shards_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", entry.alias("entry")))), lambda x: x["entry"]), ",")
    closed = inventories.groupBy("source_release_id", "source_sequence", "projector_digest").agg(shards_.alias("s"), F.sum("rows").alias("n"))
    text = F.concat(
        F.lit('{"contract":'), json_string(F.lit(contract), contract.isascii()), F.lit(f',"maxShardBytes":{max_bytes},"projectorDigest":'), json_string(F.col("projector_digest"), True), F.lit(',"rowCount":'), F.col("n").cast("string"),
        F.lit(',"shards":['), F.col("s"), F.lit('],"sourceReleaseId":'), json_string(F.col("source_release_id"), True), F.lit(',"sourceSequence":'), F.col("source_sequence").cast("string"), F.lit("}\n"),
    )
    ok = F.col("source_release_id").rlike(DIGEST) & F.col("projector_digest").rlike(DIGEST) & (F.col("source_sequence") >= 1)
    return closed.select("source_release_id", F.when(ok, text).alias("manifest"))


ENTRIES = "struct<bytes: bigint, digest: string, path: string, rows: bigint>"


def parsed_manifest(manifests: DataFrame, contract: str) -> DataFrame:
    """`manifests` (manifest: text) with issue and snapshot, which is null where the text is refused.

    Issues, the first that applies: not_canonical (or no final line feed), shape (other members or types), contract, digests, counts, size (a shard over
    the limit), path, order (paths repeat or descend), overlap, total.
    """
    line = F.regexp_replace("manifest", r"\n\z", "")
    kind = f"struct<contract: string, maxShardBytes: bigint, projectorDigest: string, rowCount: bigint, shards: array<{ENTRIES}>, sourceReleaseId: string, sourceSequence: bigint>"
    # what the fixed shape reads must write the same text again: nothing else was there, nothing was converted
    rows = manifests.withColumn("snapshot", F.from_json(line, kind)).withColumn("c_", canonical_json(line))
    s = F.col("snapshot")
    entries, prefixes = s["shards"], F.transform(s["shards"]["path"], lambda p: F.regexp_extract(p, r"\Adata/([0-9a-f]{1,4})\.jsonl\z", 1))
    above = F.flatten(F.transform(F.col("prefixes_"), lambda p: F.transform(F.filter(F.sequence(F.lit(1), F.lit(DEPTH)), lambda i: i < F.length(p)), lambda i: F.substring(p, F.lit(1), i))))
    # looked up in a hash set: a manifest has 65536 shards at most, too many to compare with one another
    inside = F.arrays_overlap(F.array_distinct(above), F.col("prefixes_"))
    rules = [
        ("not_canonical", F.col("manifest").endswith("\n") & (F.col("c_.text") == line)),
        ("shape", F.to_json(s) == line),
        ("contract", s["contract"] == contract),
        ("digests", s["sourceReleaseId"].rlike(DIGEST) & s["projectorDigest"].rlike(DIGEST) & F.forall(entries, lambda e: e["digest"].rlike(DIGEST))),
        ("counts", (s["sourceSequence"] >= 1) & (s["maxShardBytes"] >= 1) & (s["rowCount"] >= 0) & F.forall(entries, lambda e: (e["bytes"] >= 1) & (e["rows"] >= 1))),
        ("size", F.forall(entries, lambda e: e["bytes"] <= s["maxShardBytes"])),
        ("path", F.forall(F.col("prefixes_"), lambda p: p != "")),
        ("order", entries["path"] == F.array_sort(F.array_distinct(entries["path"]))),
        ("overlap", ~inside),
        ("total", F.aggregate(entries, F.lit(0).cast("long"), lambda a, e: a + e["rows"]) == s["rowCount"]),
    ]
    issue = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), code) for code, ok in rules])
    out = rows.withColumn("prefixes_", prefixes).withColumn("issue", issue)
    return out.withColumn("snapshot", F.when(F.col("issue").isNull(), s)).drop("c_", "prefixes_")


def duplicate_ids(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").count().where("count > 1").select("id")


def closure_violations(manifest: DataFrame, max_bytes: int, row_count: int | None = None) -> DataFrame:
    """(check_ordinal, code, path) for each broken rule of an inventory."""
    prefix = F.regexp_extract("path", r"\Adata/([0-9a-f]{1,4})\.jsonl\z", 1)
    known = manifest.withColumn("prefix", prefix)
    above = known.where("length(prefix) > 1").select("path", F.explode(F.transform(F.sequence(F.lit(1), F.length("prefix") - 1), lambda i: F.substring("prefix", F.lit(1), i))).alias("up"))
    overlap = above.join(known.select(F.col("prefix").alias("up")).distinct(), "up", "left_semi").select("path").distinct()
    parts = [
        known.where("prefix = ''").select(F.lit(1).alias("check_ordinal"), F.lit("path").alias("code"), "path"),
        known.where(~F.col("digest").rlike(r"\Asha256:[a-f0-9]{64}\z")).select(F.lit(2), F.lit("digest"), "path"),
        known.where("rows < 1 or bytes < 1").select(F.lit(3), F.lit("count"), "path"),
        known.where(F.col("bytes") > max_bytes).select(F.lit(4), F.lit("size"), "path"),
        known.groupBy("path").count().where("count > 1").select(F.lit(5), F.lit("duplicate"), "path"),
        overlap.select(F.lit(6), F.lit("overlap"), "path"),
    ]
    if row_count is not None:
        parts.append(known.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).where(F.col("n") != row_count).select(F.lit(7), F.lit("total"), F.lit(None).cast("string")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def route(ids: DataFrame, leaves: DataFrame) -> DataFrame:
    """`ids` (id) with the path that holds or would hold each: its leaf, else the first branch that is not split.

    Different prefixes of four hex digits at most bound what is broadcast, however many `leaves` (path) there are.
    """
    own = leaves.select(F.regexp_extract("path", r"\Adata/([0-9a-f]{1,4})\.jsonl\z", 1).alias("prefix")).distinct()
    branches = own.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("prefix") - 1), lambda i: F.substring("prefix", F.lit(1), i))).alias("prefix")).where("prefix <> ''").distinct()
    marked = own.withColumn("leaf", F.lit(True)).unionByName(branches.withColumn("leaf", F.lit(False)))
    steps = ids.withColumn("h", F.sha2("id", 256)).select("id", "h", F.explode(F.sequence(F.lit(1), F.lit(DEPTH))).alias("depth")).withColumn("prefix", F.expr("substring(h, 1, depth)"))
    found = steps.join(F.broadcast(marked), "prefix", "left").where("leaf is null or leaf")
    return found.groupBy("id").agg(F.min_by("prefix", "depth").alias("prefix")).select("id", F.concat(F.lit("data/"), "prefix", F.lit(".jsonl")).alias("path"))


def affected(changed_ids: DataFrame, leaves: DataFrame) -> DataFrame:
    return route(changed_ids, leaves).select("path").distinct()


def successor(previous: DataFrame, leaves: DataFrame, changes: DataFrame, max_bytes: int) -> DataFrame:
    """Rows of the affected shards after `changes` (id, line; a null line deletes), with the path of their shard.

    Only rows of affected shards are read and written. A shard that outgrows `max_bytes` is split below its own prefix; shards are never merged
    again. Deleting an unknown id does nothing. `previous` is (id, line, path).
    """
    routed = route(changes.select("id"), leaves)
    paths = routed.select("path").distinct()
    old = previous.join(F.broadcast(paths), "path", "left_semi").select("id", F.col("line").alias("old"), F.col("path").alias("old_path"))
    new = changes.join(routed, "id").select("id", F.col("line").alias("new"), F.col("path").alias("new_path"), F.lit(True).alias("changed"))
    merged = old.join(new, "id", "full").select("id", F.when(F.col("changed"), F.col("new")).otherwise(F.col("old")).alias("line"), F.coalesce("new_path", "old_path").alias("base")).where("line is not null")
    depth = F.length("base") - F.lit(len("data/.jsonl"))
    hashed = _hashed(merged).withColumn("least", depth)
    fine = hashed.groupBy("p4", "least").agg(F.sum(F.octet_length("line") + 1).alias("b"))
    every = fine.select("p4", "b", F.explode(F.sequence(F.col("least"), F.lit(DEPTH))).alias("depth"))
    sized = every.withColumn("bytes", F.sum("b").over(Window.partitionBy("depth", F.expr("substring(p4, 1, depth)"))))
    leaf = sized.where((F.col("bytes") <= max_bytes) | (F.col("depth") == DEPTH)).groupBy("p4").agg(F.min("depth").alias("depth"))
    return hashed.join(F.broadcast(leaf), "p4").select("id", "line", F.expr("concat('data/', substring(p4, 1, depth), '.jsonl')").alias("path"))


def inventory_changes(before: DataFrame, after_affected: DataFrame, affected_paths: DataFrame) -> DataFrame:
    """(path, action, digest, bytes, rows): write new or changed shards, delete shards that are gone, carry the rest."""
    was = before.select("path", F.col("digest").alias("was"), F.col("bytes").alias("was_bytes"), F.col("rows").alias("was_rows"))
    touched = affected_paths.select("path", F.lit(True).alias("touched"))
    both = was.join(after_affected, "path", "full").join(touched, "path", "left")
    action = F.when(F.col("digest").isNull() & F.col("touched"), "delete").when(F.col("digest").isNull() | F.col("digest").eqNullSafe(F.col("was")), "carry").otherwise("write")
    return both.select("path", action.alias("action"), F.coalesce("digest", "was").alias("digest"), F.coalesce("bytes", "was_bytes").alias("bytes"), F.coalesce("rows", "was_rows").alias("rows"))


# -- what a writer and a successor refuse ------------------------------------------------------------------------------


def leaf_violations(leaves: DataFrame) -> DataFrame:
    """(path, check_ordinal, code) of leaves (path) that cannot route: 1 path: no shard's name, 2 duplicate, 3 overlap: below another leaf.

    `route` is meaningful only where this is empty. Ancestors are three prefixes at most, so the last is an equi-join.
    """
    known = leaves.select("path", F.regexp_extract("path", r"\Adata/([0-9a-f]{1,4})\.jsonl\z", 1).alias("prefix"))
    bad = known.where("coalesce(prefix, '') = ''").select("path", F.lit(1).alias("check_ordinal"), F.lit("path").alias("code")).distinct()
    twice = known.groupBy("path").count().where("count > 1").select("path", F.lit(2), F.lit("duplicate"))
    above = known.where("length(prefix) > 1").distinct().select("path", F.explode(F.transform(F.sequence(F.lit(1), F.length("prefix") - 1), lambda i: F.substring("prefix", F.lit(1), i))).alias("prefix"))
    inside = above.join(known.where("prefix <> ''").select("prefix").distinct(), "prefix", "left_semi").select("path").distinct()
    return bad.union(twice).union(inside.select("path", F.lit(3), F.lit("overlap")))


def writer_violations(rows: DataFrame, max_bytes: int) -> DataFrame:
    """(check_ordinal, code, name) of rows (id, line) that no snapshot can hold: 1 no_id, 2 repeated_id, 3 no_line, 4 oversized: a leaf of the last depth above the limit."""
    none = F.lit(None).cast("string").alias("name")
    parts = [
        rows.where("id is null").limit(1).select(F.lit(1).alias("check_ordinal"), F.lit("no_id").alias("code"), none),
        duplicate_ids(rows.where("id is not null")).select(F.lit(2), F.lit("repeated_id"), "id"),
        rows.where("id is not null and line is null").select(F.lit(3), F.lit("no_line"), "id").distinct(),
        layout(rows.where("id is not null and line is not null"), max_bytes).where(F.col("bytes") > max_bytes).select(F.lit(4), F.lit("oversized"), F.concat(F.lit("data/"), "p4", F.lit(".jsonl"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def successor_violations(entries: DataFrame, files: DataFrame, changes: DataFrame, previous_sequence: int | None = None, next_sequence: int | None = None) -> DataFrame:
    """(path, check_ordinal, code): why no successor can be made of the manifest's `entries` (path, digest, bytes, rows), prior `files` (path, content) and `changes` (id, line).

    0 sequence: the next source does not follow the previous one. 1 to 3 as `leaf_violations` of the manifest. 4 repeated_change (path: the id) and 5 no_id. 6 not_affected: a file that no
    change needs, or of no entry. 7 missing: a needed file that is not there or null. 8 repeated_file. 9 digest, 10 counts: a file's bytes are not those of its entry. 11 to 18 as
    `shard_violations` of the needed files. Only needed files are hashed and parsed; the rest of the projection is not read.
    """
    leaves = entries.select("path").distinct()
    parts = [leaf_violations(entries.select("path"))]
    if next_sequence is not None and previous_sequence is not None and next_sequence <= previous_sequence:
        parts.append(entries.sparkSession.createDataFrame([(None, 0, "sequence")], "path string, check_ordinal int, code string"))
    ids = changes.where("id is not null").select("id")
    parts.append(duplicate_ids(ids).select("id", F.lit(4), F.lit("repeated_change")))
    parts.append(changes.where("id is null").limit(1).select(F.lit(None).cast("string"), F.lit(5), F.lit("no_id")))
    needed = written(affected(ids.distinct(), leaves).join(leaves, "path", "left_semi"), "needed-shards")
    given = files.where("content is not null").select("path", "content")
    parts.append(files.select("path").distinct().join(needed, "path", "left_anti").select("path", F.lit(6), F.lit("not_affected")))
    parts.append(needed.join(given.select("path").distinct(), "path", "left_anti").select("path", F.lit(7), F.lit("missing")))
    twice = files.groupBy("path").count().where("count > 1").select("path")
    parts.append(twice.select("path", F.lit(8), F.lit("repeated_file")))
    used = given.join(needed, "path", "left_semi").join(twice, "path", "left_anti")
    text = F.col("content").cast("string")
    have = used.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("has"), F.octet_length("content").alias("n"), F.regexp_count(text, F.lit("\n")).alias("k"))
    both = have.join(entries.select("path", "digest", "bytes", "rows"), "path")
    parts.append(both.where("has <> digest").select("path", F.lit(9), F.lit("digest")).distinct())
    parts.append(both.where("n <> bytes or k <> rows").select("path", F.lit(10), F.lit("counts")).distinct())
    parts.append(shard_violations(used).select("path", (F.col("check_ordinal") + 10).cast("int"), "code"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def prepared_successor(entries: DataFrame, files: DataFrame, changes: DataFrame, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(rows of the shards to write with their path, the inventory changes as `inventory_changes` gives them), from files that `successor_violations` finds nothing against."""
    leaves = entries.select("path")
    touched = affected(changes.select("id"), leaves)
    prior = shard_rows(files).select("id", "line", "path")
    rows = successor(prior, leaves, changes, max_bytes)
    return rows, inventory_changes(entries, inventory(rows), touched)
