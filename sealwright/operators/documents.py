"""Normal forms of captured documents by media type, and records whose shape is checked strictly: every refusal is a typed row.

HTML is not read into sections here; such documents are refused as `html`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealwright.functions.values import DIGEST, IDENTIFIER, INSTANT, canonical_json, normal_text, sha256, trimmed
from sealwright.session import written

HTML = ("text/html", "application/xhtml+xml")


def decoded(content: Column) -> Column:
    """The text of UTF-8 bytes without its byte order mark (and one more, as a reader that strips it twice does); null where they are none."""
    text = content.cast("binary").cast("string")
    return F.when(F.is_valid_utf8(text), F.regexp_replace(text, "\\A\ufeff{1,2}", ""))


def matches(kind: Column, patterns: list[str]) -> Column:
    """Whether a lower-cased media type is one of `patterns`; the first * of a pattern stands for any run between what is before and behind it."""
    out = F.lit(False)
    for p in patterns:
        head, star, tail = p.partition("*")
        out = out | ((F.startswith(kind, F.lit(head)) & F.endswith(kind, F.lit(tail))) if star else (kind == p))
    return F.coalesce(out, F.lit(False))


def normal_documents(docs: DataFrame, json_types: list[str], xml_types: list[str], content_col: str = "content", media_col: str = "media_type") -> DataFrame:
    """`docs` with a struct column `normal`: kind, issue, text, bytes, digest.

    kind is json, html or text, by the media type before its parameters; JSON types come first, then HTML, then XML types and all of text/. issue is null, or
    unsupported_media_type, html, encoding (no UTF-8), empty_document, or what keeps JSON from a canonical form (syntax, number, depth, colliding_keys). JSON becomes its canonical text, text its
    normal lines; both end with a line feed. A null content is empty. A column of `docs` that is named normal is replaced.
    """
    kind = F.lower(trimmed(F.substring_index(F.col(media_col), ";", 1)))
    which = F.when(matches(kind, json_types), "json").when(kind.isin(*HTML), "html").when(matches(kind, xml_types) | F.startswith(kind, F.lit("text/")), "text")
    rows = docs.withColumn("kind_", which)
    rows = rows.withColumn("text_", F.when(F.col("kind_").isin("json", "text"), decoded(F.coalesce(F.col(content_col), F.lit("").cast("binary")))))
    rows = rows.withColumn("json_", canonical_json(F.when(F.col("kind_") == "json", F.col("text_")))).withColumn("lines_", normal_text(F.when(F.col("kind_") == "text", F.col("text_"))))
    issue = (
        F.when(F.col("kind_").isNull(), "unsupported_media_type")
        .when(F.col("kind_") == "html", "html")
        .when(F.col("text_").isNull(), "encoding")
        .when(F.col("kind_") == "json", F.col("json_.issue"))
        .when(F.col("lines_").isNull(), "empty_document")
    )
    text = F.when(F.col("kind_") == "json", F.concat(F.col("json_.text"), F.lit("\n"))).otherwise(F.col("lines_"))
    rows = rows.withColumn("out_", text)
    out = F.col("out_")
    normal = F.struct(F.col("kind_").alias("kind"), issue.alias("issue"), out.alias("text"), F.octet_length(out).cast("long").alias("bytes"), F.when(out.isNotNull(), sha256(out)).alias("digest"))
    return rows.withColumn("normal", normal).drop("kind_", "text_", "json_", "lines_", "out_")


# -- records of unknown shape ------------------------------------------------------------------------------------------


def _escaped(key: Column) -> Column:
    for c, code in (("%", "%25"), (".", "%2E"), ("[", "%5B")):
        key = F.replace(key, F.lit(c), F.lit(code))
    return key


def visited(rows: DataFrame, id_col: str, payload: str) -> DataFrame:
    """(id_col, path, parent, key, at, type, text) of every value in JSON texts, the whole included; texts that are no JSON, or give a key twice, have none.

    path is `$`, `.key` and `[n]`; at is the path with `[]` for every index, in whose keys %, . and [ are percent-encoded; type is OBJECT, ARRAY, STRING, BOOLEAN, VOID or a number's. One level of
    all texts is exploded at a time, so the rounds are the greatest depth, and nothing is shuffled; a level is written before the next one.
    """
    spark = rows.sparkSession
    kind = F.substring_index(F.substring_index(F.schema_of_variant("value"), "<", 1), "(", 1)
    columns = [id_col, "path", "parent", "key", "at", "type", "text", "value"]

    def typed(level: DataFrame) -> DataFrame:
        level = level.withColumn("type", kind)
        return level.withColumn("text", F.when(F.col("type") == "STRING", F.try_variant_get("value", "$", "string")).when(~F.col("type").isin("OBJECT", "ARRAY", "VOID"), F.to_json("value"))).select(*columns)

    top = rows.withColumn("value", F.try_parse_json(payload)).where("value is not null")
    none = F.lit(None).cast("string")
    level = written(typed(top.select(id_col, F.lit("$").alias("path"), none.alias("parent"), none.alias("key"), F.lit("$").alias("at"), "value")), "visited")
    out = level.drop("value")
    while True:
        inner = level.where("type in ('OBJECT', 'ARRAY')").select(id_col, F.col("path").alias("p"), F.col("at").alias("a"), F.col("value").alias("v"))
        found = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.col("key")))
        below = found.select(id_col, F.concat("p", F.coalesce(step, F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))).alias("path"), F.col("p").alias("parent"), "key", F.concat("a", F.coalesce(F.concat(F.lit("."), _escaped(F.col("key"))), F.lit("[]"))).alias("at"), "value")
        level = written(typed(below), "visited")
        if not level.limit(1).count():
            return out
        out = out.unionByName(level.drop("value"))


@dataclass(frozen=True)
class Field:
    """What may stand at a path of a record. kind: object, array, string, integer, boolean or any (whose inside is not looked at)."""

    at: str
    kind: str
    required: bool = True
    nullable: bool = False
    values: tuple[str, ...] = ()
    pattern: str | None = None
    least: int = 0  # of an array's elements, or of an integer


@dataclass(frozen=True)
class Shape:
    """A strict record: keys that no field names are refused, but below `open` paths, whose keys must match a pattern."""

    fields: tuple[Field, ...]
    open: tuple[tuple[str, str], ...] = field(default=())


_KINDS = {"object": ("OBJECT",), "array": ("ARRAY",), "string": ("STRING",), "boolean": ("BOOLEAN",), "integer": ("BIGINT",)}


def strict_faults(rows: DataFrame, id_col: str, payload: str, shape: Shape) -> DataFrame:
    """(id_col, path, check_ordinal, code): 1 syntax, 2 unknown_key, 3 missing, 4 type, 5 value, 6 open_key, 7 too_few.

    The fields are few and broadcast; unknown keys are an anti join against them, missing ones an anti join of what each object must have against what it has. Below an unknown key,
    or a value of another type, nothing more is said.
    """
    spark = rows.sparkSession
    seen = written(visited(rows, id_col, payload), "strict")
    opened = dict(shape.open)
    # a key of an open object is one field, whatever its name
    star = F.lit(None).cast("string")
    for at in opened:
        star = F.when(F.regexp_extract("at", "\\A(" + _quoted(at) + ")\\.", 1) != "", F.lit(at)).otherwise(star)
    seen = seen.withColumn("under", star)
    named = F.col("at")
    for at in opened:
        named = F.when(F.col("under") == at, F.regexp_replace("at", "\\A" + _quoted(at) + r"\.[^.\[]*", at.replace("$", "\\$") + ".*")).otherwise(named)
    seen = seen.withColumn("spot", named)
    table = spark.createDataFrame([(f.at, f.kind, f.required, f.nullable, list(f.values), f.pattern, f.least) for f in shape.fields], "spot string, kind string, required boolean, nullable boolean, vals array<string>, pattern string, least int")
    spots = F.broadcast(table)
    known = seen.join(spots, "spot", "left")
    fault = lambda df, path, n, code: df.select(id_col, F.col(path).alias("path"), F.lit(n).alias("check_ordinal"), F.lit(code).alias("code"))
    syntax = rows.select(id_col, F.lit("$").alias("path"), F.try_parse_json(payload).isNull().alias("no")).where("no")
    null = (F.col("type") == "VOID") & F.col("nullable")
    right = F.col("kind") == "any"
    for name, types in _KINDS.items():
        right = right | ((F.col("kind") == name) & F.col("type").isin(*types))
    typed = known.where("kind is not null").withColumn("right", right | null)
    good = typed.where("right and type <> 'VOID'")
    parents = good.where("kind in ('object', 'array')").select(id_col, F.col("path").alias("parent"))
    unknown = known.where("kind is null and parent is not null").join(parents, [id_col, "parent"], "left_semi")
    below = typed.where("path = '$'").unionByName(typed.where("path <> '$'").join(parents, [id_col, "parent"], "left_semi").select(*typed.columns))
    value = F.when(F.size("vals") > 0, F.array_contains("vals", F.col("text"))).otherwise(F.lit(True)) & (F.col("pattern").isNull() | F.expr("text rlike pattern"))
    number = (F.col("kind") != "integer") | (F.col("text").try_cast("long") >= F.col("least"))
    needs = [(f.at.rpartition(".")[0], f.at.rpartition(".")[2]) for f in shape.fields if f.required and "." in f.at and not f.at.endswith((".*", "]"))]
    objects = good.where("kind = 'object'").select(id_col, "spot", "path")
    must = objects.join(F.broadcast(spark.createDataFrame(needs or [("", "")], "spot string, key string")), "spot").select(id_col, F.col("path").alias("parent"), "key")
    missing = must.join(seen.select(id_col, "parent", "key"), [id_col, "parent", "key"], "left_anti").withColumn("path", F.concat("parent", F.lit("."), "key"))
    sizes = seen.where("key is null and parent is not null").groupBy(id_col, F.col("parent").alias("path")).agg(F.count("*").alias("n"))
    few = good.where("kind = 'array' and least > 0").join(sizes, [id_col, "path"], "left").where("coalesce(n, 0) < least")
    keys = seen.where("under is not null").where(F.col("at") == F.concat("under", F.lit("."), _escaped(F.col("key"))))
    bad_key = F.lit(False)
    for at, pattern in opened.items():
        bad_key = bad_key | ((F.col("under") == at) & ~F.col("key").rlike(pattern))
    parts = [
        fault(syntax, "path", 1, "syntax"),
        fault(unknown, "path", 2, "unknown_key"),
        fault(missing, "path", 3, "missing"),
        fault(below.where("not right"), "path", 4, "type"),
        fault(good.where(~F.coalesce(value & number, F.lit(False))), "path", 5, "value"),
        fault(keys.where(bad_key), "path", 6, "open_key"),
        fault(few, "path", 7, "too_few"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _quoted(at: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in at)


# -- the shapes of a release's own records -----------------------------------------------------------------------------


def change_shape(kinds: tuple[str, ...], subject_types: tuple[str, ...], tombstone: tuple[Field, ...] = (), at: str = "$") -> Shape:
    """A change record over an instance's vocabulary. The fields of `tombstone` are relative to it (`.reason`)."""
    d = lambda name, **k: Field(f"{at}.{name}", "string", pattern=DIGEST, **k)
    name = rf"(?:{IDENTIFIER})|(?:{DIGEST})"
    fields = [Field(at, "object"), d("change_id"), Field(f"{at}.kind", "string", values=kinds), Field(f"{at}.subject_type", "string", values=subject_types), Field(f"{at}.subject_id", "string", pattern=name)]
    fields += [d(n, required=False) for n in ("revision_digest", "previous_revision_digest", "projection_digest", "previous_projection_digest")]
    fields += [Field(f"{at}.basis_event_ids", "array"), Field(f"{at}.basis_event_ids[]", "string", pattern=DIGEST), Field(f"{at}.tombstone", "object", required=False)]
    return Shape(tuple(fields + [Field(f"{at}.tombstone{f.at}", f.kind, f.required, f.nullable, f.values, f.pattern, f.least) for f in tombstone]))


CONTRACTS = ("manifest", "snapshot", "artifact", "release", "descriptor", "diff", "bundle", "resourceTransition")
_PATH_KEY = r"\A[a-z0-9][a-z0-9._-]*(?:/[a-z0-9][a-z0-9._-]*)*\z"


def envelope_shapes(contracts: dict[str, str], change: Shape) -> dict[str, Shape]:
    """The strict shapes of manifest, descriptor, diff and bundle under eight different contract names; ValueError for other ones.

    `change` comes from `change_shape`; a diff holds an array of it.
    """
    if set(contracts) != set(CONTRACTS) or not all(contracts.values()) or len(set(contracts.values())) != len(CONTRACTS):
        raise ValueError("eight different, non-empty contract names are needed")

    def text(at: str, pattern: str | None = None, **k) -> Field:
        return Field(at, "string", pattern=pattern, **k)

    def declared(at: str) -> tuple[list[Field], tuple[str, str]]:
        return [Field(at, "object"), Field(f"{at}.*", "object"), text(f"{at}.*.sha256", DIGEST), Field(f"{at}.*.bytes", "integer")], (at, _PATH_KEY)

    def resources(at: str) -> tuple[list[Field], tuple[str, str]]:
        return [Field(at, "object"), text(f"{at}.*", DIGEST)], (at, IDENTIFIER)

    def descriptor(at: str) -> tuple[list[Field], list[tuple[str, str]]]:
        s, r = f"{at}.snapshot_core", f"{at}.release_core"
        inner, opened = resources(f"{s}.resource_digests")
        fields = [Field(at, "object"), text(f"{at}.descriptor_contract", values=(contracts["descriptor"],)), text(f"{at}.snapshot_id", DIGEST), text(f"{at}.release_id", DIGEST), Field(s, "object"), Field(r, "object")]
        fields += [text(f"{s}.snapshot_contract", values=(contracts["snapshot"],)), Field(f"{s}.release_sequence", "integer", least=1), text(f"{s}.compiler_version", r"(?s)."), text(f"{s}.artifact_contract", values=(contracts["artifact"],)), text(f"{s}.policy_as_of", INSTANT)]
        fields += [text(f"{s}.{n}", DIGEST) for n in ("input_set_digest", "artifact_digest", "root_set_digest", "signer_registry_digest")] + [text(f"{s}.trust_transition_digest", DIGEST, nullable=True)] + inner
        fields += [text(f"{r}.release_contract", values=(contracts["release"],)), Field(f"{r}.release_sequence", "integer", least=1), text(f"{r}.snapshot_id", DIGEST), text(f"{r}.parent_release_id", DIGEST, nullable=True), text(f"{r}.diff_digest", DIGEST)]
        return fields, [opened]

    objects, opened_objects = declared("$.objects")
    files, opened_files = declared("$.files")
    own, opened_own = resources("$.resource_digests")
    inner, opened_inner = descriptor("$.release")
    whole, opened_whole = descriptor("$")
    moved = [Field(f.at.replace("$", "$.changes[]", 1), f.kind, f.required, f.nullable, f.values, f.pattern, f.least) for f in change.fields]
    digests = [text(f"$.{n}", DIGEST) for n in ("verifier_digest", "object_manifest_digest", "bundle_digest")]
    return {
        "manifest": Shape((Field("$", "object"), text("$.manifest_contract", values=(contracts["manifest"],)), *objects), (opened_objects,)),
        "descriptor": Shape(tuple(whole), tuple(opened_whole)),
        "diff": Shape((Field("$", "object"), text("$.diff_contract", values=(contracts["diff"],)), text("$.parent_snapshot_id", DIGEST, nullable=True), text("$.snapshot_id", DIGEST), Field("$.changes", "array"), *moved)),
        "bundle": Shape(
            (Field("$", "object"), text("$.bundle_contract", values=(contracts["bundle"],)), Field("$.admitted_input_digests", "array", least=1), text("$.admitted_input_digests[]", DIGEST), *digests, *inner, *own, *files),
            (*opened_inner, opened_own, opened_files),
        ),
    }
