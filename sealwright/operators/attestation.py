"""Sealed captures and their attestations: digests that are computed again, framed bytes to sign, and the closure of three sealed tables.

Nothing is signed here and no signature is checked. What a signature must cover is: the domain, a NUL and canonical JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealwright.functions.values import DIGEST, IDENTIFIER, canonical, digest, instant_key
from sealwright.operators.capture import _chained, attempt_rules, issues_of, start_rules, with_method
from sealwright.operators.keys import key_verdicts


def _struct(*fields: str, optional: tuple[str, ...] = (), **kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(f, kinds.get(f, T.StringType()), True, {"presence": "optional"} if f in optional else {}) for f in sorted(fields)])


METHOD = _struct("name", "version")
START = _struct("capture_key", "request_digest", "lease_token", "source_url", "requested_url", "started_at", "lease_until", "method", "method_registry_digest", method=METHOD)
_ATTEMPT = ("source_url", "requested_url", "checked_at", "method", "method_registry_digest", "outcome", "reason", "final_url", "redirect_chain", "response_status_code", "media_type", "content_digest", "content_bytes", "archive_snapshot_at")
ATTEMPT = _struct(
    *_ATTEMPT, optional=_ATTEMPT[6:], method=METHOD, redirect_chain=T.ArrayType(_struct("from", "to")), response_status_code=T.IntegerType(), content_bytes=T.LongType()
)
CORE = _struct("attestation_contract", "capture_key", "start_digest", "attempt_digest", "method_registry_digest", "signed_at")
HEADER = _struct("signature_purpose", "issuer_id", "key_id", "signer_registry_digest", "algorithm")
#: Fixed value: the algorithm of a header, and the text form of its signature.
ALGORITHM, SIGNATURE = "ed25519", r"\A[A-Za-z0-9+/]{86}==\z"


# -- bytes and their text forms ----------------------------------------------------------------------------------------


def preimage(domain: list[str], payload: Column) -> Column:
    """The bytes that a signature covers: the domain's parts and `payload`, which is canonical JSON already, with a NUL behind each part."""
    if not domain or any(not d or "\0" in d for d in domain):
        raise ValueError("a domain has parts, which are not empty and have no NUL")
    return F.concat(F.lit("".join(d + "\0" for d in domain)), payload).cast("binary")


def from_base64(c: Column) -> Column:
    """The bytes of the one base-64 text that stands for them; null for every other text."""
    data = F.try_to_binary(c, F.lit("base64"))
    # Spark may break long texts into lines
    return F.when(c.rlike(r"\A[A-Za-z0-9+/]*={0,2}\z") & (F.regexp_replace(F.base64(data), r"[\r\n]", "") == c), data)


def from_base64url(c: Column) -> Column:
    """The bytes of an unpadded base-64 text of the URL alphabet; null for what is not the one text that stands for them."""
    plain = F.translate(c, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")
    return F.when(c.rlike(r"\A[A-Za-z0-9_-]*\z") & (F.length(c) % 4 != 1), from_base64(padded))


# -- sealed starts and attempts ----------------------------------------------------------------------------------------


def _digests(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).rlike(DIGEST)
    return out


def sealed_starts(starts: DataFrame, methods: DataFrame) -> DataFrame:
    """`starts` (the fields of START) with issues, and start_digest of those without any: a refused reservation is not sealed.

    methods: registry_digest, name, version, capabilities of the installed registries.
    """
    rows = with_method(starts.withColumn("registry_digest", F.col("method_registry_digest")), methods)
    rules = start_rules() | {"digests": _digests("capture_key", "request_digest", "method_registry_digest")}
    out = rows.withColumn("issues", issues_of(rules))
    out = out.withColumn("start_digest", F.when(F.size("issues") == 0, digest(F.struct(*START.fieldNames()), START)))
    return out.drop("registry_digest", "name", "version", "capabilities")


def sealed_attempts(attempts: DataFrame, methods: DataFrame) -> DataFrame:
    """`attempts` (the fields of ATTEMPT; those that an outcome does not have are null) with issues, and attempt_digest of those without any."""
    rows = _chained(with_method(attempts.withColumn("registry_digest", F.col("method_registry_digest")), methods))
    instants = instant_key(F.col("checked_at")).isNotNull() & (F.col("archive_snapshot_at").isNull() | instant_key(F.col("archive_snapshot_at")).isNotNull())
    rules = attempt_rules() | {"digests": _digests("method_registry_digest") & (F.col("content_digest").isNull() | _digests("content_digest")), "instants": instants}
    out = rows.withColumn("issues", issues_of(rules))
    out = out.withColumn("attempt_digest", F.when(F.size("issues") == 0, digest(F.struct(*ATTEMPT.fieldNames()), ATTEMPT)))
    return out.drop("registry_digest", "name", "version", "capabilities", "chain_")


def unsealed(rows: DataFrame, methods: DataFrame, which: str) -> DataFrame:
    """Sealed starts or attempts (`which` is start or attempt) that break a rule, or whose digest is not that of the rest; with issues."""
    seal = {"start": sealed_starts, "attempt": sealed_attempts}[which]
    again = seal(rows.withColumnRenamed(f"{which}_digest", "given"), methods)
    return again.where(~F.col(f"{which}_digest").eqNullSafe(F.col("given"))).drop(f"{which}_digest").withColumnRenamed("given", f"{which}_digest")


def settlement(start: str = "s", result: str = "r") -> Column:
    """Why a result (a struct column) does not settle its start: method, registry, url or too_early; null where it does."""
    s, r = F.col(start), F.col(result)
    same = lambda c: F.coalesce(s[c] == r[c], F.lit(False))
    return (
        F.when(~same("source_url") | ~same("requested_url"), "url")
        .when(~F.coalesce((s["method"]["name"] == r["method"]["name"]) & (s["method"]["version"] == r["method"]["version"]), F.lit(False)), "method")
        .when(~same("method_registry_digest"), "registry")
        .when(~F.coalesce(instant_key(r["checked_at"]) >= instant_key(s["started_at"]), F.lit(False)), "too_early")
    )


# -- attestations ------------------------------------------------------------------------------------------------------


def core(contract: str, start: Column, attempt: Column, signed_at: Column) -> Column:
    """The core of an attestation of sealed structs; it is meaningful where `settlement` is null and the signing is not before the result."""
    values = {"attestation_contract": F.lit(contract), "capture_key": start["capture_key"], "start_digest": start["start_digest"], "attempt_digest": attempt["attempt_digest"], "method_registry_digest": start["method_registry_digest"], "signed_at": signed_at}
    return F.struct(*[values[f].alias(f) for f in CORE.fieldNames()])


def signature_preimage(domain: str, attestation_digest: Column, header: Column) -> Column:
    """The bytes that an attestation's signer signs; `header` has the fields of HEADER, a signature beside them is left out."""
    kind = T.StructType([T.StructField("attestation_digest", T.StringType()), T.StructField("protected", HEADER)])
    value = F.struct(attestation_digest.alias("attestation_digest"), F.struct(*[header[f].alias(f) for f in HEADER.fieldNames()]).alias("protected"))
    return preimage([domain], canonical(value, kind))


def header_fault(header: Column, purpose: str) -> Column:
    """The first rule that a protected header breaks: purpose, names, registry, algorithm, signature; null for none."""
    no = lambda ok: ~F.coalesce(ok, F.lit(False))
    return (
        F.when(no(header["signature_purpose"] == purpose), "purpose")
        .when(no(header["issuer_id"].rlike(IDENTIFIER) & header["key_id"].rlike(IDENTIFIER)), "names")
        .when(no(header["signer_registry_digest"].rlike(DIGEST)), "registry")
        .when(no(header["algorithm"] == ALGORITHM), "algorithm")
        .when(no(header["signature"].rlike(SIGNATURE) & from_base64(header["signature"]).isNotNull()), "signature")
    )


def signing_request_issues(contract: str, core_contract: str) -> Column:
    """The broken rules of a request to sign: signing_contract, core (a struct), attestation_digest."""
    c = F.col("core")
    rules = {
        "contract": F.col("signing_contract") == contract,
        "core_contract": c["attestation_contract"] == core_contract,
        "core": c["capture_key"].rlike(DIGEST) & c["start_digest"].rlike(DIGEST) & c["attempt_digest"].rlike(DIGEST) & c["method_registry_digest"].rlike(DIGEST) & instant_key(c["signed_at"]).isNotNull(),
        "digest": F.col("attestation_digest") == digest(F.struct(*[c[f].alias(f) for f in CORE.fieldNames()]), CORE),
    }
    return issues_of(rules)


def trusted(attestations: DataFrame, keys: DataFrame, registry_digest: str, purpose: str, sequence: int | None = None) -> DataFrame:
    """`attestations` with trust: other_registry where they name another signer registry than `registry_digest`, else the verdict on their key at the time of signing.

    keys: the columns of `key_verdicts`. A key that was compromised is refused from its sequence on, or always without `sequence`.
    """
    facts = attestations.withColumns({"key_id": F.col("protected.key_id"), "issuer_id": F.col("protected.issuer_id"), "purpose": F.lit(purpose), "at": F.col("signed_at"), "sequence": F.lit(sequence).cast("long")})
    judged = key_verdicts(facts, keys)
    trust = F.when(~F.coalesce(F.col("protected.signer_registry_digest") == registry_digest, F.lit(False)), "other_registry").otherwise(F.col("verdict"))
    return judged.withColumn("trust", trust).select(*attestations.columns, "trust")


def verdicts(starts: DataFrame, attempts: DataFrame, attestations: DataFrame, methods: DataFrame, contract: str, purpose: str) -> DataFrame:
    """(attestation_digest, verdict) for each of `attestations` (the fields of CORE, attestation_digest, protected with signature), by the first rule that fails.

    repeated: its digest is given twice. contract; purpose, names, registry, algorithm or signature of the header. no_start, no_attempt: a side is not in the set. repeated_start, repeated_attempt. start,
    attempt: that side is not sealed, its digest is computed again. url, method, registry_of_method, before_start: the result does not settle the start. too_early: signed before the result. core, digest: the core
    that both sides give is another one. two_attempts: its start settles several. proved. All joins are on digests; those of starts and attempts are unique or refused.
    """

    # digests share their first bytes, by which Spark sorts: their hashes lead the keys
    hashed = lambda c: F.xxhash64(c).alias(f"{c}_h")

    def again(rows: DataFrame, which: str, facts: list[str]) -> DataFrame:
        """One row for each digest of a side: how often it is given, and what there is to know of it if that is once."""
        name, own = f"{which}_digest", f"own_{which}"
        seal = {"start": sealed_starts, "attempt": sealed_attempts}[which](rows.withColumnRenamed(name, "given"), methods)
        one = seal.select(hashed("given"), "given", F.struct(*facts, F.col("given").alias(name)).alias({"start": "s", "attempt": "r"}[which]), F.col(name).eqNullSafe(F.col("given")).alias(own))
        times = rows.select(hashed(name), name).groupBy(f"{name}_h", name).agg(F.count("*").alias(f"n_{which}"))
        return times.join(one, (F.col(f"{name}_h") == F.col("given_h")) & (F.col(name) == F.col("given")) & (F.col(f"n_{which}") == 1), "left").drop("given_h", "given")

    # what an attestation tells by itself is computed before it is shuffled
    rows = attestations.select(*CORE.fieldNames(), "attestation_digest", hashed("start_digest"), hashed("attempt_digest"), F.col("attestation_digest").eqNullSafe(digest(F.struct(*CORE.fieldNames()), CORE)).alias("sealed"), header_fault(F.col("protected"), purpose).alias("fault"))
    rows = rows.withColumn("contracted", F.coalesce(F.col("attestation_contract") == contract, F.lit(False))).drop("attestation_contract")
    twice = attestations.groupBy("attestation_digest").agg(F.count("*").alias("times")).where("times > 1")
    of_start, of_attempt = ["start_digest_h", "start_digest"], ["attempt_digest_h", "attempt_digest"]
    settled = attestations.where("attempt_digest is not null").select(hashed("start_digest"), "start_digest", "attempt_digest").repartition(*of_start).distinct()
    several = settled.groupBy(*of_start).agg(F.count("*").alias("settles")).where("settles > 1")
    sides = ["source_url", "requested_url", "method", "method_registry_digest"]
    joined = rows.join(again(starts, "start", ["capture_key", "started_at", *sides]), of_start, "left").join(several, of_start, "left")
    # the other fields of the core are what was joined on, or compared before; a sealed start has digests here, of which no other text has the normal form
    joined = joined.withColumn("claimed", F.col("capture_key").eqNullSafe(F.col("s.capture_key")) & F.col("method_registry_digest").eqNullSafe(F.col("s.method_registry_digest")))
    joined = joined.drop("start_digest_h", "start_digest", "capture_key", "method_registry_digest").join(again(attempts, "attempt", ["checked_at", *sides]), of_attempt, "left")
    joined = joined.withColumn("settles_", settlement())
    fault, settles = F.col("fault"), F.col("settles_")
    verdict = (
        F.when(~F.col("contracted"), "contract")
        .when(fault.isNotNull(), fault)
        .when(F.col("n_start").isNull(), "no_start")
        .when(F.col("n_attempt").isNull(), "no_attempt")
        .when(F.col("n_start") > 1, "repeated_start")
        .when(F.col("n_attempt") > 1, "repeated_attempt")
        .when(~F.col("own_start"), "start")
        .when(~F.col("own_attempt"), "attempt")
        .when(settles == "too_early", "before_start")
        .when(settles == "registry", "registry_of_method")
        .when(settles.isNotNull(), settles)
        .when(~F.coalesce(instant_key(F.col("signed_at")) >= instant_key(F.col("r.checked_at")), F.lit(False)), "too_early")
        .when(~F.col("claimed"), "core")
        .when(~F.col("sealed"), "digest")
        .when(F.col("settles") > 1, "two_attempts")
        .otherwise("proved")
    )
    judged = joined.select("attestation_digest", verdict.alias("verdict")).join(twice, "attestation_digest", "left")
    return judged.select("attestation_digest", F.when(F.col("times") > 1, "repeated").otherwise(F.col("verdict")).alias("verdict"))
