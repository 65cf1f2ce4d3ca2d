"""Registries of signing keys: their broken rules, and the verdict on the key that a fact names. Signatures themselves are not checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealwright.functions.values import instant_key, utf16_length

#: Fixed text form of an Ed25519 public key: 12 bytes of header and 32 of key in base 64.
ED25519_PEM = r"\A-----BEGIN PUBLIC KEY-----\nMCowBQYDK2VwAyEA[A-Za-z0-9+/]{42}[AEIMQUYcgkosw048]=\n-----END PUBLIC KEY-----\n\z"
MOST_SEQUENCE = 2**53 - 1
LONGEST_NAME = 256


def registry_violations(keys: DataFrame) -> DataFrame:
    """(key_id, check_ordinal, code) of key_id, issuer_id, purposes, public_key, valid_from, valid_until, compromised_after_sequence (bounds: instants as text or null)."""
    named = lambda c: utf16_length(F.col(c)).between(1, LONGEST_NAME)
    start, end, purposes = F.col("valid_from"), F.col("valid_until"), F.col("purposes")
    rules = [
        ("issuer_id", named("issuer_id")),
        ("key_id", named("key_id")),
        ("purposes", (F.size(purposes) > 0) & (F.size(F.array_distinct(purposes)) == F.size(purposes))),
        ("instants", (start.isNull() | instant_key(start).isNotNull()) & (end.isNull() | instant_key(end).isNotNull())),
        ("interval", start.isNull() | end.isNull() | (instant_key(start) < instant_key(end))),
        ("sequence", F.col("compromised_after_sequence").isNull() | F.col("compromised_after_sequence").between(1, MOST_SEQUENCE)),
        ("public_key", F.col("public_key").rlike(ED25519_PEM)),
    ]
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(n).alias("n"), F.lit(code).alias("code"))) for n, (code, ok) in enumerate(rules, 2)]))
    twice = keys.groupBy("key_id").count().where("count > 1").select("key_id", F.lit(1).alias("check_ordinal"), F.lit("named_twice").alias("code"))
    return twice.union(keys.select("key_id", F.explode(broken).alias("x")).select("key_id", "x.n", "x.code"))


def key_verdicts(facts: DataFrame, keys: DataFrame) -> DataFrame:
    """`facts` (key_id, issuer_id, purpose, at, sequence; null: not given) with a verdict, by the first rule that fails.

    A fact without a time is judged without the interval; one without a sequence is refused if its key was ever compromised.
    """
    names = ("issuer_id", "purposes", "valid_from", "valid_until", "compromised_after_sequence")
    joined = facts.join(keys.select("key_id", *[F.col(n).alias(f"k_{n}") for n in names]), "key_id", "left")
    at, start, end, after = instant_key(F.col("at")), F.col("k_valid_from"), F.col("k_valid_until"), F.col("k_compromised_after_sequence")
    inside = at.isNotNull() & (start.isNull() | (instant_key(start) <= at)) & (end.isNull() | (at < instant_key(end)))
    verdict = (
        F.when(F.col("k_purposes").isNull(), "unknown_key")
        .when(F.col("issuer_id") != F.col("k_issuer_id"), "other_issuer")
        .when(~F.coalesce(F.array_contains("k_purposes", F.col("purpose")), F.lit(False)), "purpose")
        .when(F.col("at").isNotNull() & ~F.coalesce(inside, F.lit(False)), "interval")
        .when(after.isNotNull() & (F.col("sequence").isNull() | (F.col("sequence") >= after)), "compromised")
        .otherwise("authorized")
    )
    return joined.select(*facts.columns, verdict.alias("verdict"))
