"""Method registries, reservations and outcomes of captures as tables with their broken rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealwright.functions.values import IDENTIFIER, canonical, instant_key, plain_url, sha256

#: Fixed grammar of method versions.
VERSION = r"\A[a-z0-9][a-z0-9._-]*\z"
#: Fixed outcomes with the reasons they may give.
REASONS = {
    "captured": (),
    "redirected_outside_authority": (),
    "unreachable": ("dns_failure", "http_status"),
    "transport_error": ("deadline_exceeded", "tls_failure", "byte_limit", "non_public_address", "policy_blocked", "other"),
    "manual_imported": (),
    "manual_import_error": ("read_failed", "byte_limit"),
}
MOST_REDIRECTS = 5
METHOD = T.StructType([T.StructField("capabilities", T.ArrayType(T.StringType())), T.StructField("name", T.StringType()), T.StructField("version", T.StringType())])


def method_violations(methods: DataFrame) -> DataFrame:
    """(registry, name, version, code) of declared methods (registry, name, version, capabilities)."""
    c = F.col("capabilities")
    bad = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("name").rlike(IDENTIFIER) & F.col("version").rlike(VERSION), F.lit(False)), "grammar"),
            F.when(F.coalesce((F.size(c) < 1) | F.exists(c, lambda x: ~x.rlike(IDENTIFIER)) | (F.size(F.array_distinct(c)) != F.size(c)), F.lit(True)), "capabilities"),
        )
    )
    twice = methods.groupBy("registry", "name", "version").count().where("count > 1").select("registry", "name", "version", F.lit("declared_twice").alias("code"))
    return methods.select("registry", "name", "version", F.explode(bad).alias("code")).unionByName(twice)


def registry_digests(methods: DataFrame) -> DataFrame:
    """(registry, registry_digest, n_methods): methods in the order of name:version with sorted capabilities. A registry is installed code, so it is small."""
    one = F.struct(F.concat_ws(":", "name", "version").alias("o"), canonical(F.struct(F.array_sort("capabilities").alias("capabilities"), "name", "version"), METHOD, True).alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["line"]), ",")
    return methods.groupBy("registry").agg(sha256(F.concat(F.lit('{"methods":['), lines, F.lit("]}"))).alias("registry_digest"), F.count("*").alias("n_methods"))


def directory_violations(digests: DataFrame) -> DataFrame:
    """(registry_digest, n_registries) of digests (registry, registry_digest) that stand for several registries: a lookup by them has no answer."""
    return digests.groupBy("registry_digest").agg(F.countDistinct("registry").alias("n_registries")).where("n_registries > 1")


def _https(c: Column) -> Column:
    return F.coalesce(F.try_parse_url(c, F.lit("PROTOCOL")) == "https", F.lit(False))


def _origin(c: Column) -> Column:
    port = F.regexp_extract(F.try_parse_url(c, F.lit("AUTHORITY")), r":(\d+)$", 1)
    protocol = F.try_parse_url(c, F.lit("PROTOCOL"))
    usual = F.when(protocol == "https", "443").when(protocol == "http", "80")
    return F.concat_ws("|", protocol, F.lower(F.try_parse_url(c, F.lit("HOST"))), F.when(port == "", usual).otherwise(port))


def _codes(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, check_ordinal, code): a rule that is unknown does not hold."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(n).alias("check_ordinal"), F.lit(code).alias("code"))) for n, (code, ok) in enumerate(rules.items(), 1)]))
    return rows.select(key, F.explode(broken).alias("x")).select(key, "x.check_ordinal", "x.code")


def issues_of(rules: dict[str, Column]) -> Column:
    """The codes of all broken rules, in order. They pass through a text, which Spark compiles: array_compact has its whole argument interpreted for each row."""
    return F.array_remove(F.split(F.concat_ws(",", *[F.when(~F.coalesce(ok, F.lit(False)), code) for code, ok in rules.items()]), ","), "")


def with_method(rows: DataFrame, methods: DataFrame) -> DataFrame:
    """`rows` with the capabilities of their method in their registry; null where it is not installed. Installed methods are few and are broadcast: rows of one method are not one key of a shuffle."""
    held = methods.select("registry_digest", "name", "version", "capabilities").dropDuplicates(["registry_digest", "name", "version"])
    return rows.withColumns({"name": F.col("method.name"), "version": F.col("method.version")}).join(F.broadcast(held), ["registry_digest", "name", "version"], "left")


def start_violations(starts: DataFrame, methods: DataFrame, key: str = "start_digest") -> DataFrame:
    """(key, check_ordinal, code) of reservations: source_url, requested_url, started_at, lease_until, lease_token, method (name, version), registry_digest.

    methods: registry_digest, name, version, capabilities of the installed registries.
    """
    return _codes(with_method(starts, methods), key, start_rules())


def start_rules() -> dict[str, Column]:
    """The rules of a reservation that has its method's capabilities."""
    return {
        "method": F.col("capabilities").isNotNull(),
        "https": _https(F.col("source_url")) & _https(F.col("requested_url")),
        "plain_url": plain_url(F.col("source_url")) & plain_url(F.col("requested_url")),
        "lease_token": F.col("lease_token") != "",
        "lease": instant_key(F.col("lease_until")) > instant_key(F.col("started_at")),
    }


def attempt_violations(attempts: DataFrame, methods: DataFrame, key: str = "attempt_digest") -> DataFrame:
    """(key, check_ordinal, code) of outcomes: every rule that is broken, a reader refuses at the first.

    attempts: outcome, reason, source_url, requested_url, final_url, checked_at, archive_snapshot_at, redirect_chain array<struct<from, to>>,
    response_status_code, media_type, content_digest, content_bytes, method (name, version), registry_digest. methods as in `start_violations`.
    """
    return _codes(_chained(with_method(attempts, methods)), key, attempt_rules())


def _chained(attempts: DataFrame) -> DataFrame:
    return attempts.withColumn("chain_", F.coalesce("redirect_chain", F.array().cast("array<struct<from: string, to: string>>")))


def attempt_rules() -> dict[str, Column]:
    """The rules of an outcome that has its method's capabilities and its chain."""
    chain, outcome, requested, final, status = F.col("chain_"), F.col("outcome"), F.col("requested_url"), F.col("final_url"), F.col("response_status_code")
    n = F.size(chain)
    last = F.when(n > 0, F.try_element_at(chain, F.lit(-1))["to"])
    froms, tos = F.transform(chain, lambda x: x["from"]), F.transform(chain, lambda x: x["to"])
    visited = F.concat(F.array(requested), tos)
    captured, outside, manual = outcome == "captured", outcome == "redirected_outside_authority", outcome.isin("manual_imported", "manual_import_error")
    has = lambda name: F.array_contains("capabilities", name)
    reasons = reduce(lambda a, x: a.when(outcome == x[0], F.col("reason").isin(*x[1]) if x[1] else F.col("reason").isNull()), REASONS.items(), F.when(F.lit(False), F.lit(False)))
    holds_bytes = outcome.isin("captured", "manual_imported")
    urls = F.concat(F.array("source_url", "requested_url"), froms, tos, F.when(captured | outside, F.array(final)).otherwise(F.array().cast("array<string>")))
    arrived = F.coalesce(last, requested)
    return {
        "method": F.col("capabilities").isNotNull(),
        "outcome": outcome.isin(*REASONS),
        "reason": reasons,
        "final_url": (captured | outside) == final.isNotNull(),
        "content": (holds_bytes == F.col("content_digest").isNotNull()) & (holds_bytes == F.col("content_bytes").isNotNull()) & (F.coalesce("content_bytes", F.lit(0)) >= 0),
        "media_type": captured == F.coalesce(F.col("media_type") != "", F.lit(False)),
        "status": F.when(captured, F.coalesce(status.between(200, 299), F.lit(False)))
        .when(outcome == "unreachable", F.when(F.col("reason") == "http_status", F.coalesce(status.between(400, 599), F.lit(False))).otherwise(status.isNull()))
        .otherwise(status.isNull()),
        # every outcome but a manual one has a chain, an empty one where nothing redirected
        "redirect_count": (n <= MOST_REDIRECTS) & (~outside | (n > 0)) & (manual == F.col("redirect_chain").isNull()),
        "https": _https(F.col("source_url")) & _https(requested) & (~captured | _https(final)),
        "plain_url": F.forall(urls, plain_url),
        "chain_start": (n == 0) | (F.try_element_at(froms, F.lit(1)) == requested),
        "chain_contiguous": F.slice(froms, F.lit(2), F.greatest(n - 1, F.lit(0))) == F.slice(tos, F.lit(1), F.greatest(n - 1, F.lit(0))),
        "chain_https": F.forall(F.transform(tos, lambda t, i: _https(t) | (outside & (i == n - 1))), lambda x: x),
        "chain_acyclic": F.size(F.array_distinct(visited)) == F.size(visited),
        "chain_end": ~outside | (last == final),
        "manual": manual == has("manual-review"),
        "navigation": ~captured | (final == arrived) | (has("rendered-page") & (_origin(final) == _origin(arrived))),
        "archive_time": F.when(captured, has("history-only") == F.col("archive_snapshot_at").isNotNull()).otherwise(F.col("archive_snapshot_at").isNull()),
        "archive_order": F.col("archive_snapshot_at").isNull() | (instant_key(F.col("archive_snapshot_at")) <= instant_key(F.col("checked_at"))),
    }
