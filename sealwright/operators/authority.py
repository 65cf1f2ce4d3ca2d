"""Signing authority over intervals, thresholds, settlements and attestation closure as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealwright.operators.intervals import within
from sealwright.session import written

MOST_KEYS = 10_000


def valid_at(at: Column) -> Column:
    """Half-open: from valid_from (included) to valid_until (excluded); null bounds are open."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_until").isNull() | (at < F.col("valid_until")))


def compromised(sequence: Column) -> Column:
    """From its sequence on, that included; without a sequence whenever the key was compromised at all."""
    return F.col("compromised_after_sequence").isNotNull() & (sequence.isNull() | (sequence >= F.col("compromised_after_sequence")))


def active_keys(facts: DataFrame, keys: DataFrame, at: Column, purpose: Column, sequence: Column | None = None) -> DataFrame:
    """`facts` with key_id and n_active. key_id is null unless exactly one key is active for the purpose at the time.

    keys: key_id, purpose, valid_from, valid_until, compromised_after_sequence. A registry of up to MOST_KEYS rows is broadcast, one array for each
    purpose, so that the facts are not shuffled; of a larger one, the intervals are cut into blocks of a grid and joined on purpose and block.
    """
    sequence = F.lit(None).cast("long") if sequence is None else sequence
    if keys.limit(MOST_KEYS + 1).count() <= MOST_KEYS:
        columns = ("key_id", "valid_from", "valid_until", "compromised_after_sequence")
        held = keys.groupBy(F.col("purpose").alias("purpose_")).agg(F.collect_list(F.struct(*columns)).alias("keys_"))
        joined = facts.join(F.broadcast(held), purpose == F.col("purpose_"), "left")
        active = F.filter(
            "keys_",
            lambda k: (k["valid_from"].isNull() | (k["valid_from"] <= at))
            & (k["valid_until"].isNull() | (at < k["valid_until"]))
            & ~(k["compromised_after_sequence"].isNotNull() & (sequence.isNull() | (sequence >= k["compromised_after_sequence"]))),
        )
        n = F.coalesce(F.size(active), F.lit(0)).cast("long")
        return joined.select(*facts.columns, F.when(n == 1, active[0]["key_id"]).alias("key_id"), n.alias("n_active"))
    # the rows are numbered once and written, so that a task that runs again gives the same numbers
    one = written(facts.withColumn("row_", F.monotonically_increasing_id()).withColumn("purpose_", purpose).withColumn("at_", at).withColumn("sequence_", sequence), "authority-facts")
    held = keys.select(F.col("key_id").alias("k_"), F.col("purpose").alias("purpose_"), "valid_from", "valid_until", "compromised_after_sequence")
    found = within(one.select("row_", "purpose_", "at_", "sequence_"), held, ["purpose_"], "at_", "valid_from", "valid_until").where(~compromised(F.col("sequence_")))
    counted = found.groupBy("row_").agg(F.count("k_").alias("n_active"), F.min("k_").alias("k_"))
    out = one.join(counted, "row_", "left").withColumn("n_active", F.coalesce("n_active", F.lit(0)))
    return out.select(*facts.columns, F.when(F.col("n_active") == 1, F.col("k_")).alias("key_id"), "n_active")


def root_violations(roots: DataFrame, threshold: int, key: str = "key_id", public_key: str = "public_key") -> DataFrame:
    """(key, check_ordinal, code) of a set of root keys: 1 threshold (key null): not between one and the number of keys, 2 named_twice, 3 key: no name of 1 to 256 characters, 4 public_key: not its fixed text form."""
    from sealwright.functions.values import utf16_length
    from sealwright.operators.keys import ED25519_PEM, LONGEST_NAME

    n = roots.agg(F.count("*").alias("n"))
    none = F.lit(None).cast("string").alias(key)
    wrong = n.where((F.lit(threshold) < 1) | (F.lit(threshold) > F.col("n"))).select(none, F.lit(1).alias("check_ordinal"), F.lit("threshold").alias("code"))
    twice = roots.groupBy(key).count().where(f"count > 1 and {key} is not null").select(key, F.lit(2), F.lit("named_twice"))
    named = roots.where(~F.coalesce(utf16_length(F.col(key)).between(1, LONGEST_NAME), F.lit(False))).select(key, F.lit(3), F.lit("key")).distinct()
    text = roots.where(~F.coalesce(F.col(public_key).rlike(ED25519_PEM), F.lit(False))).select(key, F.lit(4), F.lit("public_key")).distinct()
    return wrong.union(twice).union(named).union(text)


def reached(signatures: DataFrame, subject: str, signer: str, roots: DataFrame, threshold: int) -> DataFrame:
    """(subject, n_signers) signed by at least `threshold` different root keys; unknown and repeated signers do not count."""
    return signatures.join(roots.select(signer).distinct(), signer, "left_semi").groupBy(subject).agg(F.countDistinct(signer).alias("n_signers")).where(F.col("n_signers") >= threshold)


def settlement_verdict() -> Column:
    """By the first rule that fails, for a result joined to its start (columns prefixed s_)."""
    return (
        F.when(F.col("s_method").isNull(), "no_start")
        .when(~F.col("method").eqNullSafe(F.col("s_method")), "method")
        .when(~F.col("url").eqNullSafe(F.col("s_url")), "url")
        .when(F.col("checked_at") < F.col("s_started_at"), "too_early")
        .otherwise("settled")
    )


def settlements(results: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """`results` (key, method, url, checked_at) with a verdict against `starts` (key, method, url, started_at)."""
    s = starts.select(key, *[F.col(c).alias(f"s_{c}") for c in ("method", "url", "started_at")])
    return results.join(s, key, "left").withColumn("verdict", settlement_verdict())


def attestation_violations(starts: DataFrame, attempts: DataFrame, attestations: DataFrame) -> DataFrame:
    """(id, check_ordinal, code). starts: start_id; attempts: attempt_id; attestations: start_id, attempt_id.

    Each attestation has both sides, a start settles one attempt, and nothing is left without an attestation. One attempt may settle several starts.
    """
    a = attestations.select("start_id", "attempt_id").distinct()
    no_start = a.join(starts, "start_id", "left_anti").select(F.col("start_id").cast("string").alias("id"), F.lit(1).alias("check_ordinal"), F.lit("no_start").alias("code")).distinct()
    no_attempt = a.join(attempts, "attempt_id", "left_anti").select(F.col("attempt_id").cast("string"), F.lit(2), F.lit("no_attempt")).distinct()
    two = a.groupBy("start_id").agg(F.countDistinct("attempt_id").alias("n")).where("n > 1").select(F.col("start_id").cast("string"), F.lit(3), F.lit("two_attempts"))
    open_starts = starts.select("start_id").distinct().join(a, "start_id", "left_anti").select(F.col("start_id").cast("string"), F.lit(4), F.lit("unproved_start"))
    open_attempts = attempts.select("attempt_id").distinct().join(a, "attempt_id", "left_anti").select(F.col("attempt_id").cast("string"), F.lit(5), F.lit("unproved_attempt"))
    return no_start.union(no_attempt).union(two).union(open_starts).union(open_attempts)


#: Headers that no record carries.
UNRECORDABLE = ("authorization", "cookie", "proxy-authenticate", "proxy-authorization", "set-cookie", "set-cookie2")


def _once(value: Column, use) -> Column:
    """`use` of a value that is computed once, however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def _named_headers(headers: Column, longest: int) -> Column:
    from sealwright.functions.values import trimmed

    return F.transform(headers, lambda h: F.struct(F.lower(trimmed(h["name"])).alias("name"), _bounded(trimmed(h["value"]), longest).alias("value")))


def _bounded(value: Column, longest: int) -> Column:
    """The first `longest` UTF-16 code units; half of a character at the cut goes too."""
    from sealwright.functions.values import utf16_length

    units = F.substring(F.encode(value, "UTF-16BE"), 1, 2 * longest)
    # a code unit of D800 to DBFF at the end is the first half of a character
    torn = F.substring(F.hex(units), 4 * longest - 3, 4).rlike("D[89AB]..")
    whole = F.when(torn, F.substring(units, 1, 2 * longest - 2)).otherwise(units)
    return F.when((F.length(value) > longest // 2) & (utf16_length(value) > longest), F.decode(whole, "UTF-16BE")).otherwise(value)


def _kept_headers(named: Column) -> Column:
    from sealwright.functions.values import utf16_key

    kept = F.array_distinct(F.filter(named, lambda h: h["value"] != ""))
    ordered = F.array_sort(F.transform(kept, lambda h: F.struct(utf16_key(F.concat(h["name"], F.lit("\0"), h["value"])).alias("o"), h.alias("h"))))
    return F.transform(ordered, lambda x: x["h"])


def _unrecordable(named: Column) -> Column:
    return F.exists(named, lambda h: h["name"].isin(*UNRECORDABLE))


def header_issues(headers: Column, most: int = 32, longest: int = 1024) -> Column:
    """Why a selection of headers is refused: a name that is never recorded, whatever its value, or more than `most` different headers."""
    return _once(_named_headers(headers, longest), lambda n: F.array_compact(F.array(F.when(_unrecordable(n), "unrecordable"), F.when(F.size(_kept_headers(n)) > most, "too_many"))))


def recordable_headers(headers: Column, most: int = 32, longest: int = 1024) -> Column:
    """[(name, value)] lower-cased, trimmed, without empty values, values cut, different and sorted; null for a refused selection, which is never cut.

    `header_issues` says why. Values are cut by, and headers are in the order of, UTF-16 code units.
    """
    kept = _once(_named_headers(headers, longest), lambda n: F.when(~_unrecordable(n), _kept_headers(n)))
    return _once(kept, lambda k: F.when(F.size(k) <= most, k))


def exchange_issues(started: Column, finished: Column, method: Column, url: Column, header_names: Column, body_bytes: Column) -> Column:
    """All broken rules of one exchange, in their order."""
    from sealwright.functions.values import plain_url, strictly_ascending

    return F.array_compact(
        F.array(
            F.when(finished < started, "time_order"),
            F.when(~plain_url(url), "url"),
            F.when(~strictly_ascending(header_names), "header_order"),
            F.when(F.exists(header_names, lambda n: n.isin(*UNRECORDABLE)), "cookie"),
            F.when(method.isin("GET", "HEAD") & (body_bytes > 0), "body"),
        )
    )
