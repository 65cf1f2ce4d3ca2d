"""Recorded HTTP exchanges: every broken rule of a record, and the digest that seals it.

A record has started_at, finished_at (instants as text), outcome, request, response and reason, in the shape of RECORD. Request header values
are never recorded; of a credential only its handle's digest, its scheme and where it travelled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealwright.functions.values import DIGEST, digest, instant_key, plain_url, strictly_ascending, utf16_key, utf16_length
from sealwright.operators.authority import UNRECORDABLE

#: Fixed values of the record format.
METHODS = ("GET", "HEAD", "POST", "PUT", "PATCH", "DELETE")
REASONS = ("dns_failure", "deadline_exceeded", "tls_failure", "byte_limit", "non_public_address", "policy_blocked", "other")
HEADER_NAME = r"\A[a-z0-9!#$%&'*+.^_`|~-]{1,128}\z"
FIELD = r"\A[A-Za-z0-9_.-]{1,64}\z"
FORM = "application/x-www-form-urlencoded"
MOST_SENT, MOST_CREDENTIALS, MOST_KEPT, LONGEST = 64, 4, 32, 1024


def _struct(*fields: str | tuple[str, T.DataType], optional: tuple[str, ...] = ()) -> T.StructType:
    """Fields are texts unless a type is given; an optional one is left out of the canonical form where it is null."""
    named = [(f, T.StringType()) if isinstance(f, str) else f for f in fields]
    return T.StructType([T.StructField(n, t, metadata={"presence": "optional"} if n in optional else {}) for n, t in named])


BODY = _struct("media_type", "content_digest", ("content_bytes", T.LongType()))
CREDENTIAL = _struct("handle_digest", "scheme", "header_name", "field", "parameter", optional=("header_name", "field", "parameter"))
REQUEST = _struct("method", "url", ("header_names", T.ArrayType(T.StringType())), ("credentials", T.ArrayType(CREDENTIAL)), ("body", BODY))
#: A response header is an array of its name and its value.
RESPONSE = _struct(("status", T.IntegerType()), ("headers", T.ArrayType(T.ArrayType(T.StringType()))), ("body", BODY))
RECORD = _struct("started_at", "finished_at", "outcome", ("request", REQUEST), ("response", RESPONSE), "reason", optional=("response", "reason"))


def carrier(credential: Column) -> Column:
    """Where a credential travelled, in the order in which records list them."""
    return F.coalesce(F.concat(F.lit("header:"), credential["header_name"]), F.concat(F.lit("form:"), credential["field"]), F.concat(F.lit("query:"), credential["parameter"]))


def _body_ok(body: Column) -> Column:
    return utf16_length(body["media_type"]).between(1, LONGEST) & body["content_digest"].rlike(DIGEST) & (body["content_bytes"] >= 0)


def _credential_ok(c: Column) -> Column:
    header, field, parameter = c["header_name"], c["field"], c["parameter"]
    by_header = c["scheme"].isin("bearer", "basic", "header") & header.rlike(HEADER_NAME) & field.isNull() & parameter.isNull()
    by_form = (c["scheme"] == "form") & field.rlike(FIELD) & header.isNull() & parameter.isNull()
    by_query = (c["scheme"] == "query") & parameter.rlike(FIELD) & header.isNull() & field.isNull()
    return c["handle_digest"].rlike(DIGEST) & (F.coalesce(by_header, F.lit(False)) | F.coalesce(by_form, F.lit(False)) | F.coalesce(by_query, F.lit(False)))


def _ascending(texts: Column) -> Column:
    return strictly_ascending(F.transform(texts, utf16_key))


def _query_values(url: Column, parameter: Column) -> Column:
    """The decoded values of a parameter in a URL."""
    pairs = F.transform(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"), F.try_url_decode(F.regexp_extract(p, r"(?s)=(.*)\z", 1)).alias("v")))
    return F.transform(F.filter(pairs, lambda p: p["k"] == parameter), lambda p: p["v"])


def issues() -> Column:
    """All broken rules of a record in its columns, in a fixed order; a rule that cannot be judged for a null is broken."""
    request, response = F.col("request"), F.col("response")
    names, credentials, headers = request["header_names"], request["credentials"], response["headers"]
    responded = F.col("outcome") == "responded"
    carries = lambda column: F.forall(credentials, lambda c: c[column].isNull())
    rules: list[tuple[str, Column]] = [
        ("instants", instant_key(F.col("started_at")).isNotNull() & instant_key(F.col("finished_at")).isNotNull()),
        ("time_order", instant_key(F.col("started_at")) <= instant_key(F.col("finished_at"))),
        ("outcome", (responded & response.isNotNull() & F.col("reason").isNull()) | ((F.col("outcome") == "transport_error") & response.isNull() & F.col("reason").isin(*REASONS))),
        ("method", request["method"].isin(*METHODS)),
        ("https", request["url"].rlike(r"(?i)\Ahttps:")),
        ("url", plain_url(request["url"])),
        ("header_names", (F.size(names) <= MOST_SENT) & F.forall(names, lambda n: n.rlike(HEADER_NAME))),
        ("header_order", _ascending(names)),
        ("credentials", (F.size(credentials) <= MOST_CREDENTIALS) & F.forall(credentials, _credential_ok)),
        ("credential_order", _ascending(F.transform(credentials, carrier))),
        ("credential_header", F.forall(credentials, lambda c: c["header_name"].isNull() | F.array_contains(names, c["header_name"]))),
        ("credential_form", carries("field") | F.coalesce(request["body"]["media_type"] == FORM, F.lit(False))),
        ("credential_query", F.forall(credentials, lambda c: c["parameter"].isNull() | (_query_values(request["url"], c["parameter"]) == F.array(c["handle_digest"])))),
        ("request_body", request["body"].isNull() | _body_ok(request["body"])),
        ("bodyless", ~request["method"].isin("GET", "HEAD") | request["body"].isNull()),
        ("status", ~responded | response["status"].between(100, 999)),
        ("response_body", ~responded | _body_ok(response["body"])),
        ("response_headers", ~responded | ((F.size(headers) <= MOST_KEPT) & F.forall(headers, lambda h: (F.size(h) == 2) & h[0].rlike(HEADER_NAME) & utf16_length(h[1]).between(1, LONGEST)))),
        ("unrecordable", ~responded | ~F.exists(headers, lambda h: h[0].isin(*UNRECORDABLE))),
        ("response_order", ~responded | _ascending(F.transform(headers, lambda h: F.concat_ws("\0", h)))),
    ]
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), code) for code, ok in rules]))


def sealed(records: DataFrame) -> DataFrame:
    """`records` with issues, and exchange_digest of those without any: a refused record is not sealed."""
    out = records.withColumn("issues", issues())
    return out.withColumn("exchange_digest", F.when(F.size("issues") == 0, digest(F.struct(*RECORD.fieldNames()), RECORD)))


def unsealed(records: DataFrame) -> DataFrame:
    """The sealed `records` (with exchange_digest) that break a rule, or whose digest is not that of the rest."""
    again = sealed(records.withColumnRenamed("exchange_digest", "given"))
    return again.where("size(issues) > 0 or not exchange_digest <=> given").drop("exchange_digest").withColumnRenamed("given", "exchange_digest")
