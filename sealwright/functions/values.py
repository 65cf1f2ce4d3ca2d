"""Canonical values, digests, grammars and orderings as Column expressions.

Canonical JSON has NFC strings, keys in UTF-16 order, no white space, and numbers as ECMAScript prints them. A struct
type is compiled once into one expression that stays in the JVM; Python is used only for double numbers, NFC of texts
that are not ASCII, arrays and maps that hold either, free JSON, and IP literals.
"""

from __future__ import annotations

import ipaddress
import json
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed grammars of the record format.
DIGEST = r"\Asha256:[a-f0-9]{64}\z"
IDENTIFIER = r"\A[a-z0-9][a-z0-9_-]*\z"
ACTOR_IDENTIFIER = r"\A[a-z0-9][a-z0-9_-]*(?:\.[a-z0-9][a-z0-9_-]*)*\z"
SLUG = r"\A[a-z0-9]+(?:-[a-z0-9]+)*\z"
OPERATION_ID = r"\Aop_[0-9a-hjkmnp-tv-z]{26}\z"
INSTANT = r"\A(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:\.(\d+))?(Z|[+-]\d{2}:\d{2})\z"
#: Fixed alphabet of operation identifiers (Crockford base 32).
BASE32 = "0123456789abcdefghjkmnpqrstvwxyz"
#: Fixed class of white space in ECMAScript, as a Java pattern.
SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
MAX_DEPTH = 256


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    # Arrow's own kernel leaves some texts decomposed (pyarrow 23)
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(T.IntegerType())
def _ip_version(s: pd.Series) -> pd.Series:
    def version(x: str) -> int:
        if "%" in x:
            return 0
        try:
            return ipaddress.ip_address(x).version
        except ValueError:
            return 0

    return s.map(version, na_action="ignore")


def js_number(x: float) -> str:
    """The shortest decimal that reads back as `x`, in ECMAScript's layout."""
    if x != x or x in (float("inf"), float("-inf")):
        raise ValueError("canonical numbers are finite")
    if x == 0:
        return "0"
    sign, digits, exponent = ("-" if x < 0 else ""), *_shortest(abs(x))
    n, k = exponent, len(digits)
    if k <= n <= 21:
        body = digits + "0" * (n - k)
    elif 0 < n <= 21:
        body = f"{digits[:n]}.{digits[n:]}"
    elif -6 < n <= 0:
        body = "0." + "0" * -n + digits
    else:
        e = n - 1
        body = digits[0] + (f".{digits[1:]}" if k > 1 else "") + f"e{'+' if e >= 0 else '-'}{abs(e)}"
    return sign + body


def _shortest(x: float) -> tuple[str, int]:
    mantissa, _, exp = f"{x!r}".partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(exp or 0) - (len(whole + part) - len(digits))
    return digits.rstrip("0") or "0", point


@F.pandas_udf(T.StringType())
def _number(s: pd.Series) -> pd.Series:
    return s.map(js_number, na_action="ignore")


def nfc(c: Column) -> Column:
    """NFC; ASCII texts reach Python as nulls only."""
    return F.coalesce(_nfc(F.when(F.octet_length(c) != F.length(c), c)), c)


#: Texts whose canonical string is the text in quotes; JSON escapes none of their characters.
NO_ESCAPE = r"\A[ !#-\[\]-~]*\z"
#: Fixed short escapes of JSON.
SHORT = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}


def _raw_quoted(text: str) -> str:
    return '"' + "".join("\\" + x if x in '"\\' else "\\" + SHORT.get(ord(x), f"u{ord(x):04x}") if x < " " else x for x in text) + '"'


def json_literal(text: str) -> str:
    """A quoted canonical string of a Python text, as `json_string` gives it for a column."""
    return _raw_quoted(unicodedata.normalize("NFC", text))


def json_string(c: Column, ascii_only: bool = False) -> Column:
    """A quoted canonical string: short escapes where JSON has them, else lower-case \\u00xx."""
    c = c if ascii_only else nfc(c)
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    # one expression over a literal, not one for each code: a record has many texts, and what Spark compiles is bounded
    escapes = F.array(*[F.lit("\\" + SHORT.get(code, f"u{code:04x}")) for code in range(32)])
    out = F.aggregate(F.sequence(F.lit(0), F.lit(31)), out, lambda t, code: F.replace(t, F.char(code), F.element_at(escapes, code + 1)))
    quote = F.lit('"')
    return F.when(c.rlike(r'["\\\x00-\x1f]'), F.concat(quote, out, quote)).otherwise(F.concat(quote, c, quote))


def _quoted(text: str) -> str:
    """`json_literal`, and lone surrogates as escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", json_literal(text))


class NotCanonical(ValueError):
    """A value without a canonical form; its text is one of depth, number, colliding_keys, syntax."""


def _members(pairs: list[tuple[str, object]]) -> list[tuple[str, object]]:
    """The members of an object by canonical key, in UTF-16 order."""
    by_key: dict[str, object] = {}
    for key, value in pairs:
        key = unicodedata.normalize("NFC", key)
        if key in by_key:
            raise NotCanonical("colliding_keys")
        by_key[key] = value
    return sorted(by_key.items(), key=lambda kv: kv[0].encode("utf-16-be", "surrogatepass"))


def canonical_value(value: object, depth: int = 0) -> str:
    """Canonical JSON of what `json.loads` gives."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return _quoted(value)
    if isinstance(value, (int, float)):
        try:
            return js_number(float(value))
        except (ValueError, OverflowError):
            raise NotCanonical("number") from None
    if depth >= MAX_DEPTH:
        raise NotCanonical("depth")
    if isinstance(value, dict):
        return "{" + ",".join(f"{_quoted(k)}:{canonical_value(v, depth + 1)}" for k, v in _members(list(value.items()))) + "}"
    return "[" + ",".join(canonical_value(v, depth + 1) for v in value) + "]"


def _typed(value: object, kind: T.DataType, normal_keys: bool) -> str:
    """Canonical JSON of an Arrow value of Spark type `kind`."""
    if value is None:
        return "null"
    if isinstance(kind, T.StructType):
        kept = [(f.name, (value[f.name], f.dataType)) for f in kind.fields if value[f.name] is not None or (f.metadata or {}).get("presence") != "optional"]
        return "{" + ",".join(f"{_quoted(k)}:{_typed(*v, normal_keys)}" for k, v in _members(kept)) + "}"
    if isinstance(kind, T.MapType):
        if normal_keys:
            members = [(_quoted(k), v) for k, v in _members(list(value))]
        else:
            members = [(_raw_quoted(k), v) for k, v in sorted(value, key=lambda kv: kv[0].encode("utf-16-be"))]
        return "{" + ",".join(f"{k}:{_typed(v, kind.valueType, normal_keys)}" for k, v in members) + "}"
    if isinstance(kind, T.ArrayType):
        return "[" + ",".join(_typed(v, kind.elementType, normal_keys) for v in value) + "]"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return str(value)
    return canonical_value(value)


def _collection(c: Column, kind: T.DataType, normal_keys: bool) -> Column:
    """A whole array or map column, rendered batch by batch: no Python function can stand inside a lambda."""

    @F.arrow_udf(T.StringType())
    def render(s: pa.Array) -> pa.Array:
        return pa.array([None if v is None else _typed(v, kind, normal_keys) for v in s.to_pylist()], pa.string())

    return render(c)


def _from_json(value: object, kind: T.DataType) -> object:
    """What Arrow would give for a value of Spark type `kind`, from JSON whose objects are lists of pairs."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        members = dict(value)
        return {f.name: _from_json(members[f.name], f.dataType) for f in kind.fields}
    if isinstance(kind, T.MapType):
        return [(k, _from_json(v, kind.valueType)) for k, v in value]
    return [_from_json(v, kind.elementType) for v in value] if isinstance(kind, T.ArrayType) else value


def _record(c: Column, kind: T.StructType, normal_keys: bool) -> Column:
    """A struct column without doubles, most of whose rows are null, rendered batch by batch. It goes to Python as one text: a struct costs a writer for each field, for null rows too."""

    @F.arrow_udf(T.StringType())
    def render(s: pa.Array) -> pa.Array:
        if s.null_count == len(s):
            return pa.nulls(len(s), pa.string())
        values = (None if v is None else _from_json(json.loads(v, object_pairs_hook=list), kind) for v in s.to_pylist())
        return pa.array([None if v is None else _typed(v, kind, normal_keys) for v in values], pa.string())

    return render(F.to_json(c, {"ignoreNullFields": "false"}))


def _holds_doubles(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_doubles(f.dataType) for f in kind.fields)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return _holds_doubles(kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType)
    return isinstance(kind, (T.FloatType, T.DoubleType))


def _in_python(kind: T.DataType, ascii_only: bool, normal_keys: bool) -> bool:
    """Whether elements of `kind` need Python."""
    if isinstance(kind, T.StructType):
        return any(_in_python(f.dataType, ascii_only, normal_keys) for f in kind.fields)
    if isinstance(kind, T.MapType):
        return (normal_keys and not ascii_only) or _in_python(kind.valueType, ascii_only, normal_keys)
    if isinstance(kind, T.ArrayType):
        return _in_python(kind.elementType, ascii_only, normal_keys)
    return isinstance(kind, (T.FloatType, T.DoubleType)) or (isinstance(kind, T.StringType) and not ascii_only)


def _check(kind: T.DataType, depth: int = 0) -> None:
    inner = [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else [kind.valueType] if isinstance(kind, T.MapType) else None
    if inner is None:
        if not isinstance(kind, (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)):
            raise TypeError(f"no canonical form of {kind.simpleString()}")
        return
    if depth >= MAX_DEPTH:
        raise ValueError(f"nested deeper than {MAX_DEPTH}")
    if isinstance(kind, T.MapType) and not isinstance(kind.keyType, T.StringType):
        raise TypeError("the keys of an object are strings")
    names = [unicodedata.normalize("NFC", f.name) for f in kind.fields] if isinstance(kind, T.StructType) else []
    if len(set(names)) < len(names):
        raise ValueError("two keys have one normal form")
    for each in inner:
        _check(each, depth + 1)


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("issue", T.StringType())]))
def _free(s: pa.Array) -> pa.Array:
    def constant(name: str) -> None:
        raise NotCanonical("syntax")

    texts: list[str | None] = []
    issues: list[str | None] = []
    for given in s.to_pylist():
        text = issue = None
        if given is not None:
            try:
                text = canonical_value(json.loads(given, parse_int=float, parse_constant=constant))
            except NotCanonical as e:
                issue = str(e)
            except RecursionError:
                issue = "depth"
            except ValueError:
                issue = "syntax"
        texts.append(text)
        issues.append(issue)
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(issues, pa.string())], ["text", "issue"])


def canonical_json(c: Column) -> Column:
    """(text, issue) of JSON texts: the canonical form, or why there is none; both null for null.

    Issues are syntax, number (not finite), depth, and colliding_keys (different keys of one normal form). Of a key given twice the last value
    counts, and numbers are doubles, as ECMAScript reads them.
    """
    return _free(c)


def utf16_key(c: Column) -> Column:
    """Sorts as UTF-16 code units."""
    return F.encode(c, "UTF-16BE")


def canonical(c: Column, kind: T.DataType, ascii_only: bool = False, normal_keys: bool = True) -> Column:
    """Canonical JSON of a column of type `kind`.

    A null field is left out if its metadata say {"presence": "optional"}, else it is null. A null value is null.
    Map keys get their normal form, and keys of one normal form fail the job. Without `normal_keys` they keep the form they have, for keys that are known to be normal.
    """
    _check(kind)
    if isinstance(kind, T.StructType) and not ascii_only and _in_python(kind, False, normal_keys) and not _holds_doubles(kind):
        # what is all ASCII stays in the JVM, and one column of nulls goes to Python instead of one for each text
        text = F.concat_ws("", *_texts(c, kind))
        plain = F.octet_length(text) == F.length(text)
        # one look at all texts of a record, instead of one at each, tells that none has an escape
        simple, quick, own = text.rlike(NO_ESCAPE), _canonical(c, kind, True, False, True), _canonical(c, kind, True, False)
        return F.coalesce(F.when(simple, quick).when(plain, own).otherwise(_record(F.when(~plain, c), kind, normal_keys)), F.lit("null"))
    return _canonical(c, kind, ascii_only, normal_keys)


def _texts(c: Column, kind: T.DataType) -> list[Column]:
    """Texts that together are ASCII if all strings of `c` are."""
    if isinstance(kind, T.StructType):
        return [t for f in kind.fields for t in _texts(c.getField(f.name), f.dataType)]
    return [c.cast("string")] if isinstance(kind, (T.StringType, T.ArrayType, T.MapType)) else []


def _canonical(c: Column, kind: T.DataType, ascii_only: bool, normal_keys: bool, simple: bool = False) -> Column:
    """`simple`: the texts in `c`, but for those in arrays and maps, are known to match NO_ESCAPE."""
    if isinstance(kind, T.StructType):
        members = []
        for f in sorted(kind.fields, key=lambda f: unicodedata.normalize("NFC", f.name).encode("utf-16-be")):
            value = _canonical(c.getField(f.name), f.dataType, ascii_only, normal_keys, simple)
            key = F.lit(json_literal(f.name) + ":")
            optional = (f.metadata or {}).get("presence") == "optional"
            members.append(F.when(c.getField(f.name).isNotNull(), F.concat(key, value)) if optional else F.concat(key, value))
        out = F.when(c.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}")))
    elif isinstance(kind, (T.ArrayType, T.MapType)) and _in_python(kind, ascii_only, normal_keys):
        out = _collection(c, kind, normal_keys)
        if not _holds_doubles(kind):
            # what renders as ASCII has one form only, and stays in the JVM
            ascii_ = F.transform(F.array(_canonical(c, kind, True, False)), lambda t: F.when(F.octet_length(t) == F.length(t), t))[0]
            out = F.coalesce(ascii_, _collection(F.when(ascii_.isNull(), c), kind, normal_keys))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: _canonical(x, kind.elementType, True, False)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(utf16_key(e["key"]).alias("o"), e["key"].alias("k"), e["value"].alias("v")))
        out = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(json_string(e["k"], True), F.lit(":"), _canonical(e["v"], kind.valueType, True, False))), ","), F.lit("}"))
    elif isinstance(kind, T.StringType):
        out = F.concat(F.lit('"'), c, F.lit('"')) if simple else json_string(c, ascii_only)
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        out = _number(c.cast("double"))
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit("null"))


def sha256(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def digest(c: Column, kind: T.DataType, ascii_only: bool = False, normal_keys: bool = True) -> Column:
    return sha256(canonical(c, kind, ascii_only, normal_keys))


def base32_128(hexadecimal: Column) -> Column:
    """The first 128 bits of a hex text as 26 base-32 characters, from single bits: no wide arithmetic.

    The text and its bits are computed once each: a lambda would compute them for every character.
    """

    def characters(bits: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(25)), lambda i: F.substring(F.lit(BASE32), F.conv(F.substring(bits, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))), "")

    def bits(text: Column) -> Column:
        return F.concat(F.lit("00"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.lpad(F.conv(F.substring(text, i, F.lit(1)), 16, 2), 4, "0")), ""))

    return F.transform(F.transform(F.array(hexadecimal), bits), characters)[0]


def operation_id(contract: str, canonical_value: Column) -> Column:
    """op_ and 128 bits of the digest of {operation_contract, value}; `canonical_value` is canonical JSON already."""
    if not contract.strip():
        raise ValueError("the contract must not be empty")
    core = F.concat(F.lit('{"operation_contract":'), json_string(F.lit(contract), contract.isascii()), F.lit(',"value":'), canonical_value, F.lit("}"))
    return F.concat(F.lit("op_"), base32_128(F.sha2(core, 256)))


def instant_key(c: Column) -> Column:
    """(seconds, fraction digits) of an ISO instant with offset; null for what is none. Compares to every digit."""
    fraction = F.contains(c, F.lit("."))  # most instants have none, and are cast as they are
    base = F.when(fraction, F.concat(F.regexp_extract(c, INSTANT, 1), F.regexp_extract(c, INSTANT, 3))).otherwise(c)
    moment = F.when(c.rlike(INSTANT), F.unix_seconds(base.try_cast("timestamp")))
    return F.when(moment.isNotNull(), F.struct(moment.alias("s"), F.when(fraction, F.rtrim(F.regexp_extract(c, INSTANT, 2), F.lit("0"))).otherwise(F.lit("")).alias("f")))


def ip_version(c: Column) -> Column:
    return F.coalesce(_ip_version(c), F.lit(0))


def path_segment(c: Column) -> Column:
    return F.replace(c, F.lit(":"), F.lit("-"))


def from_path_segment(c: Column) -> Column:
    """The digest of a path segment, null if it is none."""
    out = F.regexp_replace(c, r"\Asha256-", "sha256:")
    return F.when(out.rlike(DIGEST), out)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def normal_text(c: Column) -> Column:
    """Line feeds, NFC, no blanks at the ends of lines, trimmed, one final line feed; null if nothing is left."""
    out = trimmed(F.regexp_replace(nfc(F.regexp_replace(c, r"\r\n?", "\n")), r"(?m)[ \t]+$", ""))
    return F.when(out != "", F.concat(out, F.lit("\n")))


def normal_inline(c: Column) -> Column:
    return trimmed(F.regexp_replace(nfc(c), f"{SPACE}+", " "))


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def plain_url(c: Column) -> Column:
    """A URL without user information and fragment; an empty fragment or user is none. False for null and for what is no absolute URL.

    A host that has no name, a character that no host may have, or a port above 65535 makes it none; blanks and stray percent signs in a path do not.
    """
    text = F.regexp_replace(F.regexp_replace(c, r"\A[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\n\r]", "")
    special = text.rlike(r"(?i)\A(https?|wss?|ftp):")
    rest = F.regexp_extract(text, r"(?s)\A[A-Za-z][A-Za-z0-9+.\-]*:([^#]*)", 1)
    authority = F.when(special, F.regexp_extract(rest, r"(?s)\A[/\\]*([^/\\?]*)", 1)).otherwise(F.regexp_extract(rest, r"(?s)\A//([^/?]*)", 1))
    user, place = F.regexp_extract(authority, r"(?s)\A(.*)@", 1), F.regexp_extract(authority, r"(?s)([^@]*)\z", 1)
    host, port = F.regexp_replace(place, r":[0-9]*\z", ""), F.regexp_extract(place, r":([0-9]*)\z", 1)
    digits = F.ltrim(port, F.lit("0"))  # a failed cast costs an exception for each row, so only digits are cast
    fine = host.rlike(r"\A(\[[0-9A-Fa-f:.]+\]|[^\x00-\x20\x7F#/:<>?@\[\\\]^|%]*)\z") & (F.length(digits) <= 5) & (F.when(F.length(digits).between(1, 5), digits.cast("int")).otherwise(0) <= 65535)
    ok = text.rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*:") & fine & (~special | (host != "")) & user.isin("", ":") & ~text.rlike(r"(?s)#.")
    # most URLs are simple and need one look
    simple = c.rlike(r"\Ahttps?://[A-Za-z0-9.\-]+(:[0-9]{1,4})?([/?][^\x00-\x20#\\@]*)?#?\z")
    return F.when(simple, F.lit(True)).otherwise(F.coalesce(ok, F.lit(False)))


def media_type_matches(kind: Column, pattern: str) -> Column:
    """A pattern with at most one *."""
    if pattern.count("*") > 1:
        raise ValueError("one * at most")
    return F.lower(kind).like(pattern.lower().replace("\\", "\\\\").replace("_", "\\_").replace("%", "\\%").replace("*", "%"))


def strictly_ascending(c: Column) -> Column:
    return c == F.array_sort(F.array_distinct(c))


def canonical_key(c: Column) -> Column:
    """Sorts as canonical strings do: by the UTF-16 code units of the normal form."""
    return utf16_key(nfc(c))


@F.arrow_udf(T.BooleanType())
def _ascending(c: pa.Array) -> pa.Array:
    def ascends(value: list[str]) -> bool:
        keys = [unicodedata.normalize("NFC", x).encode("utf-16-be", "surrogatepass") for x in value]
        return all(a < b for a, b in zip(keys, keys[1:]))

    return pa.array([None if v is None or None in v else ascends(v) for v in c.to_pylist()], pa.bool_())


def canonically_ascending(c: Column) -> Column:
    """Whether the texts of an array ascend strictly in canonical order; null for null and for arrays with a null. ASCII arrays stay in the JVM."""
    plain = F.forall(c, lambda x: F.octet_length(x) == F.length(x))
    simple = F.when(F.coalesce(plain, F.lit(False)), strictly_ascending(c))
    return F.coalesce(simple, _ascending(F.when(simple.isNull(), c)))


def visited_strings(value: object, path: str = "$") -> list[tuple[str, str]]:
    """Every string of a JSON-shaped Python value with its path, depth first."""
    if isinstance(value, str):
        return [(path, value)]
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in visited_strings(v, f"{path}.{k}")]
    if isinstance(value, (list, tuple)):
        return [x for i, v in enumerate(value) for x in visited_strings(v, f"{path}[{i}]")]
    return []


def object_id(c: Column) -> Column:
    """An exact object id of 40 or 64 hexadecimal digits; null for anything else."""
    return F.when(c.rlike(r"\A(?:[a-f0-9]{40}|[a-f0-9]{64})\z"), c)


def inside(root: str, path: Column) -> Column:
    """The path strictly below `root`, an absolute folder, that a relative `path` names; null for absolute and escaping paths, and for the root itself.

    Empty and `.` segments are dropped, and `..` takes the segment before it away; one that takes more than there is escapes.
    """
    if not root.startswith("/") or ".." in root.split("/"):
        raise ValueError("the root must be an absolute folder")
    base = "/" + "/".join(s for s in root.split("/") if s not in ("", "."))
    up = F.lit("..")
    named = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    # a segment too many taken away marks the path for good; the root's own segments may be left and entered again
    start = F.array(*[F.lit(s) for s in base.split("/") if s]).cast("array<string>")
    end = F.aggregate(named, start, lambda held, s: F.when(s != up, F.concat(held, F.array(s))).otherwise(F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))))
    whole = F.concat(F.lit("/"), F.array_join(end, "/"))
    return F.when(~F.startswith(path, F.lit("/")) & F.startswith(whole, F.lit(base.rstrip("/") + "/")) & (whole != base), whole)


@F.pandas_udf(T.StringType())
def _pretty(c: pd.Series) -> pd.Series:
    return c.map(lambda t: t if t is None else json.dumps(_integers(json.loads(t)), indent=2, ensure_ascii=False) + "\n")


def _integers(value: object) -> object:
    """Whole doubles as integers, as ECMAScript writes them."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return int(value)
    if isinstance(value, list):
        return [_integers(v) for v in value]
    return {k: _integers(v) for k, v in value.items()} if isinstance(value, dict) else value


def pretty_json(c: Column) -> Column:
    """JSON texts for reading: two spaces a level and a final line feed; keys keep their order. For display, not for digests: no canonical form."""
    return _pretty(c)
