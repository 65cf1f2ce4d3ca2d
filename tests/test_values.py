import re
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealwright.functions import values as V


def one(spark, column, row=("x",), schema="v string"):
    return spark.createDataFrame([row], schema).select(column.alias("out")).first()["out"]


def test_canonical_value_and_digest(spark):
    kind = T.StructType(
        [
            T.StructField("b", T.StructType([T.StructField("n", T.LongType()), T.StructField("t", T.StringType())])),
            T.StructField("a", T.MapType(T.StringType(), T.BooleanType())),
            T.StructField("gone", T.StringType(), metadata={"presence": "optional"}),
        ]
    )
    df = spark.createDataFrame([(((1, "é"), {"z": None, "Á": True}, None),)], T.StructType([T.StructField("v", kind)]))
    got = df.select(V.canonical(F.col("v"), kind).alias("c")).first()["c"]
    assert got == '{"a":{"z":null,"\u00c1":true},"b":{"n":1,"t":"\u00e9"}}'


def test_pinned_preimage(spark):
    text = '{"a":{"z":null,"Å":true},"b":[1,"é"]}'
    assert one(spark, V.sha256(F.lit(text))) == "sha256:1629fa1b498a82a4eea2a0690006908636977635b8e2b87609bcaeb41cc2987f"


def test_string_escapes(spark):
    assert one(spark, V.json_string(F.col("v")), ('a"\\\n\x01\x1f/',)) == '"a\\"\\\\\\n\\u0001\\u001f/"'


def test_utf16_order(spark):
    rows = [("\U0001f600",), ("￿",), ("퟿",)]
    got = [r["v"] for r in spark.createDataFrame(rows, "v string").orderBy(V.utf16_key(F.col("v"))).collect()]
    assert got == ["퟿", "\U0001f600", "￿"]


@pytest.mark.parametrize("x,text", [(1e21, "1e+21"), (1e-7, "1e-7"), (1.0, "1"), (-0.0, "0"), (123456789012345680000.0, "123456789012345680000"), (0.000001, "0.000001"), (1.5e-10, "1.5e-10"), (-2.25, "-2.25"), (1e300, "1e+300"), (100.0, "100")])
def test_js_numbers(x, text):
    assert V.js_number(x) == text


def test_js_numbers_read_back():
    rng = random.Random(5)
    for _ in range(2000):
        x = rng.uniform(-1, 1) * 10 ** rng.randint(-25, 25)
        assert float(V.js_number(x)) == x


def test_instants(spark):
    texts = ["2026-01-01T10:00:00.0001Z", "2026-01-01T10:00:00.0009Z", "2026-01-01T11:00:00.1+01:00", "2026-01-01T10:00:00.100Z", "2026-02-30T10:00:00Z", "2026-01-01 10:00:00Z", "2026-01-01T10:00:00.0000009Z"]
    k = [r["k"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(V.instant_key(F.col("t")).alias("k")).collect()]
    assert k[0] < k[1] and k[2] == k[3] and k[4] is None and k[5] is None and k[6] != ("", "")
    assert (k[6]["s"], k[6]["f"]) == (k[0]["s"], "0000009")


def test_operation_id_matches_big_integer(spark):
    import hashlib

    got = one(spark, V.operation_id("a.b/v1", F.lit('{"x":1}')))
    n = int(hashlib.sha256(b'{"operation_contract":"a.b/v1","value":{"x":1}}').hexdigest()[:32], 16)
    want = ""
    for _ in range(26):
        want, n = V.BASE32[n & 31] + want, n >> 5
    assert got == "op_" + want
    with pytest.raises(ValueError):
        V.operation_id(" ", F.lit("1"))


def test_grammars_reject_a_final_line_feed(spark):
    for pattern, good in [(V.DIGEST, "sha256:" + "a" * 64), (V.IDENTIFIER, "a_b-1"), (V.ACTOR_IDENTIFIER, "github.login"), (V.SLUG, "a-b"), (V.OPERATION_ID, "op_" + "0" * 26)]:
        assert one(spark, F.col("v").rlike(pattern), (good,)) and not one(spark, F.col("v").rlike(pattern), (good + "\n",))


def test_texts(spark):
    assert one(spark, V.normal_text(F.col("v")), ("﻿ one \t\r\ntwo\r　",)) == "one\ntwo\n"
    assert one(spark, V.normal_text(F.col("v")), (" \n ",)) is None
    assert one(spark, V.normal_inline(F.col("v")), (" a   b\n",)) == "a b"
    assert one(spark, V.utf16_length(F.col("v")), ("\U0001f600a",)) == 3


def test_urls_and_segments(spark):
    assert one(spark, V.plain_url(F.lit("https://h/#"))) and not one(spark, V.plain_url(F.lit("https://h/#a"))) and not one(spark, V.plain_url(F.lit("https://u@h/")))
    d = "sha256:" + "0" * 64
    assert one(spark, V.from_path_segment(V.path_segment(F.lit(d)))) == d and one(spark, V.from_path_segment(F.lit("sha256-1"))) is None
    assert one(spark, V.media_type_matches(F.lit("text/html"), "text/*")) and not one(spark, V.media_type_matches(F.lit("textxhtml"), "text_*l"))


def test_visited_strings():
    assert V.visited_strings({"a": ["x", {"b": "y"}], "c": 1}) == [("$.a[0]", "x"), ("$.a[1].b", "y")]


def test_plain_urls(spark):
    plain = ["https://h/", "https://h", "https://h/a b", "https://h/%zz", "https://h:8080/x?y=1", "https://[::1]/", "http:h.org/a", "mailto:me@h.org", "https://@h/", "https://h/#", " https://h/ ", "https://h/a@b", "https://h:/"]
    other = ["not a url", "", "h.org/a", "https://u:p@h/a b", "https://h/%zz#frag x", "https://u@h/", "https://:p@h/", "https://", "https:///#", "https://h:99999/", "https://a b/", "https://h/#a", "//h/x", "https://u:p@h/a@b", None]
    df = spark.createDataFrame([(u,) for u in plain + other], "u string")
    got = [r[0] for r in df.select(V.plain_url(F.col("u"))).collect()]
    assert dict(zip(plain + other, got)) == dict.fromkeys(plain, True) | dict.fromkeys(other, False)


def test_collections(spark):
    kind = T.StructType([T.StructField("a", T.ArrayType(T.StringType())), T.StructField("d", T.ArrayType(T.DoubleType())), T.StructField("m", T.MapType(T.StringType(), T.ArrayType(T.StructType([T.StructField("x", T.DoubleType(), metadata={"presence": "optional"}), T.StructField("t", T.StringType())]))))])
    rows = [((["e\u0301", None, "a"], [1.0, None, 1e21], {"e\u0301": [(0.5, "b"), (None, None)], "z": None}),), ((None, [], {}),), (None,)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("v", kind)]))
    got = [r["c"] for r in df.select(V.canonical(F.col("v"), kind, normal_keys=True).alias("c")).collect()]
    assert got == ['{"a":["\u00e9",null,"a"],"d":[1,null,1e+21],"m":{"z":null,"\u00e9":[{"t":"b","x":0.5},{"t":null}]}}', '{"a":null,"d":[],"m":{}}', "null"]
    clash = spark.createDataFrame([({"e\u0301": 1, "\u00e9": 2},)], "m map<string, int>")
    with pytest.raises(Exception, match="colliding_keys"):
        clash.select(V.canonical(F.col("m"), clash.schema["m"].dataType, normal_keys=True)).collect()
    for bad in (T.DateType(), T.ArrayType(T.DecimalType()), T.MapType(T.IntegerType(), T.StringType())):
        with pytest.raises(TypeError):
            V.canonical(F.lit(None), bad)


def test_free_json(spark):
    deep = "[" * 256 + "]" * 256
    cases = {
        '{"b": [1, "e\u0301"], "a": {"A\u030a": true, "z": null}}': ('{"a":{"z":null,"\u00c5":true},"b":[1,"\u00e9"]}', None),
        '{"\U0001f600": 1, "\uffff": 2, "\ud7ff": 3}': ('{"\ud7ff":3,"\U0001f600":1,"\uffff":2}', None),
        '{"2": 2, "10": 10}': ('{"10":10,"2":2}', None),
        '{"a": 1, "a": 2}': ('{"a":2}', None),
        '"\\ud800"': ('"\\ud800"', None),
        "9007199254740993": ("9007199254740992", None),
        "-0": ("0", None),
        "1e21": ("1e+21", None),
        deep: (deep, None),
        f"[{deep}]": (None, "depth"),
        "[" * 100000: (None, "depth"),
        '{"e\u0301": 1, "\u00e9": 2}': (None, "colliding_keys"),
        "1e999": (None, "number"),
        "[NaN]": (None, "syntax"),
        "[1,]": (None, "syntax"),
        "": (None, "syntax"),
        None: (None, None),
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string").select("c", V.canonical_json(F.col("c")).alias("r"))
    assert {r["c"]: tuple(r["r"]) for r in df.collect()} == cases


def test_structs_in_the_jvm_and_in_python_agree(spark):
    """A struct that is all ASCII is rendered in the JVM, any other in one column of Python; both as its fields one by one."""
    from pyspark.sql import types as T

    inner = T.StructType([T.StructField("to", T.StringType()), T.StructField("from", T.StringType())])
    kind = T.StructType([T.StructField("z", T.StringType()), T.StructField("a", T.StringType(), True, {"presence": "optional"}), T.StructField("n", T.LongType()), T.StructField("m", inner), T.StructField("l", T.ArrayType(inner))])
    texts = ["", "plain", 'q"\\', "".join(map(chr, range(32))) + "\x7f", "é", "é", "\U0001f600 ", None]
    rows = [(t, u, 1, None if t is None else (u, t), [(t, u), None]) for t in texts for u in texts]
    df = spark.createDataFrame(rows, kind)
    got = [r["x"] for r in df.select(V.canonical(F.struct(*kind.fieldNames()), kind).alias("x")).collect()]

    def want(t, u, n, m, _):
        pair = lambda p: None if p is None else {"from": p[1], "to": p[0]}
        return V.canonical_value({"z": t, "n": float(n), "m": pair(m), "l": [pair((t, u)), None]} | ({} if u is None else {"a": u}))

    assert got == [want(*r) for r in rows]
    plan = df.select(V.canonical(F.struct(*kind.fieldNames()), kind))._jdf.queryExecution().optimizedPlan().toString()
    assert len(set(re.findall(r"pythonUDF\d+#\d+", plan)) or re.findall(r"render\(", plan)) == 1 and "_nfc(" not in plan


def test_ports_of_urls(spark):
    ports = {"": True, "0": True, "65535": True, "65536": False, "00080": True, "0000065535": True, "99999999999999999999": False, "000000": True}
    df = spark.createDataFrame([(f"https://h.example:{p}/#",) for p in ports], "u string")
    assert [r["x"] for r in df.select(V.plain_url(F.col("u")).alias("x")).collect()] == list(ports.values())
