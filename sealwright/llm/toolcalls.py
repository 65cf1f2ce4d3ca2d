"""Linking tool calls with their results and writing both as canonical JSON, in DataFrame operations only.

Calls and results are tables; results are hash-joined to calls by identifier. A call may wait for another
call's result (`after`, an identifier). Such waits are forests, so the depth of a call is found by pointer doubling,
in as many rounds as the logarithm of the longest chain, and ordering by depth is topological; a call on or
behind a cycle is found by the same rounds and marked. Arguments are maps of strings, validated against a table of
schemas. The text is JSON with sorted keys and no white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read

#: Turns of one conversation that a window looks at together; longer ones are stitched by a second window over chunks.
CHUNK = 1024
ROUNDS = 40


def canonical_string(c: Column) -> Column:
    """A JSON string: quote and backslash escaped, control characters as lower-case \\u00xx."""
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(32):
        c = F.replace(c, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), c, F.lit('"'))


def canonical_text(c: Column) -> Column:
    """canonical_string, which texts without special characters pass in one step."""
    return F.when(c.rlike(r'["\\\x00-\x1f]'), canonical_string(c)).otherwise(F.concat(F.lit('"'), c, F.lit('"')))


def canonical_object(pairs: dict[str, Column]) -> Column:
    """JSON object of columns that hold JSON already, keys sorted; a null member is left out."""
    members = [F.concat(F.lit(f'"{k}":'), v) for k, v in sorted(pairs.items())]
    return F.concat(F.lit("{"), F.array_join(F.array(*members), ","), F.lit("}"))


def canonical_map(c: Column) -> Column:
    """JSON object of a map of strings: keys sorted by bytes, values as strings."""
    members = F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(canonical_text(e["key"]), F.lit(":"), F.coalesce(canonical_text(e["value"]), F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def depths(calls: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(id, depth) of `calls` (id, after): 1 without a known call to wait for, null on or behind a cycle.

    Every round joins the table with itself once: a row jumps to where its target had jumped, and adds the steps.
    """
    known = calls.select("id").distinct()
    first = calls.groupBy("id").agg(F.min("after").alias("after"))
    now = first.join(known.select(F.col("id").alias("there")), F.col("after") == F.col("there"), "left").select("id", F.col("there").alias("to"), F.when(F.col("there").isNull(), 0).otherwise(1).alias("steps"))
    now = materialize(now, "calls")
    waiting = now.where("to is not null").count()
    for _ in range(rounds):
        if not waiting:
            break
        there = now.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        moved = now.where("to is not null").join(there, "to").select("id", F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps"))
        now = materialize(moved.unionByName(now.where("to is null")), "calls")
        left = now.where("to is not null").count()
        # every round settles the calls twice as deep as before; without progress, only those on or behind cycles are left
        if left == waiting:
            break
        waiting = left
    return now.select("id", F.when(F.col("to").isNull(), F.col("steps") + 1).alias("depth"))


def violations(name: Column, arguments: Column, schemas: DataFrame, calls: DataFrame) -> DataFrame:
    """`calls` with `problems`: unknown tool, missing, unexpected and ill-typed arguments, sorted.

    `schemas` has a row for each tool (its number is checked): name, required array, types map of integer, string or boolean.
    """
    if schemas.limit(10_001).count() > 10_000:
        raise ValueError("more than 10000 tools")
    table = F.broadcast(schemas.select(F.col("name").alias("tool"), "required", "types"))
    bad = F.concat(
        F.transform(F.filter(F.col("required"), lambda k: ~F.map_contains_key(arguments, k)), lambda k: F.concat(F.lit("missing:"), k)),
        F.transform(F.filter(F.map_keys(arguments), lambda k: ~F.map_contains_key(F.col("types"), k)), lambda k: F.concat(F.lit("unexpected:"), k)),
        F.transform(
            F.filter(
                F.map_entries(arguments),
                lambda e: F.map_contains_key(F.col("types"), e["key"])
                & ~F.coalesce(
                    F.when(F.col("types")[e["key"]] == "integer", e["value"].rlike(r"\A-?(0|[1-9][0-9]*)\z"))
                    .when(F.col("types")[e["key"]] == "boolean", e["value"].isin("true", "false"))
                    .when(F.col("types")[e["key"]] == "string", F.length(e["value"]) > 0),
                    F.lit(False),
                ),
            ),
            lambda e: F.concat(F.lit("type:"), e["key"]),
        ),
    )
    problems = F.when(F.col("tool").isNull(), F.array(F.lit("unknown_tool"))).when(arguments.isNull(), F.array(F.lit("no_arguments"))).otherwise(F.array_sort(bad))
    return calls.join(table, name == F.col("tool"), "left").withColumn("problems", problems).drop("tool", "required", "types")


def linked(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each call: thread, id, name, depth, n_results, problems, json.

    calls: thread, id, after, name, arguments (map of strings), place. results: id, place, content. A call with several
    results keeps the first by (place, content), and n_results says how many there were; one without has a null result. Results without a
    call are left to `orphans`. Calls with a null id get no result and depth 1. Repeated ids share depth and result.
    """
    best = results.where("id is not null").groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("place", "content")).alias("r")).select(F.col("id").alias("rid"), "n", F.col("r.content").alias("content"))
    deep = depths(calls.where("id is not null").select("id", "after")).withColumnRenamed("id", "did")
    out = calls.join(best, F.col("id") == F.col("rid"), "left").join(deep, F.col("id") == F.col("did"), "left")
    out = violations(F.col("name"), F.col("arguments"), schemas, out)
    json = canonical_object(
        {
            "id": canonical_text(F.col("id").cast("string")),
            "name": canonical_text(F.col("name")),
            "arguments": canonical_map(F.col("arguments")),
            "after": canonical_text(F.col("after").cast("string")),
            "result": F.coalesce(canonical_text(F.col("content")), F.lit("null")),
        }
    )
    depth = F.when(F.col("id").isNull(), 1).otherwise(F.col("depth"))
    return out.select("thread", "id", "name", "place", depth.cast("long").alias("depth"), F.coalesce("n", F.lit(0)).cast("long").alias("n_results"), "problems", json.alias("json"))


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """The results that belong to no call."""
    return results.join(calls.select("id").distinct(), "id", "left_anti")


def _last_before(turns: DataFrame, what: Column, name: str) -> DataFrame:
    """The last non-null `what` on an earlier turn of the conversation, in chunks of CHUNK turns and then over chunks."""
    w = Window.partitionBy("conv_id", "chunk").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    chunks = turns.groupBy("conv_id", "chunk").agg(F.max(F.when(what.isNotNull(), F.struct("turn", what.alias("x"))))["x"].alias("own"))
    over = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(F.col("conv_id").alias("c_"), F.col("chunk").alias("k_"), F.last("own", ignorenulls=True).over(over).alias("carried"))
    near = turns.withColumn(name, F.last(what, ignorenulls=True).over(w))
    return near.join(chunks, F.col("conv_id").eqNullSafe(F.col("c_")) & F.col("chunk").eqNullSafe(F.col("k_"))).withColumn(name, F.coalesce(name, "carried")).drop("c_", "k_", "carried")


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Read a conversation as calls and results: a user or system turn calls the tool of its role, an assistant turn answers the last call before it.

    A call waits for the call before it in its conversation. The identifiers are conv_id:turn. Rows with a null conv_id, turn or role are neither.
    """
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").cast("string").alias("text")).where("conv_id is not null and turn is not null and role is not null")
    turns = turns.withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    own = F.when(F.col("role") != "assistant", F.concat_ws(":", "conv_id", "turn"))
    light = _last_before(turns, own, "last_call")
    arguments = F.map_from_arrays(F.array(F.lit("turn"), F.lit("text"), F.lit("n_chars")), F.array(F.col("turn").cast("string"), F.coalesce("text", F.lit("")), F.coalesce(F.length("text"), F.lit(0)).cast("string")))
    calls = light.where("role <> 'assistant'").select(F.col("conv_id").alias("thread"), F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("last_call").alias("after"), F.col("role").alias("name"), arguments.alias("arguments"), F.col("turn").alias("place"))
    results = light.where("role = 'assistant'").select(F.col("last_call").alias("id"), F.col("turn").alias("place"), F.coalesce("text", F.lit("")).alias("content"))
    return calls, results


def chat_schemas(spark: SparkSession) -> DataFrame:
    return spark.sql(
        """SELECT name, array('text', 'turn') AS required, map('text', 'string', 'turn', 'integer', 'n_chars', 'integer') AS types
           FROM VALUES ('user'), ('system') AS t(name)"""
    )


def op6_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = conversation_calls(read(spark, sf_dir, "conversations"))
    out = linked(calls, results, chat_schemas(spark))
    return out.select(F.col("thread").alias("conv_id"), F.col("id").alias("call_id"), "depth", "n_results", F.array_join("problems", ",").alias("problems"), F.sha2("json", 256).alias("json_sha256"), F.length("json").cast("long").alias("json_chars"))


def _json_sql(x: str) -> str:
    x = f"replace(replace({x}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34))"
    for code in range(1, 32):
        x = f"replace({x}, chr({code}), chr(92) || 'u{code:04x}')"
    return f"(chr(34) || {x} || chr(34))"


OP6_SQL = f"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, CASE WHEN role <> 'assistant' THEN conv_id || ':' || turn END AS own
           FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL),
l AS (SELECT *, last_value(own IGNORE NULLS) OVER w AS last_call, count(own) OVER w AS earlier FROM t
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT last_call AS id, count(*) AS n, arg_min(text, turn) AS content FROM l WHERE role = 'assistant' AND last_call IS NOT NULL GROUP BY 1),
j AS (SELECT conv_id, own AS call_id, earlier + 1 AS depth, coalesce(n, 0) AS n_results,
             concat_ws(',', CASE WHEN text = '' THEN 'type:text' END) AS problems,
             '{{' || coalesce('"after":"' || last_call || '",', '') || '"arguments":{{"n_chars":"' || length(text) || '","text":' || {_json_sql("text")} ||
             ',"turn":"' || turn || '"}},"id":"' || own || '","name":"' || role || '","result":' || coalesce({_json_sql("content")}, 'null') || '}}' AS json
      FROM l LEFT JOIN r ON own = id WHERE role <> 'assistant')
SELECT conv_id, call_id, depth, n_results, problems, sha256(json) AS json_sha256, CAST(length(json) AS BIGINT) AS json_chars FROM j
"""
