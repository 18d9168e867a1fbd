"""Tool-call linking for chat transcripts.

Calls and results are hash-joined by conversation and identifier, ordered so that a call follows all calls it needs,
checked against argument schemas, and written as canonical JSON (sorted keys at every level, no white space, types
kept). DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import ranked, ship, written

STEP = 64  # turns ranked together
CYCLE = -1  # stands for a need that is never met


def _chains(single: DataFrame) -> DataFrame:
    """single(n, up): calls with one need. (n, up, w): the first call up the chain that is not single, w steps away, by
    pointer doubling; up is CYCLE on or behind a cycle."""
    own = single.select(F.col("n").alias("up"), F.lit(True).alias("open"))
    table = written(single.join(own, "up", "left").select("n", "up", F.lit(1).cast("long").alias("w"), F.coalesce("open", F.lit(False)).alias("open")), "chains")
    total, reach = table.count(), 1
    while reach <= 2 * total and not table.filter("open").isEmpty():
        far = table.select(F.col("n").alias("up"), F.col("up").alias("next"), F.col("w").alias("more"), F.col("open").alias("still"))
        after = table.join(far, "up", "left").select(
            "n", F.coalesce("next", "up").alias("up"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), F.coalesce("still", F.lit(False)).alias("open"))
        table, reach = written(after, "chains"), reach * 2
    return table.select("n", F.when(F.col("open"), CYCLE).otherwise(F.col("up")).alias("up"), "w")


def _depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(n, depth) of nodes(n) under edges(n, up): the longest chain of needs below each call; null on or behind a cycle.

    Chains of single needs are contracted first, so the number of rounds is that of calls with several needs on one path.
    """
    edges = written(edges.select("n", "up").distinct(), "needs")
    counts = edges.groupBy("n").agg(F.count(F.lit(1)).alias("k"), F.min("up").alias("up"))
    single = written(_chains(counts.filter("k = 1").select("n", "up")), "single")
    many = counts.filter("k > 1").select("n")
    anchors = single.select(F.col("n").alias("up"), F.col("up").alias("anchor"), "w")
    todo = edges.join(many, "n", "left_semi").join(anchors, "up", "left").select("n", F.coalesce("anchor", "up").alias("up"), (F.coalesce("w", F.lit(0)) + 1).alias("w"))
    todo = todo.join(many.select(F.col("n").alias("up"), F.lit(True).alias("late")), "up", "left")
    todo = written(todo.select("n", F.when(F.coalesce("late", F.col("up") == CYCLE), F.col("up")).alias("up"), F.col("w").cast("long").alias("w")), "todo")
    found = None
    while not todo.isEmpty():
        # A need that is met has no `up` and its depth as w.
        ready = written(todo.groupBy("n").agg(F.count("up").alias("open"), F.max("w").alias("depth")).filter("open = 0").select("n", "depth"), "ready")
        if ready.isEmpty():
            break
        found = ready if found is None else found.unionByName(ready)
        rest = todo.join(ready, "n", "left_anti").join(ready.select(F.col("n").alias("up"), "depth"), "up", "left")
        todo = written(rest.select("n", F.when(F.col("depth").isNull(), F.col("up")).alias("up"), (F.col("w") + F.coalesce("depth", F.lit(0))).alias("w")), "todo")
    known = many.select("n", F.lit(None).cast("long").alias("depth")) if found is None else many.join(found, "n", "left")
    several = known.select(F.col("n").alias("up"), F.col("depth").alias("base"), F.lit(True).alias("late"))
    one = single.join(several, "up", "left").select("n", F.when(F.col("up") != CYCLE, F.when(F.col("late"), F.col("base")).otherwise(F.lit(0)) + F.col("w")).alias("depth"))
    needy = one.unionByName(known)
    return nodes.join(needy.withColumn("needy", F.lit(True)), "n", "left").select("n", F.when(F.col("needy"), F.col("depth")).otherwise(F.lit(0)).cast("long").alias("depth"))


def schema_errors(schemas: dict[str, dict[str, dict]]) -> Column:
    """The sorted errors of columns name, arguments (JSON text) and value (the same, parsed): `unknown_tool`, `arguments:json`
    (no JSON object), `<arg>:required`, `<arg>:type`, `<arg>:minimum`, `<arg>:maximum`, `<arg>:minLength`, `<arg>:maxLength`,
    `<arg>:unexpected`. Types are integer, number, string and boolean, as written in the JSON text."""
    keys = F.json_object_keys("arguments")
    known = F.coalesce(F.col("name").isin(list(schemas)), F.lit(False))
    found = [F.when(~known, F.lit("unknown_tool")), F.when(F.col("arguments").isNotNull() & (F.col("value").isNull() | keys.isNull()), F.lit("arguments:json"))]
    for tool, args in schemas.items():
        here = F.col("name") == tool
        for arg, rule in args.items():
            at = F.try_variant_get("value", f"$['{arg}']", "variant")
            kind = F.when(at.isNotNull() & ~F.is_variant_null(at), F.schema_of_variant(at))
            real = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
            right = {"integer": kind == "BIGINT", "number": real, "string": kind == "STRING", "boolean": kind == "BOOLEAN"}.get(rule.get("type"), F.lit(True))
            number = F.when(real, F.try_variant_get("value", f"$['{arg}']", "double"))
            size = F.when(kind == "STRING", F.length(F.try_variant_get("value", f"$['{arg}']", "string")))
            if rule.get("required"):
                found.append(F.when(here & kind.isNull(), F.lit(f"{arg}:required")))
            found.append(F.when(here & kind.isNotNull() & ~right, F.lit(f"{arg}:type")))
            for key, test in (("minimum", number < rule.get("minimum")), ("maximum", number > rule.get("maximum")), ("minLength", size < rule.get("minLength")), ("maxLength", size > rule.get("maxLength"))):
                if key in rule:
                    found.append(F.when(here & right & test, F.lit(f"{arg}:{key}")))
    allowed = [F.when(F.col("name") == t, F.array(*[F.lit(a) for a in args])) for t, args in schemas.items()]
    errors = F.array_compact(F.array(*found))
    if allowed:
        extra = F.coalesce(F.array_except(keys, F.coalesce(*allowed, keys)), F.array().cast("array<string>"))
        errors = F.concat(errors, F.transform(extra, lambda a: F.concat(a, F.lit(":unexpected"))))
    return F.array_sort(errors)


def linked(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, dict]]) -> DataFrame:
    """One row for each (conv_id, call_id) of calls(conv_id, turn, call_id, needs array<string>, name, arguments JSON text)
    or results(conv_id, turn, call_id, content).

    Returns conv_id, turn, call_id, status (`linked`, `pending` without a result, `orphan` without a call), n_calls,
    n_results, depth, position (0-based in the conversation, by depth, turn and id; cycles last), errors (joined by
    commas) and json. Identifiers hold within a conversation; a null conversation is one of its own. Of calls or results
    that repeat an id the first by turn and content counts. Rows whose id is null are left out, as nothing can refer to
    them; a need that names no call of the conversation is no need. Empty tables give an empty result; other columns are
    ignored.
    """
    called = calls.filter("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "needs", "name", "arguments")).alias("call"), F.count(F.lit(1)).alias("n_calls"))
    called = written(called.withColumn("n", F.monotonically_increasing_id()), "calls")
    given = results.filter("call_id is not null").groupBy(F.col("conv_id").alias("conv"), F.col("call_id").alias("id")).agg(
        F.min(F.struct("turn", "content")).alias("result"), F.count(F.lit(1)).alias("n_results"))
    asked = called.select("n", F.col("conv_id").alias("conv"), F.explode("call.needs").alias("id")).filter("id is not null")
    edges = asked.join(called.select("conv_id", "call_id", F.col("n").alias("up")), F.col("conv").eqNullSafe(F.col("conv_id")) & (F.col("id") == F.col("call_id"))).select("n", "up")
    depths = _depths(called.select("n"), edges)
    both = called.join(depths, "n").join(given, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("call_id") == F.col("id")), "full")
    status = F.when(F.col("call").isNull(), "orphan").when(F.col("result").isNull(), "pending").otherwise("linked")
    rows = both.select(
        F.coalesce("conv_id", "conv").alias("conv_id"), F.coalesce("call.turn", "result.turn").alias("turn"), F.coalesce("call_id", "id").alias("call_id"), status.alias("status"),
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), "depth", F.col("call.name").alias("name"),
        F.col("call.arguments").alias("arguments"), F.try_parse_json("call.arguments").alias("value"), "result")
    rows = rows.withColumn("errors", F.when(F.col("status") == "orphan", F.array(F.lit("unknown_call"))).otherwise(schema_errors(schemas)))
    result = F.when(F.col("result").isNotNull(), F.struct(F.col("result.content").alias("content"), F.col("result.turn").alias("turn")))
    body = F.struct(F.col("value").alias("arguments"), "call_id", "errors", "name", result.alias("result"))
    rows = rows.select("conv_id", "turn", "call_id", "status", "n_calls", "n_results", "depth", F.array_join("errors", ",").alias("errors"), F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))
    # Depths in order and, within one, turns by STEP: no conversation is ranked in one task.
    last = F.coalesce("depth", F.lit((1 << 31) - 1))
    part = F.coalesce(F.floor(F.col("turn") / STEP), F.lit((1 << 31) - 1))
    rows = ranked(rows, ["conv_id"], F.struct(last.alias("depth"), part.alias("part")), [last, F.col("turn").asc_nulls_last(), F.col("call_id")], "position")
    return rows.select("conv_id", "turn", "call_id", "status", "n_calls", "n_results", "depth", "position", "errors", "json")


#: Each user turn calls `reply` with its text; the next turn, if the assistant's, is the result; a call needs the one two turns before.
REPLY = {"reply": {"chars": {"type": "integer", "required": True, "minimum": 8, "maximum": 300}, "text": {"type": "string", "required": True, "minLength": 8}}}


def op3_tool_linking(spark, sf_dir):
    """The given conversations hold no tool calls, so user turns stand for calls and assistant turns for results; turns of
    other roles are neither."""
    turns = ship(spark).read.parquet(f"{sf_dir}/conversations.parquet")
    name = lambda t: F.concat(F.lit("turn-"), t)  # noqa: E731  null if t is
    text = F.coalesce("text", F.lit(""))
    known = F.col("conv_id").isNotNull()
    calls = turns.filter((F.col("role") == "user") & known).select(
        "conv_id", "turn", name(F.col("turn")).alias("call_id"), F.array(name(F.col("turn") - 2)).alias("needs"), F.lit("reply").alias("name"),
        F.to_json(F.struct(F.length(text).alias("chars"), text.alias("text"))).alias("arguments"))
    results = turns.filter((F.col("role") == "assistant") & known).select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return linked(calls, results, REPLY)


SQL = {
    "op3_tool_linking": """
    WITH u AS (
        SELECT conv_id, turn, 'turn-' || turn AS call_id, min(coalesce(text, '')) AS text, count(*) AS n_calls
        FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
    island AS (SELECT *, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM u),
    c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS depth FROM island),
    r AS (
        SELECT conv_id, turn, 'turn-' || (turn - 1) AS call_id, min(text) AS content, count(*) AS n_results
        FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
    b AS (
        SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS turn, coalesce(c.call_id, r.call_id) AS call_id,
               CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'pending' ELSE 'linked' END AS status,
               coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results, depth, c.text, r.turn AS rturn, content, r.call_id AS rid,
               CASE WHEN c.call_id IS NULL THEN ['unknown_call'] ELSE list_sort(list_filter([
                   CASE WHEN length(c.text) < 8 THEN 'chars:minimum' END, CASE WHEN length(c.text) > 300 THEN 'chars:maximum' END,
                   CASE WHEN length(c.text) < 8 THEN 'text:minLength' END], lambda e: e IS NOT NULL)) END AS es
        FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id)
    SELECT conv_id, turn, call_id, status, n_calls, n_results, depth,
           row_number() OVER (PARTITION BY conv_id ORDER BY depth NULLS LAST, turn, call_id) - 1 AS position,
           array_to_string(es, ',') AS errors,
           '{"arguments":' || CASE WHEN text IS NULL THEN 'null' ELSE '{"chars":' || length(text) || ',"text":' || to_json(text) || '}' END
           || ',"call_id":' || to_json(call_id) || ',"errors":' || to_json(es) || ',"name":' || CASE WHEN text IS NULL THEN 'null' ELSE '"reply"' END
           || ',"result":' || CASE WHEN rid IS NULL THEN 'null' ELSE '{"content":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"turn":' || rturn || '}' END || '}' AS json
    FROM b"""
}
