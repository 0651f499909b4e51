"""Tool calls of conversations, linked to their results, ordered, validated and written as canonical JSON.

A message of ``assistant`` may hold ``{"tool_calls": [{"id", "name", "arguments", "after"}]}``, one of
``tool`` ``{"tool_call_id", "content"}``; any other text is a plain message.  ``after`` names
calls of the same conversation whose results a call needs.

Calls and results meet in a hash join on (conv_id, id).  An event's order is (ready, level):
its own turn at level 0, or one level behind the latest event that it needs.  Orders rise
round by round until none changes, over all conversations at once; no conversation is
gathered in one task, so a row of the result is an event and (ready, level, turn, pos) its place.

Nulls, empties and odd input: a message without a conversation, turn, role or text stays a plain
message with these null; calls without an id are never linked; of calls with the same id the
first by (turn, pos) is the call and the others are ``repeated``; so with results; results
without a call are ``orphan``; events of a cycle keep their own turn and are ``cyclic``; equal rows
are events of their own; empty tables give none; of the input's columns only conv_id, turn,
role and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.llm.common import store

#: What ``schema_of_variant`` says of the types that a schema may name.
KINDS = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",),
         "object": ("OBJECT",), "array": ("ARRAY",)}

CALLS = "struct<tool_calls: array<struct<id: string, name: string, arguments: string, after: array<string>>>>"
RESULT = "struct<tool_call_id: string, content: string>"


def events(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, kind, role, call_id, name, body, after): messages, calls and results one by one."""
    is_calls = (F.col("role") == "assistant") & F.ltrim("text").startswith("{")
    is_result = (F.col("role") == "tool") & F.ltrim("text").startswith("{")
    read = messages.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "role", "text",
        F.when(is_calls, F.from_json("text", CALLS)).alias("c"), F.when(is_result, F.from_json("text", RESULT)).alias("r"))
    calls = read.filter("size(c.tool_calls) > 0").select(
        "conv_id", "turn", F.posexplode("c.tool_calls").alias("pos", "call"), "role").select(
        "conv_id", "turn", "pos", F.lit("call").alias("kind"), "role", F.col("call.id").alias("call_id"),
        F.col("call.name").alias("name"), F.col("call.arguments").alias("body"),
        F.coalesce("call.after", F.array().cast("array<string>")).alias("after"))
    others = read.filter("NOT coalesce(size(c.tool_calls) > 0, false)").select(
        "conv_id", "turn", F.lit(0).alias("pos"),
        F.when(F.col("r.tool_call_id").isNotNull(), "result").otherwise("message").alias("kind"), "role",
        F.col("r.tool_call_id").alias("call_id"), F.lit(None).cast("string").alias("name"),
        F.when(F.col("r.tool_call_id").isNotNull(), F.col("r.content")).otherwise(F.col("text")).alias("body"),
        F.array().cast("array<string>").alias("after"))
    return calls.unionByName(others)


def linked(all_events: DataFrame) -> DataFrame:
    """Events with ``status``: linked, no_result, repeated, orphan, or null for messages and calls without an id."""
    named = all_events.filter("call_id IS NOT NULL AND conv_id IS NOT NULL")
    # One row for each id and kind, made on the map side first; a repeated id cannot multiply the join.
    first = named.groupBy("conv_id", "call_id", "kind").agg(F.min(F.struct("turn", "pos")).alias("first"))
    calls = first.filter("kind = 'call'").selectExpr("conv_id", "call_id", "first AS first_call")
    results = first.filter("kind = 'result'").selectExpr("conv_id", "call_id", "first AS first_result")
    pairs = calls.hint("shuffle_hash").join(results, ["conv_id", "call_id"], "full")
    found = all_events.join(pairs, ["conv_id", "call_id"], "left")
    here = F.struct("turn", "pos")
    status = (
        F.when((F.col("kind") == "message") | F.col("call_id").isNull(), F.lit(None))
        .when(F.col("first_call").isNull() & (F.col("kind") == "result"), "orphan")
        .when(here != F.when(F.col("kind") == "call", F.col("first_call")).otherwise(F.col("first_result")), "repeated")
        .when(F.col("first_result").isNull(), "no_result").otherwise("linked"))
    return found.withColumn("status", status).drop("first_call", "first_result")


def ordered(events_linked: DataFrame) -> DataFrame:
    """Events with (ready, level); those of a cycle become ``cyclic`` and keep their own turn."""
    base = store(events_linked, "events")
    nodes = base.filter("status IN ('linked', 'no_result')").select("conv_id", "call_id", "kind", "turn", "after")
    needs = nodes.filter("kind = 'result'").select(
        "conv_id", "call_id", "kind", F.col("call_id").alias("need"), F.lit("call").alias("need_kind")).unionByName(
        nodes.filter("kind = 'call' AND size(after) > 0").select(
            "conv_id", "call_id", "kind", F.explode("after").alias("need"), F.lit("result").alias("need_kind")))
    needs = store(needs.distinct(), "needs")
    depth = needs.groupBy("conv_id").agg((F.count("*") + 1).alias("most"))
    node = ["conv_id", "call_id", "kind"]
    own = nodes.groupBy(*node).agg(F.min("turn").alias("ready")).withColumn("level", F.lit(0))
    at = store(own.join(depth, "conv_id", "left").withColumn("most", F.coalesce("most", F.lit(1))), "orders")
    while True:
        behind = needs.join(at.select("conv_id", F.col("call_id").alias("need"), F.col("kind").alias("need_kind"),
                                      F.col("ready").alias("r"), (F.col("level") + 1).alias("l")),
                            ["conv_id", "need", "need_kind"]).groupBy(*node).agg(F.max(F.struct("r", "l")).alias("behind"))
        risen = at.join(behind, node, "left").withColumn(
            "rises", (F.col("level") <= F.col("most")) & (F.col("behind") > F.struct(F.col("ready").alias("r"), F.col("level").alias("l"))))
        risen = store(risen.select(*node, F.when(F.col("rises"), F.col("behind.r")).otherwise(F.col("ready")).alias("ready"),
                                   F.when(F.col("rises"), F.col("behind.l")).otherwise(F.col("level")).alias("level"),
                                   "most", F.coalesce("rises", F.lit(False)).alias("rises")), "orders")
        at = risen.drop("rises")
        if risen.filter("rises").isEmpty():
            break
    placed = base.join(at, node, "left")
    cyclic = F.col("status").isin("linked", "no_result") & (F.col("level") > F.col("most"))
    moves = F.col("status").isin("linked", "no_result") & ~cyclic
    return placed.select(
        "conv_id", F.when(moves, F.col("ready")).otherwise(F.col("turn")).alias("ready"),
        F.when(moves, F.col("level")).otherwise(0).alias("level"), "turn", "pos", "kind", "role", "call_id", "name", "body",
        F.when(cyclic, "cyclic").otherwise(F.col("status")).alias("status"))


def _schema(fields: dict) -> dict:
    """A tool's schema; a plain table of (type, required) by field stands for an object without further fields."""
    if "type" in fields and isinstance(fields["type"], str):
        return fields
    return {"type": "object", "properties": {field: {"type": kind} for field, (kind, _) in fields.items()},
            "required": [field for field, (_, required) in fields.items() if required], "additionalProperties": False}


def _faults(value: Column, schema: dict, path: str) -> Column:
    """What is wrong with a variant, as texts: fields by name, then what lies in them, then fields that the schema has not."""
    kind, parts = schema["type"], []
    right = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0).isin(*KINDS[kind])
    if "enum" in schema:
        parts.append(F.when(~F.variant_get(value, "$", "string").isin(*schema["enum"]), F.array(F.lit(f"value of {path}"))))
    if kind == "object":
        for field, inner in sorted(schema.get("properties", {}).items()):
            found, where = F.variant_get(value, f"$['{field}']", "variant"), f"{path}.{field}" if path else field
            missing = F.array(F.lit(f"missing {where}")) if field in schema.get("required", ()) else F.array().cast("array<string>")
            parts.append(F.when(found.isNull(), missing).otherwise(_faults(found, inner, where)))
        if schema.get("additionalProperties", True) is False:
            known = F.array(*[F.lit(field) for field in schema.get("properties", {})]).cast("array<string>")
            extra = F.array_sort(F.array_except(F.json_object_keys(F.to_json(value)), known))
            parts.append(F.transform(extra, lambda key: F.concat(F.lit(f"unknown {path}." if path else "unknown "), key)))
    if kind == "array" and "items" in schema:
        each = F.variant_get(value, "$", "array<variant>")
        parts.append(F.flatten(F.transform(each, lambda item: _faults(item, schema["items"], f"{path}[]"))))
    none = F.array().cast("array<string>")
    whole = F.concat(none, *[F.coalesce(part, none) for part in parts])
    return F.when(~right, F.array(F.lit(f"type of {path}" if path else f"not an {kind}"))).otherwise(whole)


def argument_errors(schemas: dict[str, dict]) -> Column:
    """What is wrong with a call's arguments; ``schemas`` has a JSON schema by tool.

    Of a schema type, properties, required, additionalProperties, items and enum count, at every depth.
    """
    value = F.try_parse_json("body")
    by_tool = F.array(F.lit("unknown tool"))
    for tool, schema in schemas.items():
        by_tool = F.when(F.col("name") == tool, _faults(value, _schema(schema), "")).otherwise(by_tool)
    return F.when(F.col("kind") == "call", F.when(value.isNull(), F.array(F.lit("not JSON"))).otherwise(by_tool)).otherwise(
        F.array().cast("array<string>"))


def canonical(all_events: DataFrame) -> Column:
    """An event's JSON: keys in order, no space; a variant keeps its keys in order, at every depth."""
    arguments = F.coalesce(F.try_parse_json("body"), F.to_variant_object(F.struct(F.col("body").alias("text"))))
    call = F.to_json(F.struct(arguments.alias("arguments"), F.col("call_id").alias("id"), "name"))
    result = F.to_json(F.struct(F.col("body").alias("content"), F.col("call_id").alias("tool_call_id")))
    message = F.to_json(F.struct(F.col("body").alias("content"), "role"))
    return F.when(F.col("kind") == "call", call).when(F.col("kind") == "result", result).otherwise(message)


def link(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each event: its place, status, what is wrong with its arguments, and its canonical JSON."""
    placed = ordered(linked(events(messages)))
    return placed.select("conv_id", "ready", "level", "turn", "pos", "kind", "call_id", "status",
                         argument_errors(schemas).alias("errors"), canonical(placed).alias("json"))


#: The tools of ``traffic``.
TOOLS = {
    "ask": {"text": ("string", True), "turn": ("integer", True)},
    "look": {"type": "object", "required": ["about", "mode"], "additionalProperties": False, "properties": {
        "about": {"type": "object", "required": ["words"], "properties": {"words": {"type": "integer"}, "text": {"type": "string"}}},
        "limits": {"type": "array", "items": {"type": "integer"}}, "mode": {"type": "string", "enum": ["fast", "full"]}}},
}


def traffic(conversations: DataFrame) -> DataFrame:
    """The turns as tool traffic, with the faults that real traffic has, all decided by conversation and turn.

    A user's turn calls ``look`` and ``ask``; ``ask`` needs the results of that ``look`` and of the ``ask`` two turns before.
    The turn behind it brings both results, so ``ask`` waits within its turn.  A checksum h of conversation and turn puts
    in wrong, missing and unknown arguments (h % 8), arguments that are no JSON (h % 17), the id of the other call
    (h % 11) and results of calls that nobody made (h % 19); a last call has no result.  No turn looks at others.
    """
    turn = F.col("turn").cast("long")
    name = lambda n, more="": F.concat_ws("-", F.col("conv_id").cast("string"), n.cast("string"), *([F.lit(more)] if more else []))
    h = F.crc32(name(turn).cast("binary"))
    fault = h % 8
    about = F.struct(F.when(fault != 1, F.size(F.split("text", " "))).alias("words"), "text")
    look = F.to_json(F.struct(
        about.alias("about"), F.when(fault == 2, F.array(F.lit("1"))).otherwise(F.array(turn.cast("string"))).alias("limits"),
        F.when(fault == 3, "odd").otherwise("fast").alias("mode")))
    # Numbers of an array stand without quotes, but for the fault.
    look = F.when(fault == 2, look).otherwise(F.regexp_replace(look, r'"limits":\["([0-9]+)"\]', '"limits":[$1]'))
    look = F.when(h % 17 == 0, "look around").otherwise(look)
    ask = F.to_json(F.struct(
        F.when(fault != 4, F.col("text")).alias("text"), F.when(fault != 5, turn).alias("turn"),
        F.when(fault == 6, F.lit(True)).alias("again")))
    ask = F.when(fault == 5, F.concat(F.lit('{"turn":"late",'), F.substring(ask, F.lit(2), F.length(ask)))).otherwise(ask)
    call = lambda call_id, tool, arguments, after: F.struct(
        call_id.alias("id"), F.lit(tool).alias("name"), arguments.alias("arguments"), after.alias("after"))
    calls = F.to_json(F.struct(F.array(
        call(name(turn, "a"), "look", look, F.array().cast("array<string>")),
        call(F.when(h % 11 == 0, name(turn, "a")).otherwise(name(turn)), "ask", ask, F.array(name(turn, "a"), name(turn - 2))),
    ).alias("tool_calls")))
    result = lambda call_id: F.to_json(F.struct(call_id.alias("tool_call_id"), F.col("text").alias("content")))
    asked = F.when(h % 19 == 0, name(turn, "nobody")).otherwise(name(turn - 1))
    user, answer = F.col("role") == "user", F.col("role") == "assistant"
    texts = F.when(user, F.array(calls)).when(answer, F.array(result(name(turn - 1, "a")), result(asked))).otherwise(F.array("text"))
    return conversations.select(
        "conv_id", "turn", F.when(user, "assistant").when(answer, "tool").otherwise(F.col("role")).alias("role"),
        F.explode(texts).alias("text"))


def link_conversations(conversations: DataFrame) -> DataFrame:
    """``link`` over the traffic of a table of conversations."""
    return link(traffic(conversations), TOOLS)
