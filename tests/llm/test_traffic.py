"""The registered tool traffic beside a plain reading of the same messages, and nested schemas."""

from __future__ import annotations

import json
from collections import Counter, defaultdict

from panelspark.llm import queries, tool_calls

SF = "/root/testdata/sf0.001"
PLAIN = {str: "string", bool: "boolean", int: "integer", float: "number", dict: "object", list: "array"}


def faults(value, schema, path=""):
    kind = PLAIN.get(type(value), "null")
    if kind != schema["type"] and (kind, schema["type"]) != ("integer", "number"):
        return [f"type of {path}" if path else f"not an {schema['type']}"]
    out = [f"value of {path}"] if "enum" in schema and value not in schema["enum"] else []
    if kind == "object":
        for field, inner in sorted(schema.get("properties", {}).items()):
            where = f"{path}.{field}" if path else field
            if field in value:
                out += faults(value[field], inner, where)
            elif field in schema.get("required", ()):
                out.append(f"missing {where}")
        if schema.get("additionalProperties", True) is False:
            out += [f"unknown {path}.{key}" if path else f"unknown {key}" for key in sorted(set(value) - set(schema["properties"]))]
    if kind == "array" and "items" in schema:
        out += [fault for item in value for fault in faults(item, schema["items"], f"{path}[]")]
    return out


def plain_link(messages):
    """Counter of (conv_id, turn, pos, kind, call_id, status, ready, level, errors)."""
    events = []
    for conv, turn, role, text in messages:
        try:
            said = json.loads(text) if role in ("assistant", "tool") else None
        except (TypeError, ValueError):
            said = None
        if role == "assistant" and isinstance(said, dict) and said.get("tool_calls"):
            for pos, call in enumerate(said["tool_calls"]):
                try:
                    errors = faults(json.loads(call["arguments"]), tool_calls._schema(tool_calls.TOOLS[call["name"]]))
                except ValueError:
                    errors = ["not JSON"]
                events.append([conv, turn, pos, "call", call["id"], call.get("after", []), errors])
        elif role == "tool" and isinstance(said, dict) and said.get("tool_call_id") is not None:
            events.append([conv, turn, 0, "result", said["tool_call_id"], [], []])
        else:
            events.append([conv, turn, 0, "message", None, [], []])
    first = {}
    for conv, turn, pos, kind, name, _, _ in events:
        if name is not None:
            key = (conv, name, kind)
            first[key] = min(first.get(key, (turn, pos)), (turn, pos))
    nodes, needs = {}, defaultdict(set)
    status = []
    for conv, turn, pos, kind, name, after, _ in events:
        if kind == "message":
            status.append(None)
        elif kind == "result" and (conv, name, "call") not in first:
            status.append("orphan")
        elif first[conv, name, kind] != (turn, pos):
            status.append("repeated")
        else:
            status.append("linked" if (conv, name, "result") in first else "no_result")
            nodes[conv, name, kind] = (turn, 0)
            needs[conv, name, kind] |= {(conv, name, "call")} if kind == "result" else {(conv, x, "result") for x in after}
    changed = True
    while changed:
        changed = False
        for node, wanted in needs.items():
            behind = max(((nodes[x][0], nodes[x][1] + 1) for x in wanted if x in nodes), default=nodes[node])
            if behind > nodes[node]:
                nodes[node], changed = behind, True
    out = Counter()
    for (conv, turn, pos, kind, name, _, errors), how in zip(events, status, strict=True):
        place = nodes[conv, name, kind] if how in ("linked", "no_result") else (turn, 0)
        out[conv, turn, pos, kind, name, how, *place, tuple(errors)] += 1
    return out


def test_traffic_beside_a_plain_reading(spark):
    conversations = spark.read.parquet(f"{SF}/conversations.parquet")
    messages = [tuple(row) for row in tool_calls.traffic(conversations).select("conv_id", "turn", "role", "text").collect()]
    got = queries.op4_tool_calls(spark, SF).collect()
    ours = Counter((r["conv_id"], r["turn"], r["pos"], r["kind"], r["call_id"], r["status"], r["ready"], r["level"], tuple(r["errors"]))
                   for r in got)
    assert ours == plain_link(messages)
    assert {r["status"] for r in got} >= {"linked", "no_result", "repeated", "orphan"}
    assert {0, 1, 2} <= {r["level"] for r in got}
    assert len({error for r in got for error in r["errors"]}) >= 7


def test_nested_schemas(spark):
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {
        "a": {"type": "array", "items": {"type": "object", "required": ["x"], "properties": {
            "x": {"type": "string", "enum": ["u", "v"]}, "y": {"type": "array", "items": {"type": "number"}}}}}}}
    arguments = [{"a": []}, {}, {"a": [{"x": "u"}, {"x": "w", "y": [1, 2.5, "3"]}, {}]}, {"a": {"x": "u"}, "b": 1}, [1], 7,
                 {"a": [None, {"x": None}]}, {"a": [{"x": "v", "z": 1}]}]
    rows = [(1, i, "assistant", json.dumps({"tool_calls": [{"id": str(i), "name": "f", "arguments": json.dumps(one)}]}))
            for i, one in enumerate(arguments)]
    rows.append((2, 0, "assistant", json.dumps({"tool_calls": [{"id": "l", "name": "f", "arguments": json.dumps(
        {"a": [{"x": "u", "y": list(range(20_000))}]})}]})))
    found = tool_calls.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {"f": schema})
    got = {(r["conv_id"], r["turn"]): r["errors"] for r in found.collect()}
    assert got == {(1, i): faults(one, schema) for i, one in enumerate(arguments)} | {(2, 0): []}


def test_equal_messages_and_ties(spark):
    call = json.dumps({"tool_calls": [{"id": "a", "name": "ask", "arguments": '{"text":"t","turn":1}'}]})
    rows = [(1, 1, "assistant", call)] * 3 + [(1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "x"}))] * 2
    found = tool_calls.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tool_calls.TOOLS)
    got = Counter((r["kind"], r["status"]) for r in found.collect())
    assert got == {("call", "linked"): 3, ("result", "linked"): 2}  # equal places are one event's
