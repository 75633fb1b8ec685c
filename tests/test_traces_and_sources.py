"""Spans, logs, merges and files."""

import json

from pyspark.sql import functions as F

from parley.operators import traces
from parley.sources import documents


def attr(key, **value):
    return {"key": key, "value": value}


def payload(spans, resource=(), camel=True):
    r, s = ("resourceSpans", "scopeSpans") if camel else ("resource_spans", "scope_spans")
    return json.dumps({r: [{"resource": {"attributes": list(resource)}, s: [{"spans": spans}]}]})


ROUTE = [attr("eval.conversation_id", stringValue="c1"), attr("eval.turn_id", intValue="3")]


def test_span_conversion(spark):
    spans = [
        {"name": "a", "spanId": "s1", "attributes": [attr("gen_ai.tool.name", stringValue="search"), attr("gen_ai.tool.call.arguments", stringValue='{"b":1,"a":2}'), attr("gen_ai.tool.call.result", stringValue=""), attr("tool.id", stringValue="t9"), *ROUTE]},
        {"name": "execute_tool lookup", "spanId": "s2", "attributes": [attr("tool.parameters", stringValue="[1]"), *ROUTE]},
        {"name": "execute_tool hidden", "spanId": "s3", "attributes": [attr("gen_ai.tool.name", stringValue=""), attr("tool.name", stringValue="other"), *ROUTE]},
        {"name": "http get", "spanId": "s4", "attributes": ROUTE},
        {"name": "execute_tool fails", "spanId": "s5", "attributes": ROUTE, "status": {"code": 2}},
        {"name": "execute_tool fails", "spanId": "s6", "attributes": ROUTE, "status": {"code": "STATUS_CODE_ERROR", "message": "boom"}},
        {"name": "execute_tool typed", "span_id": "s7", "attributes": [attr("output.value", boolValue=False), attr("eval.turn_id", stringValue=" 7 "), attr("eval.conversation_id", stringValue="own")]},
        {"name": "execute_tool lost", "spanId": "s8", "attributes": [attr("eval.turn_id", stringValue="two")]},
    ]
    snake = [{"name": "execute_tool snake", "span_id": "s9", "attributes": [{"key": "tool_call.id", "value": {"string_value": "id9"}}, {"key": "output.value", "value": {"double_value": 1.5}}]}]
    rows = [(payload(spans, [attr("eval.conversation_id", stringValue="shared")]),), (payload(snake, ROUTE, camel=False),), ("{broken",), ("x" * 100,), (json.dumps({"resourceSpans": []}),), (None,)]
    spans_df = documents.parse_otlp(spark.createDataFrame(rows, "payload string"))
    got = {r["id"]: r for r in traces.spans_to_tool_calls(traces.route_spans(spans_df)).collect()}
    assert set(got) == {"t9", "s2", "s3", "s5", "s6", "s7", "id9"}
    assert (got["t9"]["name"], got["t9"]["arguments"], got["t9"]["result"]) == ("search", '{"a":2,"b":1}', "")
    assert (got["s2"]["name"], got["s2"]["arguments"]) == ("lookup", "{}")
    assert got["s3"]["name"] == "hidden"
    assert got["s5"]["error"] == "unknown error" and got["s6"]["error"] == "boom" and got["s2"]["error"] is None
    assert (got["s7"]["conversation_id"], got["s7"]["turn_id"], got["s7"]["result"]) == ("own", 7, "False")
    assert (got["id9"]["conversation_id"], got["id9"]["turn_id"], got["id9"]["result"]) == ("c1", 3, "1.5")


def test_large_payloads_are_rejected_whole(spark):
    rows = spark.createDataFrame([(payload([{"name": "execute_tool x", "attributes": ROUTE}]),)], "payload string")
    assert documents.parse_otlp(rows).count() == 1 and documents.parse_otlp(rows, max_bytes=20).count() == 0


CALLS = "conversation_id long, turn_id long, call_pos int, id string, name string, arguments string"


def test_merge(spark):
    explicit = [(1, 0, 0, "e1", "search", '{"a":1}'), (1, 0, 1, "e2", "lookup", "{}")]
    traced = [(1, 0, 0, "e1", "search", '{"a":9}'), (1, 0, 1, "t1", "search", '{"a":1}'), (1, 0, 2, "t2", "cancel", "{}"), (1, 0, 3, "t3", "cancel", "{}"), (1, 1, 0, "e1", "search", '{"a":1}')]
    got = [tuple(r)[1:5] for r in traces.merge_tool_calls(spark.createDataFrame(explicit, CALLS), spark.createDataFrame(traced, CALLS)).orderBy("turn_id", "call_pos").collect()]
    assert got == [(0, 0, "e1", "search"), (0, 1, "e2", "lookup"), (0, 2, "t2", "cancel"), (0, 3, "t3", "cancel"), (1, 0, "e1", "search")]


EVENTS = "conversation_id long, turn_id long, seq int, kind string, text string, status_text string, artifacts array<struct<extensions:array<string>,text:string,metadata:string>>"


def test_fold_events(spark):
    art = lambda t: [(["x"], t, "{}")]
    rows = [
        (1, 0, 0, "artifact_update", None, None, art("old")), (1, 0, 1, "task", None, "status", art("snap")), (1, 0, 2, "status_update", None, "no", None), (1, 0, 3, "artifact_update", None, None, art("new")),
        (2, 0, 0, "artifact_update", None, None, art("gone")), (2, 0, 1, "task", None, "status", None),
        (3, 0, 0, "message", "first", None, None), (3, 0, 1, "message", "last", None, None), (4, 0, 0, "status_update", None, "x", None),
    ]
    got = {r["conversation_id"]: r["text"] for r in traces.fold_events(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == {1: "snap\nnew", 2: "status", 3: "last", 4: ""}


def test_artifact_calls(spark):
    uri = "urn:t/v1"
    entries = [{"id": "1", "name": "a", "arguments": {"x": 1}, "result": "text"}, {"name": "b", "result": {"k": [1]}}, {"name": ""}, {"name": "c", "arguments": None}, {"name": 3}, "no", {"name": "d", "arguments": [1]}]
    rows = [(1, [uri], json.dumps({f"{uri}/tool_calls": entries})), (2, ["urn:other"], json.dumps({f"{uri}/tool_calls": entries})), (3, [uri], json.dumps({f"{uri}/tool_calls": {"name": "x"}})), (4, [uri], "{}"), (5, None, None)]
    got = traces.artifact_calls(spark.createDataFrame(rows, "conversation_id long, extensions array<string>, metadata string"), uri).collect()
    assert [(r["conversation_id"], r["name"], r["arguments"], r["result"]) for r in got] == [(1, "a", '{"x":1}', "text"), (1, "b", "{}", '{"k":[1]}')]


def test_pair_outputs(spark):
    rows = [(1, "call", "k", 0, "f", '{"a":1}', None), (1, "output", "k", 1, None, None, "one"), (1, "output", "k", 2, None, None, "two"), (1, "call", "m", 3, "g", "bad", None)]
    got = traces.pair_outputs(spark.createDataFrame(rows, "conversation_id long, kind string, call_id string, pos int, name string, arguments string, output string")).orderBy("pos").collect()
    assert [(r["call_id"], r["arguments"], r["result"]) for r in got] == [("k", '{"a":1}', "two"), ("m", "{}", None)]


def test_responses(spark):
    cases = [
        ({"choices": [{"message": {"content": "m"}}], "content": [{"type": "text", "text": "no"}]}, "m", None), ({"choices": [{"delta": {"content": "d"}}]}, "d", None), ({"choices": [{"message": {"content": None}}]}, "", None), ({"choices": []}, None, "empty choices"),
        ({"content": [{"type": "text", "text": "a"}, {"type": "tool_use"}, {"type": "text", "text": "b"}]}, "ab", None), ({"content": []}, "", None), ({"candidates": [{"content": {"parts": [{"text": "x"}, {"other": 1}, {"text": "y"}]}}]}, "xy", None),
        ({"candidates": []}, None, "empty candidates"), ({"foo": 1}, None, "unknown response format"),
    ]
    rows = [(i, json.dumps(c[0])) for i, c in enumerate(cases)] + [(99, "not json")]
    got = {r["i"]: (r["text"], r["error"]) for r in documents.normalize_responses(spark.createDataFrame(rows, "i int, raw string")).collect()}
    assert got == {**{i: c[1:] for i, c in enumerate(cases)}, 99: (None, "unknown response format")}


def test_files(spark, tmp_path):
    run = {"simulation_id": "r1", "conversations": [{"conversation_id": "c", "scenario_id": "s", "conversation_history": [{"turn_id": 0, "role": "simulated_user", "content": "hi"}, {"turn_id": 0, "role": "assistant", "content": "yo", "tool_calls": [
        {"id": "1", "name": "f", "arguments": {"b": 1, "a": 2}, "source": "otel_trace", "more": 1}, {"id": "2", "name": "g", "source": "pigeon"}, {"name": "no id"}]}],
        "simulated_user_prompt": {"variables": {"scenario.goal": "win", "scenario.knowledge": ["k"]}}}, {"conversation_id": "e", "scenario_id": "s", "conversation_history": []}]}
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "a.json").write_text(json.dumps(run, indent=1))
    conversations, messages, calls = documents.read_simulations(spark, str(tmp_path / "runs"))
    assert [(r["conversation_id"], r["goal"], list(r["knowledge"])) for r in conversations.orderBy("conversation_id").collect()] == [("c", "win", ["k"]), ("e", "", [])]
    assert messages.count() == 2
    assert [(r["run_id"], r["id"], r["arguments"], r["source"]) for r in calls.orderBy("id").collect()] == [("r1", "1", '{"a":2,"b":1}', "otel_trace"), ("r1", "2", "{}", None)]
    (tmp_path / "s.json").write_text(json.dumps({"schema_version": "v1", "scenarios": [{"scenario_id": "a", "goal": "g"}, {"scenario_id": "b", "user_attributes": {"x": 1}}, {"scenario_id": "c", "user_attributes": {"x": 1}, "user_profile": "p"}]}))
    good, bad = documents.read_scenarios(spark, str(tmp_path / "s.json"))
    assert sorted((r["scenario_id"], len(r["knowledge"]), len(r["assertions"])) for r in good.collect()) == [("a", 0, 0), ("c", 0, 0)] and [r["scenario_id"] for r in bad.collect()] == ["b"]
    kb = tmp_path / "kb" / "deep"
    kb.mkdir(parents=True)
    for name, text in (("a.md", "A\nb"), (".hidden.md", "no"), ("p.html", "<p>x</p>"), ("z.exe", "?")):
        (kb / name).write_text(text)
    got = {r["title"]: (r["content"], r["is_error"]) for r in documents.read_knowledge_files(spark, str(tmp_path / "kb")).collect()}
    assert got == {"a.md": ("A\nb", False), "p.html": ("<p>x</p>", False), "z.exe": (None, True)}


def test_clean_is_null_safe(spark):
    rows = spark.createDataFrame([(None, "f", None, "x"), ("1", None, None, "x"), ("1", "f", None, None)], "id string, name string, arguments string, source string")
    assert [tuple(r) for r in traces.clean_tool_calls(rows).select("id", "name", "arguments", "source").collect()] == [("1", "f", "{}", None)]
    assert traces.clean_tool_calls(rows.where(F.lit(False))).count() == 0
