"""Tool calls from spans, event logs and explicit lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley import constants as C
from parley.functions.text import canonical_json, parse_arguments
from parley.operators.turns import conversation_keys

#: Span or resource attributes that say where a span belongs; a deployment has its own names.
CONVERSATION_KEY, TURN_KEY = "eval.conversation_id", "eval.turn_id"
NAME_KEYS = ["gen_ai.tool.name", "tool.name"]
ARGUMENT_KEYS = ["gen_ai.tool.call.arguments", "tool_call.function.arguments", "tool.parameters"]
ID_KEYS = ["gen_ai.tool.call.id", "tool_call.id", "tool.id"]
RESULT_KEYS = ["gen_ai.tool.call.result", "output.value"]
SPAN_PREFIX = "execute_tool "


def attribute(attributes: Column, key: str) -> Column:
    """The first typed value under a key, as text: string, int, bool, double in this order, in either spelling. False and empty values count."""

    def text(value: Column) -> Column:
        truth = F.coalesce(value["boolValue"], value["bool_value"])
        return F.coalesce(
            value["stringValue"], value["string_value"], value["intValue"], value["int_value"], F.when(truth, "True").when(~truth, "False"), value["doubleValue"].cast("string"), value["double_value"].cast("string")
        )

    typed = F.filter(F.transform(F.filter(attributes, lambda a: a["key"] == key), lambda a: text(a["value"])), lambda t: t.isNotNull())
    return F.get(typed, 0)


def first_attribute(attributes: Column, keys: list[str]) -> Column:
    """The first key that is present wins, even if its value is empty."""
    return F.coalesce(*[attribute(attributes, k) for k in keys])


def route_spans(spans: DataFrame, conversation_key: str = CONVERSATION_KEY, turn_key: str = TURN_KEY) -> DataFrame:
    """Spans with conversation_id and turn_id, from their own attributes or else the resource's; spans without both, or with a turn that is no integer, are dropped."""
    of = lambda key: F.coalesce(attribute(F.col("attributes"), key), attribute(F.col("resource_attributes"), key))
    rows = spans.withColumn("conversation_id", of(conversation_key)).withColumn("turn_id", F.trim(of(turn_key)).try_cast("int"))
    return rows.where("conversation_id is not null and turn_id is not null")


def spans_to_tool_calls(spans: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Tool calls of routed spans: (conversation_id, turn_id, id, name, arguments, result, error, source) and arrival, payload_id and span_pos, where spans have them; and the columns to keep."""
    a = F.col("attributes")
    name = F.coalesce(F.nullif(first_attribute(a, NAME_KEYS), F.lit("")), F.when(F.col("name").startswith(SPAN_PREFIX), F.substring("name", len(SPAN_PREFIX) + 1, 1 << 30)))
    failed = F.col("status.code").isin("2", "STATUS_CODE_ERROR")
    extra = [*keep, *(c for c in ("arrival", "payload_id", "span_pos") if c in spans.columns)]
    return spans.select(
        "conversation_id", "turn_id", F.coalesce(F.nullif(first_attribute(a, ID_KEYS), F.lit("")), "span_id", F.lit("")).alias("id"), name.alias("name"),
        F.coalesce(parse_arguments(first_attribute(a, ARGUMENT_KEYS)), F.lit("{}")).alias("arguments"), first_attribute(a, RESULT_KEYS).alias("result"),
        F.when(failed, F.coalesce("status.message", F.lit("unknown error"))).alias("error"), F.lit("otel_trace").alias("source"), *extra,
    ).where("name is not null")


def pair_outputs(items: DataFrame) -> DataFrame:
    """Call items joined to the last output of their call_id: (keys, pos, call_id, name, arguments, result).

    items: kind call or output, call_id, pos, name, arguments, output.
    """
    keys = conversation_keys(items)
    outputs = items.where("kind = 'output'").groupBy(*keys, "call_id").agg(F.max_by("output", "pos").alias("result"))
    return items.where("kind = 'call'").select(*keys, "pos", "call_id", "name", parse_arguments(F.col("arguments")).alias("arguments")).join(outputs, [*keys, "call_id"], "left")


def artifact_calls(artifacts: DataFrame, uri: str) -> DataFrame:
    """Calls in the metadata of artifacts (keys, extensions, metadata) that list the extension's uri.

    The list stands under <uri>/tool_calls. An entry needs a name that is a
    non-empty text, and arguments that are an object or absent; other results
    and errors than texts become JSON.
    """
    same = [c for c in artifacts.columns if c not in ("extensions", "metadata", "text")]
    listed = artifacts.where(F.array_contains("extensions", uri)).withColumn("m", F.from_json("metadata", "map<string,string>"))
    calls = F.try_element_at("m", F.lit(f"{uri}/tool_calls"))
    rows = listed.select(*same, F.posexplode(F.from_json(F.when(F.ltrim(calls).startswith("["), calls), "array<string>")).alias("call_pos", "raw"))
    v = rows.withColumn("v", F.try_parse_json("raw")).withColumn("keys", F.from_json("raw", "map<string,string>"))
    kind = lambda k: F.schema_of_variant(F.try_variant_get("v", F.lit(f"$.{k}"), "variant"))
    text = lambda k: F.when(kind(k) == "STRING", F.try_variant_get("v", F.lit(f"$.{k}"), "string")).when(F.col("keys")[k].isNotNull(), canonical_json(F.col("keys")[k]))
    ok = F.schema_of_variant("v").startswith("OBJECT") & (kind("name") == "STRING") & (F.try_variant_get("v", F.lit("$.name"), "string") != "")
    absent = ~F.array_contains(F.map_keys("keys"), "arguments")
    out = v.where(ok & (absent | kind("arguments").startswith("OBJECT")))
    return out.select(
        *same, "call_pos", F.coalesce(text("id"), F.lit("")).alias("id"), F.try_variant_get("v", F.lit("$.name"), "string").alias("name"),
        F.coalesce(canonical_json(F.col("keys")["arguments"]), F.lit("{}")).alias("arguments"), text("result").alias("result"), text("error").alias("error"), F.lit("a2a_protocol").alias("source"),
    )


def fold_events(events: DataFrame) -> DataFrame:
    """(keys, turn_id, text) of the latest state of each event log.

    A task snapshot clears what came before it, artifact updates add to it,
    status updates change nothing. The text is the artifacts', else the
    snapshot's status message, else the last message, else empty.
    """
    keys = [*conversation_keys(events), "turn_id"]
    w = Window.partitionBy(*keys).orderBy("seq")
    epochs = events.withColumn("epoch", F.sum((F.col("kind") == "task").cast("int")).over(w))
    top = epochs.withColumn("last", F.max("epoch").over(Window.partitionBy(*keys)))
    now = top.where("epoch = last and kind in ('task', 'artifact_update')")
    state = now.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("seq", "artifacts"))).alias("a"), F.max(F.when(F.col("kind") == "task", F.col("status_text"))).alias("status_text"))
    message = events.where("kind = 'message'").groupBy(*keys).agg(F.max_by("text", "seq").alias("message"))
    parts = F.filter(F.flatten(F.transform("a", lambda x: F.transform(F.coalesce(x["artifacts"], F.array().cast(events.schema["artifacts"].dataType)), lambda y: y["text"]))), lambda t: F.coalesce(t, F.lit("")) != "")
    text = F.when(F.size(parts) > 0, F.array_join(parts, "\n"))
    return events.select(*keys).distinct().join(state, keys, "left").join(message, keys, "left").select(*keys, F.coalesce(text, F.nullif("status_text", F.lit("")), "message", F.lit("")).alias("text"))


def clean_tool_calls(calls: DataFrame) -> DataFrame:
    """Unknown sources become null, calls without id or name go, missing arguments are empty."""
    source = F.when(F.col("source").isin(C.TOOL_SOURCES), F.col("source"))
    return calls.where("id is not null and name is not null").withColumn("source", source).withColumn("arguments", parse_arguments(F.col("arguments")))


def merge_tool_calls(explicit: DataFrame, traced: DataFrame) -> DataFrame:
    """Explicit calls, then the traced ones of the same turn that have neither an explicit id nor an explicit (name, arguments).

    Traced calls are not compared with each other. All three tables are
    partitioned by the turn, so the two anti joins and the numbering share it.
    """
    keys = [*conversation_keys(explicit), "turn_id"]
    columns = [*keys, "call_pos", "id", "name", "arguments"]
    seen = explicit.select(*keys, "id", "name", "arguments")
    new = traced.join(seen.select(*keys, "id"), [*keys, "id"], "left_anti").join(seen.select(*keys, "name", "arguments"), [*keys, "name", "arguments"], "left_anti")
    both = explicit.select(*columns, F.lit(0).alias("part")).unionByName(new.select(*columns, F.lit(1).alias("part")))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("part", "call_pos", "id")) - 1
    return both.select(*keys, order.alias("call_pos"), "id", "name", "arguments", F.when(F.col("part") == 0, "explicit").otherwise("traced").alias("origin"))
