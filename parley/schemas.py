"""Schemas of the JSON documents that are read; nothing is inferred."""

from __future__ import annotations

CALL = "STRUCT<id: STRING, name: STRING, arguments: STRING, result: STRING, error: STRING, source: STRING>"
MESSAGE = f"STRUCT<turn_id: INT, message_id: STRING, role: STRING, content: STRING, tool_calls: ARRAY<{CALL}>>"
PROMPT = "STRUCT<simulated_user_prompt_template: STRING, variables: STRUCT<`scenario.agent_context`: STRING, `scenario.goal`: STRING, `scenario.knowledge`: ARRAY<STRING>, `scenario.user_profile`: STRING>>"
SIMULATION = (
    "schema_version STRING, simulator_version STRING, simulation_id STRING, generated_at STRING, "
    f"conversations ARRAY<STRUCT<conversation_id: STRING, scenario_id: STRING, conversation_history: ARRAY<{MESSAGE}>, simulated_user_prompt: {PROMPT}>>, _corrupt_record STRING"
)
EXPECTED = "STRUCT<name: STRING, arguments: STRING, arg_match_mode: STRING>"
SCENARIO = (
    "STRUCT<scenario_id: STRING, user_id: STRING, goal: STRING, agent_context: STRING, user_profile: STRING, knowledge: ARRAY<STRUCT<content: STRING>>, "
    f"origin: STRING, assertions: ARRAY<STRUCT<type: STRING, match_mode: STRING, expected: ARRAY<{EXPECTED}>>>, user_attributes: STRING>"
)
SCENARIOS = f"schema_version STRING, scenarios ARRAY<{SCENARIO}>, _corrupt_record STRING"
VALUE = "STRUCT<stringValue: STRING, string_value: STRING, intValue: STRING, int_value: STRING, boolValue: BOOLEAN, bool_value: BOOLEAN, doubleValue: DOUBLE, double_value: DOUBLE>"
ATTRIBUTES = f"ARRAY<STRUCT<key: STRING, value: {VALUE}>>"
SPAN = f"STRUCT<name: STRING, spanId: STRING, span_id: STRING, attributes: {ATTRIBUTES}, status: STRUCT<code: STRING, message: STRING>>"
SCOPE = f"STRUCT<spans: ARRAY<{SPAN}>>"
RESOURCE = f"STRUCT<resource: STRUCT<attributes: {ATTRIBUTES}>, scopeSpans: ARRAY<{SCOPE}>, scope_spans: ARRAY<{SCOPE}>>"
OTLP = f"STRUCT<resourceSpans: ARRAY<{RESOURCE}>, resource_spans: ARRAY<{RESOURCE}>>"
