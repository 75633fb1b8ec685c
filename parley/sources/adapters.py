"""The driver's tables as transcripts, scores, calls and scenarios.

The same text of plain SQL feeds Spark and the comparison in another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parley import constants as C
from parley.functions.tables import materialize

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"
_LABELS = [*C.FAILURE_LABELS, C.NO_FAILURE]


def _case(number: str, labels: list[str]) -> str:
    return "CASE " + number + " ".join([""] + [f"WHEN {i} THEN '{x}'" for i, x in enumerate(labels)]) + " END"


MESSAGES = "SELECT conv_id AS conversation_id, turn AS msg_pos, CASE WHEN role = 'user' THEN 'simulated_user' ELSE role END AS role, text AS content FROM conversations"
TALKS = "SELECT DISTINCT conv_id AS conversation_id FROM conversations"
LINES = f"""SELECT l_orderkey AS conversation_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) - 1 AS turn_id,
  CAST(l_partkey AS BIGINT) AS p, CAST(l_suppkey AS BIGINT) AS s, CAST(l_linenumber AS BIGINT) AS n FROM lineitem"""
TURNS = f"SELECT conversation_id, turn_id FROM ({LINES})"
_TURN_METRICS = [
    ("helpfulness", "1 + p % 5"), ("coherence", "CASE WHEN s % 11 = 0 THEN -1 ELSE 1 + s % 5 END"), ("verbosity", "1 + n % 5"), ("relevance", "3 + (p + s) % 3"), ("faithfulness", "2 + (p + n) % 4"),
]


def _by_metric(values: list[str]) -> str:
    return "CASE m.pos " + " ".join(f"WHEN {i + 1} THEN {v}" for i, v in enumerate(values)) + " END"


#: The lines are numbered once and met with a list of metrics, which is of fixed length.
QUANT = f"""SELECT * FROM (
  SELECT conversation_id, turn_id, {_by_metric([repr(n) for n, _ in _TURN_METRICS])} AS name, 'turn' AS scope, CAST({_by_metric([f"({v})" for _, v in _TURN_METRICS])} AS DOUBLE) AS value, 5.0E0 AS score_max, m.pos AS pos
    FROM ({LINES}) AS l CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS m(pos) WHERE m.pos <> 5 OR p % 7 <> 0
  UNION ALL SELECT CAST(o_orderkey AS BIGINT), NULL, 'politeness', 'conversation', CAST(1 + o_custkey % 5 AS DOUBLE), NULL, 6 FROM orders) AS q"""
VERDICTS = f"SELECT conversation_id, turn_id, {_case('(p + n) % 8', _LABELS)} AS label, concat('Part ', CAST(p % 20 AS STRING), ' was   told   wrong') AS reason FROM ({LINES})"
TOOL_VERDICTS = f"SELECT conversation_id, turn_id, {_case('(s + n) % 8', _LABELS)} AS label, concat('Call ', CAST(s % 9 AS STRING)) AS reason FROM ({LINES}) WHERE p % 3 = 0"
QUAL = f"""SELECT * FROM (
  SELECT conversation_id, turn_id, 'tone' AS name, 'turn' AS scope, CASE (p + s) % 3 WHEN 0 THEN 'friendly' WHEN 1 THEN 'neutral' ELSE 'rude' END AS value, CAST(n AS INT) AS pos FROM ({LINES})
  UNION ALL SELECT conversation_id, turn_id, 'tone', 'turn', 'neutral', CAST(n + 1 AS INT) FROM ({LINES}) WHERE p % 2 = 0
  UNION ALL SELECT CAST(o_orderkey AS BIGINT), NULL, 'outcome', 'conversation', CASE o_custkey % 3 WHEN 0 THEN 'lost' WHEN 1 THEN 'kept' ELSE 'agent_api_error' END, 1 FROM orders) AS q"""
CONVERSATIONS = "SELECT o_orderkey AS conversation_id, o_custkey AS scenario_id FROM orders"
GOALS = """SELECT o_orderkey AS conversation_id, 'goal_completion' AS name, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE -1 END AS DOUBLE) AS value, concat('status ', o_orderstatus) AS reason, 1 AS pos FROM orders"""
SCENARIOS = "SELECT c_custkey AS scenario_id, c_name AS goal, c_mktsegment AS user_profile FROM customer WHERE c_custkey % 10 <> 0"
CALLS = """SELECT user_id AS conversation_id, CAST(floor((rn - 1) / 5) AS BIGINT) AS turn_id, (rn - 1) % 5 AS call_pos, CAST(event_id AS STRING) AS id, event_type AS name, props AS arguments, event_id
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"""
SQL = {
    "messages": MESSAGES, "lines": LINES, "turns": TURNS, "quant": QUANT, "verdicts": VERDICTS, "tool_verdicts": TOOL_VERDICTS, "qual": QUAL, "conversations": CONVERSATIONS, "goals": GOALS, "scenarios": SCENARIOS, "calls": CALLS, "conversations_of_messages": TALKS,
}
_TABLES = {
    "messages": ["conversations"], "lines": ["lineitem"], "turns": ["lineitem"], "quant": ["lineitem", "orders"], "verdicts": ["lineitem"], "tool_verdicts": ["lineitem"], "qual": ["lineitem", "orders"], "conversations": ["orders"],
    "goals": ["orders"], "scenarios": ["customer"], "calls": ["events"], "conversations_of_messages": ["conversations"],
}


def adapt(spark: SparkSession, sf_dir: str, name: str, lines: DataFrame | None = None) -> DataFrame:
    """One of SQL's tables over the Parquet files of sf_dir; with lines, that of numbered_lines(), the lines aren't numbered again."""
    if lines is not None and name == "lines":
        return lines
    text, tables = SQL[name], {}
    if lines is not None and f"({LINES})" in text:
        text, tables["lines"] = text.replace(f"({LINES})", "{lines}"), lines
    for t in _TABLES[name]:
        if f"FROM {t}" in text:
            text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
            tables[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(text, **tables)


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table lines, numbered once for all that is made of it, and dealt by turns: what is joined by turns moves as a few numbers, before labels and reasons are made of them."""
    return materialize(adapt(spark, sf_dir, "lines"), "lines").repartition("conversation_id", "turn_id")
