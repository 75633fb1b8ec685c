"""The registered queries of the reference's operators, over whole tables, and SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley import constants as C
from parley.functions import text as T
from parley.functions.tables import fresh_path, materialize, sliced, write_files
from parley.jobs import run_files
from parley.jobs.evaluate import evaluate, gate, merged_labels, turn_evaluations
from parley.operators import errors as E
from parley.operators import gates as G
from parley.operators import kb, report, scoring, traces, trajectory, turns
from parley.sources import documents
from parley.sources.adapters import SQL, adapt, numbered_lines
from parley.streaming.spans import TurnCalls, read_payload_stream
from parley.streaming.turns import EVENTS, FATES, collect_batch, collect_stream, run_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _with(*names: str, more: str = "") -> str:
    """A WITH clause of adapter tables, each named t_<name>."""
    return "WITH " + ", ".join(f"t_{n} AS ({SQL[n]})" for n in names) + (", " + more if more else "") + "\n"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


# turns

_TALK = """talk AS (SELECT * FROM t_messages WHERE role IN ('simulated_user', 'assistant')),
 lagged AS (SELECT *, lag(role) OVER w AS pr, lag(content) OVER w AS pc FROM talk WINDOW w AS (PARTITION BY conversation_id ORDER BY msg_pos)),
 pairs AS (SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY msg_pos) - 1 AS turn_id, pc AS user_msg, content AS assistant_msg FROM lagged WHERE role = 'assistant' AND pr = 'simulated_user')"""


@query("prj_1_assemble_turns", _with("messages", more=_TALK) + "SELECT * FROM pairs")
def _(spark, sf):
    return turns.assemble_turns(adapt(spark, sf, "messages"))


@query("prj_2_turn_counts", _with("messages", more=_TALK) + "SELECT c.conversation_id, count(p.turn_id) AS turns FROM (SELECT DISTINCT conversation_id FROM t_messages) c LEFT JOIN pairs p USING (conversation_id) GROUP BY 1")
def _(spark, sf):
    m = adapt(spark, sf, "messages")
    return turns.turn_counts(turns.assemble_turns(m), m.select("conversation_id").distinct())


_NUMBERED = "numbered AS (SELECT *, coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY msg_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS turn_id FROM t_messages)"


@query("prj_3_number_messages", _with("messages", more=_NUMBERED) + "SELECT conversation_id, msg_pos, turn_id FROM numbered")
def _(spark, sf):
    return turns.number_messages(adapt(spark, sf, "messages")).select("conversation_id", "msg_pos", "turn_id")


_STOPPED = "stopped AS (SELECT conversation_id, msg_pos, role, CASE WHEN msg_pos % 7 = 4 THEN concat(content, ' ###STOP###') ELSE content END AS content FROM t_messages)"


@query(
    "prj_4_truncate_at_stop",
    _with("messages", more=_STOPPED + """, marked AS (SELECT *, coalesce(max(CASE WHEN role = 'simulated_user' AND contains(content, '###STOP###') THEN 1 ELSE 0 END) OVER w, 0) AS stops,
 coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER w, 0)::INT AS turn_id FROM stopped WINDOW w AS (PARTITION BY conversation_id ORDER BY msg_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
    + "SELECT conversation_id, msg_pos, role, content, turn_id FROM marked WHERE stops = 0 AND turn_id < 3",
)
def _(spark, sf):
    m = adapt(spark, sf, "messages").withColumn("content", F.when(F.col("msg_pos") % 7 == 4, F.concat("content", F.lit(" ###STOP###"))).otherwise(F.col("content")))
    return turns.truncate_at_stop(m, 3)


_HISTORY = "SELECT p.conversation_id, p.turn_id, string_agg(concat('user: ', h.user_msg, chr(10), 'assistant: ', h.assistant_msg, chr(10)), '' ORDER BY h.turn_id) AS history FROM pairs p JOIN pairs h ON h.conversation_id = p.conversation_id AND h.turn_id <= p.turn_id GROUP BY 1, 2"


@query("prj_5_6_history_prefix", _with("messages", more=_TALK) + _HISTORY)
def _(spark, sf):
    t = turns.assemble_turns(adapt(spark, sf, "messages"))
    rows = t.join(turns.conversation_history(t), "conversation_id")
    return rows.select("conversation_id", "turn_id", T.format_history(turns.history_prefix(F.col("history"), F.col("turn_id"))).alias("history"))


@query(
    "prj_7_combine_knowledge",
    _with("messages", more="k AS (SELECT conversation_id, content, row_number() OVER (PARTITION BY conversation_id ORDER BY msg_pos) AS i FROM t_messages WHERE role = 'assistant')")
    + "SELECT conversation_id, string_agg(concat('Knowledge ', i, ':', chr(10), content), concat(chr(10), chr(10)) ORDER BY i) AS knowledge FROM k GROUP BY 1",
)
def _(spark, sf):
    said = adapt(spark, sf, "messages").where("role = 'assistant'").groupBy("conversation_id").agg(F.sort_array(F.collect_list(F.struct("msg_pos", "content"))).alias("k"))
    return said.select("conversation_id", T.combine_knowledge(F.transform("k", lambda x: x["content"])).alias("knowledge"))


@query("prj_8_9_judge_requests", _with("messages", more=_TALK + ", h AS (" + _HISTORY + ")") + """SELECT conversation_id, turn_id, m.metric, CASE m.metric WHEN 'coherence' THEN concat('Rate the talk.', chr(10), history) ELSE concat('Goal: find out', chr(10), history, '[]') END AS prompt
 FROM h CROSS JOIN (SELECT 'coherence' AS metric UNION ALL SELECT 'own_check') m""")  # fmt: skip
def _(spark, sf):
    m = adapt(spark, sf, "messages")
    metrics = spark.createDataFrame(
        [("coherence", "turn", "Rate the talk.\n{chat_history}"), ("relevance", "turn", "{user_goal}"), ("own_check", "turn", "Goal: {user_goal}\n{chat_history}{tool_calls}"), ("goal_completion", "conversation", "{chat_history}")], "name string, scope string, template string"
    )
    conversations = m.select("conversation_id").distinct().withColumns({"goal": F.lit("find out"), "knowledge": F.array().cast("array<string>")})
    return turns.select_metrics(turns.judge_requests(turns.assemble_turns(m), conversations, metrics), ["coherence"], ["own_check"])


@query("prj_10_conversation_requests", _with("messages", more=_TALK) + """SELECT c.conversation_id, 'goal_completion' AS metric, concat('Did it end well?', chr(10), coalesce(string_agg(concat('user: ', user_msg, chr(10), 'assistant: ', assistant_msg, chr(10)), '' ORDER BY turn_id) FILTER (turn_id IS NOT NULL), '')) AS prompt
 FROM (SELECT DISTINCT conversation_id FROM t_messages) c LEFT JOIN pairs USING (conversation_id) GROUP BY 1""")  # fmt: skip
def _(spark, sf):
    m = adapt(spark, sf, "messages")
    metrics = spark.createDataFrame([("goal_completion", "conversation", "Did it end well?\n{chat_history}")], "name string, scope string, template string")
    conversations = m.select("conversation_id").distinct().withColumns({"goal": F.lit(""), "knowledge": F.array().cast("array<string>")})
    return turns.conversation_requests(turns.assemble_turns(m), conversations, metrics)


@query(
    "prj_11_parse_verdicts",
    _with("lines") + "SELECT conversation_id, turn_id, CASE n % 2 WHEN 0 THEN 'verbosity' ELSE 'coherence' END AS metric, CAST(CASE n % 2 WHEN 0 THEN 6 - (1 + p % 5) ELSE 1 + p % 5 END AS DOUBLE) AS value, 'r' AS reason FROM t_lines WHERE s % 4 <> 0",
)
def _(spark, sf):
    lines = adapt(spark, sf, "lines")
    reply = F.when(F.col("s") % 4 == 0, "no json here").otherwise(F.concat(F.lit('{"score": '), (1 + F.col("p") % 5).cast("string"), F.lit(', "reason": "r"}')))
    quant, _, _ = turns.parse_verdicts(lines.select("conversation_id", "turn_id", F.when(F.col("n") % 2 == 0, "verbosity").otherwise("coherence").alias("metric"), reply.alias("response")))
    return quant


_REPLIES = "replies AS (SELECT conversation_id, turn_id, CASE n % 2 WHEN 0 THEN 'verbosity' ELSE 'coherence' END AS metric, s % 4 AS k, p FROM t_lines)"


def _replies(spark, sf):
    """Four kinds of reply: a score, a label with a reason, no JSON, and JSON without a verdict."""
    reply = F.when(F.col("s") % 4 == 0, F.concat(F.lit('{"score": '), (1 + F.col("p") % 5).cast("string"), F.lit("}"))).when(F.col("s") % 4 == 1, F.concat(F.lit('{"label": "l'), (F.col("p") % 3).cast("string"), F.lit('", "reason": "r"}')))
    reply = reply.when(F.col("s") % 4 == 2, "no json here").otherwise('{"reason": "none"}')
    return turns.parse_verdicts(adapt(spark, sf, "lines").select("conversation_id", "turn_id", F.when(F.col("n") % 2 == 0, "verbosity").otherwise("coherence").alias("metric"), reply.alias("response")))


@query(
    "prj_11_all_outcomes",
    _with("lines", more=_REPLIES) + """SELECT conversation_id, turn_id, metric, CASE k WHEN 0 THEN 'score' WHEN 1 THEN 'label' ELSE 'reject' END AS outcome,
 CASE k WHEN 0 THEN concat(CASE metric WHEN 'verbosity' THEN 6 - (1 + p % 5) ELSE 1 + p % 5 END, '.0') WHEN 1 THEN concat('l', p % 3) WHEN 2 THEN 'no json here' ELSE '{"reason": "none"}' END AS value, CASE k WHEN 0 THEN '' WHEN 1 THEN 'r' END AS reason FROM replies""",
)
def _(spark, sf):
    quant, qual, rejects = _replies(spark, sf)
    part = lambda df, kind, value, reason: df.select("conversation_id", "turn_id", "metric", F.lit(kind).alias("outcome"), F.col(value).cast("string").alias("value"), reason.alias("reason"))
    return part(quant, "score", "value", F.col("reason")).unionByName(part(qual, "label", "value", F.col("reason"))).unionByName(part(rejects, "reject", "response", F.lit(None).cast("string")))


@query("prj_12_recent_context", _with("messages") + """SELECT c.conversation_id, coalesce(string_agg(line, chr(10) ORDER BY msg_pos), '(just started)') AS context FROM (SELECT DISTINCT conversation_id FROM t_messages) c LEFT JOIN (
 SELECT conversation_id, msg_pos, concat(CASE role WHEN 'assistant' THEN 'AGENT' ELSE 'CUSTOMER' END, ': ', substr(content, 1, 200)) AS line, row_number() OVER (PARTITION BY conversation_id ORDER BY msg_pos DESC) AS back
   FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY msg_pos) AS nth FROM t_messages) WHERE nth > 1 AND role IN ('simulated_user', 'assistant')) l ON l.conversation_id = c.conversation_id AND back <= 6 GROUP BY 1""")  # fmt: skip
def _(spark, sf):
    return turns.recent_context(adapt(spark, sf, "messages"))


@query("prj_13_score_label", _with("quant") + "SELECT name, CASE WHEN value < 2 THEN 'Poor' WHEN value < 3 THEN 'Needs Improvement' WHEN value < 4 THEN 'Good' ELSE 'Excellent' END AS label, count(*) AS n FROM t_quant GROUP BY 1, 2")
def _(spark, sf):
    return adapt(spark, sf, "quant").groupBy("name", T.score_label(F.col("value")).alias("label")).agg(F.count("*").alias("n"))


@query(
    "prj_14_truncate_reason",
    _with("messages", more="w AS (SELECT conversation_id, msg_pos, list_filter(regexp_split_to_array(coalesce(content, ''), '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> '') AS ws FROM t_messages)")
    + "SELECT conversation_id, msg_pos, CASE WHEN len(ws) = 0 THEN '' WHEN len(ws) > 10 THEN concat(array_to_string(ws[1:10], ' '), '...') ELSE array_to_string(ws, ' ') END AS reason FROM w",
)
def _(spark, sf):
    return adapt(spark, sf, "messages").select("conversation_id", "msg_pos", T.truncate_reason(F.col("content")).alias("reason"))


# scores

_SCORED = "scored AS (SELECT conversation_id, turn_id, avg(value) AS turn_score, coalesce(bool_or(value < 0.6 * score_max), false) AS below FROM t_quant WHERE turn_id IS NOT NULL GROUP BY 1, 2)"
_EVALS = _SCORED + """, evals AS (SELECT t.conversation_id, t.turn_id, coalesce(turn_score, -1) AS turn_score, CASE WHEN below THEN label ELSE 'skipped_good_performance' END AS label,
 CASE WHEN below THEN reason ELSE 'Skipped: all turn metrics are at or above their thresholds.' END AS reason FROM t_turns t LEFT JOIN scored USING (conversation_id, turn_id) LEFT JOIN t_verdicts v USING (conversation_id, turn_id))"""
_RANK = "CASE {} WHEN 'unsafe action' THEN 0 WHEN 'unsafe state' THEN 0 WHEN 'false information' THEN 0 WHEN 'disobey user request' THEN 1 WHEN 'lack of specific information' THEN 2 WHEN 'failure to ask for clarification' THEN 2 WHEN 'repetition' THEN 3 ELSE 99 END"
_SKIP = "('skipped_good_performance', 'no failure')"
_MERGED = _EVALS + f""", both_ AS (SELECT e.*, v.label AS nl, v.reason AS nr, e.label IN {_SKIP} OR {_RANK.format('v.label')} < {_RANK.format('e.label')} AS take FROM evals e
 LEFT JOIN (SELECT * FROM t_tool_verdicts WHERE label NOT IN {_SKIP}) v USING (conversation_id, turn_id)),
 merged AS (SELECT conversation_id, turn_id, turn_score, CASE WHEN nl IS NOT NULL AND take THEN nl ELSE label END AS label, CASE WHEN nl IS NULL THEN reason WHEN take THEN nr ELSE concat(reason, chr(10), nr) END AS reason FROM both_)"""
_CONVO = _MERGED + f""", counts AS (SELECT conversation_id, count(*) AS turns FROM t_turns GROUP BY 1), fails AS (SELECT conversation_id, count(*) FILTER (label NOT IN {_SKIP}) AS failures FROM merged GROUP BY 1),
 g AS (SELECT conversation_id, min_by(value, pos) AS goal FROM t_goals GROUP BY 1),
 r AS (SELECT c.conversation_id, coalesce(counts.turns, 0) AS turns, coalesce(goal, -1) AS goal_completion_score, CASE WHEN coalesce(counts.turns, 0) > 0 THEN (counts.turns - coalesce(failures, 0)) / counts.turns ELSE 1.0::DOUBLE END AS turn_success_ratio
   FROM (SELECT DISTINCT conversation_id FROM t_conversations) c LEFT JOIN counts USING (conversation_id) LEFT JOIN fails USING (conversation_id) LEFT JOIN g USING (conversation_id)),
 r2 AS (SELECT *, CASE WHEN goal_completion_score < 0 THEN turn_success_ratio ELSE turn_success_ratio * 0.75::DOUBLE + goal_completion_score * 0.25::DOUBLE END AS overall_agent_score FROM r),
 convo AS (SELECT *, CASE WHEN overall_agent_score = 1.0 THEN 'Done' WHEN overall_agent_score >= 0.6 THEN 'Partial Failure' ELSE 'Failed' END AS evaluation_status FROM r2)"""
_ALL = ("turns", "quant", "verdicts", "tool_verdicts", "conversations", "goals")


@query("agg_1_2_turn_scores", _with("quant", more=_SCORED) + "SELECT * FROM scored")
def _(spark, sf):
    return scoring.turn_scores(adapt(spark, sf, "quant"))


@query("agg_3_turn_labels", _with("turns", "quant", "verdicts", more=_EVALS) + "SELECT * FROM evals")
def _(spark, sf):
    return turn_evaluations(spark, sf)


@query("agg_4_merge_failures", _with(*_ALL[:4], more=_MERGED) + "SELECT * FROM merged")
def _(spark, sf):
    return merged_labels(spark, sf)


@query("agg_5_success_ratio", _with(*_ALL, more=_CONVO) + "SELECT conversation_id, turns, turn_success_ratio FROM convo")
def _(spark, sf):
    return evaluate(spark, sf).select("conversation_id", "turns", "turn_success_ratio")


@query("agg_6_7_overall_and_status", _with(*_ALL, more=_CONVO) + "SELECT evaluation_status, count(*) AS n, min(overall_agent_score) AS lowest, max(overall_agent_score) AS highest FROM convo GROUP BY 1")
def _(spark, sf):
    return evaluate(spark, sf).groupBy("evaluation_status").agg(F.count("*").alias("n"), F.min("overall_agent_score").alias("lowest"), F.max("overall_agent_score").alias("highest"))


@query("agg_8_goal_scores", _with("goals") + "SELECT conversation_id, min_by(value, pos) AS goal_completion_score, min_by(reason, pos) AS goal_completion_reason FROM t_goals GROUP BY 1")
def _(spark, sf):
    return scoring.goal_scores(adapt(spark, sf, "goals"))


@query("agg_9_evaluate_conversations", _with(*_ALL, more=_CONVO) + "SELECT * FROM convo")
def _(spark, sf):
    return evaluate(spark, sf)


# gates

_NUMERIC = """th(metric, threshold) AS (VALUES ('overall_score', 0.5::DOUBLE), ('goal_completion', 1.0::DOUBLE), ('helpfulness', 3.0::DOUBLE), ('politeness', 2.0::DOUBLE), ('unknown', 1.0::DOUBLE)),
 measured AS (SELECT name AS metric, conversation_id, coalesce(min_by(CASE WHEN scope = 'conversation' THEN value END, CASE WHEN scope = 'conversation' THEN pos END), avg(CASE WHEN scope = 'turn' THEN value END)) AS score FROM t_quant WHERE value >= 0 GROUP BY 1, 2
   UNION ALL SELECT 'overall_score', conversation_id, overall_agent_score FROM convo UNION ALL SELECT 'goal_completion', conversation_id, goal_completion_score FROM convo WHERE goal_completion_score >= 0),
 numeric_ AS (SELECT metric, conversation_id, score, threshold FROM measured JOIN th USING (metric) WHERE score < threshold)"""
_LABELLED = """sets(metric, label) AS (VALUES ('tone', 'rude'), ('outcome', 'lost'), ('agent_behavior_failure', 'unsafe action'), ('agent_behavior_failure', 'false information')),
 labels_ AS (SELECT name AS metric, conversation_id, 'conversation' AS place, value AS label FROM t_qual WHERE scope = 'conversation'
   UNION ALL SELECT 'agent_behavior_failure', conversation_id, turn_id::VARCHAR, label FROM merged
   UNION ALL SELECT name, conversation_id, turn_id::VARCHAR, min_by(value, pos) FROM t_qual WHERE scope = 'turn' AND name <> 'agent_behavior_failure' GROUP BY name, conversation_id, turn_id),
 label_ AS (SELECT metric, conversation_id, place, label FROM labels_ SEMI JOIN sets USING (metric, label) WHERE label NOT IN ('skipped_good_performance', 'evaluation_run_failed', 'agent_api_error'))"""


@query("gate_1_numeric", _with(*_ALL, more=_CONVO + ", " + _NUMERIC) + "SELECT * FROM numeric_")
def _(spark, sf):
    return gate(spark, sf)[0]


@query("gate_2_labels", _with(*_ALL, "qual", more=_CONVO + ", " + _LABELLED) + "SELECT * FROM label_")
def _(spark, sf):
    return gate(spark, sf)[1]


@query("gate_3_report", _with(*_ALL, "qual", more=_CONVO + ", " + _NUMERIC + ", " + _LABELLED) + "SELECT (SELECT count(*) FROM numeric_) AS numeric_failures, (SELECT count(*) FROM label_) AS label_failures, (SELECT count(*) FROM numeric_) = 0 AND (SELECT count(*) FROM label_) = 0 AS passed")
def _(spark, sf):
    return G.gate_report(*gate(spark, sf))


# errors

_REAL = "('false information', 'disobey user request', 'lack of specific information', 'failure to ask for clarification', 'repetition', 'unsafe action', 'unsafe state')"
_ERRORS = _MERGED + f""", items AS (SELECT *, substr(sha256(concat(label, chr(10), regexp_replace(trim(regexp_replace(lower(reason), '\\s+', ' ', 'g')), '[0-9]+', '#', 'g'))), 1, 16) AS unique_error_id FROM merged WHERE label IN {_REAL}),
 errors AS (SELECT unique_error_id, label AS category, arg_min(reason, (conversation_id, turn_id)) AS description, count(*) AS n_occurrences,
   CASE WHEN label IN ('unsafe action', 'unsafe state', 'false information') THEN 'critical' WHEN label = 'disobey user request' THEN 'high' WHEN label = 'repetition' THEN 'low' ELSE 'medium' END AS severity FROM items GROUP BY 1, 2),
 occ AS (SELECT unique_error_id, conversation_id, turn_id FROM items)"""
_ORDER = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, n_occurrences DESC, unique_error_id"
_MAPPED = _ERRORS + f""", ids AS (SELECT unique_error_id, list_sort(list(DISTINCT scenario_id)) AS scenario_ids FROM occ JOIN t_conversations USING (conversation_id) JOIN t_scenarios USING (scenario_id) GROUP BY 1),
 mapped AS (SELECT row_number() OVER (ORDER BY {_ORDER}) AS error_index, unique_error_id, description, severity, n_occurrences, scenario_ids FROM errors JOIN ids USING (unique_error_id))"""


def _errors(spark, sf, labels=None):
    errors, occurrences = E.group_failures(merged_labels(spark, sf) if labels is None else labels)
    return materialize(errors, "errors"), materialize(occurrences, "occurrences")


def _mappings(spark, sf):
    errors, occurrences = _errors(spark, sf)
    return E.error_scenario_mappings(errors, occurrences, adapt(spark, sf, "conversations"), adapt(spark, sf, "scenarios"))


@query("err_1_failure_items", _with(*_ALL[:4], more=_MERGED) + f"SELECT conversation_id, turn_id, label, reason, concat('Item ', conversation_id, '_', turn_id, ': agent_behavior_failure label and reason: ', label, ': ', reason) AS item FROM merged WHERE label IN {_REAL}")
def _(spark, sf):
    return E.failure_items(merged_labels(spark, sf))


@query("err_2_parse_occurrences", _with("lines") + "SELECT concat('e', p % 50) AS unique_error_id, concat('run_', conversation_id) AS conversation_id, turn_id::INT AS turn_id FROM t_lines WHERE s % 5 <> 0")
def _(spark, sf):
    text = F.concat(F.lit("run_"), F.col("conversation_id").cast("string"), F.lit("_"), F.when(F.col("s") % 5 == 0, "last").otherwise(F.col("turn_id").cast("string")))
    return E.parse_occurrences(adapt(spark, sf, "lines").select(F.concat(F.lit("e"), (F.col("p") % 50).cast("string")).alias("unique_error_id"), F.array(text).alias("occurrences")))


@query("err_3_4_group_failures", _with(*_ALL[:4], more=_ERRORS) + "SELECT * FROM errors")
def _(spark, sf):
    return _errors(spark, sf)[0]


#: Reasons of a failed line: one of 40 rare names, and one of five wordings of what happened, two of which share few words with the others.
_WORDINGS = ["told a wrong price for item", "told the wrong price for the item", "gave a wrong price for item", "could not find any open order of", "repeated what was said about"]
_REWORDED = _MERGED + f""", named AS (SELECT m.conversation_id, m.turn_id, m.label, concat({_WORDINGS!r}[(l.p % 5 + 1)::INT], ' name', chr((97 + l.s % 40 // 8)::INT), chr((97 + l.s % 8)::INT)) AS reason FROM merged m JOIN t_lines l USING (conversation_id, turn_id) WHERE m.label IN {_REAL}),
 exact AS (SELECT label, reason, count(*) AS n, substr(sha256(concat(label, chr(10), reason)), 1, 16) AS id FROM named GROUP BY 1, 2),
 w AS (SELECT DISTINCT label, id, unnest(string_split(reason, ' ')) AS word FROM exact), tot AS (SELECT label, count(*) AS reasons FROM exact GROUP BY 1),
 wt AS (SELECT label, word, ln(1 + reasons / count(*)) AS weight FROM w JOIN tot USING (label) GROUP BY label, word, reasons), s AS (SELECT id, sum(weight) AS total FROM w JOIN wt USING (label, word) GROUP BY 1),
 o AS (SELECT x.id AS a, y.id AS b, sum(weight) AS common FROM w x JOIN w y USING (label, word) JOIN wt USING (label, word) WHERE x.id < y.id GROUP BY 1, 2),
 e AS (SELECT a, b FROM o JOIN s sa ON sa.id = a JOIN s sb ON sb.id = b WHERE common / (sa.total + sb.total - common) >= 0.6 - 1e-9), ee AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 reach(node, seen) AS (SELECT id, id FROM exact UNION SELECT reach.node, ee.b FROM reach JOIN ee ON ee.a = reach.seen), grp AS (SELECT node AS id, min(seen) AS grp FROM reach GROUP BY 1)"""


def _reworded(spark, sf):
    lines = adapt(spark, sf, "lines")
    wording = F.get(F.array(*[F.lit(x) for x in _WORDINGS]), (F.col("p") % 5).cast("int"))
    letter = lambda n: F.char(97 + n)
    reason = F.concat(wording, F.lit(" name"), letter(F.floor(F.col("s") % 40 / 8)), letter(F.col("s") % 8))
    return merged_labels(spark, sf).drop("reason").join(lines.select("conversation_id", "turn_id", reason.alias("reason")), ["conversation_id", "turn_id"])


@query("err_4_root_causes", _with(*_ALL[:4], "lines", more=_REWORDED).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT label AS category, arg_min(id, (-n, id)) AS unique_error_id, arg_min(reason, (-n, id)) AS description, sum(n)::BIGINT AS n_occurrences, count(*) AS n_reasons FROM exact JOIN grp USING (id) GROUP BY label, grp")
def _(spark, sf):
    """Reasons in several wordings: those of one name that share most of their weight are one error."""
    return E.root_causes(_reworded(spark, sf))[0].select("category", "unique_error_id", "description", "n_occurrences", "n_reasons")


@query("err_5_link_errors", _with(*_ALL[:4], more=_ERRORS) + "SELECT m.conversation_id, m.turn_id, coalesce(string_agg(DISTINCT unique_error_id, ',' ORDER BY unique_error_id), '') AS ids FROM merged m LEFT JOIN occ USING (conversation_id, turn_id) GROUP BY 1, 2")
def _(spark, sf):
    labels = merged_labels(spark, sf)
    return E.link_errors(labels, _errors(spark, sf, labels)[1]).select("conversation_id", "turn_id", F.array_join("unique_error_ids", ",").alias("ids"))


@query("err_6_scenario_mappings", _with(*_ALL, "scenarios", more=_MAPPED) + "SELECT error_index::INT AS error_index, unique_error_id, description, severity, n_occurrences, unnest(scenario_ids) AS scenario_id FROM mapped")
def _(spark, sf):
    return _mappings(spark, sf).select("error_index", "unique_error_id", "description", "severity", "n_occurrences", "scenario_id")


@query(
    "err_7_focus_sets",
    _with(*_ALL, "scenarios", more=_MAPPED + ", one AS (SELECT concat('error_', error_index) AS focus_set, unnest(scenario_ids) AS scenario_id FROM mapped), every_ AS (SELECT * FROM one UNION ALL SELECT DISTINCT 'all_failures', scenario_id FROM one)")
    + "SELECT focus_set, scenario_id, goal, user_profile FROM every_ JOIN t_scenarios USING (scenario_id)",
)
def _(spark, sf):
    return E.focus_sets(_mappings(spark, sf), adapt(spark, sf, "scenarios")).select("focus_set", "scenario_id", "goal", "user_profile")


@query(
    "err_8_top_errors",
    _with(*_ALL, more=_ERRORS + f", best AS (SELECT * FROM errors ORDER BY {_ORDER} LIMIT 5)")
    + "SELECT unique_error_id, category, severity, n_occurrences, count(DISTINCT conversation_id) AS conversations, count(DISTINCT scenario_id) AS scenarios FROM best JOIN occ USING (unique_error_id) LEFT JOIN t_conversations USING (conversation_id) GROUP BY 1, 2, 3, 4",
)
def _(spark, sf):
    errors, occurrences = _errors(spark, sf)
    return E.top_errors(errors, occurrences, adapt(spark, sf, "conversations"))


_GOLD = "gold AS (SELECT conversation_id, turn_id AS pos, CASE WHEN (p + s) % 3 = 0 THEN v.label ELSE 'no failure' END AS label FROM t_lines JOIN t_verdicts v USING (conversation_id, turn_id)), want AS (SELECT conversation_id, coalesce(arg_min(label, pos) FILTER (label <> 'no failure'), 'no failure') AS expected FROM gold GROUP BY 1)"


@query(
    "err_9_judge_agreement",
    _with(*_ALL[:4], "lines", more=_MERGED + ", " + _GOLD + ", have AS (SELECT conversation_id, list(DISTINCT label) AS labels FROM merged GROUP BY 1)")
    + """SELECT expected, count(*) AS conversations, count(*) FILTER (ok) AS agreed, count(*) FILTER (ok) / count(*) AS rate FROM (SELECT expected, CASE WHEN expected = 'no failure'
 THEN NOT list_has_any(labels, ['false information', 'disobey user request', 'lack of specific information', 'failure to ask for clarification', 'repetition']) ELSE list_contains(labels, expected) END AS ok FROM want JOIN have USING (conversation_id)) GROUP BY 1""",
)
def _(spark, sf):
    numbers = numbered_lines(spark, sf)
    lines = adapt(spark, sf, "lines", numbers).join(adapt(spark, sf, "verdicts", numbers), ["conversation_id", "turn_id"])
    gold = lines.select("conversation_id", F.col("turn_id").alias("pos"), F.when((F.col("p") + F.col("s")) % 3 == 0, F.col("label")).otherwise(C.NO_FAILURE).alias("label"))
    return E.judge_agreement(merged_labels(spark, sf, numbers), gold)


# report

_SYSTEM = "('skipped_good_performance', 'evaluation_run_failed', 'agent_api_error')"


@query("rpt_1_run_totals", _with(*_ALL, more=_CONVO) + "SELECT count(*) AS conversations, sum(turns)::BIGINT AS turns, sum(turns) / count(*) AS avg_turns FROM convo")
def _(spark, sf):
    return report.run_totals(evaluate(spark, sf))


@query("rpt_2_metric_averages", _with("quant") + "SELECT name, scope, avg(value) AS average FROM t_quant GROUP BY 1, 2")
def _(spark, sf):
    return report.metric_averages(adapt(spark, sf, "quant"))


@query(
    "rpt_3_performance_metrics",
    _with("quant", more="m AS (SELECT name, avg(value) AS average FROM t_quant WHERE value <> -1 GROUP BY 1)")
    + "SELECT name, concat(upper(name[1]), name[2:]) AS title, average, CASE name WHEN 'politeness' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS low, CASE name WHEN 'politeness' THEN 10.0::DOUBLE ELSE 5.0::DOUBLE END AS high FROM m WHERE EXISTS (SELECT 1 FROM m WHERE name = 'helpfulness')",
)
def _(spark, sf):
    return report.performance_metrics(adapt(spark, sf, "quant"), spark.createDataFrame([("politeness", 0.0, 10.0)], "name string, low double, high double"))


@query(
    "rpt_4_overall_average",
    _with("quant", more="m AS (SELECT name, avg(value) AS m FROM t_quant WHERE name <> 'politeness' GROUP BY 1), a AS (SELECT avg(m) AS overall_average FROM m)")
    + "SELECT overall_average, CASE WHEN overall_average < 2 THEN 'Poor' WHEN overall_average < 3 THEN 'Needs Improvement' WHEN overall_average < 4 THEN 'Good' ELSE 'Excellent' END AS label FROM a",
)
def _(spark, sf):
    return report.overall_average(adapt(spark, sf, "quant"))


@query("rpt_5_failure_breakdown", _with(*_ALL[:4], more=_MERGED) + f"SELECT label, count(*) AS n, count(*) / sum(count(*)) OVER () * 100 AS share FROM merged WHERE label NOT IN {_SYSTEM} GROUP BY 1")
def _(spark, sf):
    return report.failure_breakdown(merged_labels(spark, sf))


@query("rpt_6_failure_distribution", _with(*_ALL[:4], more=_MERGED) + f"SELECT label, count(*) AS n, count(*) / sum(count(*)) OVER () * 100 AS share FROM merged WHERE label NOT IN {_SYSTEM} AND label <> 'no failure' GROUP BY 1")
def _(spark, sf):
    return report.failure_distribution(merged_labels(spark, sf))


@query(
    "rpt_7_label_distributions",
    _with(*_ALL[:4], "qual", more=_MERGED + f", every_ AS (SELECT name, value AS label FROM t_qual UNION ALL SELECT 'agent_behavior_failure', label FROM merged WHERE label NOT IN {_SYSTEM} AND label <> 'no failure' AND NOT EXISTS (SELECT 1 FROM t_qual WHERE name = 'agent_behavior_failure'))")
    + "SELECT name, label, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY name) * 100 AS share FROM every_ GROUP BY 1, 2",
)
def _(spark, sf):
    return report.label_distributions(adapt(spark, sf, "qual"), merged_labels(spark, sf))


@query("rpt_8_conversation_labels", _with("conversations") + "SELECT conversation_id, concat('Conversation ', row_number() OVER (ORDER BY conversation_id)) AS label FROM (SELECT DISTINCT conversation_id FROM t_conversations)")
def _(spark, sf):
    return report.conversation_labels(adapt(spark, sf, "conversations"))


@query("rpt_9_turn_issues", _with(*_ALL[:4], more=_MERGED + """, low AS (SELECT conversation_id, turn_id, string_agg(concat(name, ' (', printf('%.1f', value), ')'), '; ' ORDER BY name) AS low FROM t_quant WHERE scope = 'turn' AND value <= 1 GROUP BY 1, 2),
 w AS (SELECT *, list_filter(regexp_split_to_array(reason, '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> '') AS ws FROM merged)""") + f"""SELECT conversation_id, turn_id, coalesce(nullif(concat_ws('; ', CASE WHEN label IN {_REAL} THEN concat(label, ': ', array_to_string(ws[1:10], ' '), CASE WHEN len(ws) > 10 THEN '...' ELSE '' END) END, low), ''), 'No issues detected') AS issues FROM w LEFT JOIN low USING (conversation_id, turn_id)""")
def _(spark, sf):
    lines = numbered_lines(spark, sf)
    return report.turn_issues(merged_labels(spark, sf, lines), adapt(spark, sf, "quant", lines))


@query(
    "rpt_10_convo_rows",
    _with(*_ALL, "scenarios", more=_CONVO)
    + "SELECT convo.conversation_id, turns, goal_completion_score, turn_success_ratio, overall_agent_score, evaluation_status, coalesce(k.scenario_id::VARCHAR, '') AS scenario_id, coalesce(goal, '') AS goal, coalesce(user_profile, '') AS user_profile FROM convo LEFT JOIN t_conversations k USING (conversation_id) LEFT JOIN t_scenarios s ON s.scenario_id = k.scenario_id",
)
def _(spark, sf):
    return report.convo_rows(evaluate(spark, sf), adapt(spark, sf, "conversations"), adapt(spark, sf, "scenarios"))


@query(
    "rpt_11_turn_rows",
    _with(*_ALL[:4], more=_MERGED) + "SELECT m.conversation_id, m.turn_id, label, (SELECT 1) * coalesce(q.n, 0) AS n_scores, coalesce(q.names, '') AS names FROM merged m LEFT JOIN (SELECT conversation_id, turn_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM t_quant WHERE scope = 'turn' GROUP BY 1, 2) q USING (conversation_id, turn_id)",
)
def _(spark, sf):
    lines = numbered_lines(spark, sf)
    rows = report.turn_rows(merged_labels(spark, sf, lines), adapt(spark, sf, "quant", lines))
    return rows.select("conversation_id", "turn_id", "label", F.size("scores").cast("long").alias("n_scores"), F.array_join(F.transform("scores", lambda s: s["name"]), ",").alias("names"))


@query(
    "rpt_12_error_snippets",
    _with("messages", more=_NUMBERED + ", o AS (SELECT conversation_id, turn_id FROM numbered WHERE role = 'assistant'), w AS (SELECT conversation_id, turn_id, arg_max(content, msg_pos) FILTER (role = 'simulated_user') AS u, arg_max(content, msg_pos) FILTER (role = 'assistant') AS a FROM numbered GROUP BY 1, 2)")
    + "SELECT 'e' AS unique_error_id, conversation_id, turn_id, coalesce(u, '') AS user_msg, coalesce(a, '') AS assistant_msg, 'repetition' AS label FROM o JOIN w USING (conversation_id, turn_id)",
)
def _(spark, sf):
    m = adapt(spark, sf, "messages")
    at = turns.number_messages(m).where("role = 'assistant'").select(F.lit("e").alias("unique_error_id"), "conversation_id", "turn_id")
    return report.error_snippets(at, m, at.select("conversation_id", "turn_id", F.lit("repetition").alias("label")))


@query("rpt_12_error_rows", _with(*_ALL[:4], more=_ERRORS + ", t AS (SELECT unique_error_id, conversation_id, string_agg(concat('turn_', turn_id), ',' ORDER BY turn_id) AS turns FROM (SELECT DISTINCT * FROM occ) GROUP BY 1, 2)") + "SELECT unique_error_id, category, n_occurrences, conversation_id, turns FROM errors JOIN t USING (unique_error_id)")
def _(spark, sf):
    rows = report.error_rows(*_errors(spark, sf))
    return rows.select("unique_error_id", "category", "n_occurrences", "conversation_id", F.array_join("turns", ",").alias("turns"))


@query("rpt_12_error_scenarios", _with(*_ALL, "scenarios", more=_MAPPED) + "SELECT unique_error_id, count(*) AS scenarios, min(scenario_id) AS first_scenario FROM (SELECT unique_error_id, unnest(scenario_ids) AS scenario_id FROM mapped) GROUP BY 1")
def _(spark, sf):
    pairs = E.error_scenarios(_errors(spark, sf)[1], adapt(spark, sf, "conversations"), adapt(spark, sf, "scenarios"))
    return pairs.groupBy("unique_error_id").agg(F.count("*").alias("scenarios"), F.min("scenario_id").alias("first_scenario"))


@query("rpt_13_kpi", _with(*_ALL, more=_CONVO) + "SELECT avg(overall_agent_score) AS mean_score, avg(CASE WHEN evaluation_status = 'Done' THEN 1.0::DOUBLE ELSE 0 END) AS pass_rate, avg(turns) AS avg_turns, count(*) AS conversations FROM convo")
def _(spark, sf):
    return report.kpi(evaluate(spark, sf))


# tool calls

_SPLIT = """explicit_ AS (SELECT * FROM t_calls WHERE event_id % 3 <> 0), traced_ AS (SELECT conversation_id, turn_id, call_pos, CASE WHEN event_id % 2 = 0 THEN id ELSE concat('t', id) END AS id, name, arguments FROM t_calls WHERE event_id % 3 <> 1)"""


def _split_calls(spark, sf):
    calls = adapt(spark, sf, "calls")
    explicit, traced = calls.where("event_id % 3 <> 0"), calls.where("event_id % 3 <> 1")
    return documents.canonical_arguments(explicit.drop("event_id")), documents.canonical_arguments(traced.withColumn("id", F.when(F.col("event_id") % 2 == 0, F.col("id")).otherwise(F.concat(F.lit("t"), "id"))).drop("event_id"))


def _payloads(spark, sf, half: int | None = None):
    """Calls as span payloads, one for each turn, in both spellings; half: only the calls at even or odd places."""
    calls = adapt(spark, sf, "calls") if half is None else adapt(spark, sf, "calls").where(F.col("call_pos") % 2 == half)
    camel = F.col("turn_id") % 2 == 0
    attr = lambda k, kind, v: F.concat(F.lit(f'{{"key":"{k}","value":{{"{kind}":'), v, F.lit("}}"))
    args = F.regexp_replace(F.to_json(F.struct(F.coalesce("arguments", F.lit("{}")).alias("x"))), r'^\{"x":(.*)\}$', "$1")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    attributes = F.concat_ws(",", attr("gen_ai.tool.call.arguments", "stringValue", args), attr("tool_call.id", "string_value", quoted(F.col("id"))), attr("eval.turn_id", "intValue", quoted(F.col("turn_id").cast("string"))))
    span = F.concat(F.lit('{"name":"execute_tool '), "name", F.lit('","spanId":"s'), "id", F.lit('","attributes":['), attributes, F.lit("]}"))
    spans = calls.groupBy("conversation_id", "turn_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("call_pos", span.alias("s")))), lambda x: x["s"]), ",").alias("s"))
    head = F.concat(F.lit('[{"resource":{"attributes":['), attr("eval.conversation_id", "stringValue", quoted(F.col("conversation_id").cast("string"))), F.lit("]},"))
    one = F.when(camel, F.concat(F.lit('{"resourceSpans":'), head, F.lit('"scopeSpans":[{"spans":['))).otherwise(F.concat(F.lit('{"resource_spans":'), head, F.lit('"scope_spans":[{"spans":[')))
    return spans.select(F.concat(one, "s", F.lit("]}]}]}")).alias("payload"))


@query("src_4_trc_1_2_3_span_calls", _with("calls") + "SELECT conversation_id::VARCHAR AS conversation_id, turn_id::INT AS turn_id, id, name, coalesce(arguments, '{}')::JSON::VARCHAR AS arguments, 'otel_trace' AS source FROM (SELECT * REPLACE (replace(arguments, ' ', '') AS arguments) FROM t_calls)")
def _(spark, sf):
    return traces.spans_to_tool_calls(traces.route_spans(documents.parse_otlp(_payloads(spark, sf)))).select("conversation_id", "turn_id", "id", "name", "arguments", "source")


@query("str_1_stream_tool_calls", _with("calls") + "SELECT conversation_id::VARCHAR AS conversation_id, turn_id::INT AS turn_id, count(*) AS calls, string_agg(id, ',' ORDER BY id) AS ids FROM t_calls GROUP BY 1, 2")
def _(spark, sf):
    """Payloads in files, those of a turn in two of them, accumulated by a stream into one row for each turn; the first batches come twice."""
    source, table = fresh_path(spark, "payloads"), TurnCalls(spark, fresh_path(spark, "turn-calls"), buckets=8)
    for half in (0, 1):
        _payloads(spark, sf, half).coalesce(2).write.mode("append").text(source)
    stream = read_payload_stream(spark, source, wholetext=False, maxFilesPerTrigger=2)
    for _ in range(2):  # the second query has no checkpoint, so it replays all batches
        table.run(stream, fresh_path(spark, "stream")).awaitTermination()
    return table.read().select("conversation_id", "turn_id", F.size("calls").cast("long").alias("calls"), F.array_join(F.sort_array(F.transform("calls", lambda c: c["id"])), ",").alias("ids"))


@query("trc_4_parse_arguments", _with("calls") + "SELECT id, CASE WHEN event_id % 3 = 0 THEN '{}' ELSE replace(arguments, ' ', '') END AS arguments FROM t_calls")
def _(spark, sf):
    raw = F.when(F.col("event_id") % 6 == 0, "[1]").when(F.col("event_id") % 6 == 3, "not json").otherwise(F.col("arguments"))
    return adapt(spark, sf, "calls").select("id", T.parse_arguments(raw).alias("arguments"))


@query("trc_5_pair_outputs", _with("calls", more="o AS (SELECT conversation_id, id, max(event_id) AS e FROM (SELECT conversation_id, id, event_id FROM t_calls WHERE event_id % 4 <> 0) GROUP BY 1, 2)") + "SELECT c.conversation_id, c.id AS call_id, c.name, concat('out ', o.e + 1) AS result FROM (SELECT * FROM t_calls) c JOIN o USING (conversation_id, id) UNION ALL SELECT conversation_id, id, name, NULL FROM t_calls WHERE event_id % 4 = 0")
def _(spark, sf):
    calls = adapt(spark, sf, "calls")
    none = F.lit(None).cast("string")
    items = calls.select("conversation_id", F.lit("call").alias("kind"), F.col("id").alias("call_id"), (F.col("event_id") * 10).alias("pos"), "name", "arguments", none.alias("output"))
    for k in (0, 1):
        items = items.unionByName(calls.where("event_id % 4 <> 0").select("conversation_id", F.lit("output").alias("kind"), F.col("id").alias("call_id"), (F.col("event_id") * 10 + 1 + k).alias("pos"), none.alias("name"), none.alias("arguments"), F.concat(F.lit("out "), (F.col("event_id") + k).cast("string")).alias("output")))
    return traces.pair_outputs(items).select("conversation_id", "call_id", "name", "result")


@query("trc_6_artifact_calls", _with("calls") + "SELECT id, name, CASE WHEN event_id % 5 = 1 THEN '{}' ELSE replace(arguments, ' ', '') END AS arguments, concat('{\"n\":', event_id, '}') AS result FROM t_calls WHERE event_id % 4 <> 0 AND event_id % 5 <> 2")
def _(spark, sf):
    uri = "urn:tool-calls/v1"
    name = F.when(F.col("event_id") % 5 == 2, '""').otherwise(F.concat(F.lit('"'), "name", F.lit('"')))
    args = F.when(F.col("event_id") % 5 == 1, "").otherwise(F.concat(F.lit(',"arguments":'), "arguments"))
    entry = F.concat(F.lit('{"id":"'), "id", F.lit('","name":'), name, args, F.lit(',"result":{"n":'), F.col("event_id").cast("string"), F.lit("}}"))
    rows = adapt(spark, sf, "calls").select("conversation_id", F.array(F.when(F.col("event_id") % 4 == 0, "urn:other").otherwise(uri)).alias("extensions"), F.concat(F.lit(f'{{"{uri}/tool_calls":['), entry, F.lit("]}")).alias("metadata"))
    return traces.artifact_calls(rows, uri).select("id", "name", "arguments", "result")


@query(
    "trc_7_fold_events",
    _with("calls", more="""e AS (SELECT conversation_id, turn_id, call_pos AS seq, name AS t, event_id, CASE event_id % 4 WHEN 0 THEN 'task' WHEN 1 THEN 'message' WHEN 2 THEN 'artifact_update' ELSE 'status_update' END AS kind FROM t_calls),
 f AS (SELECT *, sum(CASE WHEN kind = 'task' THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id, turn_id ORDER BY seq) AS ep FROM e), l AS (SELECT *, max(ep) OVER (PARTITION BY conversation_id, turn_id) AS last FROM f)""")
    + """SELECT conversation_id, turn_id, coalesce(string_agg(t, chr(10) ORDER BY seq) FILTER (ep = last AND kind = 'artifact_update'), max(concat('status ', event_id)) FILTER (ep = last AND kind = 'task'), arg_max(concat('said ', t), seq) FILTER (kind = 'message'), '') AS text FROM l GROUP BY 1, 2""",
)
def _(spark, sf):
    kind = F.get(F.array(*[F.lit(k) for k in ("task", "message", "artifact_update", "status_update")]), (F.col("event_id") % 4).cast("int"))
    calls = adapt(spark, sf, "calls").withColumn("kind", kind)
    artifacts = F.when(F.col("kind") == "artifact_update", F.array(F.struct(F.array(F.lit("x")).alias("extensions"), F.col("name").alias("text"), F.lit("{}").alias("metadata"))))
    return traces.fold_events(calls.select("conversation_id", "turn_id", F.col("call_pos").alias("seq"), "kind", F.concat(F.lit("said "), "name").alias("text"), F.concat(F.lit("status "), F.col("event_id").cast("string")).alias("status_text"), artifacts.alias("artifacts")))


@query(
    "trc_8_merge_tool_calls",
    _with("calls", more=_SPLIT + """, new_ AS (SELECT * FROM traced_ t WHERE NOT EXISTS (SELECT 1 FROM explicit_ e WHERE e.conversation_id = t.conversation_id AND e.turn_id = t.turn_id AND (e.id = t.id OR (e.name = t.name AND replace(e.arguments, ' ', '') = replace(t.arguments, ' ', ''))))),
 all_ AS (SELECT conversation_id, turn_id, call_pos, id, name, arguments, 0 AS part FROM explicit_ UNION ALL SELECT conversation_id, turn_id, call_pos, id, name, arguments, 1 FROM new_)""")
    + "SELECT conversation_id, turn_id, row_number() OVER (PARTITION BY conversation_id, turn_id ORDER BY part, call_pos, id) - 1 AS call_pos, id, name, replace(arguments, ' ', '') AS arguments, CASE part WHEN 0 THEN 'explicit' ELSE 'traced' END AS origin FROM all_",
)
def _(spark, sf):
    return traces.merge_tool_calls(*_split_calls(spark, sf))


@query("src_3_clean_tool_calls", _with("calls") + "SELECT id, name, CASE event_id % 3 WHEN 0 THEN 'otel_trace' WHEN 1 THEN 'a2a_protocol' END AS source FROM t_calls WHERE event_id % 7 <> 0")
def _(spark, sf):
    source = F.get(F.array(F.lit("otel_trace"), F.lit("a2a_protocol"), F.lit("carrier pigeon")), (F.col("event_id") % 3).cast("int"))
    calls = adapt(spark, sf, "calls").withColumn("source", source).withColumn("id", F.when(F.col("event_id") % 7 != 0, F.col("id")))
    return traces.clean_tool_calls(calls).select("id", "name", "source")


@query("src_5_normalize_responses", _with("calls") + "SELECT id, CASE event_id % 4 WHEN 3 THEN NULL ELSE name END AS text, CASE event_id % 4 WHEN 3 THEN 'unknown response format' END AS error FROM t_calls")
def _(spark, sf):
    j = lambda a, b: F.concat(F.lit(a), "name", F.lit(b))
    raw = (
        F.when(F.col("event_id") % 4 == 0, j('{"choices":[{"message":{"content":"', '"}}]}'))
        .when(F.col("event_id") % 4 == 1, j('{"content":[{"type":"thinking"},{"type":"text","text":"', '"}]}'))
        .when(F.col("event_id") % 4 == 2, j('{"candidates":[{"content":{"parts":[{"text":"', '"}]}}]}'))
        .otherwise(j('{"reply":"', '"}'))
    )
    return documents.normalize_responses(adapt(spark, sf, "calls").select("id", raw.alias("raw"))).select("id", "text", "error")


# trajectories


def _trajectories(spark, sf):
    """All calls of each user against a list that its number picks; each fourth user has another mode."""
    calls = adapt(spark, sf, "calls")
    wanted = F.transform(F.array(F.lit("click"), F.lit("view"), F.lit("purchase")), lambda n: F.struct(n.alias("name"), F.lit("{}").alias("arguments"), F.lit("ignore").alias("arg_match_mode")))
    mode = F.get(F.array(*[F.lit(m) for m in ("unordered", "contains", "within", "strict")]), F.pmod("conversation_id", F.lit(4)).cast("int"))
    return trajectory.actual_calls(calls).withColumns({"expected": wanted, "match_mode": mode})


_TRJ = """act AS (SELECT conversation_id, list(name ORDER BY turn_id, call_pos) AS a, ['click', 'view', 'purchase'] AS e, ['unordered', 'contains', 'within', 'strict'][(conversation_id % 4 + 1)::INT] AS mode FROM t_calls GROUP BY 1),
 d AS (SELECT *, list_filter(e, lambda x: NOT list_contains(a, x)) AS missing,
   list_filter(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN NOT list_contains(e, a[i]) OR list_contains(a[1:i - 1], a[i]) THEN a[i] END), lambda x: x IS NOT NULL) AS extra, list_filter(a, lambda x: NOT list_contains(e, x)) AS beyond FROM act),
 g AS (SELECT *, CASE WHEN mode = 'within' THEN CASE WHEN len(beyond) > 0 THEN 'disobey user request' END
   WHEN mode = 'strict' AND len(a) = 3 THEN CASE WHEN a <> e THEN 'disobey user request' END
   WHEN mode = 'contains' THEN CASE WHEN len(missing) > 0 THEN 'disobey user request' END
   WHEN len(missing) > 0 THEN 'disobey user request' WHEN len(extra) > 0 THEN CASE WHEN len(beyond) > 0 THEN 'disobey user request' ELSE 'repetition' END END AS failure_label FROM d)"""


@query(
    "trj_1_8_match_trajectories",
    _with("calls", more=_TRJ) + """SELECT conversation_id, mode AS match_mode, failure_label IS NULL AS matched, failure_label, CASE WHEN mode = 'within' OR (mode = 'strict' AND len(a) = 3) THEN '' ELSE array_to_string(missing, ',') END AS missing,
 CASE WHEN mode = 'within' THEN array_to_string(beyond, ',') WHEN mode = 'contains' OR (mode = 'strict' AND len(a) = 3) THEN '' ELSE array_to_string(extra, ',') END AS extra FROM g""",
)
def _(spark, sf):
    rows = trajectory.match_trajectories(_trajectories(spark, sf))
    return rows.select("conversation_id", "match_mode", "matched", "failure_label", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"))


@query(
    "trj_2_long_conversations",
    _with("calls", more=_TRJ) + """SELECT conversation_id, mode AS match_mode, failure_label IS NULL AS matched, failure_label, CASE WHEN mode = 'within' OR (mode = 'strict' AND len(a) = 3) THEN 0 ELSE len(missing) END::BIGINT AS n_missing,
 CASE WHEN mode = 'within' THEN len(beyond) WHEN mode = 'contains' OR (mode = 'strict' AND len(a) = 3) THEN 0 ELSE len(extra) END::BIGINT AS n_extra FROM g""",
)
def _(spark, sf):
    """The same with calls as rows: no conversation becomes one row of one task."""
    calls = adapt(spark, sf, "calls")
    mode = F.get(F.array(*[F.lit(m) for m in ("unordered", "contains", "within", "strict")]), F.pmod("conversation_id", F.lit(4)).cast("int"))
    modes = calls.select("conversation_id").distinct().withColumn("match_mode", mode)
    expected = modes.select("conversation_id", F.posexplode(F.array(F.lit("click"), F.lit("view"), F.lit("purchase"))).alias("at", "name")).withColumns({"arguments": F.lit("{}"), "arg_match_mode": F.lit("ignore")})
    return trajectory.match_long(modes, expected, calls)[0].drop("n_ordering_issues")


@query("trj_1_argument_modes", _with("calls", more="""x AS (SELECT id, event_id, CAST(arguments->>'k' AS INT) AS k, CASE event_id % 3 WHEN 0 THEN 'ignore' WHEN 1 THEN 'exact' ELSE 'partial' END AS mode, event_id % 5 AS kind FROM t_calls),
 y AS (SELECT *, CASE WHEN mode = 'ignore' THEN true WHEN mode = 'exact' THEN kind IN (0, 1) ELSE kind IN (0, 1, 2) END AS ok FROM x)""") + "SELECT id, mode, ok AS matched, CASE WHEN ok THEN NULL WHEN mode = 'partial' THEN 'lack of specific information' ELSE 'false information' END AS failure_label FROM y")  # fmt: skip
def _(spark, sf):
    """Each call against its own arguments: equal, with other spaces, fewer, with another value, more."""
    calls = adapt(spark, sf, "calls").withColumn("k", F.get_json_object("arguments", "$.k"))
    made = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    mode = F.get(F.array(F.lit("ignore"), F.lit("exact"), F.lit("partial")), (F.col("event_id") % 3).cast("int"))
    other = F.get(F.array(made('{"k":', F.col("k"), "}"), made('{  "k" :  ', F.col("k"), " }"), F.lit("{}"), made('{"k":', F.col("k"), "1}"), made('{"m":[1],"k":', F.col("k"), "}")), (F.col("event_id") % 5).cast("int"))
    rows = calls.select("id", mode.alias("mode"), F.array(F.struct("name", "arguments")).alias("actual"), F.array(F.struct("name", other.alias("arguments"), mode.alias("arg_match_mode"))).alias("expected"), F.lit("strict").alias("match_mode"))
    return trajectory.match_trajectories(rows).select("id", "mode", "matched", "failure_label")


@query(
    "trj_9_attribute_failures",
    _with("calls", more=_TRJ + ", last_ AS (SELECT conversation_id, max(turn_id) AS turn_id FROM t_calls GROUP BY 1), ev AS (SELECT DISTINCT conversation_id, turn_id FROM t_calls)")
    + "SELECT ev.conversation_id, ev.turn_id, CASE WHEN g.failure_label IS NOT NULL AND ev.turn_id = last_.turn_id THEN g.failure_label ELSE 'no failure' END AS label FROM ev LEFT JOIN g USING (conversation_id) LEFT JOIN last_ USING (conversation_id)",
)
def _(spark, sf):
    calls = adapt(spark, sf, "calls")
    evals = calls.select("conversation_id", "turn_id").distinct().withColumns({"turn_score": F.lit(3.0), "label": F.lit(C.NO_FAILURE), "reason": F.lit("")})
    results = trajectory.match_trajectories(_trajectories(spark, sf))
    return trajectory.attribute_failures(results, calls, evals)[0].select("conversation_id", "turn_id", "label")


# knowledge base


@query("kb_1_html_to_text", r"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, regexp_replace(regexp_replace(coalesce(html, ''), '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<![^>]*>', '<x>', 'gs'), '<a [^>]*>[^<]*</a>', '<x>', 'g') AS h FROM pages),
 n AS (SELECT *, list_filter(list_transform(list_transform(regexp_split_to_array(h, '<[^>]*>'), lambda x: replace(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '&amp', '&')), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS nodes,
   replace(replace(replace(trim(regexp_extract(html, '<title>([^<]*)', 1)), '&quot;', '"'), '&amp;', '&'), '&amp', '&') AS t FROM p)
 SELECT page_id, url, coalesce(nullif(t, ''), url) AS title, array_to_string(nodes, chr(10)) AS content FROM n""")  # fmt: skip
def _(spark, sf):
    return kb.html_to_text(spark.read.parquet(f"{sf}/pages.parquet"))


@query("kb_2_extract_links", """SELECT DISTINCT url, concat(url, h) AS link FROM (SELECT regexp_extract(url, '^https?://[^/]+') AS url, unnest(regexp_extract_all(html, '<a href="(/[^"#]+)"', 1)) AS h FROM pages)""")
def _(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return kb.extract_links(pages.withColumn("url", F.regexp_extract("url", "^https?://[^/]+", 0)))


def _docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "source", F.col("text").alias("content"), F.lit(False).alias("is_chunk"), (F.col("doc_id") % 50 == 0).alias("is_error"))


@query("kb_3_chunk_documents")
def _(spark, sf):
    return kb.chunk_documents(_docs(spark, sf), 1000, 100)


@query("kb_4_valid_docs", "SELECT doc_id AS id, source FROM documents WHERE text IS NOT NULL AND text <> '' AND doc_id % 50 <> 0")
def _(spark, sf):
    return kb.valid_docs(_docs(spark, sf)).select("id", "source")


def _vectors(spark, sf):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 3))
    return kb.l2_normalize(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", scaled.alias("embedding")))


@query("kb_5_l2_normalize", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 3)) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v)
 SELECT vec_id, len(e)::INT AS dim, round(list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i] / n * (i % 7))), 6) AS dot, round(e[1] / n, 6) AS first, round(e[len(e)] / n, 6) AS last FROM n""")  # fmt: skip
def _(spark, sf):
    v = _vectors(spark, sf)
    weighted = F.aggregate(F.transform("embedding", lambda x, i: x * ((i + 1) % 7)), F.lit(0.0), lambda a, x: a + x)
    return v.select("vec_id", F.size("embedding").alias("dim"), F.round(weighted, 6).alias("dot"), F.round(F.get("embedding", 0), 6).alias("first"), F.round(F.element_at("embedding", -1), 6).alias("last"))


@query(
    "kb_6_top_k",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS e FROM embeddings),
 s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, list_dot_product(q.e, c.e) AS score FROM v q, v c WHERE q.vec_id % 20 = 0)
 SELECT query_id, chunk_id, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, chunk_id) AS place FROM s) WHERE place <= 4""",
)
def _(spark, sf):
    v = _vectors(spark, sf)
    found = kb.top_k(v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v.select(F.col("vec_id").alias("chunk_id"), "embedding"))
    return found.select("query_id", "chunk_id", "place")


_FOUND_CHUNKS = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS e FROM embeddings WHERE vec_id % 7 <> 3),
 s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, list_dot_product(q.e, c.e) AS score FROM v q, v c WHERE q.vec_id % 20 = 0)
 SELECT query_id, chunk_id, place::INT AS place, concat('text ', chunk_id) AS content, concat('title ', chunk_id % 9) AS title, '' AS source, round(score, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, chunk_id) AS place FROM s) WHERE place <= 4"""


@query("kb_6_retrieve", _FOUND_CHUNKS)
def _(spark, sf):
    """Whole answers of a search; a seventh of the vectors is null, ragged, or holds no number."""
    v = _vectors(spark, sf)
    bad = F.when(F.col("vec_id") % 3 == 0, F.lit(None).cast("array<double>")).when(F.col("vec_id") % 3 == 1, F.slice("embedding", 1, 5)).otherwise(F.transform("embedding", lambda x, i: F.when(i == 3, float("nan")).otherwise(x)))
    v = v.withColumn("embedding", F.when(F.col("vec_id") % 7 == 3, bad).otherwise(F.col("embedding")))
    n = F.col("vec_id").cast("string")
    chunks = v.select(F.col("vec_id").alias("chunk_id"), "embedding", F.concat(F.lit("text "), n).alias("content"), F.concat(F.lit("title "), (F.col("vec_id") % 9).cast("string")).alias("title"), F.lit(None).cast("string").alias("source"))
    found = kb.retrieve(v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), chunks)
    return found.withColumn("confidence", F.round("confidence", 6))


@query("kb_3_token_chunks")
def _(spark, sf):
    import public_tokenizers

    return kb.token_chunks(_docs(spark, sf), public_tokenizers.path("word_bpe_49k.json")).select("id", "source", "content")


@query("kb_3_recursive_tokens")
def _(spark, sf):
    import public_tokenizers

    return kb.recursive_token_chunks(_docs(spark, sf), public_tokenizers.path("word_bpe_49k.json"), 400, 40).select("id", "source", "content")


@query("kb_3_recursive_words", """WITH d AS (SELECT doc_id, source, regexp_split_to_array(trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g')), ' ') AS ws FROM documents WHERE text IS NOT NULL AND text <> '' AND doc_id % 50 <> 0 AND trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g')) <> ''),
 c AS (SELECT doc_id, source, ws, unnest(range(CASE WHEN len(ws) <= 200 THEN 1 ELSE ((len(ws) - 200 + 179) // 180) + 1 END)) AS i FROM d)
 SELECT concat(doc_id, '_', i) AS id, source, concat(array_to_string(ws[i * 180 + 1:i * 180 + 200], ' '), CASE WHEN i * 180 + 200 < len(ws) THEN ' ' ELSE '' END) AS content FROM c""")  # fmt: skip
def _(spark, sf):
    """Texts of one line each, in chunks of at most 200 words of which 20 are shared."""
    flat = F.trim(F.regexp_replace("content", "[\\x20\\x09-\\x0D]+", " "))
    return kb.recursive_token_chunks(_docs(spark, sf).withColumn("content", flat), None, 200, 20).select("id", "source", "content")


@query("src_6_knowledge_files", "SELECT concat('page-', page_id, '.html') AS title, html AS content, false AS is_error FROM pages WHERE coalesce(html, '') <> '' UNION ALL SELECT concat('note-', doc_id, '.', ['md', 'txt', 'pdf', 'json'][doc_id % 4 + 1]), CASE WHEN doc_id % 4 <> 2 THEN text END, doc_id % 4 = 2 FROM documents WHERE coalesce(text, '') <> ''")
def _(spark, sf):
    return _knowledge(spark, sf).select("title", "content", "is_error")


def _knowledge(spark, sf):
    """All pages and documents as files, read back; a folder for each thousand, as a folder is listed by one task."""
    root = fresh_path(spark, "knowledge")
    kinds = F.get(F.array(*[F.lit(k) for k in ("md", "txt", "pdf", "json")]), (F.col("doc_id") % 4).cast("int"))
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(F.concat(F.lit("pages-"), F.floor(F.col("page_id") / 1000).cast("string"), F.lit("/page-"), F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.col("html").alias("content"))
    notes = spark.read.parquet(f"{sf}/documents.parquet").select(F.concat(F.lit("notes-"), F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("/note-"), F.col("doc_id").cast("string"), F.lit("."), kinds).alias("name"), F.col("text").alias("content"))
    write_files(pages.unionByName(notes), root)
    return documents.read_knowledge_files(spark, root)


@query("kb_chain_files_to_search", """WITH f AS (SELECT concat('page-', page_id, '.html') AS title FROM pages WHERE coalesce(html, '') <> '' UNION ALL SELECT concat('note-', doc_id, '.', ['md', 'txt', 'pdf', 'json'][doc_id % 4 + 1]) FROM documents WHERE coalesce(text, '') <> '' AND doc_id % 4 <> 2),
 k AS (SELECT title, regexp_extract(title, '[0-9]+')::INT AS n, title LIKE 'page-%' AS page FROM f)
 SELECT title AS query, 'self' AS best FROM k WHERE n % 20 = 0""")  # fmt: skip
def _(spark, sf):
    """Files to text, to chunks with text ids, to vectors of hashed words; each twentieth file's first chunk finds itself, or a chunk of equal text."""
    files = kb.readable(_knowledge(spark, sf).withColumn("id", F.col("title")))
    chunks = kb.chunk_documents(files, 2000, 200)
    buckets = F.transform(F.split(F.lower("content"), r"\s+"), lambda w: F.pmod(F.xxhash64(w), F.lit(64)).cast("int"))

    def count(batches):
        for part in sliced(batches, 4096):
            words = part.column("b")
            row = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False))
            counts = np.bincount(row * 64 + words.flatten().to_numpy(zero_copy_only=False), minlength=64 * len(words)).astype(float)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(np.arange(0, 64 * len(words) + 1, 64, dtype=np.int32), counts)], ["id", "embedding"])

    vectors = kb.l2_normalize(chunks.select("id", buckets.alias("b")).mapInArrow(count, "id string, embedding array<double>"))
    vectors = materialize(vectors, "vectors")
    number = F.regexp_extract("id", "[0-9]+", 0).cast("int")
    asked = vectors.where(F.endswith("id", F.lit("_0")) & (number % 20 == 0))
    found = kb.top_k(asked.withColumnRenamed("id", "query_id"), vectors.withColumnRenamed("id", "chunk_id"), 1)
    return found.select(F.regexp_replace("query_id", "_0$", "").alias("query"), F.when((F.col("chunk_id") == F.col("query_id")) | (F.abs(F.col("score") - 1) < 1e-9), "self").otherwise("other").alias("best"))


# run files, sinks

#: Fifty conversations a run; conversations of different runs have equal ids.
_RUN = "concat('run', CAST(floor(conversation_id / 50) AS BIGINT)) AS run_id, concat('c', conversation_id % 50) AS conversation_id"


def _run_ids(c: str = "conversation_id") -> list:
    return [F.concat(F.lit("run"), F.floor(F.col(c) / 50).cast("string")).alias("run_id"), F.concat(F.lit("c"), (F.col(c) % 50).cast("string")).alias("conversation_id")]


def _run_files(spark, sf) -> str:
    """Run files made of all conversations, each conversation with a call in its first turn."""
    root = fresh_path(spark, "runs")
    called = F.when(F.col("msg_pos") == 1, F.array(F.struct(F.lit("k1").alias("id"), F.when(F.col("conversation_id") % 3 == 0, "search").otherwise("lookup").alias("name"), F.lit('{"q": 1}').alias("arguments"))))
    m = adapt(spark, sf, "messages").withColumn("calls", called)
    said = F.transform(F.sort_array(F.collect_list(F.struct("msg_pos", F.floor(F.col("msg_pos") / 2).cast("int").alias("turn_id"), "role", "content", F.col("calls").alias("tool_calls")))), lambda x: x.dropFields("msg_pos"))
    talks = m.groupBy("conversation_id").agg(said.alias("conversation_history"))
    talk = F.struct(_run_ids()[1], F.concat(F.lit("s"), (F.col("conversation_id") % 7).cast("string")).alias("scenario_id"), "conversation_history")
    runs = talks.groupBy(_run_ids()[0]).agg(F.collect_list(talk).alias("conversations"))
    write_files(runs.select(F.concat("run_id", F.lit(".json")).alias("name"), F.to_json(F.struct(F.lit("1").alias("schema_version"), F.col("run_id").alias("simulation_id"), "conversations")).alias("content")), root)
    return root


def _scenario_files(spark, sf) -> str:
    """A scenario file for each hundred customers, and one with the scenarios s0 to s6 of the runs; every third expects a call."""
    root = fresh_path(spark, "scenarios")
    expected = lambda c: F.when(c % 3 == 0, F.array(F.struct(F.lit("tool_calls").alias("type"), F.lit("contains").alias("match_mode"), F.array(F.struct(F.lit("search").alias("name"), F.lit("{}").alias("arguments"), F.lit("ignore").alias("arg_match_mode"))).alias("expected"))))
    own = adapt(spark, sf, "scenarios").select(F.floor(F.col("scenario_id") / 100).cast("string").alias("file"), F.struct(F.concat(F.lit("c"), F.col("scenario_id").cast("string")).alias("scenario_id"), "goal", "user_profile", expected(F.col("scenario_id")).alias("assertions")).alias("s"))
    seven = spark.range(7).select(F.lit("runs").alias("file"), F.struct(F.concat(F.lit("s"), F.col("id").cast("string")).alias("scenario_id"), F.lit("goal").alias("goal"), F.lit("profile").alias("user_profile"), expected(F.col("id")).alias("assertions")).alias("s"))
    files = own.unionByName(seven).groupBy("file").agg(F.collect_list("s").alias("scenarios"))
    write_files(files.select(F.concat("file", F.lit(".json")).alias("name"), F.to_json(F.struct(F.lit("1").alias("schema_version"), "scenarios")).alias("content")), root)
    return root


@query("src_1_scenario_files", _with("scenarios") + "SELECT concat('c', scenario_id) AS scenario_id, goal, user_profile, CASE WHEN scenario_id % 3 = 0 THEN 1 ELSE 0 END AS assertions FROM t_scenarios UNION ALL SELECT concat('s', i), 'goal', 'profile', CASE WHEN i % 3 = 0 THEN 1 ELSE 0 END FROM range(7) r(i)")
def _(spark, sf):
    return documents.read_scenarios(spark, _scenario_files(spark, sf))[0].select("scenario_id", "goal", "user_profile", F.size("assertions").alias("assertions"))


@query("src_2_run_files", _with("messages") + f"SELECT {_RUN}, msg_pos, role, content FROM t_messages")
def _(spark, sf):
    return documents.read_simulations(spark, _run_files(spark, sf))[1].select("run_id", "conversation_id", "msg_pos", "role", "content")


def _evaluated(spark, sf) -> run_files.Evaluation:
    """All runs judged by replies that follow from the ids: a low score at each third turn, a behaviour label for every turn, a goal for every conversation, and one reply in eleven without a verdict."""
    t = turns.assemble_turns(adapt(spark, sf, "messages"))
    c, n = F.col("conversation_id"), F.col("turn_id")
    number = lambda x: F.concat(F.lit('{"score": '), x.cast("string"), F.lit("}"))
    labels = F.get(F.array(*[F.lit(x) for x in (C.FALSE_INFORMATION, C.REPETITION, C.NO_FAILURE)]), F.pmod(c + n, F.lit(3)).cast("int"))
    scores = t.select(*_run_ids(), "turn_id", F.lit("helpfulness").alias("metric"), F.when((c + n) % 11 == 0, "no verdict").otherwise(number(F.when((c + n * 2) % 3 == 0, 1).otherwise(4))).alias("response"))
    judged = t.select(*_run_ids(), "turn_id", F.lit(C.BEHAVIOUR).alias("metric"), F.concat(F.lit('{"label": "'), labels, F.lit('", "reason": "Part '), (c % 5).cast("string"), F.lit('"}')).alias("response"))
    goals = adapt(spark, sf, "conversations_of_messages").select(*_run_ids(), F.lit(None).cast("int").alias("turn_id"), F.lit(C.GOAL).alias("metric"), number(c % 2).alias("response"))
    return run_files.evaluate_run_files(spark, _run_files(spark, sf), _scenario_files(spark, sf), scores.unionByName(judged).unionByName(goals))


_RUN_EVALS = _TALK + """, base AS (SELECT conversation_id AS c, turn_id AS n FROM pairs),
 ev0 AS (SELECT c, n, CASE WHEN (c + n) % 11 <> 0 AND (c + n * 2) % 3 = 0 THEN ['false information', 'repetition', 'no failure'][(c + n) % 3 + 1] ELSE 'skipped_good_performance' END AS label,
   CASE WHEN (c + n) % 11 <> 0 AND (c + n * 2) % 3 = 0 THEN concat('Part ', c % 5) ELSE 'Skipped: all turn metrics are at or above their thresholds.' END AS reason, CASE WHEN (c + n) % 11 = 0 THEN -1.0 WHEN (c + n * 2) % 3 = 0 THEN 1.0 ELSE 4.0 END::DOUBLE AS turn_score FROM base),
 hit AS (SELECT conversation_id AS c FROM t_messages WHERE msg_pos = 1 AND (conversation_id % 7) % 3 = 0 AND conversation_id % 3 <> 0),
 ev AS (SELECT ev0.c, n, turn_score, CASE WHEN hit.c IS NULL OR n <> 0 THEN label WHEN label IN ('skipped_good_performance', 'no failure', 'repetition') THEN 'disobey user request' ELSE label END AS label,
   CASE WHEN hit.c IS NULL OR n <> 0 THEN reason WHEN label IN ('skipped_good_performance', 'no failure', 'repetition') THEN '[Trajectory] missing: search' ELSE concat(reason, chr(10), '[Trajectory] missing: search') END AS reason FROM ev0 LEFT JOIN hit ON hit.c = ev0.c),
 cv AS (SELECT a.c, coalesce(t, 0) AS turns, (a.c % 2)::DOUBLE AS goal, CASE WHEN coalesce(t, 0) > 0 THEN (t - f) / t ELSE 1.0::DOUBLE END AS ratio FROM (SELECT DISTINCT conversation_id AS c FROM t_messages) a
   LEFT JOIN (SELECT c, count(*) AS t, count(*) FILTER (label NOT IN ('skipped_good_performance', 'no failure')) AS f FROM ev GROUP BY 1) b ON a.c = b.c)"""


@query("job_run_files", _with("messages", more=_RUN_EVALS) + f"SELECT {_RUN.replace('conversation_id /', 'c /').replace('conversation_id %', 'c %')}, turns, goal AS goal_completion_score, ratio AS turn_success_ratio, ratio * 0.75::DOUBLE + goal * 0.25::DOUBLE AS overall_agent_score, CASE WHEN ratio * 0.75::DOUBLE + goal * 0.25::DOUBLE = 1 THEN 'Done' WHEN ratio * 0.75::DOUBLE + goal * 0.25::DOUBLE >= 0.6 THEN 'Partial Failure' ELSE 'Failed' END AS evaluation_status FROM cv")
def _(spark, sf):
    return _evaluated(spark, sf).convo_evals


@query("job_run_errors", _with("messages", more=_RUN_EVALS) + f"""SELECT run_id, category, n_occurrences, severity, row_number() OVER (PARTITION BY run_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 3 END, n_occurrences DESC, id)::INT AS error_index FROM (
 SELECT concat('run', CAST(floor(c / 50) AS BIGINT)) AS run_id, label AS category, count(*) AS n_occurrences, CASE label WHEN 'false information' THEN 'critical' WHEN 'repetition' THEN 'low' ELSE 'high' END AS severity,
   substr(sha256(concat('run', CAST(floor(c / 50) AS BIGINT), chr(10), label, chr(10), regexp_replace(trim(regexp_replace(lower(reason), '\\s+', ' ', 'g')), '[0-9]+', '#', 'g'))), 1, 16) AS id FROM ev WHERE label IN {_REAL} GROUP BY 1, 2, 4, 5)""")  # fmt: skip
def _(spark, sf):
    found = _evaluated(spark, sf)
    rows = found.mappings.select("run_id", "error_index", "unique_error_id", "n_occurrences", "severity").distinct()
    return rows.join(found.errors.select("run_id", "unique_error_id", "category"), ["run_id", "unique_error_id"]).select("run_id", "category", "n_occurrences", "severity", "error_index")


#: Labels, scores and conversations by run, and once more for all runs, whose run_id is null.
_BY_RUN = """, lab AS (SELECT concat('run', CAST(floor(c / 50) AS BIGINT)) AS run_id, label FROM ev), cvr AS (SELECT concat('run', CAST(floor(c / 50) AS BIGINT)) AS run_id, *, ratio * 0.75::DOUBLE + goal * 0.25::DOUBLE AS overall FROM cv),
 sc AS (SELECT concat('run', CAST(floor(c / 50) AS BIGINT)) AS run_id, 'helpfulness' AS name, 'turn' AS scope, turn_score AS value FROM ev WHERE turn_score >= 0 UNION ALL SELECT run_id, 'goal_completion', 'conversation', goal FROM cvr)"""


@query("rpt_1_13_by_run", _with("messages", more=_RUN_EVALS + _BY_RUN) + "SELECT run_id, count(*) AS conversations, sum(turns)::BIGINT AS turns, avg(overall) AS mean_score, avg(CASE WHEN overall = 1 THEN 1.0::DOUBLE ELSE 0 END) AS pass_rate, avg(turns) AS avg_turns FROM cvr GROUP BY GROUPING SETS ((run_id), ())")
def _(spark, sf):
    found = _evaluated(spark, sf).convo_evals
    both = report.run_totals(found).drop("avg_turns").join(report.kpi(found).drop("conversations").withColumnRenamed("run_id", "_run"), F.col("run_id").eqNullSafe(F.col("_run"))).drop("_run")
    return both.select("run_id", "conversations", "turns", "mean_score", "pass_rate", "avg_turns")


@query("rpt_2_3_by_run", _with("messages", more=_RUN_EVALS + _BY_RUN) + "SELECT run_id, name, scope, avg(value) AS average, concat(upper(name[1]), CASE name WHEN 'helpfulness' THEN 'elpfulness' ELSE 'oal Completion' END) AS title FROM sc GROUP BY GROUPING SETS ((run_id, name, scope), (name, scope))")
def _(spark, sf):
    quant = _evaluated(spark, sf).quant
    shown = report.performance_metrics(quant).select(F.col("run_id").alias("_run"), F.col("name").alias("_name"), "title")
    rows = report.metric_averages(quant)
    return rows.join(shown, F.col("run_id").eqNullSafe(F.col("_run")) & (F.col("name") == F.col("_name"))).select("run_id", "name", "scope", "average", "title")


@query("rpt_4_by_run", _with("messages", more=_RUN_EVALS + _BY_RUN + ", m AS (SELECT run_id, avg(value) AS m FROM sc WHERE name = 'helpfulness' GROUP BY GROUPING SETS ((run_id), ()))") + "SELECT run_id, m AS overall_average, CASE WHEN m < 2 THEN 'Poor' WHEN m < 3 THEN 'Needs Improvement' WHEN m < 4 THEN 'Good' ELSE 'Excellent' END AS label FROM m")
def _(spark, sf):
    return report.overall_average(_evaluated(spark, sf).quant)


@query("rpt_5_6_by_run", _with("messages", more=_RUN_EVALS + _BY_RUN + f", n AS (SELECT run_id, label, count(*) AS n FROM lab WHERE label NOT IN {_SYSTEM} GROUP BY GROUPING SETS ((run_id, label), (label)))") + """SELECT 'all' AS kind, run_id, label, n, n / sum(n) OVER (PARTITION BY run_id) * 100 AS share FROM n
 UNION ALL SELECT 'failures', run_id, label, n, n / sum(n) OVER (PARTITION BY run_id) * 100 FROM n WHERE label <> 'no failure'""")  # fmt: skip
def _(spark, sf):
    evals = _evaluated(spark, sf).evals
    columns = [F.col(c) for c in ("run_id", "label", "n", "share")]
    return report.failure_breakdown(evals).select(F.lit("all").alias("kind"), *columns).unionByName(report.failure_distribution(evals).select(F.lit("failures").alias("kind"), *columns))


_HIT_RUNS = ", hr AS (SELECT DISTINCT concat('run', CAST(floor(c / 50) AS BIGINT)) AS run_id FROM hit JOIN base USING (c) WHERE n = 0), hits AS (SELECT concat('run', CAST(floor(c / 50) AS BIGINT)) AS run_id FROM hit WHERE c IN (SELECT c FROM base))"


@query("rpt_7_by_run", _with("messages", more=_RUN_EVALS + _BY_RUN + _HIT_RUNS + f""", t AS (SELECT run_id, label, count(*) AS n FROM lab WHERE label NOT IN {_SYSTEM} AND label <> 'no failure' GROUP BY GROUPING SETS ((run_id, label), (label))),
 q AS (SELECT run_id, 'disobey user request' AS label, count(*) AS n FROM hits GROUP BY GROUPING SETS ((run_id), ()) HAVING count(*) > 0),
 b AS (SELECT * FROM q UNION ALL SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.run_id IS NOT DISTINCT FROM t.run_id))""") + "SELECT run_id, 'agent_behavior_failure' AS name, label, n, n / sum(n) OVER (PARTITION BY run_id) * 100 AS share FROM b")  # fmt: skip
def _(spark, sf):
    found = _evaluated(spark, sf)
    return report.label_distributions(found.qual, found.evals)


@query("gate_3_by_run", _with("messages", more=_RUN_EVALS + _BY_RUN + """, fails AS (SELECT run_id, 1 AS n, 0 AS l FROM cvr WHERE overall < 0.6 UNION ALL SELECT run_id, 0, 1 FROM lab WHERE label = 'repetition' UNION ALL SELECT run_id, 0, 0 FROM cvr)""") + "SELECT run_id, sum(n)::BIGINT AS numeric_failures, sum(l)::BIGINT AS label_failures, sum(n) + sum(l) = 0 AS passed FROM fails GROUP BY GROUPING SETS ((run_id), ())")
def _(spark, sf):
    thresholds = spark.createDataFrame([("overall_score", 0.6)], "metric string, threshold double")
    return run_files.gate_summary(_evaluated(spark, sf), thresholds, spark.createDataFrame([(C.BEHAVIOUR, C.REPETITION)], "metric string, label string"))


@query("err_8_by_run", _with("messages", more=_RUN_EVALS) + f"""SELECT run_id, category, n_occurrences, conversations, scenarios FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 3 END, n_occurrences DESC, id) AS place FROM (
 SELECT concat('run', CAST(floor(c / 50) AS BIGINT)) AS run_id, label AS category, count(*) AS n_occurrences, count(DISTINCT c) AS conversations, count(DISTINCT c % 7) AS scenarios, CASE label WHEN 'false information' THEN 'critical' WHEN 'repetition' THEN 'low' ELSE 'high' END AS severity,
   substr(sha256(concat('run', CAST(floor(c / 50) AS BIGINT), chr(10), label, chr(10), regexp_replace(trim(regexp_replace(lower(reason), '\\s+', ' ', 'g')), '[0-9]+', '#', 'g'))), 1, 16) AS id FROM ev WHERE label IN {_REAL} GROUP BY ALL)) WHERE place <= 2""")  # fmt: skip
def _(spark, sf):
    found = _evaluated(spark, sf)
    return E.top_errors(found.errors, found.occurrences, found.conversations, 2).select("run_id", "category", "n_occurrences", "conversations", "scenarios")


@query("err_9_by_run", _with("messages", more=_RUN_EVALS + """, g AS (SELECT concat('run', CAST(floor(c / 50) AS BIGINT)) AS run_id, c, CASE c % 3 WHEN 0 THEN 'no failure' WHEN 1 THEN 'repetition' ELSE 'false information' END AS expected FROM cv),
 ok AS (SELECT run_id, expected, CASE WHEN expected = 'no failure' THEN NOT EXISTS (SELECT 1 FROM ev WHERE ev.c = g.c AND label NOT IN ('no failure', 'skipped_good_performance')) ELSE EXISTS (SELECT 1 FROM ev WHERE ev.c = g.c AND label = expected) END AS ok FROM g)""")
    + "SELECT run_id, expected, count(*) AS conversations, count(*) FILTER (ok) AS agreed, count(*) FILTER (ok) / count(*) AS rate FROM ok GROUP BY GROUPING SETS ((run_id, expected), (expected))")
def _(spark, sf):
    want = F.get(F.array(*[F.lit(x) for x in (C.NO_FAILURE, C.REPETITION, C.FALSE_INFORMATION)]), (F.col("conversation_id") % 3).cast("int"))
    golden = adapt(spark, sf, "conversations_of_messages").select(*_run_ids(), F.lit(0).alias("pos"), want.alias("label"))
    return E.judge_agreement(_evaluated(spark, sf).evals, golden)


def _written(spark, sf) -> str:
    root = fresh_path(spark, "evaluation")
    run_files.write_runs(_evaluated(spark, sf), root)
    return root


@query("snk_1_evaluation", _with("messages", more=_RUN_EVALS) + "SELECT concat('run', CAST(floor(c / 50) AS BIGINT)) AS run_id, concat('c', c % 50) AS conversation_id, n AS turn_id, turn_score, label, reason FROM ev")
def _(spark, sf):
    rows = run_files.written_runs(spark, _written(spark, sf)).read("evaluation").select("run_id", "conversation_id", F.explode("turn_scores").alias("t"))
    return rows.select("run_id", "conversation_id", "t.turn_id", "t.turn_score", "t.label", "t.reason")


_RUN_FAILS = ", fl AS (SELECT DISTINCT concat('run', CAST(floor(c / 50) AS BIGINT)) AS run_id, concat('s', c % 7) AS scenario_id FROM ev WHERE label IN " + _REAL + ")"


@query("snk_2_focus", _with("messages", more=_RUN_EVALS + _RUN_FAILS) + "SELECT run_id, 'all_failures' AS focus_set, scenario_id, 'goal' AS goal FROM fl")
def _(spark, sf):
    return run_files.written_runs(spark, _written(spark, sf)).read("focus").where("focus_set = 'all_failures'").select("run_id", "focus_set", "scenario_id", "goal")


@query("snk_3_report_tables", _with("messages", more=_TALK) + "SELECT 'rejects' AS name, concat('run', CAST(floor(conversation_id / 50) AS BIGINT)) AS run_id, count(*) AS n FROM pairs WHERE (conversation_id + turn_id) % 11 = 0 GROUP BY 2")
def _(spark, sf):
    return run_files.written_runs(spark, _written(spark, sf)).read("rejects").groupBy("run_id").agg(F.count("*").alias("n")).select(F.lit("rejects").alias("name"), "run_id", "n")


# streams' batch twin, metrics


#: Calls and awaited turns in milliseconds. Each fourth turn is waited for late, when later turns have closed; turn 0 of each seventh conversation never.
_SPANS = """c AS (SELECT conversation_id, turn_id, id, turn_id * 1000 + call_pos * 40 + (event_id % 3) * 50 AS arrival FROM t_calls),
 e AS (SELECT DISTINCT conversation_id, turn_id, turn_id * 1000 + 30 + CASE WHEN turn_id % 4 = 1 THEN 2500 ELSE 0 END AS w, turn_id % 2 = 0 AS s FROM t_calls WHERE turn_id <> 0 OR conversation_id % 7 <> 0)"""
#: Ends from each conversation's last turn down: ds has those of the later turns, which purge what came before the wait, or before the end.
_FATES = _SPANS + """,
 g AS (SELECT e.conversation_id, e.turn_id, w, s, coalesce(list(arrival) FILTER (arrival IS NOT NULL), []) AS arr FROM e LEFT JOIN c USING (conversation_id, turn_id) GROUP BY e.conversation_id, e.turn_id, w, s),
 a AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn_id DESC) AS k FROM g),
 r(conversation_id, turn_id, k, ds, d) AS (SELECT conversation_id, turn_id, 0::BIGINT, []::BIGINT[], NULL::BIGINT FROM a WHERE k = 1
  UNION ALL SELECT conversation_id, turn_id, k, ds, CASE WHEN s THEN w + CASE WHEN len(list_filter(live, lambda x: x <= w)) > 0 THEN 100 ELSE 0 END WHEN len(list_filter(live, lambda x: x <= w + 5000)) = 0 THEN w + 5000
    ELSE greatest(list_min(list_filter(live, lambda x: x <= w + 5000)), w) + 100 END
   FROM (SELECT *, list_filter(arr, lambda x: x > coalesce(list_max(list_filter(ds, lambda y: y < w)), -1)) AS live
    FROM (SELECT a.conversation_id, a.turn_id, a.k, a.w, a.s, a.arr, CASE WHEN r.d IS NULL THEN r.ds ELSE list_append(r.ds, r.d) END AS ds FROM r JOIN a ON a.conversation_id = r.conversation_id AND a.k = r.k + 1))),
 d AS (SELECT conversation_id, turn_id, ds, d FROM r WHERE k > 0),
 f AS (SELECT c.conversation_id, c.turn_id, c.id, CASE WHEN arrival > d.d THEN 'late' WHEN d.d IS NOT NULL AND arrival <= coalesce(list_max(list_filter(ds, lambda y: y < d.d)), -1) THEN 'purged' WHEN d.d IS NOT NULL THEN 'turn'
   WHEN arrival <= (SELECT max(h.d) FROM d h WHERE h.conversation_id = c.conversation_id AND h.turn_id > c.turn_id) THEN 'purged' ELSE 'stale' END AS fate FROM c LEFT JOIN d USING (conversation_id, turn_id))"""
_FATE_COUNTS = "SELECT conversation_id, turn_id, fate, count(*) AS calls, string_agg(id, ',' ORDER BY id) AS ids FROM f GROUP BY ALL"


def _span_events(spark, sf):
    calls = adapt(spark, sf, "calls")
    arrival = F.col("turn_id") * 1000 + F.col("call_pos") * 40 + (F.col("event_id") % 3) * 50
    ends = calls.select("conversation_id", "turn_id").distinct().where("turn_id <> 0 or conversation_id % 7 <> 0")
    waited = F.col("turn_id") * 1000 + 30 + F.when(F.col("turn_id") % 4 == 1, 2500).otherwise(0)
    return calls.select("conversation_id", "turn_id", "id", arrival.alias("arrival")), ends.withColumns({"waited_from": waited, "signalled": F.col("turn_id") % 2 == 0})


def _fate_counts(rows):
    return rows.groupBy("conversation_id", "turn_id", "fate").agg(F.count("*").alias("calls"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))


@query("str_2_3_collect_turns", _with("calls", more=_FATES).replace("WITH ", "WITH RECURSIVE ", 1) + _FATE_COUNTS)
def _(spark, sf):
    took, rest = collect_batch(*_span_events(spark, sf), wait=5000, settle=100)
    return _fate_counts(took.withColumn("fate", F.lit("turn")).unionByName(rest))


@query("str_2_3_stream_turns", _with("calls", more=_FATES).replace("WITH ", "WITH RECURSIVE ", 1) + _FATE_COUNTS)
def _(spark, sf):
    """The same from a stream of files in which events are up to 0.9 seconds out of order, read by an event-time query with state."""
    calls, ends = _span_events(spark, sf)
    both = calls.select("conversation_id", "turn_id", F.lit("call").alias("kind"), F.col("id").alias("payload"), F.lit(None).cast("boolean").alias("signalled"), F.col("arrival").alias("at"))
    both = both.unionByName(ends.select("conversation_id", "turn_id", F.lit("end").alias("kind"), F.lit(None).cast("string").alias("payload"), "signalled", F.col("waited_from").alias("at")))
    both = materialize(both.select(F.col("conversation_id").cast("string").alias("conversation_id"), F.col("turn_id").cast("int").alias("turn_id"), "kind", "payload", "signalled", (F.col("at") + 1_000_000).alias("at")), "events")
    source, out = fresh_path(spark, "event-files"), fresh_path(spark, "fates")
    place = F.col("at") + F.pmod(F.xxhash64("conversation_id", "payload", "at"), F.lit(900))
    low, high, n = both.agg(F.min("at"), F.max("at"), F.count("*")).first()
    steps, files = 4, max(4, n // 1_000_000)
    width = ((high or 0) - (low or 0) + 900) // steps + 1
    for i in range(steps):  # files of one step are older than those of the next
        both.where(F.floor((place - (low or 0)) / width) == i).coalesce(files).write.mode("append").json(source)
    clock = [("clock", 0, "tick", None, None, (high or 0) + 10**9)]
    for _ in range(2):
        spark.createDataFrame(clock, EVENTS).coalesce(1).write.mode("append").json(source)
    spark.range(0).selectExpr("'' as conversation_id", "0 as turn_id", "'' as fate", "0L as at", "array('') as calls").write.parquet(out)
    run_stream(collect_stream(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).json(source), wait=5000, settle=100, delay=f"{width + 900} milliseconds"), out)
    found = spark.read.schema(FATES).parquet(out).where("conversation_id <> 'clock'")
    return _fate_counts(found.select(F.col("conversation_id").cast("long").alias("conversation_id"), F.col("turn_id").cast("long").alias("turn_id"), "fate", F.explode("calls").alias("id")))


@query("udf_1_3_user_metrics", _with("messages", more=_TALK) + "SELECT conversation_id, turn_id, 'length' AS name, 'turn' AS scope, least(5.0, greatest(1.0, length(assistant_msg) / 100)) AS value FROM pairs WHERE length(assistant_msg) % 7 <> 0")
def _(spark, sf):
    from parley.functions.metrics import QuantMetric, score_with

    def length(assistant_msg: str, scale: int) -> float:
        if len(assistant_msg) % 7 == 0:
            raise ValueError("unlucky")
        return min(5.0, max(1.0, len(assistant_msg) / scale))

    scores, _ = score_with(turns.assemble_turns(adapt(spark, sf, "messages")), QuantMetric("length", length, ["assistant_msg"], additional_input={"scale": 100}))
    return scores.select("conversation_id", "turn_id", "name", "scope", "value")


@query("udf_2_qual_metric", _with("messages", more=_TALK) + "SELECT conversation_id, turn_id, CASE WHEN length(user_msg) > length(assistant_msg) THEN 'short' ELSE 'long' END AS value FROM pairs")
def _(spark, sf):
    from parley.functions.metrics import QualMetric, score_with

    size = lambda user_msg, assistant_msg: "short" if len(user_msg) > len(assistant_msg) else "long"
    scores, _ = score_with(turns.assemble_turns(adapt(spark, sf, "messages")), QualMetric("size", size, ["user_msg", "assistant_msg"]))
    return scores.select("conversation_id", "turn_id", "value")


@query("udf_4_composite_metric", _with("lines") + "SELECT conversation_id, turn_id, ((p % 10) / 10 + (s % 10) / 10) / 2 * 5 AS value FROM t_lines")
def _(spark, sf):
    return adapt(spark, sf, "lines").select("conversation_id", "turn_id", T.composite(F.col("p") % 10 / 10, F.col("s") % 10 / 10).alias("value"))


@query("udf_5_response_length", _with("messages", more=_TALK) + "SELECT conversation_id, turn_id, least(5.0, greatest(1.0, length(assistant_msg) / 100)) AS value FROM pairs")
def _(spark, sf):
    return turns.assemble_turns(adapt(spark, sf, "messages")).select("conversation_id", "turn_id", T.response_length(F.col("assistant_msg")).alias("value"))


@query("udf_1_3_metric_files", _with("messages", more=_TALK) + """SELECT 'brevity' AS name, conversation_id, turn_id, 5.0::DOUBLE - least(4.0::DOUBLE, length(assistant_msg) / 100) AS value, NULL AS label, NULL AS error FROM pairs WHERE length(assistant_msg) % 7 <> 0
 UNION ALL SELECT 'brevity', conversation_id, turn_id, NULL, NULL, 'ValueError: unlucky' FROM pairs WHERE length(assistant_msg) % 7 = 0
 UNION ALL SELECT 'Echo', conversation_id, turn_id, NULL, CASE WHEN length(assistant_msg) > length(user_msg) THEN 'longer' ELSE 'shorter' END, NULL FROM pairs""")  # fmt: skip
def _(spark, sf):
    """The turn metrics of a user's file, all called in one Python stage."""
    from parley.functions.metrics import load_metrics, score_all
    from parley.jobs import sample_metrics

    own = [m for m in load_metrics([sample_metrics.__file__]) if m.scope == "turn"]
    numbers, labels, errors = score_all(turns.assemble_turns(adapt(spark, sf, "messages")), own)
    none = {"value": F.lit(None).cast("double"), "label": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}
    columns = ["name", "conversation_id", "turn_id", "value", "label", "error"]
    parts = [numbers, labels.withColumnRenamed("value", "label"), errors]
    return parts[0].withColumns({c: none[c] for c in ("label", "error")}).select(*columns).unionByName(parts[1].withColumns({c: none[c] for c in ("value", "error")}).select(*columns)).unionByName(parts[2].withColumns({c: none[c] for c in ("value", "label")}).select(*columns))


# what can't be read


@query("src_1_2_4_rejects", _with("messages", more="k AS (SELECT DISTINCT conversation_id AS c FROM t_messages)") + """SELECT 'run' AS source, concat('f', c, '.json') AS name, CASE c % 4 WHEN 0 THEN length(concat('{"simulation_id": "r', c, '", "conversations": [')) WHEN 1 THEN 0 END::BIGINT AS "offset", CASE c % 4 WHEN 0 THEN 'Expecting value' WHEN 1 THEN 'empty file' ELSE 'no conversations' END AS reason FROM k WHERE c % 4 < 3
 UNION ALL SELECT 'scenario', concat('f', c, '.json'), CASE c % 4 WHEN 0 THEN 16 WHEN 1 THEN 0 END, CASE c % 4 WHEN 0 THEN 'Expecting value' WHEN 1 THEN 'empty file' ELSE 'scenario 0: user_attributes without user_profile' END FROM k WHERE c % 4 < 3
 UNION ALL SELECT 'spans', concat('f', c, '.json'), CASE c % 4 WHEN 0 THEN 19 WHEN 1 THEN 100 END, CASE c % 4 WHEN 0 THEN 'Expecting value' WHEN 1 THEN 'too large: 219 bytes' ELSE 'not an object' END FROM k WHERE c % 4 < 3""")  # fmt: skip
def _(spark, sf):
    """A run file, a scenario file and a span payload for each conversation: a quarter ends too early, a quarter is empty or too large, a quarter lacks a field or has an old form."""
    c = F.col("conversation_id")
    ids = materialize(adapt(spark, sf, "conversations_of_messages"), "ids")
    name = F.concat(F.lit("f"), c.cast("string"), F.lit(".json")).alias("name")
    kind = lambda *x: F.when(c % 4 == 0, x[0]).when(c % 4 == 1, x[1]).when(c % 4 == 2, x[2]).otherwise(x[3]).alias("content")
    head = F.concat(F.lit('{"simulation_id": "r'), c.cast("string"), F.lit('"'))
    runs, scenarios = fresh_path(spark, "runs"), fresh_path(spark, "scenarios")
    write_files(ids.select(name, kind(F.concat(head, F.lit(', "conversations": [')), F.lit(""), F.concat(head, F.lit("}")), F.concat(head, F.lit(', "conversations": []}')))), runs)
    write_files(ids.select(name, kind(F.lit('{"scenarios": [ '), F.lit(""), F.lit('{"scenarios": [{"scenario_id": "a", "user_attributes": {"x": 1}}]}'), F.lit('{"scenarios": [{"scenario_id": "a"}]}'))), scenarios)
    payloads = ids.select(name.alias("file"), kind(F.lit('{"resourceSpans": ['), F.concat(F.lit('{"resourceSpans": "'), F.repeat(F.lit("x"), F.lit(198)), F.lit('"}')), F.lit("[1]"), F.lit('{"resourceSpans": []}')).alias("payload"))
    base = lambda df, source: df.select(F.lit(source).alias("source"), F.regexp_extract("file", "[^/]+$", 0).alias("name"), "offset", "reason")
    out = base(documents.simulation_rejects(spark, runs), "run").unionByName(base(documents.scenario_rejects(spark, scenarios), "scenario"))
    return out.unionByName(base(documents.otlp_rejects(payloads, max_bytes=100), "spans"))


@query("src_6_all_names", "SELECT CASE doc_id % 4 WHEN 0 THEN concat('_note-', doc_id, '.md') ELSE concat('note-', doc_id, '.txt') END AS title, text AS content, doc_id % 4 = 1 AS below FROM documents WHERE doc_id % 4 < 2 AND coalesce(text, '') <> ''")
def _(spark, sf):
    """Files whose names, or whose folders' names, begin with an underscore are read, those with a dot are not."""
    n = F.col("doc_id").cast("string")
    names = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("_note-"), n, F.lit(".md"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("_docs/part/note-"), n, F.lit(".txt"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit(".note-"), n, F.lit(".md"))).otherwise(F.concat(F.lit("docs/.deep/note-"), n, F.lit(".md")))
    root = fresh_path(spark, "knowledge")
    folder = F.concat(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("/"))  # a folder is listed by one task
    write_files(spark.read.parquet(f"{sf}/documents.parquet").select(F.concat(folder, names).alias("name"), F.col("text").alias("content")), root)
    return documents.read_knowledge_files(spark, root).select("title", "content", F.contains("source", F.lit("/_docs/part/")).alias("below"))


# the whole job with all kinds of input


def _judged(spark, sf, good: bool = False):
    """Replies on helpfulness, behaviour and goals as in _evaluated(), and on the tool calls of every turn; with good only high scores."""
    t = turns.assemble_turns(adapt(spark, sf, "messages"))
    c, n = F.col("conversation_id"), F.col("turn_id")
    pick = lambda labels, at: F.get(F.array(*[F.lit(x) for x in labels]), F.pmod(at, F.lit(len(labels))).cast("int"))
    say = lambda label, reason: F.concat(F.lit('{"label": "'), label, F.lit('", "reason": "'), reason, F.lit('"}')).alias("response")
    score = F.lit(4) if good else F.when((c + n * 2) % 3 == 0, 1).otherwise(4)
    rows = [
        t.select(*_run_ids(), n, F.lit("helpfulness").alias("metric"), F.concat(F.lit('{"score": '), score.cast("string"), F.lit("}")).alias("response")),
        t.select(*_run_ids(), n, F.lit(C.BEHAVIOUR).alias("metric"), say(pick((C.FALSE_INFORMATION, C.REPETITION, C.NO_FAILURE), c + n), F.concat(F.lit("Part "), (c % 5).cast("string")))),
        t.select(*_run_ids(), n, F.lit(C.TOOL_BEHAVIOUR).alias("metric"), say(pick((C.UNSAFE_ACTION, C.NO_FAILURE, C.REPETITION), c + n), F.concat(F.lit("Call "), (c % 4).cast("string")))),
        adapt(spark, sf, "conversations_of_messages").select(*_run_ids(), F.lit(None).cast("int").alias("turn_id"), F.lit(C.GOAL).alias("metric"), F.concat(F.lit('{"score": '), (c % 2).cast("string"), F.lit("}")).alias("response")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _span_payloads(spark, sf):
    """A search by each even conversation in its first turn, as spans; the payloads of each fifth conversation are cut off."""
    c = F.col("conversation_id")
    attr = lambda k, kind, v: F.concat(F.lit(f'{{"key":"{k}","value":{{"{kind}":"'), v, F.lit('"}}'))
    _, own = _run_ids()
    text = F.concat(F.lit('{"resourceSpans":[{"scopeSpans":[{"spans":[{"name":"execute_tool search","spanId":"s","attributes":['), attr("eval.conversation_id", "stringValue", own), F.lit(","), attr("eval.turn_id", "intValue", F.lit("0")), F.lit("]}]}]}]}"))
    rows = adapt(spark, sf, "conversations_of_messages").where("conversation_id % 2 = 0")
    return rows.select(_run_ids()[0], F.concat(F.lit("p"), c.cast("string")).alias("payload_id"), F.when(c % 5 == 0, F.substring(text, 1, 30)).otherwise(text).alias("payload"))


_FULL = _TALK + """, base AS (SELECT conversation_id AS c, turn_id AS n FROM pairs), called AS (SELECT DISTINCT conversation_id AS c FROM t_messages WHERE msg_pos = 1 UNION SELECT DISTINCT conversation_id FROM t_messages WHERE conversation_id % 2 = 0 AND conversation_id % 5 <> 0),
 ev0 AS (SELECT c, n, CASE WHEN (c + n * 2) % 3 = 0 THEN ['false information', 'repetition', 'no failure'][(c + n) % 3 + 1] ELSE 'skipped_good_performance' END AS label,
   CASE WHEN (c + n * 2) % 3 = 0 THEN concat('Part ', c % 5) ELSE 'Skipped: all turn metrics are at or above their thresholds.' END AS reason FROM base),
 tv AS (SELECT c, 0 AS n, ['unsafe action', 'no failure', 'repetition'][c % 3 + 1] AS t, concat('[Tool call] Call ', c % 4) AS r FROM called WHERE c % 3 <> 1),
 ev1 AS (SELECT c, n, CASE WHEN t IS NULL THEN label WHEN label IN ('skipped_good_performance', 'no failure') OR (t = 'unsafe action' AND label = 'repetition') THEN t ELSE label END AS label,
   CASE WHEN t IS NULL THEN reason WHEN label IN ('skipped_good_performance', 'no failure') OR (t = 'unsafe action' AND label = 'repetition') THEN r ELSE concat(reason, chr(10), r) END AS reason FROM ev0 LEFT JOIN tv USING (c, n)),
 hit AS (SELECT DISTINCT conversation_id AS c FROM t_messages WHERE (conversation_id % 7) % 3 = 0 AND NOT (conversation_id % 2 = 0 AND conversation_id % 5 <> 0) AND (conversation_id % 3 <> 0 OR conversation_id NOT IN (SELECT conversation_id FROM t_messages WHERE msg_pos = 1))),
 last AS (SELECT c, CASE WHEN c IN (SELECT c FROM called) THEN 0 ELSE max(n) END AS n FROM base GROUP BY c),
 ev AS (SELECT ev1.c, ev1.n, CASE WHEN h.c IS NULL THEN label WHEN label IN ('skipped_good_performance', 'no failure', 'repetition') THEN 'disobey user request' ELSE label END AS label,
   CASE WHEN h.c IS NULL THEN reason WHEN label IN ('skipped_good_performance', 'no failure', 'repetition') THEN '[Trajectory] missing: search' ELSE concat(reason, chr(10), '[Trajectory] missing: search') END AS reason
   FROM ev1 LEFT JOIN (SELECT hit.c, n FROM hit JOIN last USING (c)) h ON h.c = ev1.c AND h.n = ev1.n)"""
_AS_RUN = "concat('run', CAST(floor(c / 50) AS BIGINT)) AS run_id, concat('c', c % 50) AS conversation_id"


@query("job_tool_verdicts_and_spans", _with("messages", more=_FULL) + f"SELECT {_AS_RUN}, n AS turn_id, label, reason FROM ev")
def _(spark, sf):
    found = run_files.evaluate_run_files(spark, _run_files(spark, sf), _scenario_files(spark, sf), _judged(spark, sf), payloads=_span_payloads(spark, sf))
    return found.evals.select("run_id", "conversation_id", "turn_id", "label", "reason")


@query("job_broken_inputs", _with("messages") + "SELECT 'spans' AS source, concat('p', conversation_id) AS file, 19::BIGINT AS \"offset\", 'Unterminated string starting at' AS reason FROM (SELECT DISTINCT conversation_id FROM t_messages) WHERE conversation_id % 10 = 0")
def _(spark, sf):
    found = run_files.evaluate_run_files(spark, _run_files(spark, sf), _scenario_files(spark, sf), _judged(spark, sf), payloads=_span_payloads(spark, sf))
    root = fresh_path(spark, "evaluation")
    run_files.write_runs(found, root)
    return run_files.written_runs(spark, root).read("broken").select("source", "file", "offset", "reason")


@query("snk_1_3_second_job", _with("messages", more=_FULL + """, again AS (SELECT base.c, base.n, (tv.c IS NOT NULL AND tv.n = base.n) OR (h.c IS NOT NULL) AS failed FROM base LEFT JOIN tv ON tv.c = base.c AND tv.n = base.n LEFT JOIN (SELECT hit.c, n FROM hit JOIN last USING (c)) h ON h.c = base.c AND h.n = base.n),
 both_ AS (SELECT c, n, CASE WHEN CAST(floor(c / 50) AS BIGINT) % 2 = 0 THEN failed ELSE label NOT IN ('skipped_good_performance', 'no failure') END AS failed FROM ev JOIN again USING (c, n))""") + """SELECT concat('run', CAST(floor(c / 50) AS BIGINT)) AS run_id, count(*) AS turns, count(*) FILTER (failed) AS failures, CASE WHEN CAST(floor(c / 50) AS BIGINT) % 2 = 0 THEN 2 ELSE 1 END AS job FROM both_ GROUP BY ALL""")  # fmt: skip
def _(spark, sf):
    """A second job over every other run, with better scores: the first one's other runs stay as they are in all tables."""
    root = fresh_path(spark, "evaluation")
    runs, scenarios = _run_files(spark, sf), _scenario_files(spark, sf)
    for job, good in ((1, False), (2, True)):
        found = run_files.evaluate_run_files(spark, runs, scenarios, _judged(spark, sf, good), payloads=_span_payloads(spark, sf))
        if good:
            found = run_files.only_runs(found, F.regexp_extract("run_id", "[0-9]+", 0).cast("int") % 2 == 0)
        tables = {k: v.withColumn("job", F.lit(job)) for k, v in run_files.report_tables(found).items()}
        run_files.written_runs(spark, root).commit(tables, found.conversations.select("run_id").distinct())
    table = run_files.written_runs(spark, root)
    counted = table.read("turns").groupBy("run_id").agg(F.count("*").alias("turns"), F.count_if(~F.col("label").isin(C.SKIP_OUTCOMES)).alias("failures"), F.max("job").alias("job"))
    return counted.join(table.read("summary").select("run_id", "job"), ["run_id", "job"])

