"""The evaluation of many runs from their files: transcripts, scenarios, judge replies and spans to scores, errors, gates and sinks."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley import constants as C
from parley.functions.metrics import QuantMetric, score_all
from parley.functions.snapshots import Snapshots
from parley.functions.tables import materialize
from parley.functions.text import combine_knowledge, format_history
from parley.operators import errors as E
from parley.operators import gates, report, scoring, traces, trajectory, turns
from parley.operators.turns import conversation_keys
from parley.sources import documents

SCORE_MAX = 5.0
#: The part that a job's broken files make.
NO_RUN = "-"


@dataclass
class Evaluation:
    """All tables lead with run_id, but for broken: the files (source, file, offset, reason) that couldn't be read. rejects are judge replies without a verdict, metric_errors failed calls of user metrics."""

    conversations: DataFrame
    turns: DataFrame
    quant: DataFrame
    qual: DataFrame
    rejects: DataFrame
    evals: DataFrame
    convo_evals: DataFrame
    errors: DataFrame
    occurrences: DataFrame
    mappings: DataFrame
    focus: DataFrame
    messages: DataFrame
    scenarios: DataFrame
    metric_errors: DataFrame
    broken: DataFrame | None = None


def _scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    scope = F.when(F.col("turn_id").isNull(), "conversation").otherwise("turn")
    return rows.select(*keys, "turn_id", F.col("metric").alias("name"), scope.alias("scope"), "value", "reason")


def metric_inputs(paired: DataFrame, conversations: DataFrame, scope: str, wanted: set[str]) -> DataFrame:
    """The rows that user metrics of a scope are called for, with what they may ask for: user_msg and assistant_msg of a turn; chat_history, knowledge, user_goal, profile."""
    keys = conversation_keys(conversations)
    about = conversations.select(*keys, combine_knowledge(F.col("knowledge")).alias("knowledge"), F.col("goal").alias("user_goal"), "profile")
    rows = paired.join(about, keys, "left") if scope == "turn" else about
    if "chat_history" not in wanted:
        return rows
    rows = rows.join(turns.conversation_history(paired), keys, "left")
    told = turns.history_prefix(F.col("history"), F.col("turn_id")) if scope == "turn" else F.col("history")
    return rows.withColumn("chat_history", F.coalesce(format_history(told), F.lit(""))).drop("history")


def evaluate_runs(
    conversations: DataFrame, messages: DataFrame, calls: DataFrame, scenarios: DataFrame, replies: DataFrame, traced: DataFrame | None = None, metrics_to_run: list[str] | None = None, metrics: list[QuantMetric] = (),
) -> Evaluation:
    """conversations, messages and calls as of read_simulations(), scenarios as of read_scenarios().

    replies: run_id, conversation_id, turn_id (null for a whole conversation),
    metric, response. Replies on the behaviour metric label a turn in which a
    metric is low; those on the tool-call metric count for turns with calls,
    whatever the metrics say; those on goal completion a conversation. traced:
    calls of spans, with the same keys, that join those of the transcripts.
    metrics_to_run: the built-in metrics that count, all if empty; tool-call
    replies and trajectories only count if the tool-call metric is among them.
    metrics: the user's own, which always run.
    """
    keys = conversation_keys(conversations)
    runs = lambda name: not metrics_to_run or name in metrics_to_run
    # what several tables are made of is written once
    paired = materialize(turns.assemble_turns(messages), "run-turns")
    builtin = [*C.TURN_METRICS, C.BEHAVIOUR, C.TOOL_BEHAVIOUR, C.GOAL]
    replies = replies.where(~F.col("metric").isin([m for m in builtin if not runs(m)])) if metrics_to_run else replies  # a user's own metrics always count
    numbers, labels, rejects = turns.parse_verdicts(replies)
    quant = _scores(numbers, keys).withColumn("score_max", F.when(F.col("name").isin(C.TURN_METRICS), SCORE_MAX)).withColumn("pos", F.lit(1))
    qual = _scores(labels, keys).withColumn("pos", F.lit(1))
    failed = conversations.select(*keys, F.lit(None).cast("int").alias("turn_id"), *(F.lit("").alias(c) for c in ("name", "scope", "error"))).limit(0)
    for scope in ("turn", "conversation"):
        if not (own := [m for m in metrics if m.scope == scope]):
            continue
        given = metric_inputs(paired, conversations, scope, {c for m in own for c in m.inputs})
        found = [x if scope == "turn" else x.withColumn("turn_id", F.lit(None).cast("int")) for x in score_all(given, own)]
        top = F.lit(None).cast("double")
        for m in own:
            top = F.when(F.col("name") == m.name, float(m.score_range[1])).otherwise(top)
        quant = quant.unionByName(found[0].withColumns({"score_max": top, "pos": F.lit(2)}))
        qual = qual.unionByName(found[1].withColumn("pos", F.lit(2)))
        failed = failed.unionByName(found[2])
    quant, qual, rejects = materialize(quant, "run-quant"), materialize(qual, "run-qual"), materialize(rejects, "run-rejects")
    verdicts = lambda name: qual.where((F.col("name") == name) & F.col("turn_id").isNotNull()).select(*keys, "turn_id", F.col("value").alias("label"), "reason")
    evals = scoring.turn_labels(paired, quant.where(F.col("name") != C.GOAL), verdicts(C.BEHAVIOUR), runs(C.BEHAVIOUR))
    if traced is not None:
        calls = traces.merge_tool_calls(calls, traced)
    more = None
    if runs(C.TOOL_BEHAVIOUR):
        called = verdicts(C.TOOL_BEHAVIOUR).join(calls.select(*keys, "turn_id").distinct(), [*keys, "turn_id"], "left_semi")
        evals = scoring.merge_failures(evals, called, "[Tool call] ")
        said = F.when(F.coalesce("reason", F.lit("")) == "", "").otherwise(F.concat(F.lit("[Tool call] "), "reason"))
        more = called.select(*keys, "turn_id", F.lit(C.BEHAVIOUR).alias("name"), F.lit("turn").alias("scope"), F.col("label").alias("value"), said.alias("reason"))
        results = trajectory.check_trajectories(conversations, scenarios, calls)
        evals, missed = trajectory.attribute_failures(results, calls, evals)
        more = more.unionByName(missed)
    evals = materialize(evals, "run-evals")
    goals = scoring.goal_scores(quant.where("turn_id is null"))
    convo = materialize(scoring.evaluate_conversations(evals, turns.turn_counts(paired, conversations), goals), "run-conversations")
    errors, occurrences = E.group_failures(evals)
    errors, occurrences = materialize(errors, "run-errors"), materialize(occurrences, "run-occurrences")
    mappings = materialize(E.error_scenario_mappings(errors, occurrences, conversations, scenarios), "run-mappings")
    focus = E.focus_sets(mappings, scenarios.select("scenario_id", "goal", "user_profile"))
    # a behaviour reply is the turn's own label, a tool-call reply a score of the behaviour metric; neither stands among the qual scores by itself
    qual = qual.where(~F.col("name").isin(C.BEHAVIOUR, C.TOOL_BEHAVIOUR))
    if more is not None:
        qual = qual.unionByName(more.withColumn("pos", F.lit(3)))
    return Evaluation(conversations, paired, quant, qual, rejects, evals, convo, errors, occurrences, mappings, focus, messages, scenarios, failed)


def evaluate_run_files(spark: SparkSession, runs: str, scenarios: str, replies: DataFrame, traced: DataFrame | None = None, payloads: DataFrame | None = None, **options) -> Evaluation:
    """evaluate_runs() over the run files and scenario files below two folders, and over span payloads (run_id, payload, ...), all of which may be broken in part."""
    conversations, messages, calls, lost_runs = documents.simulation_files(spark, runs)
    known, _, lost_scenarios = documents.scenario_files(spark, scenarios)
    broken = lost_runs.select(F.lit("run").alias("source"), "*").unionByName(lost_scenarios.select(F.lit("scenario").alias("source"), "*"))
    if payloads is not None:
        spans = traces.spans_to_tool_calls(traces.route_spans(documents.parse_otlp(payloads)), ["run_id"])
        # calls of one turn stand in the order of payloads and spans
        at = F.struct("payload_id", "span_pos")
        listed = spans.groupBy("run_id", "conversation_id", "turn_id").agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), "id", "name", "arguments"))).alias("calls"))
        found = listed.select("run_id", "conversation_id", "turn_id", F.posexplode("calls").alias("call_pos", "c")).select("run_id", "conversation_id", "turn_id", "call_pos", "c.id", "c.name", "c.arguments")
        traced = found if traced is None else traced.select(*found.columns).unionByName(found)
        lost = documents.otlp_rejects(payloads)
        broken = broken.unionByName(lost.select(F.lit("spans").alias("source"), F.col("payload_id").alias("file"), "offset", "reason"))
    found = evaluate_runs(conversations, messages, calls, known, replies, traced, **options)
    found.broken = broken
    return found


def only_runs(found: Evaluation, condition: Column) -> Evaluation:
    """The tables of the runs for which a condition on run_id holds."""
    return replace(found, **{f.name: df.where(condition) for f in fields(found) if isinstance(df := getattr(found, f.name), DataFrame) and "run_id" in df.columns})


def gate_runs(found: Evaluation, thresholds: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(numeric failures, label failures) of all runs."""
    return gates.numeric_failures(thresholds, found.convo_evals, found.quant), gates.label_failures(labels, found.evals, found.qual)


def gate_summary(found: Evaluation, thresholds: DataFrame, labels: DataFrame) -> DataFrame:
    """Whether each run passes, and whether all do."""
    return gates.gate_report(*gate_runs(found, thresholds, labels), found.conversations.select("run_id").distinct())


def report_tables(found: Evaluation) -> dict[str, DataFrame]:
    """The tables of a report, each with run_id: evaluation (a nested row for each conversation), focus, summary, conversations, turns, labels, errors, their scenarios, rejects, metric_errors, broken.

    Broken files belong to no run: their run_id is NO_RUN.
    """
    keys = conversation_keys(found.convo_evals)
    turn_rows = report.turn_rows(E.link_errors(found.evals, found.occurrences), found.quant)
    nested = turn_rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("turn_id", *[c for c in turn_rows.columns if c not in (*keys, "turn_id")]))).alias("turn_scores"))
    each = lambda df: df.where("run_id is not null")  # noqa: E731 - the sums over all runs are no run's
    summary = each(report.run_totals(found.convo_evals)).join(each(report.kpi(found.convo_evals)).drop("avg_turns", "conversations"), "run_id")
    out = {
        "evaluation": found.convo_evals.join(nested, keys, "left"), "focus": found.focus, "summary": summary, "conversations": report.convo_rows(found.convo_evals, found.conversations, found.scenarios), "turns": turn_rows,
        "labels": each(report.label_distributions(found.qual, found.evals)), "errors": found.errors, "error_scenarios": found.mappings, "rejects": found.rejects, "metric_errors": found.metric_errors,
    }
    return out if found.broken is None else out | {"broken": found.broken.select(F.lit(NO_RUN).alias("run_id"), "*")}


def write_runs(found: Evaluation, path: str) -> int:
    """Puts the report's tables of these runs in the place of what they had, all at once; the number of the commit. Other runs stay; broken files are those of the last job."""
    parts = found.conversations.select("run_id").distinct().unionByName(found.conversations.sparkSession.createDataFrame([(NO_RUN,)], "run_id string"))
    return written_runs(found.conversations.sparkSession, path).commit(report_tables(found), parts)


def written_runs(spark: SparkSession, path: str) -> Snapshots:
    """The tables below path; read(name) gives one as of the last commit."""
    return Snapshots(spark, path, "run_id", folders=False)
