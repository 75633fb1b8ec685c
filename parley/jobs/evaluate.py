"""Whole jobs over the canonical tables, and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.tables import materialize
from parley.operators import gates, scoring
from parley.operators.turns import conversation_keys
from parley.sources.adapters import adapt, numbered_lines


def turn_evaluations(spark: SparkSession, sf: str, lines: DataFrame | None = None) -> DataFrame:
    lines = numbered_lines(spark, sf) if lines is None else lines
    return scoring.turn_labels(*(adapt(spark, sf, t, lines) for t in ("turns", "quant", "verdicts")))


def merged_labels(spark: SparkSession, sf: str, lines: DataFrame | None = None) -> DataFrame:
    """The labels of all turns, written once: jobs read them several times."""
    lines = numbered_lines(spark, sf) if lines is None else lines
    return materialize(scoring.merge_failures(turn_evaluations(spark, sf, lines), adapt(spark, sf, "tool_verdicts", lines)), "labels")


def evaluate(spark: SparkSession, sf: str, labels: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """Conversation evaluations: turns are labelled, tool-call verdicts merged, goals and ratios combined."""
    lines = numbered_lines(spark, sf) if lines is None else lines
    conversations = adapt(spark, sf, "conversations").select("conversation_id").distinct()
    counts = adapt(spark, sf, "turns", lines).groupBy("conversation_id").agg(F.count("*").alias("n"))
    counts = conversations.join(counts, "conversation_id", "left").select("conversation_id", F.coalesce("n", F.lit(0)).alias("turns"))
    goals = scoring.goal_scores(adapt(spark, sf, "goals")).drop("goal_completion_reason")
    return scoring.evaluate_conversations(merged_labels(spark, sf, lines) if labels is None else labels, counts, goals)


def gate(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(numeric failures, label failures) under one set of limits."""
    lines = numbered_lines(spark, sf)
    labels = merged_labels(spark, sf, lines)
    thresholds = spark.createDataFrame([("goal_completion", 1.0), ("helpfulness", 3.0), ("politeness", 2.0), ("unknown", 1.0)], "metric string, threshold double")
    sets = spark.createDataFrame([("tone", "rude"), ("outcome", "lost"), ("agent_behavior_failure", "unsafe action"), ("agent_behavior_failure", "false information")], "metric string, label string")
    numeric = gates.numeric_failures(gates.with_score_threshold(thresholds, 0.5), evaluate(spark, sf, labels, lines), adapt(spark, sf, "quant", lines))
    return numeric, gates.label_failures(sets, labels, adapt(spark, sf, "qual", lines))


def write_evaluation(convo_evals: DataFrame, turn_rows: DataFrame, path: str, run: dict[str, str], fmt: str = "json") -> None:
    """One nested row for each conversation, its turns in order, with the run's fields as columns."""
    keys = conversation_keys(convo_evals)
    nested = turn_rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("turn_id", *[c for c in turn_rows.columns if c not in (*keys, "turn_id")]))).alias("turn_scores"))
    rows = convo_evals.join(nested, keys, "left").withColumns({k: F.lit(v) for k, v in run.items()})
    rows.write.mode("overwrite").format(fmt).save(path)


def write_focus(focus: DataFrame, path: str) -> None:
    """A folder of scenarios for each focus set, below one for each run if there are many."""
    focus.write.mode("overwrite").partitionBy(*[c for c in focus.columns if c == "run_id"], "focus_set").json(path)


def write_report_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
