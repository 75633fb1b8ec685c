"""Scores of turns and conversations. Every aggregation is partial before its shuffle."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley import constants as C
from parley.operators.turns import conversation_keys


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*d.items())])


def severity_rank(label: Column) -> Column:
    """0 is worst; labels without a severity rank last."""
    return F.coalesce(F.try_element_at(literal_map({k: C.SEVERITY_RANK[s] for k, s in C.LABEL_SEVERITY.items()}), F.lower(label)), F.lit(C.UNKNOWN_RANK))


def turn_scores(quant: DataFrame) -> DataFrame:
    """(keys, turn_id, turn_score, below): mean of the turn's values, and whether any is under its threshold; scores without a maximum are no known metric."""
    low = F.col("value") < C.FAILURE_SHARE * F.col("score_max")
    return quant.where("turn_id is not null").groupBy(*conversation_keys(quant), "turn_id").agg(F.avg("value").alias("turn_score"), F.coalesce(F.bool_or(low), F.lit(False)).alias("below"))


def turn_labels(turns: DataFrame, quant: DataFrame, verdicts: DataFrame, behaviour_enabled: bool = True) -> DataFrame:
    """(keys, turn_id, turn_score, label, reason): the behaviour verdict where a metric is low, else the skipped label."""
    keys = [*conversation_keys(turns), "turn_id"]
    rows = turns.select(*keys).join(turn_scores(quant), keys, "left").join(verdicts.select(*keys, F.col("label").alias("v_label"), F.col("reason").alias("v_reason")), keys, "left")
    use = F.coalesce("below", F.lit(False)) & F.lit(behaviour_enabled) & F.col("v_label").isNotNull()
    return rows.select(
        *keys, F.coalesce("turn_score", F.lit(C.SCORE_NOT_COMPUTED)).alias("turn_score"), F.when(use, F.col("v_label")).otherwise(C.SKIPPED).alias("label"),
        F.when(use, F.coalesce("v_reason", F.lit(""))).otherwise(C.SKIPPED_REASON).alias("reason"),
    )


def merge_failures(evals: DataFrame, verdicts: DataFrame, prefix: str = "") -> DataFrame:
    """evals with a second verdict (keys, turn_id, label, reason) merged in.

    A verdict that is no failure changes nothing. A failure replaces a label
    that is none, or one of lower severity; otherwise its reason is appended.
    A label that comes without a reason has an empty one, without the prefix.
    """
    keys = [*conversation_keys(evals), "turn_id"]
    new = verdicts.where(~F.col("label").isin(C.SKIP_OUTCOMES)).select(*keys, F.col("label").alias("n_label"), F.concat(F.lit(prefix), F.coalesce("reason", F.lit(""))).alias("n_reason"))
    rows = evals.join(new, keys, "left")
    take = F.col("label").isin(C.SKIP_OUTCOMES) | (severity_rank(F.col("n_label")) < severity_rank(F.col("label")))
    reason = F.when(F.col("n_label").isNull(), F.col("reason")).when(take, F.when(F.col("n_reason") == prefix, "").otherwise(F.col("n_reason"))).otherwise(F.concat_ws("\n", "reason", "n_reason"))
    return rows.withColumn("reason", reason).withColumn("label", F.when(F.col("n_label").isNotNull() & take, F.col("n_label")).otherwise(F.col("label"))).drop("n_label", "n_reason")


def is_failure(label: Column) -> Column:
    return ~label.isin(C.SKIP_OUTCOMES)


def success_ratio(turns: Column, failures: Column) -> Column:
    return F.when(turns > 0, (turns - failures) / turns).otherwise(F.lit(1.0))


def overall_score(ratio: Column, goal: Column) -> Column:
    return F.when(goal < 0, ratio).otherwise(ratio * C.TURN_SUCCESS_WEIGHT + goal * C.GOAL_WEIGHT)


def evaluation_status(score: Column) -> Column:
    return F.when(score == 1.0, C.DONE).when(score >= C.PARTIAL_FROM, C.PARTIAL).otherwise(C.FAILED)


def goal_scores(convo_scores: DataFrame) -> DataFrame:
    """(keys, goal_completion_score, goal_completion_reason): the first goal result of each conversation, by pos."""
    first = convo_scores.where(F.col("name") == C.GOAL).groupBy(*conversation_keys(convo_scores)).agg(F.min_by(F.struct("value", "reason"), "pos").alias("g"))
    return first.select(*conversation_keys(convo_scores), F.col("g.value").alias("goal_completion_score"), F.coalesce("g.reason", F.lit("")).alias("goal_completion_reason"))


def evaluate_conversations(evals: DataFrame, counts: DataFrame, goals: DataFrame) -> DataFrame:
    """One row for each conversation of counts (keys, turns): goal, success ratio, overall score and status.

    counts holds the turns of the transcript; turns whose evaluation is
    missing count as successes.
    """
    keys = conversation_keys(counts)
    failures = evals.groupBy(*keys).agg(F.count_if(is_failure(F.col("label"))).alias("failures"))
    rows = counts.join(failures, keys, "left").join(goals, keys, "left")
    rows = rows.withColumn("goal_completion_score", F.coalesce(F.col("goal_completion_score").cast("double"), F.lit(C.SCORE_NOT_COMPUTED)))
    rows = rows.withColumn("turn_success_ratio", success_ratio(F.col("turns"), F.coalesce("failures", F.lit(0))))
    rows = rows.withColumn("overall_agent_score", overall_score(F.col("turn_success_ratio"), F.col("goal_completion_score")))
    return rows.withColumn("evaluation_status", evaluation_status(F.col("overall_agent_score"))).select(*keys, "turns", "goal_completion_score", "turn_success_ratio", "overall_agent_score", "evaluation_status")
