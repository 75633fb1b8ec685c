"""Tables of the report and the console summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley import constants as C
from parley.functions.tables import numbered
from parley.functions.text import score_label, truncate_reason
from parley.operators.turns import conversation_keys, number_messages


def for_each_run(rows: DataFrame, *by: str):
    """rows grouped by these columns; where rows have run_id, once for each run and once for all runs, whose run_id is null; a null run counts as one with an empty id, no rows give none. One shuffle of partial sums serves both."""
    if "run_id" not in rows.columns:
        return rows.groupBy(*by)
    rows = rows.withColumn("run_id", F.coalesce(F.col("run_id").cast("string"), F.lit("")))
    return rows.groupingSets([["run_id", *by], list(by)], "run_id", *by)


def _run(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c == "run_id"]


def run_totals(convo_evals: DataFrame) -> DataFrame:
    rows = for_each_run(convo_evals).agg(F.count("*").alias("conversations"), F.coalesce(F.sum("turns"), F.lit(0)).alias("turns"))
    return rows.withColumn("avg_turns", F.when(F.col("conversations") > 0, F.col("turns") / F.col("conversations")).otherwise(F.lit(0.0)))


def metric_averages(quant: DataFrame) -> DataFrame:
    return for_each_run(quant, "name", "scope").agg(F.avg("value").alias("average"))


def performance_metrics(quant: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """(run_id if there, name, title, average, low, high) over both scopes without values that were not computed; nothing for a run in which helpfulness was not measured.

    ranges (name, low, high) lists custom metrics; others go from 1 to 5.
    """
    means = for_each_run(quant.where(F.col("value") != C.SCORE_NOT_COMPUTED), "name").agg(F.avg("value").alias("average"))
    run = _run(means)
    # a row for each metric of a run, so its window is small
    shown = means.withColumn("_any", F.max(F.col("name") == "helpfulness").over(Window.partitionBy(*run))).where("_any").drop("_any")
    shown = shown.withColumn("title", F.initcap(F.replace("name", F.lit("_"), F.lit(" "))))
    if ranges is None:
        return shown.select(*run, "name", "title", "average", F.lit(1.0).alias("low"), F.lit(5.0).alias("high"))
    return shown.join(F.broadcast(ranges), "name", "left").select(*run, "name", "title", "average", F.coalesce("low", F.lit(1.0)).alias("low"), F.coalesce("high", F.lit(5.0)).alias("high"))


def overall_average(quant: DataFrame) -> DataFrame:
    """Mean of the built-in metrics' means, with its label."""
    means = for_each_run(quant.where(F.col("name").isin(C.TURN_METRICS)), "name").agg(F.avg("value").alias("m"))
    return means.groupBy(*_run(means)).agg(F.avg("m").alias("overall_average")).withColumn("label", score_label(F.col("overall_average")))


def _shares(counts: DataFrame, *by: str) -> DataFrame:
    """Counts by label with their share in percent of a run's, or of those of the same values of by."""
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*_run(counts), *by)) * 100)


def _label_counts(rows: DataFrame, *by: str) -> DataFrame:
    return for_each_run(rows, *by, "label").agg(F.count("*").alias("n"))


def failure_breakdown(evals: DataFrame) -> DataFrame:
    """Labels and their share in percent, without the outcomes of the system; no failure stays in."""
    return _shares(_label_counts(evals.where(~F.col("label").isin(C.SYSTEM_OUTCOMES))))


def failure_distribution(evals: DataFrame) -> DataFrame:
    return _shares(_label_counts(evals.where(~F.col("label").isin([*C.SYSTEM_OUTCOMES, C.NO_FAILURE]))))


def label_distributions(qual: DataFrame, evals: DataFrame) -> DataFrame:
    """(run_id if there, name, label, n, share) over both scopes. The behaviour metric is read from the turns, unless qual scores of the run have that name."""
    scored = _label_counts(qual.select(*_run(qual), "name", F.col("value").alias("label")), "name")
    own = _label_counts(evals.where(~F.col("label").isin([*C.SYSTEM_OUTCOMES, C.NO_FAILURE]))).withColumn("name", F.lit(C.BEHAVIOUR))
    run = _run(scored)
    taken = scored.where(F.col("name") == C.BEHAVIOUR).select(*[F.col(c).alias("_run") for c in run], F.col("name").alias("_name")).distinct()
    own = own.join(taken, F.col("run_id").eqNullSafe(F.col("_run")) if run else F.col("name") == F.col("_name"), "left_anti")
    return _shares(scored.unionByName(own.select(*scored.columns)), "name")


def conversation_labels(conversations: DataFrame, partitions: int | None = None) -> DataFrame:
    """(keys, label): Conversation 1, 2, ... in the order of the ids, for each run."""
    keys = conversation_keys(conversations)
    rows = numbered(conversations.select(*keys).distinct(), [F.col("conversation_id").asc()], "_place", keys[:-1], partitions)
    return rows.select(*keys, F.concat(F.lit("Conversation "), F.col("_place").cast("string")).alias("label"))


def turn_issues(evals: DataFrame, quant: DataFrame) -> DataFrame:
    """(keys, turn_id, issues): the real failure with the start of its reason, and metrics of at most 1."""
    keys = [*conversation_keys(evals), "turn_id"]
    low = quant.where("scope = 'turn' and value <= 1").groupBy(*keys).agg(F.array_sort(F.collect_list(F.concat("name", F.lit(" ("), F.format_number("value", 1), F.lit(")")))).alias("low"))
    real = F.when(F.col("label").isin(C.FAILURE_LABELS), F.array(F.concat("label", F.lit(": "), truncate_reason(F.col("reason")))))
    every = F.concat(F.coalesce(real, F.array().cast("array<string>")), F.coalesce("low", F.array().cast("array<string>")))
    return evals.join(low, keys, "left").select(*keys, F.when(F.size(every) == 0, "No issues detected").otherwise(F.array_join(every, "; ")).alias("issues"))


def convo_rows(convo_evals: DataFrame, conversations: DataFrame, scenarios: DataFrame) -> DataFrame:
    keys = conversation_keys(convo_evals)
    known = conversations.select(*keys, "scenario_id").join(scenarios.select("scenario_id", "goal", "user_profile"), "scenario_id", "left")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = convo_evals.join(known.withColumn("scenario_id", F.col("scenario_id").cast("string")), keys, "left")
    return rows.select(*keys, "turns", "goal_completion_score", "turn_success_ratio", "overall_agent_score", "evaluation_status", text("scenario_id"), text("goal"), text("user_profile"))


def turn_rows(evals: DataFrame, quant: DataFrame) -> DataFrame:
    """evals with each turn's scores as a sorted array of (name, value)."""
    keys = [*conversation_keys(evals), "turn_id"]
    scores = quant.where("scope = 'turn'").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("scores"))
    return evals.join(scores, keys, "left").withColumn("scores", F.coalesce("scores", F.array().cast("array<struct<name:string,value:double>>")))


def error_snippets(occurrences: DataFrame, messages: DataFrame, evals: DataFrame) -> DataFrame:
    """(unique_error_id, keys, turn_id, user_msg, assistant_msg, label): the transcript of each occurrence in a known conversation.

    A message's turn is the number of assistant messages before it; of a turn's
    user messages the last counts, and its only assistant message.
    """
    whole = conversation_keys(messages)
    keys = [*whole, "turn_id"]
    said = lambda role: F.max_by(F.when(F.col("role") == role, F.col("content")), F.when(F.col("role") == role, F.col("msg_pos")))
    words = number_messages(messages).groupBy(*keys).agg(said("simulated_user").alias("user_msg"), said("assistant").alias("assistant_msg"))
    known = messages.select(*whole).distinct()
    rows = occurrences.join(known, whole, "left_semi").join(words, keys, "left").join(evals.select(*keys, "label"), keys, "left")
    return rows.select("unique_error_id", *keys, F.coalesce("user_msg", F.lit("")).alias("user_msg"), F.coalesce("assistant_msg", F.lit("")).alias("assistant_msg"), F.coalesce("label", F.lit("")).alias("label"))


def error_rows(errors: DataFrame, occurrences: DataFrame) -> DataFrame:
    """errors with one row for each conversation that has them, and its turns; a frequent error is many rows, not one map. error_scenarios() has their scenarios."""
    keys = conversation_keys(occurrences)
    ids = [*keys[:-1], "unique_error_id"]
    each = occurrences.groupBy("unique_error_id", *keys).agg(F.array_sort(F.collect_set("turn_id")).alias("t"))
    return errors.join(each.select("unique_error_id", *keys, F.transform("t", lambda t: F.concat(F.lit("turn_"), t.cast("string"))).alias("turns")), ids, "left")


def kpi(convo_evals: DataFrame) -> DataFrame:
    done = (F.col("evaluation_status") == C.DONE).cast("double")
    return for_each_run(convo_evals).agg(F.avg("overall_agent_score").alias("mean_score"), F.avg(done).alias("pass_rate"), F.avg("turns").alias("avg_turns"), F.count("*").alias("conversations"))
