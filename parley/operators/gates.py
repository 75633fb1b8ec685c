"""Quality gates over evaluated runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley import constants as C
from parley.operators.report import for_each_run
from parley.operators.turns import conversation_keys


def numeric_failures(thresholds: DataFrame, convo_evals: DataFrame, quant: DataFrame) -> DataFrame:
    """(metric, keys, score, threshold) of the scores under their threshold.

    overall_score and goal_completion are read from the conversation, any other
    metric from its first conversation value that was computed, or else from
    the mean of its computed turn values. What was not computed passes.
    thresholds is a list set by hand; only its metrics are aggregated.
    """
    keys = conversation_keys(convo_evals)
    wanted = F.broadcast(thresholds.select(F.col("metric"), "threshold"))
    special = convo_evals.select(*keys, F.explode(F.array(
        F.struct(F.lit("overall_score").alias("metric"), F.col("overall_agent_score").alias("score")),
        F.struct(F.lit(C.GOAL).alias("metric"), F.when(F.col("goal_completion_score") >= 0, F.col("goal_completion_score")).alias("score")),
    )).alias("s")).select(*keys, "s.*")
    other = quant.where((F.col("value") >= 0) & ~F.col("name").isin("overall_score", C.GOAL)).withColumnRenamed("name", "metric").join(wanted.select("metric"), "metric", "left_semi")
    whole = F.min_by(F.when(F.col("scope") == "conversation", F.col("value")), F.when(F.col("scope") == "conversation", F.col("pos")))
    mean = F.avg(F.when(F.col("scope") == "turn", F.col("value")))
    measured = other.groupBy(*keys, "metric").agg(F.coalesce(whole, mean).alias("score"))
    return special.unionByName(measured).join(wanted, "metric").where("score < threshold").select("metric", *keys, "score", "threshold")


def label_failures(label_sets: DataFrame, evals: DataFrame, qual: DataFrame) -> DataFrame:
    """(metric, keys, place, label) of the labels that a gate names; place is a turn number or conversation.

    The behaviour metric reads the turn's own label; of other metrics the first
    qual score of a turn counts. Outcomes of the system itself are left out.
    """
    keys = conversation_keys(evals)
    named = F.broadcast(label_sets.select("metric", "label").distinct())
    whole = qual.where("scope = 'conversation'").select(F.col("name").alias("metric"), *keys, F.lit("conversation").alias("place"), F.col("value").alias("label"))
    own = evals.select(F.lit(C.BEHAVIOUR).alias("metric"), *keys, F.col("turn_id").cast("string").alias("place"), "label")
    turn = qual.where((F.col("scope") == "turn") & (F.col("name") != C.BEHAVIOUR)).groupBy("name", *keys, "turn_id").agg(F.min_by("value", "pos").alias("label"))
    turn = turn.select(F.col("name").alias("metric"), *keys, F.col("turn_id").cast("string").alias("place"), "label")
    every = whole.unionByName(own).unionByName(turn).where(~F.col("label").isin(C.SYSTEM_OUTCOMES))
    return every.join(named, ["metric", "label"], "left_semi").select("metric", *keys, "place", "label")


def with_score_threshold(thresholds: DataFrame, score_threshold: float | None) -> DataFrame:
    """thresholds, with the older single threshold for overall_score where none is set."""
    if score_threshold is None:
        return thresholds
    spark = thresholds.sparkSession
    old = spark.createDataFrame([("overall_score", float(score_threshold))], "metric string, threshold double")
    return thresholds.select("metric", "threshold").unionByName(old.join(thresholds, "metric", "left_anti"))


def gate_report(numeric: DataFrame, label: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Failures of each gate and whether the run passes: one row, or with runs (run_id) one for each of them, and one for all together whose run_id is null."""
    if runs is None:
        a, b = numeric.agg(F.count("*").alias("numeric_failures")), label.agg(F.count("*").alias("label_failures"))
        return a.crossJoin(b).withColumn("passed", (F.col("numeric_failures") == 0) & (F.col("label_failures") == 0))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    each = runs.select("run_id", zero.alias("n"), zero.alias("l")).unionByName(numeric.select("run_id", one.alias("n"), zero.alias("l"))).unionByName(label.select("run_id", zero.alias("n"), one.alias("l")))
    rows = for_each_run(each).agg(F.sum("n").alias("numeric_failures"), F.sum("l").alias("label_failures"))
    return rows.withColumn("passed", (F.col("numeric_failures") == 0) & (F.col("label_failures") == 0))
