"""Messages to turns, and what is rendered from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.constants import STOP_SIGNAL
from parley.functions.text import combine_knowledge, format_history


def conversation_keys(df: DataFrame) -> list[str]:
    """A table may hold many runs; then run_id leads every key."""
    return [k for k in ("run_id", "conversation_id") if k in df.columns]


def _in_order(df: DataFrame, order: str = "msg_pos"):
    return Window.partitionBy(*conversation_keys(df)).orderBy(order)


def assemble_turns(messages: DataFrame) -> DataFrame:
    """(keys, turn_id, user_msg, assistant_msg): each assistant message that follows a user message, numbered from 0.

    One shuffle by conversation serves both windows.
    """
    talk = messages.where(F.col("role").isin("simulated_user", "assistant"))
    w = _in_order(talk)
    paired = talk.withColumn("before", F.lag("role").over(w)).withColumn("user_msg", F.lag("content").over(w)).where("role = 'assistant' and before = 'simulated_user'")
    return paired.select(*conversation_keys(messages), (F.row_number().over(w) - 1).alias("turn_id"), "user_msg", F.col("content").alias("assistant_msg"))


def turn_counts(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    keys = conversation_keys(conversations)
    counts = turns.groupBy(*keys).agg(F.count("*").alias("n"))
    return conversations.select(*keys).join(counts, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("turns"))


def number_messages(messages: DataFrame) -> DataFrame:
    """turn_id of each message: the assistant messages before it."""
    w = _in_order(messages).rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("turn_id", F.coalesce(F.sum((F.col("role") == "assistant").cast("int")).over(w), F.lit(0)).cast("int"))


def truncate_at_stop(messages: DataFrame, max_turns: int) -> DataFrame:
    """Messages up to and with the first user message that holds the stop signal, and at most max_turns exchanges."""
    w = _in_order(messages).rowsBetween(Window.unboundedPreceding, -1)
    stop = ((F.col("role") == "simulated_user") & F.col("content").contains(STOP_SIGNAL)).cast("int")
    marked = number_messages(messages).withColumn("_stops", F.coalesce(F.max(stop).over(w), F.lit(0)))
    return marked.where((F.col("_stops") == 0) & (F.col("turn_id") < max_turns)).drop("_stops")


def conversation_history(turns: DataFrame) -> DataFrame:
    """(keys, history): the paired messages of a conversation in order, kept once."""
    keys = conversation_keys(turns)
    ordered = F.sort_array(F.collect_list(F.struct("turn_id", "user_msg", "assistant_msg")))
    pair = lambda t: F.array(
        F.struct(F.lit("simulated_user").alias("role"), t["user_msg"].alias("content")), F.struct(F.lit("assistant").alias("role"), t["assistant_msg"].alias("content"))
    )
    return turns.groupBy(*keys).agg(ordered.alias("t")).select(*keys, F.flatten(F.transform("t", pair)).alias("history"))


def history_prefix(history: Column, turn_id: Column) -> Column:
    """The paired messages up to and with a turn: a slice, not a copy per turn."""
    return F.slice(history, F.lit(1), (turn_id + 1) * 2)


def recent_context(messages: DataFrame, last: int = 6, chars: int = 200) -> DataFrame:
    """(keys, context): the last messages after the first one, labelled and cut."""
    keys = conversation_keys(messages)
    talk = messages.where(F.col("role").isin("simulated_user", "assistant"))
    first = Window.partitionBy(*keys).orderBy("msg_pos")
    ranked = messages.withColumn("_at", F.row_number().over(first)).where("_at > 1 and role in ('simulated_user', 'assistant')")
    ranked = ranked.withColumn("_back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("msg_pos")))).where(F.col("_back") <= last)
    line = F.concat(F.when(F.col("role") == "assistant", "AGENT").otherwise("CUSTOMER"), F.lit(": "), F.substring("content", 1, chars))
    lines = ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("msg_pos", line.alias("line")))).alias("l"))
    every = messages.select(*keys).distinct()
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return every.join(lines, keys, "left").select(*keys, F.coalesce(text, F.lit("(just started)")).alias("context"))


def judge_requests(turns: DataFrame, conversations: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row for each turn and turn metric: (keys, turn_id, metric, prompt).

    metrics: name, scope, template with slots {chat_history} {knowledge}
    {user_goal} {tool_calls}. It is a list of metrics, set by hand, hence small
    against the turns.
    """
    keys = conversation_keys(turns)
    told = turns.join(conversation_history(turns), keys).join(conversations.select(*keys, "goal", "knowledge"), keys, "left")
    rows = told.crossJoin(F.broadcast(metrics.where("scope = 'turn'").select(F.col("name").alias("metric"), "template")))
    calls = F.coalesce(F.col("tool_calls"), F.lit("[]")) if "tool_calls" in turns.columns else F.lit("[]")
    prompt = _fill(F.col("template"), format_history(history_prefix(F.col("history"), F.col("turn_id"))), combine_knowledge(F.col("knowledge")), F.col("goal"), calls)
    return rows.select(*keys, "turn_id", "metric", prompt.alias("prompt"))


def conversation_requests(turns: DataFrame, conversations: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row for each conversation and conversation metric, over the whole history."""
    keys = conversation_keys(conversations)
    told = conversations.select(*keys, "goal", "knowledge").join(conversation_history(turns), keys, "left")
    rows = told.crossJoin(F.broadcast(metrics.where("scope = 'conversation'").select(F.col("name").alias("metric"), "template")))
    return rows.select(*keys, "metric", _fill(F.col("template"), F.coalesce(format_history(F.col("history")), F.lit("")), combine_knowledge(F.col("knowledge")), F.col("goal"), F.lit("[]")).alias("prompt"))


def _fill(template: Column, history: Column, knowledge: Column, goal: Column, calls: Column) -> Column:
    """Slots are filled from one split of the template, so that text put in is never read as a slot."""
    parts = F.split(template, r"(?=\{(?:chat_history|knowledge|user_goal|tool_calls)\})|(?<=\{(?:chat_history|knowledge|user_goal|tool_calls)\})")
    slot = lambda p: F.when(p == "{chat_history}", history).when(p == "{knowledge}", knowledge).when(p == "{user_goal}", F.coalesce(goal, F.lit(""))).when(p == "{tool_calls}", calls).otherwise(p)
    return F.array_join(F.transform(parts, slot), "")


def select_metrics(requests: DataFrame, metrics_to_run: list[str] | None, custom: list[str] = ()) -> DataFrame:
    """Requests of the chosen metrics; none chosen means all, and custom metrics always run."""
    return requests if not metrics_to_run else requests.where(F.col("metric").isin(*metrics_to_run, *custom))


def parse_verdicts(responses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Judge replies (keys, turn_id, metric, response) as quant scores, qual scores and rejects. Verbosity is turned round."""
    v = F.from_json("response", "score INT, label STRING, reason STRING")
    parsed = responses.withColumn("v", v)
    same = [c for c in responses.columns if c != "response"]
    score = F.when(F.col("metric") == "verbosity", 6 - F.col("v.score")).otherwise(F.col("v.score")).cast("double")
    quant = parsed.where("v.score is not null").select(*same, score.alias("value"), F.coalesce("v.reason", F.lit("")).alias("reason"))
    qual = parsed.where("v.score is null and v.label is not null").select(*same, F.col("v.label").alias("value"), F.coalesce("v.reason", F.lit("")).alias("reason"))
    return quant, qual, parsed.where("v is null or (v.score is null and v.label is null)").drop("v")
