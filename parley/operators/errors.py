"""Failures grouped to unique errors and led back to scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley import constants as C
from parley.functions.graph import linked_groups
from parley.functions.tables import materialize, numbered
from parley.functions.text import normalise_reason
from parley.operators.report import for_each_run
from parley.operators.scoring import literal_map
from parley.operators.turns import conversation_keys


#: Weighted Jaccard similarity from which on two reasons have one root cause.
SIMILARITY = 0.6


def _run(df: DataFrame) -> list[str]:
    """run_id, where a table holds many runs: errors are found and numbered for each run."""
    return [k for k in conversation_keys(df) if k == "run_id"]


def failure_items(evals: DataFrame) -> DataFrame:
    """(keys, turn_id, label, reason, item) of the turns with a real failure."""
    item = F.concat(F.lit("Item "), F.col("conversation_id").cast("string"), F.lit("_"), F.col("turn_id").cast("string"), F.lit(f": {C.BEHAVIOUR} label and reason: "), "label", F.lit(": "), F.coalesce("reason", F.lit("")))
    return evals.where(F.col("label").isin(C.FAILURE_LABELS)).select(*conversation_keys(evals), "turn_id", "label", "reason", item.alias("item"))


def parse_occurrences(errors: DataFrame) -> DataFrame:
    """(run_id if there, unique_error_id, conversation_id, turn_id) from texts <conversation>_<turn>, split at the last underscore; other texts are dropped."""
    run = [c for c in errors.columns if c == "run_id"]
    rows = errors.select(*run, "unique_error_id", F.explode("occurrences").alias("o"))
    turn = F.regexp_extract("o", r"^([\s\S]*)_([\s\S]*)$", 2)
    return rows.select(*run, "unique_error_id", F.regexp_extract("o", r"^([\s\S]*)_([\s\S]*)$", 1).alias("conversation_id"), F.trim(turn).try_cast("int").alias("turn_id")).where("turn_id is not null")


def error_severity(category: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(C.LABEL_SEVERITY), F.lower(category)), F.lit("medium"))


def group_failures(evals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unique_errors, occurrences) by category and normalised reason, for each run.

    unique_errors: unique_error_id, category, description (the first reason),
    severity, n_occurrences. Occurrences stay one row each, so that one frequent
    error is no large array.
    """
    keys, run = conversation_keys(evals), _run(evals)
    items = failure_items(evals).withColumn("norm", normalise_reason(F.col("reason")))
    items = items.withColumn("unique_error_id", F.substring(F.sha2(F.concat_ws("\n", *run, "label", "norm"), 256), 1, 16))
    first = F.min(F.struct("conversation_id", "turn_id", "reason"))["reason"]
    errors = items.groupBy(*run, "unique_error_id", F.col("label").alias("category")).agg(first.alias("description"), F.count("*").alias("n_occurrences"))
    return errors.withColumn("severity", error_severity(F.col("category"))), items.select("unique_error_id", *keys, "turn_id")


def link_errors(evals: DataFrame, occurrences: DataFrame) -> DataFrame:
    """evals with the sorted ids of each turn's errors; an empty list for none."""
    keys = [*conversation_keys(evals), "turn_id"]
    ids = occurrences.groupBy(*keys).agg(F.array_sort(F.collect_set("unique_error_id")).alias("unique_error_ids"))
    return evals.join(ids, keys, "left").withColumn("unique_error_ids", F.coalesce("unique_error_ids", F.array().cast("array<string>")))


def error_order(errors: DataFrame) -> list[Column]:
    rank = F.coalesce(F.try_element_at(literal_map(C.SEVERITY_RANK), F.lower("severity")), F.lit(len(C.SEVERITY_RANK)))
    return [rank.asc(), F.desc("n_occurrences"), (F.col("pos") if "pos" in errors.columns else F.col("unique_error_id")).asc()]


def error_scenarios(occurrences: DataFrame, conversations: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(run_id if there, unique_error_id, scenario_id): the known scenarios in which an error occurs, one row each."""
    keys, run = conversation_keys(occurrences), _run(occurrences)
    at = occurrences.select("unique_error_id", *keys).distinct().join(conversations.select(*keys, "scenario_id"), keys)
    return at.select(*run, "unique_error_id", "scenario_id").distinct().join(scenarios.select("scenario_id").distinct(), "scenario_id").select(*run, "unique_error_id", "scenario_id")


def numbered_errors(errors: DataFrame, occurrences: DataFrame, pairs: DataFrame) -> DataFrame:
    """(run_id if there, error_index, unique_error_id, description, severity, n_occurrences, n_scenarios) of the errors of error_scenarios().

    Order: severity, number of all occurrences, input order; each run counts
    from 1. Reasons are free texts, so errors may be many: they are numbered by
    a range sort.
    """
    run = _run(occurrences)
    ids = [*run, "unique_error_id"]
    sizes = occurrences.groupBy(*ids).agg(F.count("*").alias("n_occurrences"))
    rows = errors.drop("n_occurrences").join(sizes, ids).join(pairs.groupBy(*ids).agg(F.count("*").alias("n_scenarios")), ids)
    rows = numbered(rows, error_order(rows), "error_index", run)
    return rows.select(*run, F.col("error_index").cast("int").alias("error_index"), "unique_error_id", "description", "severity", "n_occurrences", "n_scenarios")


def error_scenario_mappings(errors: DataFrame, occurrences: DataFrame, conversations: DataFrame, scenarios: DataFrame) -> DataFrame:
    """numbered_errors() with one row for each scenario_id of an error."""
    pairs = error_scenarios(occurrences, conversations, scenarios)
    return numbered_errors(errors, occurrences, pairs).drop("n_scenarios").join(pairs, [*_run(occurrences), "unique_error_id"])


def focus_sets(mappings: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Scenario rows for each error_<index>, and for all_failures together; for each run, if there are many."""
    run = [c for c in mappings.columns if c == "run_id"]
    one = mappings.select(*run, F.concat(F.lit("error_"), F.col("error_index").cast("string")).alias("focus_set"), "scenario_id")
    every = one.select(*run, F.lit("all_failures").alias("focus_set"), "scenario_id").distinct()
    return one.unionByName(every).join(scenarios.dropDuplicates(["scenario_id"]), "scenario_id")


def top_errors(errors: DataFrame, occurrences: DataFrame, conversations: DataFrame, k: int = 5) -> DataFrame:
    """The k worst errors, of each run if there are many, with how many conversations and scenarios they touch."""
    run = _run(errors)
    if run:  # each task keeps k of a run before the shuffle
        best = errors.withColumn("_place", F.row_number().over(Window.partitionBy(*run).orderBy(*error_order(errors)))).where(F.col("_place") <= k).drop("_place")
    else:
        best = errors.orderBy(*error_order(errors)).limit(k)
    ids, keys = [*run, "unique_error_id"], conversation_keys(occurrences)
    at = occurrences.join(best.select(*ids), ids).join(conversations.select(*keys, "scenario_id"), keys, "left")
    touched = at.groupBy(*ids).agg(F.countDistinct(*keys).alias("conversations"), F.countDistinct("scenario_id").alias("scenarios"))
    return best.join(touched, ids, "left").select(*ids, "category", "severity", "n_occurrences", F.coalesce("conversations", F.lit(0)).alias("conversations"), F.coalesce("scenarios", F.lit(0)).alias("scenarios"))


def judge_agreement(evals: DataFrame, golden: DataFrame) -> DataFrame:
    """(expected, conversations, agreed, rate), for each run and for all. golden has (keys, pos, label) for messages.

    A conversation's expected label is its first real one. It agrees if a turn
    has that label, or, if none is expected, if no turn has a failure.
    """
    real = F.when(F.col("label") != C.NO_FAILURE, F.col("label"))
    keys = conversation_keys(golden)
    expected = golden.groupBy(*keys).agg(F.coalesce(F.min_by(real, F.when(real.isNotNull(), F.col("pos"))), F.lit(C.NO_FAILURE)).alias("expected"))
    found = evals.groupBy(*keys).agg(F.collect_set("label").alias("labels"))
    rows = expected.join(found, keys, "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
    none = ~F.arrays_overlap("labels", F.array(*[F.lit(x) for x in C.CONVERSATION_LABELS]))
    agreed = F.when(F.col("expected") == C.NO_FAILURE, none).otherwise(F.array_contains("labels", F.col("expected")))
    return for_each_run(rows, "expected").agg(F.count("*").alias("conversations"), F.count_if(agreed).alias("agreed")).withColumn("rate", F.col("agreed") / F.col("conversations"))


def reason_links(reasons: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity): pairs of reasons (id, scope, norm) of one scope whose weighted Jaccard similarity is at least that.

    A word weighs the logarithm of how rare it is among the scope's reasons.
    Words are put in one order, the rarest first. Two reasons that are similar
    enough share a word among those that come before the last words of less
    than similarity of a reason's weight, so only these are joined; most of
    them are rare, so pairs grow with the reasons. What meets is verified on
    all words. Reasons without words link with nothing.
    """
    words = reasons.select("id", "scope", F.explode(F.array_distinct(F.filter(F.split("norm", " "), lambda w: w != ""))).alias("word"))
    many = reasons.groupBy("scope").agg(F.count("*").alias("reasons"))
    weights = words.groupBy("scope", "word").agg(F.count("*").alias("df")).join(many, "scope").select("scope", "word", F.log(1 + F.col("reasons") / F.col("df")).alias("weight"))
    # negative weights sort the rarest first, and words of one weight by themselves
    listed = words.join(weights, ["scope", "word"]).groupBy("id", "scope").agg(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("less"), "word"))).alias("words"))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s - x["less"])
    listed = materialize(listed.withColumn("total", add(F.col("words"))), "reason-words")
    # a word belongs to the prefix if the weight from it on is still enough
    behind = lambda i: add(F.slice("words", i + 1, F.size("words")))
    prefix = listed.select("id", "scope", "words", "total", F.posexplode("words").alias("i", "w")).where(behind(F.col("i")) >= similarity * F.col("total") - 1e-9).select("id", "scope", F.col("w.word").alias("word"), "total", "words")
    left, right = (prefix.select("scope", "word", *(F.col(c).alias(f"{side}_{c}") for c in ("id", "total", "words"))) for side in ("l", "r"))
    near = left.join(right, ["scope", "word"]).where((F.col("l_id") < F.col("r_id")) & (F.least("l_total", "r_total") >= similarity * F.greatest("l_total", "r_total") - 1e-9))
    common = add(F.array_intersect("l_words", "r_words"))
    found = near.withColumn("similarity", common / (F.col("l_total") + F.col("r_total") - common)).where(F.col("similarity") >= similarity - 1e-9)
    return found.groupBy(F.col("l_id").alias("a"), F.col("r_id").alias("b")).agg(F.max("similarity").alias("similarity"))


def root_causes(evals: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """group_failures(), with errors of one category merged whose reasons are reworded: linked by reason_links(), directly or over others.

    A merged error has the id, description and severity of its most frequent
    part, the least id of several, and the occurrences of all. n_reasons: how
    many different reasons it has.
    """
    errors, occurrences = group_failures(evals)
    run = _run(evals)
    errors = materialize(errors, "exact-errors")
    scope = F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in run], F.col("category"))
    reasons = errors.select(F.col("unique_error_id").alias("id"), scope.alias("scope"), normalise_reason(F.coalesce("description", F.lit(""))).alias("norm"))
    groups = linked_groups(reason_links(reasons, similarity).select("a", "b"))
    placed = errors.join(groups.withColumnRenamed("node", "unique_error_id"), "unique_error_id", "left").withColumn("group", F.coalesce("component", "unique_error_id")).drop("component")
    first = F.min(F.struct((-F.col("n_occurrences")).alias("less"), "unique_error_id", "description", "severity"))
    merged = materialize(placed.groupBy(*run, "group", "category").agg(first.alias("f"), F.sum("n_occurrences").alias("n_occurrences"), F.count("*").alias("n_reasons")), "root-causes")
    names = placed.select(F.col("unique_error_id").alias("exact"), "group").join(merged.select("group", "f.unique_error_id"), "group").select("exact", "unique_error_id")
    moved = occurrences.withColumnRenamed("unique_error_id", "exact").join(names, "exact").select("unique_error_id", *[c for c in occurrences.columns if c != "unique_error_id"])
    return merged.select(*run, "f.unique_error_id", "category", "f.description", "n_occurrences", "f.severity", "n_reasons"), moved
