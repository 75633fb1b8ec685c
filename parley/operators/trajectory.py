"""Expected against actual tool calls: by array functions within one row per conversation, or by joins of long rows for conversations of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley import constants as C
from parley.functions.tables import materialize
from parley.operators.scoring import merge_failures
from parley.operators.turns import conversation_keys

CALL = "struct<name:string,arguments:string,entries:array<string>>"
PLACED = "struct<at:bigint,name:string,arguments:string,entries:array<string>>"
NAMES = "array<string>"


def entries(arguments: Column) -> Column:
    """A JSON object's entries as texts, key and canonical value."""
    members = F.map_entries(F.try_parse_json(F.coalesce(arguments, F.lit("{}"))).cast("map<string,variant>"))
    return F.transform(members, lambda e: F.concat(e["key"], F.lit("\u0000"), F.to_json(e["value"])))


def prepare_calls(calls: Column, expected: bool = False) -> Column:
    """Calls (name, arguments, and arg_match_mode of expected ones) with canonical arguments and their entries."""

    def one(c: Column) -> Column:
        fields = [c["name"].alias("name"), F.coalesce(F.to_json(F.try_parse_json(c["arguments"])), F.lit("{}")).alias("arguments"), entries(c["arguments"]).alias("entries")]
        return F.struct(*fields, F.coalesce(c["arg_match_mode"], F.lit("ignore")).alias("mode")) if expected else F.struct(*fields)

    return F.transform(F.coalesce(calls, F.array().cast("array<struct<name:string,arguments:string,arg_match_mode:string>>" if expected else "array<struct<name:string,arguments:string>>")), one)


def args_match(actual: Column, expected: Column) -> Column:
    """Ignored, equal as objects, or every expected entry present with an equal value."""
    return (
        F.when(expected["mode"] == "ignore", True)
        .when(expected["mode"] == "exact", actual["arguments"] == expected["arguments"])
        .when(expected["mode"] == "partial", F.size(F.array_except(expected["entries"], actual["entries"])) == 0)
        .otherwise(False)
    )


def call_matches(actual: Column, expected: Column) -> Column:
    return (actual["name"] == expected["name"]) & args_match(actual, expected)


def greedy(actual: Column, expected: Column, give: str = "name", call: str = CALL, kind: str = "string") -> Column:
    """(missing, extra): each expected call takes the first actual one left that matches. give is the field that tells of a call, kind its type, call that of the actual ones."""
    start = F.struct(actual.cast(f"array<{call}>").alias("left"), F.array().cast(f"array<{kind}>").alias("missing"))

    def step(s: Column, e: Column) -> Column:
        at = F.array_position(F.transform(s["left"], lambda a: F.coalesce(call_matches(a, e), F.lit(False))), True).cast("int")
        rest = F.concat(F.slice(s["left"], F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(s["left"], at + 1, F.size(s["left"])))
        return F.struct(F.when(at > 0, rest).otherwise(s["left"]).alias("left"), F.when(at > 0, s["missing"]).otherwise(F.concat(s["missing"], F.array(e[give]))).alias("missing"))

    return F.aggregate(expected, start, step, lambda s: F.struct(s["missing"].alias("missing"), F.transform(s["left"], lambda a: a[give]).alias("extra")))


def _names(calls: Column) -> Column:
    return F.transform(calls, lambda c: c["name"])


def extra_label(extra: Column, expected: Column) -> Column:
    """Extra calls of expected names are repetitions; any other disobeys."""
    return F.when(F.forall(extra, lambda n: F.array_contains(_names(expected), n)), C.REPETITION).otherwise(C.DISOBEY)


def match_trajectories(pairs: DataFrame, actual: str = "actual", expected: str = "expected", mode: str = "match_mode") -> DataFrame:
    """pairs with matched, failure_label, missing, extra and ordering_issues.

    Modes: unordered (same calls), contains (none missing), within (none beyond
    the expected, which may repeat), strict (same calls in the same order).
    """
    rows = pairs.withColumn("_a", prepare_calls(F.col(actual))).withColumn("_e", prepare_calls(F.col(expected), True))
    rows = rows.withColumn("_g", greedy(F.col("_a"), F.col("_e")))
    a, e, m = F.col("_a"), F.col("_e"), F.coalesce(F.col(mode), F.lit("unordered"))
    beyond = _names(F.filter(a, lambda x: ~F.exists(e, lambda y: F.coalesce(call_matches(x, y), F.lit(False)))))
    places = F.sequence(F.lit(0), F.size(a) - 1)
    at = lambda c, i: F.get(c, i)
    swapped = F.filter(places, lambda i: at(a, i)["name"] != at(e, i)["name"])
    order = F.transform(swapped, lambda i: F.concat(F.lit("position "), i.cast("string"), F.lit(": expected "), at(e, i)["name"], F.lit(", got "), at(a, i)["name"]))
    wrong = F.filter(places, lambda i: (at(a, i)["name"] == at(e, i)["name"]) & ~F.coalesce(args_match(at(a, i), at(e, i)), F.lit(False)))
    false_args = F.exists(wrong, lambda i: at(e, i)["mode"] != "partial")
    none = F.array().cast(NAMES)
    same_length = F.size(a) == F.size(e)
    missing, extra = F.col("_g.missing"), F.col("_g.extra")
    unequal = F.when(F.size(missing) > 0, C.DISOBEY).when(F.size(extra) > 0, extra_label(extra, e))
    strict_label = F.when(~same_length, F.coalesce(unequal, F.lit(C.DISOBEY))).when(F.size(order) > 0, C.DISOBEY).when(false_args, C.FALSE_INFORMATION).when(F.size(wrong) > 0, C.LACK)
    label = (
        F.when(F.size(e) == 0, F.lit(None).cast("string"))
        .when(m == "within", F.when(F.size(beyond) > 0, extra_label(beyond, e)))
        .when(~m.isin("unordered", "contains", "strict"), C.DISOBEY)
        .when(F.size(a) == 0, C.DISOBEY)
        .when(m == "strict", strict_label)
        .when(m == "contains", F.when(F.size(missing) > 0, C.DISOBEY))
        .otherwise(unequal)
    )
    known = F.size(e) > 0
    out = rows.withColumn("failure_label", label).withColumn("matched", F.col("failure_label").isNull())
    diagnosed = known & (m.isin("unordered", "contains") | ((m == "strict") & (~same_length | (F.size(a) == 0))))
    out = out.withColumn("missing", F.when(diagnosed, missing).otherwise(none))
    out = out.withColumn("extra", F.when(known & (m == "within"), beyond).when(diagnosed & (m != "contains"), extra).otherwise(none))
    out = out.withColumn("ordering_issues", F.when(known & (m == "strict") & same_length & (F.size(a) > 0), order).otherwise(none))
    return out.drop("_a", "_e", "_g")


def actual_calls(calls: DataFrame) -> DataFrame:
    """(keys, actual): the calls of a conversation in turn order."""
    keys = conversation_keys(calls)
    ordered = F.sort_array(F.collect_list(F.struct("turn_id", "call_pos", "name", "arguments")))
    return calls.groupBy(*keys).agg(F.transform(ordered, lambda c: F.struct(c["name"].alias("name"), c["arguments"].alias("arguments"))).alias("actual"))


def expected_calls(scenarios: DataFrame) -> DataFrame:
    """(scenario_id, expected, match_mode) from the first tool-call assertion of each scenario that has one."""
    first = F.get(F.filter("assertions", lambda a: a["type"] == "tool_calls"), 0)
    return scenarios.withColumn("a", first).where("a is not null").select("scenario_id", F.col("a.expected").alias("expected"), F.coalesce("a.match_mode", F.lit("unordered")).alias("match_mode"))


def check_trajectories(conversations: DataFrame, scenarios: DataFrame, calls: DataFrame) -> DataFrame:
    """Results of the conversations whose scenario expects calls. Scenarios may be many, so Spark picks the join by size."""
    keys = conversation_keys(conversations)
    rows = conversations.select(*keys, "scenario_id").join(expected_calls(scenarios), "scenario_id").join(actual_calls(calls), keys, "left")
    return match_trajectories(rows)


def attribute_failures(results: DataFrame, calls: DataFrame, evals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evals with the failures merged in, their qual scores). A failure goes to the last turn with calls, else to the last evaluated turn."""
    keys = conversation_keys(evals)
    last_call = calls.groupBy(*keys).agg(F.max("turn_id").alias("called"))
    last_turn = evals.groupBy(*keys).agg(F.max("turn_id").alias("evaluated"))
    failed = results.where(~F.col("matched")).join(last_call, keys, "left").join(last_turn, keys)
    reason = F.concat_ws("; ", F.when(F.size("missing") > 0, F.concat(F.lit("missing: "), F.array_join("missing", ", "))), F.when(F.size("extra") > 0, F.concat(F.lit("extra: "), F.array_join("extra", ", "))), F.when(F.size("ordering_issues") > 0, F.array_join("ordering_issues", ", ")))
    at = failed.select(*keys, F.coalesce("called", "evaluated").alias("turn_id"), F.col("failure_label").alias("label"), reason.alias("reason"))
    at = at.join(evals.select(*keys, "turn_id"), [*keys, "turn_id"], "left_semi")
    quals = at.select(*keys, "turn_id", F.lit(C.BEHAVIOUR).alias("name"), F.lit("turn").alias("scope"), F.col("label").alias("value"), F.concat(F.lit("[Trajectory] "), "reason").alias("reason"))
    return merge_failures(evals, at, "[Trajectory] "), quals


def _unmatched(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side, at, name): expected calls without an actual one (side missing) and actual calls without an expected one (extra), by greedy().

    Only calls of one name compete, so each name of a conversation is matched by
    itself. If its expected calls are all compared by name, or all by equal
    arguments, the n-th of them takes the n-th actual call of the same kind:
    a join. Only names with partial or mixed comparisons go through arrays.
    """
    one = [*keys, "name"]
    kind = F.when(F.bool_and(F.col("mode") == "ignore"), "name").when(F.bool_and(F.col("mode") == "exact"), "arguments").otherwise("array")
    kinds = expected.groupBy(*one).agg(kind.alias("kind"))
    sides = {}
    for side, rows in (("missing", expected), ("extra", actual)):
        rows = rows.join(kinds, one, "left").withColumn("key", F.when(F.col("kind") == "arguments", F.col("arguments")).otherwise(""))
        sides[side] = rows.withColumn("n", F.row_number().over(Window.partitionBy(*one, "key").orderBy("at")))
    joined = {side: rows.where("kind is null or kind <> 'array'") for side, rows in sides.items()}
    on = [*one, "key", "n"]
    left = joined["missing"].join(joined["extra"].select(*on), on, "left_anti").select(*keys, F.lit("missing").alias("side"), "at", "name")
    right = joined["extra"].join(joined["missing"].select(*on), on, "left_anti").select(*keys, F.lit("extra").alias("side"), "at", "name")
    listed = {side: rows.where("kind = 'array'") for side, rows in sides.items()}
    calls = lambda side, *more: F.sort_array(F.collect_list(F.struct("at", "name", "arguments", "entries", *more)))
    groups = listed["missing"].groupBy(*one).agg(calls("missing", "mode").alias("e")).join(listed["extra"].groupBy(*one).agg(calls("extra").alias("a")), one, "left")
    none = F.array().cast(f"array<{PLACED}>")
    found = groups.withColumn("g", greedy(F.coalesce("a", none), F.col("e"), "at", PLACED, "bigint")).select(*one, "g.*")
    rest = [found.select(*keys, F.lit(side).alias("side"), F.explode(side).alias("at"), "name") for side in ("missing", "extra")]
    return left.unionByName(right).unionByName(rest[0]).unionByName(rest[1])


def match_long(modes: DataFrame, expected: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, unmatched) as match_trajectories(), for conversations of any number of calls: they stay rows.

    modes: (keys, match_mode), one row for each conversation. expected: (keys,
    at, name, arguments, arg_match_mode). calls: (keys, turn_id, call_pos, name,
    arguments). results: keys, match_mode, matched, failure_label, n_missing,
    n_extra, n_ordering_issues. unmatched: keys, side (missing or extra), at,
    name, whether or not the mode asks for them. Calls without a name match
    nothing. Conversations without calls or expected calls are judged too.
    """
    keys = conversation_keys(modes)
    canonical = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.lit("{}"))
    wanted = expected.select(*keys, F.col("at").cast("long").alias("at"), "name", canonical.alias("arguments"), entries(F.col("arguments")).alias("entries"), F.coalesce("arg_match_mode", F.lit("ignore")).alias("mode"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("turn_id", "call_pos")) - 1
    done = calls.join(modes.select(*keys), keys, "left_semi").select(*keys, place.cast("long").alias("at"), "name", canonical.alias("arguments"), entries(F.col("arguments")).alias("entries"))
    wanted, done = materialize(wanted, "expected-calls"), materialize(done, "actual-calls")
    unmatched = materialize(_unmatched(wanted, done, keys), "unmatched-calls")
    names = wanted.select(*keys, "name").distinct().withColumn("known", F.lit(True))

    def told(rows: DataFrame, prefix: str) -> DataFrame:
        """How many rows a conversation has, and whether all have expected names."""
        return rows.join(names, [*keys, "name"], "left").groupBy(*keys).agg(F.count("*").alias(f"n_{prefix}"), F.bool_and(F.coalesce("known", F.lit(False))).alias(f"known_{prefix}"))

    pair = done.select(*keys, "at", *(F.col(c).alias(f"a_{c}") for c in ("name", "arguments", "entries"))).join(wanted, [*keys, "at"])
    a, e = F.struct(F.col("a_arguments").alias("arguments"), F.col("a_entries").alias("entries")), F.struct("arguments", "entries", "mode")
    wrong = (F.col("a_name") == F.col("name")) & ~F.coalesce(args_match(a, e), F.lit(False))
    same = pair.groupBy(*keys).agg(F.count_if(F.col("a_name") != F.col("name")).alias("swapped"), F.count_if(wrong & (F.col("mode") != "partial")).alias("false_args"), F.count_if(wrong & (F.col("mode") == "partial")).alias("partial_args"))
    other = [F.col("w.name") == F.col("d.name"), args_match(F.struct("d.arguments", "d.entries"), F.struct("w.arguments", "w.entries", "w.mode")), *(F.col(f"w.{k}") == F.col(f"d.{k}") for k in keys)]
    within = done.join(modes.where("match_mode = 'within'").select(*keys), keys, "left_semi").alias("d").join(wanted.alias("w"), other, "left_anti")
    rows = modes.select(*keys, F.coalesce("match_mode", F.lit("unordered")).alias("match_mode"))
    for part in (told(unmatched.where("side = 'missing'"), "missing"), told(unmatched.where("side = 'extra'"), "extra"), told(within, "beyond"), told(done, "actual"), told(wanted, "expected"), same):
        rows = rows.join(part, keys, "left")
    n = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    m, missing, extra, beyond = F.col("match_mode"), n("n_missing"), n("n_extra"), n("n_beyond")
    by_extra = lambda c: F.when(F.col(c), C.REPETITION).otherwise(C.DISOBEY)
    unequal = F.when(missing > 0, C.DISOBEY).when(extra > 0, by_extra("known_extra"))
    equal_length = n("n_actual") == n("n_expected")
    strict = F.when(~equal_length, F.coalesce(unequal, F.lit(C.DISOBEY))).when(n("swapped") > 0, C.DISOBEY).when(n("false_args") > 0, C.FALSE_INFORMATION).when(n("partial_args") > 0, C.LACK)
    label = (
        F.when(n("n_expected") == 0, F.lit(None).cast("string"))
        .when(m == "within", F.when(beyond > 0, by_extra("known_beyond")))
        .when(~m.isin("unordered", "contains", "strict"), C.DISOBEY)
        .when(n("n_actual") == 0, C.DISOBEY)
        .when(m == "strict", strict)
        .when(m == "contains", F.when(missing > 0, C.DISOBEY))
        .otherwise(unequal)
    )
    known = n("n_expected") > 0
    diagnosed = known & (m.isin("unordered", "contains") | ((m == "strict") & (~equal_length | (n("n_actual") == 0))))
    zero = F.lit(0).cast("long")
    return rows.select(
        *keys, "match_mode", label.isNull().alias("matched"), label.alias("failure_label"), F.when(diagnosed, missing).otherwise(zero).alias("n_missing"),
        F.when(known & (m == "within"), beyond).when(diagnosed & (m != "contains"), extra).otherwise(zero).alias("n_extra"), F.when(known & (m == "strict") & equal_length, n("swapped")).otherwise(zero).alias("n_ordering_issues"),
    ), unmatched
