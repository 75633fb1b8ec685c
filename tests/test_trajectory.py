"""Modes, argument rules and guards of trajectory matching."""

import json

import pytest
from pyspark.sql import functions as F

from parley.operators import trajectory

SCHEMA = "conversation_id long, match_mode string, actual array<struct<name:string,arguments:string>>, expected array<struct<name:string,arguments:string,arg_match_mode:string>>"


def calls(*names):
    return [(n, "{}") if isinstance(n, str) else (n[0], json.dumps(n[1])) for n in names]


def wanted(*names):
    return [(n, "{}", "ignore") if isinstance(n, str) else (n[0], json.dumps(n[1]), n[2]) for n in names]


CASES = [
    # mode, actual, expected, label, missing, extra, number of ordering issues
    ("strict", calls("a", "b"), wanted("a", "b"), None, [], [], 0),
    ("strict", calls("b", "a"), wanted("a", "b"), "disobey user request", [], [], 2),
    ("strict", calls("a", "x"), wanted("a", "b"), "disobey user request", [], [], 1),
    ("strict", calls("a", "a", "b"), wanted("a", "b"), "repetition", [], ["a"], 0),
    ("strict", calls("a", "b", "x"), wanted("a", "b"), "disobey user request", [], ["x"], 0),
    ("strict", calls("a"), wanted("a", "b"), "disobey user request", ["b"], [], 0),
    ("strict", calls(("a", {"k": 1})), wanted(("a", {"k": 2}, "exact")), "false information", [], [], 0),
    ("strict", calls(("a", {"k": 1})), wanted(("a", {"k": 1, "m": 2}, "partial")), "lack of specific information", [], [], 0),
    ("strict", calls(("a", {"k": 1, "m": 2})), wanted(("a", {"m": 2}, "partial")), None, [], [], 0),
    ("strict", calls(("b", {"k": 1}), "a"), wanted(("a", {"k": 2}, "exact"), "b"), "disobey user request", [], [], 2),
    ("unordered", calls("b", "a"), wanted("a", "b"), None, [], [], 0),
    ("unordered", calls("a"), wanted("a", "a"), "disobey user request", ["a"], [], 0),
    ("unordered", calls("a", "a"), wanted("a"), "repetition", [], ["a"], 0),
    ("unordered", calls("a", "x"), wanted("a"), "disobey user request", [], ["x"], 0),
    ("unordered", calls("x"), wanted("a"), "disobey user request", ["a"], ["x"], 0),
    ("unordered", calls(("a", {"y": 2, "x": [1, {"z": 1}]})), wanted(("a", {"x": [1, {"z": 1}], "y": 2}, "exact")), None, [], [], 0),
    ("unordered", calls(("a", {"k": 1}), ("a", {"k": 2})), wanted(("a", {"k": 2}, "exact"), ("a", {}, "ignore")), None, [], [], 0),
    ("contains", calls("x", "a"), wanted("a"), None, [], [], 0),
    ("contains", calls("x"), wanted("a"), "disobey user request", ["a"], [], 0),
    ("within", calls("a", "a"), wanted("a", "b"), None, [], [], 0),
    ("within", calls("a", "x"), wanted("a"), "disobey user request", [], ["x"], 0),
    ("within", [], wanted("a"), None, [], [], 0),
    ("unordered", [], wanted("a", "b"), "disobey user request", ["a", "b"], [], 0),
    ("strict", [], wanted("a"), "disobey user request", ["a"], [], 0),
    ("contains", None, wanted("a"), "disobey user request", ["a"], [], 0),
    ("sideways", calls("a"), wanted("a"), "disobey user request", [], [], 0),
    ("strict", calls("a"), [], None, [], [], 0),
    ("unordered", calls("a"), None, None, [], [], 0),
    (None, calls("a"), wanted("a"), None, [], [], 0),
]


def test_match_trajectories(spark):
    rows = spark.createDataFrame([(i, c[0], c[1], c[2]) for i, c in enumerate(CASES)], SCHEMA)
    found = {r["conversation_id"]: r for r in trajectory.match_trajectories(rows).collect()}
    for i, (_, _, _, label, missing, extra, issues) in enumerate(CASES):
        r = found[i]
        assert (r["failure_label"], r["matched"], list(r["missing"]), list(r["extra"]), len(r["ordering_issues"])) == (label, label is None, missing, extra, issues), CASES[i]


def test_attribution_goes_to_the_last_turn_with_calls(spark):
    evals = spark.createDataFrame([(c, t, 3.0, "no failure", "fine") for c in (1, 2) for t in (0, 1)] + [(3, 0, 3.0, "unsafe action", "bad")], "conversation_id long, turn_id long, turn_score double, label string, reason string")
    tool_calls = spark.createDataFrame([(1, 0, 0, "x", "{}"), (3, 0, 0, "x", "{}")], "conversation_id long, turn_id long, call_pos long, name string, arguments string")
    results = spark.createDataFrame(
        [(1, False, "repetition", [], ["x"], []), (2, False, "disobey user request", ["a"], [], []), (3, False, "repetition", [], ["x"], []), (4, False, "repetition", [], [], [])],
        "conversation_id long, matched boolean, failure_label string, missing array<string>, extra array<string>, ordering_issues array<string>",
    )
    merged, quals = trajectory.attribute_failures(results, tool_calls, evals)
    got = {(r["conversation_id"], r["turn_id"]): (r["label"], r["reason"]) for r in merged.collect()}
    assert got[1, 0] == ("repetition", "[Trajectory] extra: x") and got[1, 1][0] == "no failure"
    assert got[2, 1] == ("disobey user request", "[Trajectory] missing: a") and got[2, 0][0] == "no failure"
    assert got[3, 0] == ("unsafe action", "bad\n[Trajectory] extra: x")
    assert quals.count() == 3


@pytest.mark.parametrize("order", [1, -1])
def test_first_tool_call_assertion_counts(spark, order):
    rows = [(1, [("other", "strict", []), ("tool_calls", None, [("a", "{}", None)]), ("tool_calls", "strict", [])]), (2, [])][::order]
    scenarios = spark.createDataFrame(rows, "scenario_id long, assertions array<struct<type:string,match_mode:string,expected:array<struct<name:string,arguments:string,arg_match_mode:string>>>>")
    got = trajectory.expected_calls(scenarios).collect()
    assert [(r["scenario_id"], r["match_mode"], [e["name"] for e in r["expected"]]) for r in got] == [(1, "unordered", ["a"])]


def test_queries_match_the_calls_of_all_turns(spark):
    from parley.jobs import registry
    from parley.sources.adapters import adapt

    sf = "/root/testdata/sf0.001"
    names, last = {}, {}
    for r in adapt(spark, sf, "calls").orderBy("turn_id", "call_pos").collect():
        names.setdefault(r["conversation_id"], []).append(r["name"])
        last[r["conversation_id"]] = r["turn_id"]
    assert max(last.values()) > 1
    found = registry.queries()["trj_1_8_match_trajectories"](spark, sf).collect()
    within = {r["conversation_id"]: r["extra"] for r in found if r["match_mode"] == "within"}
    assert within and within == {c: ",".join(n for n in names[c] if n not in ("click", "view", "purchase")) for c in within}
    failed = {r["conversation_id"] for r in found if not r["matched"]}
    turns = {(r["conversation_id"], r["turn_id"]) for r in registry.queries()["trj_9_attribute_failures"](spark, sf).collect() if r["label"] != "no failure"}
    assert turns == {(c, last[c]) for c in failed}


def test_long_form_equals_arrays(spark):
    """Random conversations of all modes, and one of 10,000 calls, judged row by row and by arrays."""
    import random

    rng = random.Random(9)
    args = ['{"a":1}', '{"a": 1}', '{"a":2}', '{"a":1,"b":2}', "{}", None]
    pick = lambda n, modes: [(rng.choice("xyz"), rng.choice(args), rng.choice(modes)) for _ in range(n)]
    rows = [(i, rng.choice(["unordered", "contains", "within", "strict", "odd", None]), pick(rng.randint(0, 6), [None]), pick(rng.randint(0, 5), rng.choice([["ignore"], ["exact"], ["partial"], ["ignore", "exact", "partial", None]]))) for i in range(120)]
    rows += [(500 + i, "strict", calls, [(n, '{"a":9}', m) for n, a, _ in calls]) for i, m in enumerate(["ignore", "exact", "partial"] * 3) for calls in [pick(4, [None])]]
    long = [(rng.choice(["x", "y", "z", "w"]), rng.choice(args[:4]), None) for _ in range(10_000)]
    rows += [(900, "unordered", long, pick(40, ["exact"])), (901, "contains", long, [("q", "{}", "ignore"), ("x", "{}", "ignore")]), (902, "within", long, [("x", None, "ignore"), ("y", None, "ignore"), ("z", None, "ignore")])]
    df = spark.createDataFrame([(i, m, [c[:2] for c in a], e) for i, m, a, e in rows], SCHEMA)
    want = {r["conversation_id"]: (r["matched"], r["failure_label"], len(r["missing"]), len(r["extra"]), len(r["ordering_issues"])) for r in trajectory.match_trajectories(df).collect()}
    expected = df.select("conversation_id", F.posexplode("expected").alias("at", "e")).select("conversation_id", "at", "e.*")
    calls = df.select("conversation_id", F.posexplode("actual").alias("at", "a")).select("conversation_id", (F.col("at") / 3).cast("int").alias("turn_id"), (F.col("at") % 3).alias("call_pos"), "a.name", "a.arguments").repartition(5)
    results, unmatched = trajectory.match_long(df.select("conversation_id", "match_mode"), expected, calls)
    got = {r["conversation_id"]: (r["matched"], r["failure_label"], r["n_missing"], r["n_extra"], r["n_ordering_issues"]) for r in results.collect()}
    assert got == want and len({v[1] for v in want.values()}) == 5
    names = {(r["conversation_id"]): r["extra"] for r in trajectory.match_trajectories(df.where("conversation_id = 900")).collect()}
    found = [r["name"] for r in unmatched.where("conversation_id = 900 and side = 'extra'").orderBy("at").collect()]
    assert found == list(names[900]) and len(found) > 9_900
    assert trajectory.match_long(df.limit(0).select("conversation_id", "match_mode"), expected.limit(0), calls.limit(0))[0].count() == 0
