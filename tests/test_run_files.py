"""The job over run files: broken inputs, tool-call verdicts, chosen metrics, user metric files, sinks that replace single runs, results by run."""

import json

import pytest
from pyspark.sql import functions as F

from parley import constants as C
from parley.functions.metrics import QualMetric, QuantMetric, load_metrics, score_all
from parley.functions.snapshots import Snapshots
from parley.jobs import run_files, sample_metrics
from parley.operators import errors, gates, report
from parley.sources import documents

REPLIES = "run_id string, conversation_id string, turn_id int, metric string, response string"


def run_file(run, conversations):
    def talk(c, n, calls):
        said = []
        for t in range(n):
            said += [{"turn_id": t, "role": "simulated_user", "content": f"q{t}"}, {"turn_id": t, "role": "assistant", "content": f"a{t}" * (t + 1), "tool_calls": [{"id": f"{c}{t}", "name": "look", "arguments": {}}] if t in calls else []}]
        return {"conversation_id": c, "scenario_id": "s", "conversation_history": said, "simulated_user_prompt": {"variables": {"scenario.goal": "win", "scenario.knowledge": ["k1", "k2"]}}}

    return json.dumps({"simulation_id": run, "conversations": [talk(*c) for c in conversations]})


def reply(run, c, turn, metric, **said):
    return (run, c, turn, metric, json.dumps(said))


@pytest.fixture
def files(tmp_path):
    (tmp_path / "runs").mkdir()
    (tmp_path / "scenarios").mkdir()
    (tmp_path / "runs" / "a.json").write_text(run_file("r1", [("c", 2, [1]), ("d", 1, [])]))
    (tmp_path / "runs" / "b.json").write_text(run_file("r2", [("c", 1, [0])]))
    (tmp_path / "scenarios" / "s.json").write_text(json.dumps({"scenarios": [{"scenario_id": "s", "goal": "g"}]}))
    return tmp_path


def evaluated(spark, files, replies, **options):
    return run_files.evaluate_run_files(spark, f"file://{files}/runs", f"file://{files}/scenarios", spark.createDataFrame(replies, REPLIES), **options)


def labels(found):
    return {(r["run_id"], r["conversation_id"], r["turn_id"]): (r["label"], r["reason"]) for r in found.evals.collect()}


LOW = [reply("r1", "c", 1, "helpfulness", score=1), reply("r1", "c", 1, C.BEHAVIOUR, label=C.REPETITION, reason="again")]


def test_tool_verdicts_count_for_turns_with_calls(spark, files):
    tool = lambda run, c, t, label, reason="bad": reply(run, c, t, C.TOOL_BEHAVIOUR, label=label, reason=reason)
    skipped = (C.SKIPPED, C.SKIPPED_REASON)
    got = evaluated(spark, files, [*LOW, tool("r1", "c", 1, C.UNSAFE_ACTION), tool("r1", "d", 0, C.UNSAFE_ACTION), tool("r2", "c", 0, C.LACK, "")])
    assert labels(got) == {("r1", "c", 0): skipped, ("r1", "c", 1): (C.UNSAFE_ACTION, "[Tool call] bad"), ("r1", "d", 0): skipped, ("r2", "c", 0): (C.LACK, "")}
    assert sorted((r["run_id"], r["name"], r["value"], r["reason"]) for r in got.qual.collect()) == [("r1", C.BEHAVIOUR, C.UNSAFE_ACTION, "[Tool call] bad"), ("r2", C.BEHAVIOUR, C.LACK, "")]
    # the graver label stays and gets the other's reason; a verdict that is none changes nothing
    worse = [LOW[0], reply("r1", "c", 1, C.BEHAVIOUR, label=C.FALSE_INFORMATION, reason="wrong"), tool("r1", "c", 1, C.DISOBEY), tool("r2", "c", 0, C.NO_FAILURE)]
    assert labels(evaluated(spark, files, worse)) == {("r1", "c", 0): skipped, ("r1", "c", 1): (C.FALSE_INFORMATION, "wrong\n[Tool call] bad"), ("r1", "d", 0): skipped, ("r2", "c", 0): skipped}


def test_metrics_to_run(spark, files):
    tool = reply("r1", "c", 1, C.TOOL_BEHAVIOUR, label=C.UNSAFE_ACTION, reason="bad")
    goal = reply("r1", "c", None, C.GOAL, score=1)
    own = reply("r1", "c", 0, "own metric", score=2)
    got = evaluated(spark, files, [*LOW, tool, goal, own], metrics_to_run=["helpfulness", C.BEHAVIOUR])
    assert labels(got)["r1", "c", 1] == (C.REPETITION, "again") and {r["goal_completion_score"] for r in got.convo_evals.collect()} == {-1.0}
    assert {r["name"] for r in got.quant.collect()} == {"helpfulness", "own metric"}
    got = evaluated(spark, files, [*LOW, tool, goal], metrics_to_run=[C.TOOL_BEHAVIOUR])
    assert labels(got)["r1", "c", 1] == (C.UNSAFE_ACTION, "[Tool call] bad") and got.quant.count() == 0
    assert labels(evaluated(spark, files, [*LOW, tool, goal], metrics_to_run=[]))["r1", "c", 1][0] == C.UNSAFE_ACTION


def test_broken_files_and_spans_are_counted(spark, files):
    (files / "runs" / "cut.json").write_text('{"simulation_id": "r9", "conversations": [{"conv')
    (files / "runs" / "empty.json").write_text("")
    (files / "runs" / "poor.json").write_text('{"conversations": []}')
    (files / "scenarios" / "old.json").write_text('{"scenarios": [{"scenario_id": "o", "user_attributes": {"a": 1}}, {"scenario_id": "n"}]}')
    span = {"resourceSpans": [{"scopeSpans": [{"spans": [{"name": "execute_tool find", "spanId": "s1", "attributes": [{"key": "eval.conversation_id", "value": {"stringValue": "d"}}, {"key": "eval.turn_id", "value": {"intValue": "0"}}]}]}]}]}
    payloads = spark.createDataFrame([("r1", "p1", json.dumps(span)), ("r1", "p2", "{"), ("r1", "p3", None), ("r1", "p4", "[]")], "run_id string, payload_id string, payload string")
    tool = reply("r1", "d", 0, C.TOOL_BEHAVIOUR, label=C.LACK, reason="r")
    got = evaluated(spark, files, [*LOW, tool], payloads=payloads)
    assert labels(got)["r1", "d", 0] == (C.LACK, "[Tool call] r")  # the span's call makes it a turn with calls
    name = lambda r: (r["source"], r["file"].rpartition("/")[2], r["offset"], r["reason"])
    assert sorted(map(name, got.broken.collect()), key=repr) == sorted([
        ("run", "cut.json", 43, "Unterminated string starting at"), ("run", "empty.json", 0, "empty file"), ("run", "poor.json", None, "no simulation_id"), ("scenario", "old.json", None, "scenario 0: user_attributes without user_profile"),
        ("spans", "p2", 1, "Expecting property name enclosed in double quotes"), ("spans", "p3", 0, "Expecting value"), ("spans", "p4", None, "not an object")], key=repr)
    assert {r["run_id"] for r in got.conversations.collect()} == {"r1", "r2"}
    run_files.write_runs(got, f"file://{files}/out")
    table = run_files.written_runs(spark, f"file://{files}/out")
    assert table.read("broken").count() == 7 and table.read("summary").count() == 2 and table.read("turns").count() == 4 and table.read("conversations").count() == 3


def test_user_metric_files(spark, files, tmp_path):
    own = load_metrics([sample_metrics.__file__])
    assert [(m.name, m.kind, m.scope) for m in own] == [("brevity", "double", "turn"), ("Echo", "string", "turn"), ("lines", "double", "conversation")]
    got = evaluated(spark, files, LOW, metrics=own)
    assert {(r["run_id"], r["conversation_id"], r["turn_id"], r["name"]): r["value"] for r in got.quant.where("name in ('brevity', 'lines')").collect()} == {
        ("r1", "c", 0, "brevity"): 4.98, ("r1", "c", 1, "brevity"): 4.96, ("r1", "d", 0, "brevity"): 4.98, ("r2", "c", 0, "brevity"): 4.98, ("r1", "c", None, "lines"): 2.0, ("r1", "d", None, "lines"): 1.0, ("r2", "c", None, "lines"): 1.0,
    }
    assert got.metric_errors.count() == 0 and got.qual.where("name = 'Echo'").count() == 4
    bad = tmp_path / "bad.py"
    bad.write_text("from parley.functions.metrics import NumberMetric\nclass A(NumberMetric):\n    def __init__(self, x):\n        pass\n    def score(self, **k):\n        return 1\n")
    with pytest.raises(RuntimeError, match="metric A"):
        load_metrics([str(bad)])
    with pytest.raises(ValueError):
        load_metrics([str(tmp_path / "x.txt")])


def test_metrics_share_a_stage_and_fail_apart(spark):
    rows = spark.createDataFrame([("c", 0, "x"), ("c", 1, None), ("d", 0, "yy")], "conversation_id string, turn_id int, text string")
    size = QuantMetric("size", lambda text, k: (len(text) * k, "r"), ["text"], additional_input={"k": 2})
    kind = QualMetric("kind", lambda text: "none" if text is None else "some", ["text"])
    never = QuantMetric("never", lambda: 1 / 0, [])
    numbers, names, failed = score_all(rows, [size, kind, never])
    assert sorted((r["name"], r["conversation_id"], r["turn_id"], r["value"]) for r in numbers.collect()) == [("size", "c", 0, 2.0), ("size", "d", 0, 4.0)]
    assert [r["value"] for r in names.orderBy("conversation_id", "turn_id").collect()] == ["some", "none", "some"]
    assert sorted((r["name"], r["error"].split(":")[0]) for r in failed.collect()) == [("never", "ZeroDivisionError")] * 3 + [("size", "TypeError")]
    assert score_all(rows.limit(0), [size])[0].count() == 0
    with pytest.raises(ValueError):
        score_all(rows, [size, size])


def test_snapshots(spark, tmp_path):
    table = Snapshots(spark, f"file://{tmp_path}/t", "run_id")
    df = lambda *rows: spark.createDataFrame(list(rows), "run_id string, n int")
    rows = lambda name: sorted(tuple(r) for r in table.read(name).collect())
    assert table.state()["number"] == 0
    table.commit({"a": df(("x", 1), ("y", 2)), "b": df(("x", 9))})
    assert rows("a") == [("x", 1), ("y", 2)] and rows("b") == [("x", 9)]
    # x is replaced in both tables, even where it has no rows any more; y stays
    assert table.commit({"a": df(("x", 5)), "b": df()}, df(("x", 0)).select("run_id")) == 2
    assert rows("a") == [("x", 5), ("y", 2)] and rows("b") == []
    # a job that is killed before its commit leaves the old state, and can be cleared away
    df(("x", 7)).write.partitionBy("run_id").parquet(f"file://{tmp_path}/t/a/version=killed")
    assert rows("a") == [("x", 5), ("y", 2)]
    with pytest.raises(Exception):
        table._publish(2, {})
    assert table.vacuum() >= 2 and rows("a") == [("x", 5), ("y", 2)]
    assert not (tmp_path / "t" / "a" / "version=killed").exists()
    with pytest.raises(KeyError):
        table.read("unknown")


def test_many_parts_are_few_files(spark, tmp_path):
    table = Snapshots(spark, f"file://{tmp_path}/t", "run_id", folders=False)
    df = lambda runs, n: spark.range(runs).repartition(3).selectExpr("concat('r', id) AS run_id", f"{n} AS n")
    table.commit({"a": df(300, 1)})
    table.commit({"a": df(100, 2).where("run_id <> 'r7'")}, df(100, 2).select("run_id"))
    assert len(list((tmp_path / "t" / "a").rglob("*.parquet"))) <= 6
    assert {r["n"]: r["runs"] for r in table.read("a").groupBy("n").agg(F.count("*").alias("runs")).collect()} == {1: 200, 2: 99}
    assert table.read("a").columns == ["run_id", "n"] and table.read("a").where("run_id = 'r7'").count() == 0


def test_listing(spark, tmp_path):
    for name in ("a.md", "_index.md", ".x", "_docs/b.md", "_docs/.y/c.md", "empty.md", "d.exe"):
        at = tmp_path / "kb" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"" if name == "empty.md" else b"caf\xff")
    got = {r["title"]: (r["content"], r["error_message"]) for r in documents.read_knowledge_files(spark, f"file://{tmp_path}/kb").collect()}
    assert got == {"a.md": ("caf�", None), "_index.md": ("caf�", None), "b.md": ("caf�", None), "d.exe": (None, "unsupported file type: exe")}
    assert documents.list_files(spark, f"file://{tmp_path}/none").count() == 0 and documents.list_files(spark, f"file://{tmp_path}/kb/a.md").count() == 1


def test_by_run_and_over_all(spark):
    convo = spark.createDataFrame([("r1", "a", 2, 1.0, "Done"), ("r1", "b", 4, 0.5, "Failed"), ("r2", "a", 0, 0.0, "Failed"), (None, "z", 1, 1.0, "Done")], "run_id string, conversation_id string, turns int, overall_agent_score double, evaluation_status string")
    assert {r["run_id"]: (r["conversations"], r["turns"]) for r in report.run_totals(convo).collect()} == {"r1": (2, 6), "r2": (1, 0), "": (1, 1), None: (4, 7)}
    assert {r["run_id"]: r["pass_rate"] for r in report.kpi(convo).collect()} == {"r1": 0.5, "r2": 0.0, "": 1.0, None: 0.5}
    none = convo.limit(0)
    assert report.run_totals(none).collect() == [] and [tuple(r) for r in report.run_totals(none.drop("run_id")).collect()] == [(0, 0, 0.0)]
    quant = spark.createDataFrame([("r1", "a", 0, "helpfulness", "turn", 4.0), ("r1", "a", 1, "helpfulness", "turn", -1.0), ("r2", "a", 0, "clarity_now", "turn", 2.0)], "run_id string, conversation_id string, turn_id int, name string, scope string, value double")
    assert sorted((r["run_id"], r["name"], r["average"]) for r in report.performance_metrics(quant).collect() if r["run_id"]) == [("r1", "helpfulness", 4.0)]
    assert {r["name"]: r["title"] for r in report.performance_metrics(quant).collect() if r["run_id"] is None} == {"helpfulness": "Helpfulness", "clarity_now": "Clarity Now"}
    evals = spark.createDataFrame([("r1", "a", 0, C.REPETITION), ("r1", "a", 1, C.NO_FAILURE), ("r2", "a", 0, C.LACK)], "run_id string, conversation_id string, turn_id int, label string")
    qual = spark.createDataFrame([("r2", "a", 0, C.BEHAVIOUR, C.DISOBEY)], "run_id string, conversation_id string, turn_id int, name string, value string")
    got = {(r["run_id"], r["label"]): r["share"] for r in report.label_distributions(qual, evals).collect()}
    assert got == {("r1", C.REPETITION): 100.0, ("r2", C.DISOBEY): 100.0, (None, C.DISOBEY): 100.0}
    assert {(r["run_id"], r["label"]): r["share"] for r in report.failure_breakdown(evals).collect()}[None, C.LACK] == pytest.approx(100 / 3)
    numeric = spark.createDataFrame([("r1",)], "run_id string")
    gate = gates.gate_report(numeric, numeric.limit(0), convo.select("run_id").distinct())
    assert {r["run_id"]: (r["numeric_failures"], r["passed"]) for r in gate.collect()} == {"r1": (1, False), "r2": (0, True), "": (0, True), None: (1, False)}
    found = spark.createDataFrame([(r, f"{r}{i}", "c", s, n) for r in ("r1", "r2") for i, (s, n) in enumerate([("low", 9), ("critical", 1), ("critical", 2)])], "run_id string, unique_error_id string, category string, severity string, n_occurrences long")
    at = found.select("run_id", "unique_error_id", F.lit("a").alias("conversation_id"), F.lit(0).alias("turn_id"))
    top = errors.top_errors(found, at, convo.select("run_id", "conversation_id", F.lit("s").alias("scenario_id")), 2)
    assert sorted((r["run_id"], r["unique_error_id"], r["conversations"]) for r in top.collect()) == [("r1", "r11", 1), ("r1", "r12", 1), ("r2", "r21", 1), ("r2", "r22", 1)]
