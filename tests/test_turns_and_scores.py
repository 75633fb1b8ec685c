"""Turn assembly, scores, merges and gates on small tables."""

from pyspark.sql import functions as F

from parley import constants as C
from parley.functions import text as T
from parley.operators import gates, scoring, turns
from parley.sources.adapters import adapt, numbered_lines

MESSAGES = "conversation_id long, msg_pos int, role string, content string"


def messages(spark, *roles, conversation=1):
    return spark.createDataFrame([(conversation, i, {"u": "simulated_user", "a": "assistant", "s": "system"}[r[0]], r[1:] or f"{r}{i}") for i, r in enumerate(roles)], MESSAGES)


def test_pairing(spark):
    m = messages(spark, "s", "a", "uone", "utwo", "s", "athree", "afour", "ufive", "asix", "useven")
    got = [(r["turn_id"], r["user_msg"], r["assistant_msg"]) for r in turns.assemble_turns(m).orderBy("turn_id").collect()]
    assert got == [(0, "two", "three"), (1, "five", "six")]
    shuffled = m.orderBy(F.desc("content")).repartition(3)
    assert sorted(map(tuple, turns.assemble_turns(shuffled).collect())) == sorted(map(tuple, turns.assemble_turns(m).collect()))


def test_runs_do_not_mix(spark):
    one = messages(spark, "u", "a").withColumn("run_id", F.lit("r1"))
    two = messages(spark, "u", "a", "u", "a").withColumn("run_id", F.lit("r2"))
    got = turns.assemble_turns(one.unionByName(two)).groupBy("run_id").count().collect()
    assert {r["run_id"]: r["count"] for r in got} == {"r1": 1, "r2": 2}


def test_empty_and_null(spark):
    none = spark.createDataFrame([], MESSAGES)
    assert turns.assemble_turns(none).count() == 0
    nulls = spark.createDataFrame([(1, 0, "simulated_user", None), (1, 1, "assistant", None), (1, 2, None, "x")], MESSAGES)
    assert [tuple(r) for r in turns.assemble_turns(nulls).collect()] == [(1, 0, None, None)]
    conversations = spark.createDataFrame([(1,), (2,)], "conversation_id long")
    assert sorted(map(tuple, turns.turn_counts(turns.assemble_turns(nulls), conversations).collect())) == [(1, 1), (2, 0)]


def test_numbering_and_stop(spark):
    m = messages(spark, "ua", "ab", "uc ###STOP###", "ad", "ue")
    assert [r["turn_id"] for r in turns.number_messages(m).orderBy("msg_pos").collect()] == [0, 0, 1, 1, 2]
    assert [r["content"] for r in turns.truncate_at_stop(m, 5).orderBy("msg_pos").collect()] == ["a", "b", "c ###STOP###"]
    assert turns.truncate_at_stop(m, 1).count() == 2


def test_recent_context(spark):
    m = messages(spark, "uhello", *[f"{r}{i}" for i in range(5) for r in "au"]).unionByName(messages(spark, "uonly", conversation=2))
    got = {r["conversation_id"]: r["context"] for r in turns.recent_context(m, 2, 3).collect()}
    assert got == {1: "AGENT: 4\nCUSTOMER: 4", 2: "(just started)"}


def test_text_functions(spark):
    row = spark.createDataFrame([(["a", "b"], [], "one  two\nthree four five six seven eight nine ten eleven", "  ")], "k array<string>, e array<string>, r string, b string")
    got = row.select(T.combine_knowledge(F.col("k")), T.combine_knowledge(F.col("e")), T.truncate_reason(F.col("r")), T.truncate_reason(F.col("b")), T.truncate_reason(F.lit(None).cast("string")), T.parse_arguments(F.lit('{"b":1,"a":{"d":1,"c":2}}')), T.parse_arguments(F.lit("[1]")), T.parse_arguments(F.lit("{"))).first()
    assert list(got) == ["Knowledge 1:\na\n\nKnowledge 2:\nb", "", "one two three four five six seven eight nine ten...", "", "", '{"a":{"c":2,"d":1},"b":1}', "{}", "{}"]
    labels = spark.createDataFrame([(x,) for x in (0.0, 1.99, 2.0, 2.5, 3.0, 3.99, 4.0, 5.0)], "s double").select(T.score_label(F.col("s")).alias("l")).collect()
    assert [r["l"] for r in labels] == ["Poor", "Poor", "Needs Improvement", "Needs Improvement", "Good", "Good", "Excellent", "Excellent"]


def test_prompts_do_not_read_slots_in_texts(spark):
    m = messages(spark, "u{knowledge}", "aok")
    t = turns.assemble_turns(m)
    c = spark.createDataFrame([(1, "go", ["fact"])], "conversation_id long, goal string, knowledge array<string>")
    metrics = spark.createDataFrame([("x", "turn", "H:{chat_history}K:{knowledge}G:{user_goal}T:{tool_calls}.")], "name string, scope string, template string")
    assert turns.judge_requests(t, c, metrics).first()["prompt"] == "H:user: {knowledge}\nassistant: ok\nK:Knowledge 1:\nfactG:goT:[]."


def test_verdicts(spark):
    rows = [(1, 0, "verbosity", '{"score": 2, "reason": "r"}'), (1, 0, "coherence", '{"score": 2}'), (1, 0, "tone", '{"label": "rude", "reason": "x"}'), (1, 0, "bad", "oops"), (1, 0, "empty", "{}")]
    quant, qual, rejects = turns.parse_verdicts(spark.createDataFrame(rows, "conversation_id long, turn_id long, metric string, response string"))
    assert sorted((r["metric"], r["value"]) for r in quant.collect()) == [("coherence", 2.0), ("verbosity", 4.0)]
    assert [(r["metric"], r["value"], r["reason"]) for r in qual.collect()] == [("tone", "rude", "x")]
    assert sorted(r["metric"] for r in rejects.collect()) == ["bad", "empty"]


QUANT = "conversation_id long, turn_id long, name string, scope string, value double, score_max double, pos int"
EVALS = "conversation_id long, turn_id long, turn_score double, label string, reason string"


def test_turn_labels(spark):
    quant = spark.createDataFrame([(1, 0, "coherence", "turn", 3.0, 5.0, 1), (1, 1, "coherence", "turn", 2.9, 5.0, 1), (1, 1, "own", "turn", 0.0, None, 2), (1, 2, "own", "turn", 0.0, None, 1), (1, 4, "coherence", "turn", 1.0, 5.0, 1)], QUANT)
    verdicts = spark.createDataFrame([(1, t, "repetition", "again") for t in range(4)], "conversation_id long, turn_id long, label string, reason string")
    t = spark.createDataFrame([(1, i) for i in range(5)], "conversation_id long, turn_id long")
    got = {r["turn_id"]: (r["turn_score"], r["label"]) for r in scoring.turn_labels(t, quant, verdicts).collect()}
    assert got == {0: (3.0, C.SKIPPED), 1: (1.45, "repetition"), 2: (0.0, C.SKIPPED), 3: (-1.0, C.SKIPPED), 4: (1.0, C.SKIPPED)}
    off = scoring.turn_labels(t, quant, verdicts, behaviour_enabled=False)
    assert {r["label"] for r in off.collect()} == {C.SKIPPED}


def test_merge_failures(spark):
    labels = [(C.SKIPPED, "false information", "false information", "n"), ("repetition", "unsafe state", "unsafe state", "n"), ("unsafe state", "repetition", "unsafe state", "o\nn"), ("repetition", "no failure", "repetition", "o"), ("repetition", None, "repetition", "o"), ("odd", "repetition", "repetition", "n"), ("critical?", "odd", "critical?", "o\nn")]
    evals = spark.createDataFrame([(1, i, 1.0, a, "o") for i, (a, _, _, _) in enumerate(labels)], EVALS)
    new = spark.createDataFrame([(1, i, b, "n") for i, (_, b, _, _) in enumerate(labels) if b], "conversation_id long, turn_id long, label string, reason string")
    got = {r["turn_id"]: (r["label"], r["reason"]) for r in scoring.merge_failures(evals, new).collect()}
    assert got == {i: (c, d) for i, (_, _, c, d) in enumerate(labels)}


def test_conversations(spark):
    evals = spark.createDataFrame([(1, 0, 1.0, "repetition", ""), (1, 1, 1.0, C.SKIPPED, ""), (3, 0, 1.0, C.NO_FAILURE, ""), (4, 0, 1.0, C.RUN_FAILED, "")], EVALS)
    counts = spark.createDataFrame([(1, 2), (2, 0), (3, 3), (4, 1)], "conversation_id long, turns long")
    goals = spark.createDataFrame([(1, 1.0), (3, 1.0)], "conversation_id long, goal_completion_score double")
    got = {r[0]: tuple(r)[1:] for r in scoring.evaluate_conversations(evals, counts, goals).collect()}
    assert got == {1: (2, 1.0, 0.5, 0.625, C.PARTIAL), 2: (0, -1.0, 1.0, 1.0, C.DONE), 3: (3, 1.0, 1.0, 1.0, C.DONE), 4: (1, -1.0, 0.0, 0.0, C.FAILED)}


def test_gates(spark):
    convo = spark.createDataFrame([(1, 0.5, -1.0), (2, 0.4, 0.5)], "conversation_id long, overall_agent_score double, goal_completion_score double")
    quant = spark.createDataFrame([(1, 0, "m", "turn", -1.0, 5.0, 1), (1, 1, "m", "turn", 2.0, 5.0, 1), (2, 0, "m", "turn", 5.0, 5.0, 1), (2, None, "m", "conversation", 1.0, 5.0, 3), (2, None, "m", "conversation", 4.0, 5.0, 4)], QUANT)
    limits = spark.createDataFrame([("goal_completion", 1.0), ("m", 2.0), ("missing", 3.0)], "metric string, threshold double")
    failures = gates.numeric_failures(gates.with_score_threshold(limits, 0.5), convo, quant)
    assert sorted(tuple(r) for r in failures.collect()) == [("goal_completion", 2, 0.5, 1.0), ("m", 2, 1.0, 2.0), ("overall_score", 2, 0.4, 0.5)]
    assert gates.with_score_threshold(spark.createDataFrame([("overall_score", 0.9)], "metric string, threshold double"), 0.5).collect()[0]["threshold"] == 0.9
    evals = spark.createDataFrame([(1, 0, 1.0, "repetition", ""), (1, 1, 1.0, C.SKIPPED, "")], EVALS)
    qual = spark.createDataFrame([(1, 0, "tone", "turn", "kind", 2), (1, 0, "tone", "turn", "rude", 1), (1, 0, C.BEHAVIOUR, "turn", "unsafe action", 1), (1, None, "end", "conversation", "lost", 1), (1, None, "end", "conversation", C.API_ERROR, 2)], "conversation_id long, turn_id long, name string, scope string, value string, pos int")
    sets = spark.createDataFrame([("tone", "rude"), ("tone", "kind"), (C.BEHAVIOUR, "repetition"), (C.BEHAVIOUR, "unsafe action"), (C.BEHAVIOUR, C.SKIPPED), ("end", "lost"), ("end", C.API_ERROR)], "metric string, label string")
    labels = gates.label_failures(sets, evals, qual)
    assert sorted(tuple(r) for r in labels.collect()) == [(C.BEHAVIOUR, 1, "0", "repetition"), ("end", 1, "conversation", "lost"), ("tone", 1, "0", "rude")]
    assert tuple(gates.gate_report(failures, labels).first()) == (3, 3, False)
    assert gates.gate_report(failures.limit(0), labels.limit(0)).first()["passed"]


def test_lines_are_numbered_once(spark):
    sf = "/root/testdata/sf0.001"
    lines = numbered_lines(spark, sf)
    for name in ("lines", "turns", "quant", "verdicts", "tool_verdicts", "qual"):
        again = adapt(spark, sf, name, lines)
        assert again.exceptAll(adapt(spark, sf, name)).count() == 0 and again.count() == adapt(spark, sf, name).count()
        assert "Window" not in again._jdf.queryExecution().executedPlan().toString()
