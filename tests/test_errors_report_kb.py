"""Errors, scenarios, report tables, knowledge base, metrics, sinks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley import constants as C
from parley.functions.metrics import QualMetric, QuantMetric, score_with
from parley.jobs.evaluate import write_evaluation, write_focus, write_report_tables
from parley.operators import errors as E
from parley.operators import kb, report

EVALS = "conversation_id long, turn_id long, turn_score double, label string, reason string"
QUANT = "conversation_id long, turn_id long, name string, scope string, value double, score_max double, pos int"


def mapped(spark, errors, occurrences, conversations, scenarios):
    e = spark.createDataFrame(errors, "unique_error_id string, category string, description string, severity string, pos int")
    o = spark.createDataFrame(occurrences, "unique_error_id string, conversation_id string, turn_id int")
    c = spark.createDataFrame(conversations, "conversation_id string, scenario_id string")
    s = spark.createDataFrame(scenarios, "scenario_id string, goal string")
    return E.error_scenario_mappings(e, o, c, s), s


def test_mappings_and_focus(spark):
    errors = [("low", "x", "d", "low", 0), ("med1", "x", "d", "medium", 1), ("med2", "x", "d", "medium", 2), ("crit", "x", "d", "Critical", 3), ("odd", "x", "d", "strange", 4), ("lost", "x", "d", "critical", 5), ("tie", "x", "d", "medium", 6)]
    occurrences = [("low", "a", 0), ("med1", "a", 0), ("med2", "a", 0), ("med2", "a", 1), ("med2", "gone", 1), ("crit", "b", 0), ("crit", "a", 0), ("odd", "a", 1), ("lost", "gone", 0), ("lost", "c", 0), ("tie", "b", 1)]
    m, s = mapped(spark, errors, occurrences, [("a", "s1"), ("b", "s2"), ("c", "unknown")], [("s1", "one"), ("s2", "two")])
    by = {}
    for r in m.collect():
        by.setdefault((r["error_index"], r["unique_error_id"], r["n_occurrences"]), []).append(r["scenario_id"])
    got = [(*k, sorted(v)) for k, v in sorted(by.items())]
    assert got == [(1, "crit", 2, ["s1", "s2"]), (2, "med2", 3, ["s1"]), (3, "med1", 1, ["s1"]), (4, "tie", 1, ["s2"]), (5, "low", 1, ["s1"]), (6, "odd", 1, ["s1"])]
    focus = sorted((r["focus_set"], r["scenario_id"]) for r in E.focus_sets(m, s).collect())
    assert ("all_failures", "s1") in focus and ("all_failures", "s2") in focus and len([f for f in focus if f[0] == "all_failures"]) == 2 and len(focus) == 9


def test_parse_occurrences(spark):
    rows = spark.createDataFrame([("e", ["conv_1_2", "a_b_c", "none", "x_ 3 ", "_4"])], "unique_error_id string, occurrences array<string>")
    assert sorted((r["conversation_id"], r["turn_id"]) for r in E.parse_occurrences(rows).collect()) == [("", 4), ("conv_1", 2), ("x", 3)]


def test_grouping_links_and_agreement(spark):
    rows = [(1, 0, 1.0, "repetition", "Said 12 times"), (1, 1, 1.0, "repetition", "said  7 TIMES"), (2, 0, 1.0, "repetition", "other"), (2, 1, 1.0, C.SKIPPED, "said 1 times"), (3, 0, 1.0, C.NO_FAILURE, "")]
    evals = spark.createDataFrame(rows, EVALS)
    errors, occurrences = E.group_failures(evals)
    assert sorted((r["description"], r["n_occurrences"], r["severity"]) for r in errors.collect()) == [("Said 12 times", 2, "low"), ("other", 1, "low")]
    linked = {(r["conversation_id"], r["turn_id"]): len(r["unique_error_ids"]) for r in E.link_errors(evals, occurrences).collect()}
    assert linked == {(1, 0): 1, (1, 1): 1, (2, 0): 1, (2, 1): 0, (3, 0): 0}
    golden = spark.createDataFrame([(1, 0, "no failure"), (1, 1, "repetition"), (1, 2, "false information"), (2, 0, "false information"), (3, 0, "no failure")], "conversation_id long, pos int, label string")
    got = {r["expected"]: (r["conversations"], r["agreed"], r["rate"]) for r in E.judge_agreement(evals, golden).collect()}
    assert got == {"repetition": (1, 1, 1.0), "false information": (1, 0, 0.0), "no failure": (1, 1, 1.0)}


def test_root_causes_of_reworded_reasons(spark):
    say = ["The agent quoted the wrong refund window", "the agent QUOTED a wrong  refund window", "quoted wrong refund window to the user", "Agent never asked for the booking number 12", "agent never asked for the booking number 99", "never asked for booking number", "", None]
    rows = [("c", i, C.LACK, r) for i, r in enumerate(say)] + [("d", 0, C.DISOBEY, say[0]), ("d", 1, C.LACK, say[0]), ("d", 2, C.NO_FAILURE, say[0])]
    evals = spark.createDataFrame(rows, "conversation_id string, turn_id int, label string, reason string")
    errors, occurrences = E.root_causes(evals, 0.5)
    got = {(r["category"], r["n_occurrences"], r["n_reasons"], r["description"]) for r in errors.collect()}
    assert {x[:3] for x in got} == {(C.LACK, 4, 3), (C.LACK, 3, 2), (C.LACK, 2, 1), (C.DISOBEY, 1, 1)}
    assert (C.LACK, 4, 3, say[0]) in got
    assert occurrences.groupBy("unique_error_id").count().where("count = 4").count() == 1 and occurrences.count() == 10
    assert E.root_causes(evals.limit(0))[0].count() == 0


def test_reason_links_equal_brute_force(spark):
    import itertools
    import math
    import random

    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    rows = [(f"e{i:03d}", rng.choice("st"), " ".join(rng.choices(vocab, [1 / (k + 1) for k in range(40)], k=rng.randint(0, 9)))) for i in range(150)]
    want = {}
    for scope in "st":
        sets = {i: set(t.split()) for i, s, t in rows if s == scope}
        weight = {w: math.log(1 + len(sets) / sum(w in x for x in sets.values())) for x in sets.values() for w in x}
        for a, b in itertools.combinations(sorted(sets), 2):
            both, every = (sum(weight[w] for w in x) for x in (sets[a] & sets[b], sets[a] | sets[b]))
            if both and both / every >= 0.6:
                want[a, b] = both / every
    got = {(r["a"], r["b"]): r["similarity"] for r in E.reason_links(spark.createDataFrame(rows, "id string, scope string, norm string")).collect()}
    assert set(got) == set(want) and len(want) > 20 and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_report(spark):
    quant = spark.createDataFrame([(1, 0, "helpfulness", "turn", 4.0, 5.0, 1), (1, 1, "helpfulness", "turn", -1.0, 5.0, 1), (2, 0, "helpfulness", "turn", 1.0, 5.0, 1), (1, None, "own_metric", "conversation", 3.0, None, 1)], QUANT)
    assert {r["name"]: (r["title"], r["average"], r["high"]) for r in report.performance_metrics(quant, spark.createDataFrame([("own_metric", 0.0, 9.0)], "name string, low double, high double")).collect()} == {"helpfulness": ("Helpfulness", 2.5, 5.0), "own_metric": ("Own Metric", 3.0, 9.0)}
    assert report.performance_metrics(quant.where("name <> 'helpfulness'")).count() == 0
    assert tuple(report.overall_average(quant).first()) == (4.0 / 3, "Poor")
    evals = spark.createDataFrame([(1, 0, 4.0, "repetition", " ".join("abcdefghijklmn")), (1, 1, -1.0, C.NO_FAILURE, ""), (2, 0, 1.0, C.SKIPPED, "")], EVALS)
    assert {r["label"]: r["share"] for r in report.failure_breakdown(evals).collect()} == {"repetition": 50.0, C.NO_FAILURE: 50.0}
    assert {r["label"]: r["share"] for r in report.failure_distribution(evals).collect()} == {"repetition": 100.0}
    qual = spark.createDataFrame([(1, 0, "tone", "turn", "rude", 1)], "conversation_id long, turn_id long, name string, scope string, value string, pos int")
    assert {(r["name"], r["label"]) for r in report.label_distributions(qual, evals).collect()} == {("tone", "rude"), (C.BEHAVIOUR, "repetition")}
    own = qual.withColumn("name", F.lit(C.BEHAVIOUR))
    assert {(r["name"], r["label"]) for r in report.label_distributions(own, evals).collect()} == {(C.BEHAVIOUR, "rude")}
    issues = {(r["conversation_id"], r["turn_id"]): r["issues"] for r in report.turn_issues(evals, quant).collect()}
    assert issues == {(1, 0): "repetition: a b c d e f g h i j...", (1, 1): "helpfulness (-1.0)", (2, 0): "helpfulness (1.0)"}
    many = spark.range(0, 37, 1, 5).select((F.col("id") * 3).alias("conversation_id"))
    labels = {r["conversation_id"]: r["label"] for r in report.conversation_labels(many, 4).collect()}
    assert labels == {3 * i: f"Conversation {i + 1}" for i in range(37)}
    none = spark.createDataFrame([], "conversation_id long, turns long, overall_agent_score double, evaluation_status string")
    assert tuple(report.run_totals(none).first()) == (0, 0, 0.0)


def test_snippets(spark):
    m = spark.createDataFrame([(1, 0, "simulated_user", "a"), (1, 1, "simulated_user", "b"), (1, 2, "assistant", "c"), (1, 3, "simulated_user", "d")], "conversation_id long, msg_pos int, role string, content string")
    o = spark.createDataFrame([("e", 1, 0), ("e", 1, 1), ("e", 9, 0), ("e", 1, 5)], "unique_error_id string, conversation_id long, turn_id int")
    evals = spark.createDataFrame([(1, 0, 1.0, "repetition", "")], EVALS)
    got = sorted((r["turn_id"], r["user_msg"], r["assistant_msg"], r["label"]) for r in report.error_snippets(o, m, evals).collect())
    assert got == [(0, "b", "c", "repetition"), (1, "d", "", ""), (5, "", "", "")]


def test_knowledge_base(spark):
    html = "<html><head><title> T </title><script>x</script></head><body><p>one <a href='/p/in#f'>in</a></p><a href='http://other/x'>out</a><!-- c --><a href='/p/f.pdf'>pdf</a><a href='/p/in/'>again</a></body></html>"
    pages = spark.createDataFrame([("http://h/p", html), ("http://n", None), ("http://e", "plain")], "url string, html string")
    got = {r["url"]: (r["title"], r["content"]) for r in kb.html_to_text(pages).collect()}
    assert got == {"http://h/p": ("T", "T\none\nin http://h/p/in\npdf http://h/p/f.pdf\nagain http://h/p/in"), "http://n": ("http://n", ""), "http://e": ("http://e", "plain")}
    assert [tuple(r) for r in kb.extract_links(pages).collect()] == [("http://h/p", "http://h/p/in")]
    docs = spark.createDataFrame([(1, "s", "abc def ghi jkl", False, False), (2, "s", "", False, False), (3, "s", None, False, False), (4, "s", "x", False, True), (5, "s", "y" * 50, True, False)], "id long, source string, content string, is_chunk boolean, is_error boolean")
    chunks = {r["id"]: r["content"] for r in kb.chunk_documents(docs, 8, 4).collect()}
    assert chunks == {"1_0": "abc def ", "1_1": "def ghi ", "1_2": "ghi jkl", "5": "y" * 50}
    assert "".join(kb.chunk_text("ab\n\ncd ef" * 9, 7, 0)) == "ab\n\ncd ef" * 9 and max(map(len, kb.chunk_text("x" * 99, 10, 3))) <= 10
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(40)] + [(40, [0.0] * 4)], "vec_id long, embedding array<double>")
    unit = kb.l2_normalize(v)
    m = {r["vec_id"]: np.array(r["embedding"]) for r in unit.collect()}
    assert all(abs(np.linalg.norm(x) - (i < 40)) < 1e-9 for i, x in m.items())
    best = kb.top_k(unit.where("vec_id < 3").selectExpr("vec_id as query_id", "embedding"), unit.selectExpr("vec_id as chunk_id", "embedding").repartition(3), 5)
    found = {(r["query_id"], r["place"]): r["chunk_id"] for r in best.collect()}
    for q in range(3):
        order = sorted(m, key=lambda i: (-(m[q] @ m[i]), i))[:5]
        assert [found[q, k + 1] for k in range(5)] == order
    assert kb.top_k(unit.limit(0).selectExpr("vec_id as query_id", "embedding"), unit.selectExpr("vec_id as chunk_id", "embedding")).count() == 0


def test_metrics_fail_alone(spark):
    rows = spark.createDataFrame([(1, 0, "abc"), (1, 1, ""), (2, 0, "abcdef")], "conversation_id long, turn_id long, text string")
    scores, errors = score_with(rows, QuantMetric("inverse", lambda text, k: (k / len(text), "why"), ["text"], additional_input={"k": 6}))
    assert sorted((r["conversation_id"], r["turn_id"], r["value"], r["reason"], r["scope"]) for r in scores.collect()) == [(1, 0, 2.0, "why", "turn"), (2, 0, 1.0, "why", "turn")]
    assert [(r["turn_id"], r["error"].split(":")[0]) for r in errors.collect()] == [(1, "ZeroDivisionError")]
    labels, _ = score_with(rows.where("turn_id = 0"), QualMetric("size", lambda text: "long" if len(text) > 3 else "short", ["text"], scope="conversation"))
    assert sorted((r["conversation_id"], r["value"]) for r in labels.collect()) == [(1, "short"), (2, "long")]


def test_sinks(spark, tmp_path):
    convo = spark.createDataFrame([(1, 0.5), (2, 1.0)], "conversation_id long, overall_agent_score double")
    turn = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "conversation_id long, turn_id long, label string")
    write_evaluation(convo, turn, str(tmp_path / "e"), {"simulation_id": "r"})
    got = {r["conversation_id"]: r for r in spark.read.json(str(tmp_path / "e")).collect()}
    assert [t["label"] for t in got[1]["turn_scores"]] == ["a", "b"] and got[2]["turn_scores"] is None and got[2]["simulation_id"] == "r"
    write_focus(spark.createDataFrame([("error_1", "s"), ("all_failures", "s")], "focus_set string, scenario_id string"), str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "f" / "focus_set=error_1")).count() == 1
    write_report_tables({"kpi": convo}, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r" / "kpi")).count() == 2


def test_numbering_in_ranges(spark):
    from parley.functions.tables import numbered

    rows = spark.createDataFrame([(f"r{i % 3}", (i * 7919) % 100, i) for i in range(100)], "run_id string, v long, i long")
    got = numbered(rows, [F.col("v").desc()], "at", partitions=7).collect()
    assert [r["v"] for r in sorted(got, key=lambda r: r["at"])] == sorted(range(100), reverse=True) and sorted(r["at"] for r in got) == list(range(1, 101))
    each = numbered(rows, [F.col("v").asc()], "at", ["run_id"], 5).collect()
    for run in ("r0", "r1", "r2"):
        mine = sorted((r["at"], r["v"]) for r in each if r["run_id"] == run)
        assert [a for a, _ in mine] == list(range(1, len(mine) + 1)) and [v for _, v in mine] == sorted(v for _, v in mine)
    assert numbered(rows.limit(0), [F.col("v").asc()], "at").count() == 0


def test_runs_with_equal_conversation_ids_stay_apart(spark):
    rows = [("a", "c1", 0, 1.0, "repetition", "Said 1"), ("a", "c1", 1, 1.0, "repetition", "said 2"), ("b", "c1", 0, 1.0, "repetition", "said 3"), ("b", "c1", 1, 1.0, "unsafe action", "x"), ("b", "c2", 0, 4.0, C.NO_FAILURE, "")]
    evals = spark.createDataFrame(rows, "run_id string, conversation_id string, turn_id long, turn_score double, label string, reason string")
    errors, occurrences = E.group_failures(evals)
    assert sorted((r["run_id"], r["category"], r["n_occurrences"]) for r in errors.collect()) == [("a", "repetition", 2), ("b", "repetition", 1), ("b", "unsafe action", 1)]
    assert {(r["run_id"], r["turn_id"]): len(r["unique_error_ids"]) for r in E.link_errors(evals, occurrences).where("conversation_id = 'c1'").collect()} == {("a", 0): 1, ("a", 1): 1, ("b", 0): 1, ("b", 1): 1}
    conversations = spark.createDataFrame([("a", "c1", "s1"), ("b", "c1", "s2"), ("b", "c2", "s1")], "run_id string, conversation_id string, scenario_id string")
    scenarios = spark.createDataFrame([("s1", "one", ""), ("s2", "two", "")], "scenario_id string, goal string, user_profile string")
    m = E.error_scenario_mappings(errors, occurrences, conversations, scenarios)
    assert sorted((r["run_id"], r["error_index"], r["severity"], r["scenario_id"]) for r in m.collect()) == [("a", 1, "low", "s1"), ("b", 1, "critical", "s2"), ("b", 2, "low", "s2")]
    focus = E.focus_sets(m, scenarios).where("focus_set = 'all_failures'").collect()
    assert sorted((r["run_id"], r["scenario_id"]) for r in focus) == [("a", "s1"), ("b", "s2")]
    golden = spark.createDataFrame([("a", "c1", 0, "repetition"), ("b", "c1", 0, "false information")], "run_id string, conversation_id string, pos int, label string")
    assert {r["expected"]: r["agreed"] for r in E.judge_agreement(evals, golden).collect()} == {"repetition": 1, "false information": 0}
    best = {r["category"]: (r["conversations"], r["scenarios"]) for r in E.top_errors(errors.where("run_id = 'b'"), occurrences, conversations).collect()}
    assert best == {"unsafe action": (1, 1), "repetition": (1, 1)}
    labels = report.conversation_labels(conversations, 3).collect()
    assert sorted((r["run_id"], r["conversation_id"], r["label"]) for r in labels) == [("a", "c1", "Conversation 1"), ("b", "c1", "Conversation 1"), ("b", "c2", "Conversation 2")]
    quant = spark.createDataFrame([("a", "c1", 0, "helpfulness", "turn", 1.0), ("b", "c1", 0, "helpfulness", "turn", 4.0)], "run_id string, conversation_id string, turn_id long, name string, scope string, value double")
    issues = {(r["run_id"], r["turn_id"]): r["issues"] for r in report.turn_issues(evals.where("conversation_id = 'c1' and turn_id = 0"), quant).collect()}
    assert issues == {("a", 0): "repetition: Said 1; helpfulness (1.0)", ("b", 0): "repetition: said 3"}
    assert {(r["run_id"], r["scores"][0]["value"]) for r in report.turn_rows(evals, quant).where("size(scores) > 0").collect()} == {("a", 1.0), ("b", 4.0)}
    said = spark.createDataFrame([("a", "c1", 0, "simulated_user", "ua"), ("a", "c1", 1, "assistant", "aa"), ("b", "c1", 0, "simulated_user", "ub"), ("b", "c1", 1, "assistant", "ab")], "run_id string, conversation_id string, msg_pos int, role string, content string")
    first = report.error_snippets(occurrences.where("turn_id = 0"), said, evals).collect()
    assert sorted((r["run_id"], r["user_msg"], r["assistant_msg"]) for r in first) == [("a", "ua", "aa"), ("b", "ub", "ab")]
    rows = report.error_rows(errors, occurrences).collect()
    assert sorted((r["run_id"], r["category"], list(r["turns"])) for r in rows) == [("a", "repetition", ["turn_0", "turn_1"]), ("b", "repetition", ["turn_0"]), ("b", "unsafe action", ["turn_1"])]


def test_search_with_text_ids_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(kb, "QUERY_BLOCK", 3)
    monkeypatch.setattr(kb, "CHUNK_BLOCK", 5)
    rng = np.random.default_rng(3)
    m = {f"doc{i}_{i % 4}": rng.normal(size=6) for i in range(31)}
    m["doc_same"] = m["doc3_3"]
    v = kb.l2_normalize(spark.createDataFrame([(k, [float(y) for y in x]) for k, x in m.items()], "id string, embedding array<double>"))
    unit = {k: x / np.linalg.norm(x) for k, x in m.items()}
    found = {(r["query_id"], r["place"]): r["chunk_id"] for r in kb.top_k(v.withColumnRenamed("id", "query_id"), v.withColumnRenamed("id", "chunk_id").repartition(3), 4).collect()}
    assert len(found) == 4 * len(m)
    for q in unit:
        order = sorted(unit, key=lambda i: (-round(float(unit[q] @ unit[i]), 12), i))[:4]
        assert [found[q, k + 1] for k in range(4)] == order
    assert kb.top_k(v.withColumnRenamed("id", "query_id"), v.limit(0).withColumnRenamed("id", "chunk_id")).count() == 0


def test_search_skips_blocks_that_cannot_hold_a_result(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(40, 8)) * 5
    points = [(f"p{i:04d}", (centers[i % 40] + rng.normal(size=8) * 0.05).tolist()) for i in range(2000)] + [("same", (centers[0]).tolist()), ("same2", (centers[0]).tolist())]
    odd = [("null", None), ("ragged", [1.0]), ("empty", []), ("nan", [float("nan")] * 8), ("inf", [float("inf")] * 8), ("hole", [1.0, None, *[0.0] * 6]), ("zero", [0.0] * 8)]
    df = spark.createDataFrame(points + odd, "id string, embedding array<double>").repartition(5)
    asked = df.where("id like 'p000%' or id = 'null' or id = 'same'").withColumnRenamed("id", "query_id")
    found, counts = kb.top_k_counted(asked, df.withColumnRenamed("id", "chunk_id"), 3)
    known = {i: np.array(x) for i, x in [*points, odd[-1]]}
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], {})[r["place"]] = r["chunk_id"]
    assert set(got) == {i for i, _ in points if i.startswith("p000") or i == "same"}
    for q, places in got.items():
        order = sorted(known, key=lambda i: (-round(float(known[q] @ known[i]), 10), i))[:3]
        assert [places[i] for i in (1, 2, 3)] == order
    n = counts.first()
    assert n["invalid_chunks"] == 6 and n["invalid_queries"] == 1 and 0 < n["skipped"] < n["pairs"] and n["skipped"] > n["pairs"] / 2
    texts = df.where("id like 'p00%'").selectExpr("id as chunk_id", "embedding", "concat('t', id) as content", "cast(null as string) as title", "'s' as source")
    one = kb.retrieve(asked.where("query_id = 'p0003'"), texts, 1).collect()
    assert [(r["place"], r["content"], r["title"], r["source"]) for r in one] == [(1, "t" + one[0]["chunk_id"], "", "s")] and one[0]["confidence"] > 0
    none = kb.top_k_counted(asked.limit(0), df.limit(0).withColumnRenamed("id", "chunk_id"))
    assert none[0].count() == 0 and none[1].first()["pairs"] == 0


def test_search_meets_few_blocks_beyond_a_query_s_own(spark, monkeypatch):
    """Queries that are chunks themselves have their best score after the blocks where they stand; nothing is clustered here."""
    monkeypatch.setattr(kb, "CHUNK_BLOCK", 16)
    rng = np.random.default_rng(6)
    m = rng.normal(size=(3000, 16))
    v = kb.l2_normalize(spark.createDataFrame([(f"c{i:04d}", x.tolist()) for i, x in enumerate(m)], "id string, embedding array<double>")).repartition(7)
    asked = v.where("id like '%0'").withColumnRenamed("id", "query_id")
    found, counts = kb.top_k_counted(asked, v.withColumnRenamed("id", "chunk_id"), 1)
    assert {(r["query_id"], r["chunk_id"]) for r in found.collect()} == {(f"c{i:04d}",) * 2 for i in range(0, 3000, 10)}
    n = counts.first()
    assert n["pairs"] == 300 * n["chunk_blocks"] and n["chunk_blocks"] >= 3000 / 16 and n["pairs"] - n["skipped"] < 4 * 300


@pytest.mark.parametrize("scale", [1e-3, 1.0, 1e3])
def test_search_of_other_queries_ties_and_lengths(spark, monkeypatch, scale):
    for name, value in (("CHUNK_BLOCK", 7), ("QUERY_BLOCK", 5), ("PIVOTS", 12), ("HELD_NUMBERS", 60)):
        monkeypatch.setattr(kb, name, value)
    rng = np.random.default_rng(7)
    m = rng.normal(size=(160, 3)).round(1) * rng.choice([0, 1, 1, 5], size=(160, 1)) * scale
    m = np.concatenate([m, m[:40], np.repeat(m[5:6], 60, 0)])
    q = np.concatenate([rng.normal(size=(30, 3)) * scale, m[::9], m[5:6], np.zeros((1, 3))])
    rows = lambda x, name: spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(x)], f"{name} long, embedding array<double>")
    for k in (1, 4, 400):
        found = {(r["query_id"], r["place"]): r["chunk_id"] for r in kb.top_k(rows(q, "query_id").repartition(3), rows(m, "chunk_id").repartition(4), k).collect()}
        scores = [[(-round(float(x @ y), 10), j) for j, y in enumerate(m)] for x in q]
        assert len(found) == len(q) * min(k, len(m))
        for i, each in enumerate(scores):
            got = [each[found[i, place]] for place in range(1, min(k, len(m)) + 1)]
            assert [s for s, _ in got] == pytest.approx([s for s, _ in sorted(each)[:k]], abs=2e-10 * max(1, scale * scale))
            if scale == 1:
                assert got == sorted(each)[:k]


def test_signs_are_counted_as_by_places():
    texts = ["ab\n\ncd ef" * 9, "x" * 99, "", "y z" * 40 + "\n" + "w" * 31]
    assert all(kb.chunk_text(t, a, b) == kb._merged(t, a, b, kb._Measure(range(len(t)))) for t in texts for a, b in ((7, 0), (10, 3), (31, 30)))


def test_token_chunks(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["one two three " * 40, "x", "", None, "é 中文 \U0001f600 " * 9, "a b c d e f g h i j"]
    docs = spark.createDataFrame([(i, "s", t, False, False) for i, t in enumerate(texts)], "id long, source string, content string, is_chunk boolean, is_error boolean")
    got = {}
    for r in kb.token_chunks(docs, path, 10, 3).collect():
        got.setdefault(int(r["id"].split("_")[0]), {})[int(r["id"].split("_")[1])] = r["content"]
    encoder = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        if not t:
            assert i not in got
            continue
        at = encoder.encode(t, add_special_tokens=False).offsets
        want, start = [], 0
        while True:
            part = at[start : start + 10]
            want.append(t[part[0][0] : part[-1][1]])
            if start + 10 >= len(at):
                break
            start += 7
        assert [got[i][k] for k in range(len(got[i]))] == want, i


def slow_chunks(text, size, overlap, starts):
    """The splitter by its rules alone: every stretch is counted sign by sign."""
    count = lambda a, b: sum(a <= s < b for s in starts)

    def pieces(a, b, marks):
        if count(a, b) <= size:
            return [(a, b)] * (b > a)
        mark = [m for m in marks if m in text[a:b]][0]
        if mark == "":
            out, at = [], a
            for x in range(a + 1, b + 1):
                if count(at, x) > size:
                    out.append((at, x - 1))
                    at = x - 1
            return [*out, (at, b)]
        out, at = [], a
        for part in text[a:b].split(mark)[:-1]:
            out += pieces(at, at + len(part) + len(mark), marks[marks.index(mark) + 1 :])
            at += len(part) + len(mark)
        return out + pieces(at, b, marks[marks.index(mark) + 1 :])

    chunks, now = [], []
    for p in pieces(0, len(text), ["\n\n", "\n", " ", ""]):
        held = sum(count(*x) for x in now)
        if now and held + count(*p) > size:
            chunks.append(text[now[0][0] : now[-1][1]])
            while now and (held > overlap or held + count(*p) > size):
                held -= count(*now.pop(0))
        now.append(p)
    return chunks + ([text[now[0][0] : now[-1][1]]] if now else [])


def test_recursive_token_chunks(spark):
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = Tokenizer.from_file(path)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé中\U0001f600") for _ in range(rng.choice([1, 2, 3, 9, 60])))
    texts = ["", None, " ", "x", "\n\n\n\n", "unbroken" * 40] + ["".join(word() + rng.choice([" ", " ", " ", "\n", "\n\n", "  "]) for _ in range(rng.randint(1, 60))) for _ in range(12)]
    docs = spark.createDataFrame([(i, "s", t, False, i == 3) for i, t in enumerate(texts)], "id long, source string, content string, is_chunk boolean, is_error boolean").selectExpr("*", "1 as i", "2 as starts")
    for tokenizer, starts in ((path, lambda t: [a for a, _ in encoder.encode(t, add_special_tokens=False).offsets]), (None, kb.word_starts)):
        for size, overlap in ((10, 3), (4, 0)):
            got = {}
            for r in kb.recursive_token_chunks(docs, tokenizer, size, overlap).collect():
                got.setdefault(int(r["id"].split("_")[0]), {})[int(r["id"].split("_")[1])] = r["content"]
            for i, t in enumerate(texts):
                want = slow_chunks(t, size, overlap, starts(t)) if t and i != 3 else []
                assert [got.get(i, {}).get(k) for k in range(len(want))] == want and len(got.get(i, {})) == len(want), (i, size)
    with pytest.raises(ValueError):
        kb.recursive_token_chunks(docs, None, 5, 5)
    assert kb.recursive_token_chunks(docs.limit(0), None).count() == 0


def test_knowledge_files_to_chunks(spark, tmp_path):
    from parley.functions.tables import write_files
    from parley.sources.documents import read_knowledge_files

    root = f"file://{tmp_path}/kb"
    rows = [("a.html", "<title>T</title><p>one <a href='/x'>two</a></p>"), ("b.md", "three"), ("c.pdf", "x"), (".hidden.md", "no"), ("d.txt", None)]
    assert write_files(spark.createDataFrame(rows, "name string, content string"), root) == 5
    files = kb.readable(read_knowledge_files(spark, root))
    got = {r["source"].rpartition("/")[2]: (r["title"], r["content"], r["is_error"]) for r in files.collect()}
    assert got == {"a.html": ("T", "T\none\ntwo /x", False), "b.md": ("b.md", "three", False), "c.pdf": ("c.pdf", None, True)}
    assert sorted(r["content"] for r in kb.chunk_documents(files, 100, 10).collect()) == ["T\none\ntwo /x", "three"]


def test_files_are_read_by_many_tasks_and_once(spark, tmp_path):
    from parley.functions.tables import write_files
    from parley.sources import documents

    rows = spark.range(40).selectExpr("concat('d', id % 3, '/f', id, if(id % 2 = 0, '.html', '.md')) AS name", "concat('<title>t', id, '</title><p>text ', id, '</p>') AS content")
    assert write_files(rows, f"file://{tmp_path}/kb") == 40
    files = documents.read_knowledge_files(spark, f"file://{tmp_path}/kb")
    assert files.rdd.getNumPartitions() >= 4
    chunks = kb.chunk_documents(kb.readable(files.withColumn("id", F.col("title"))), 2000, 200)
    assert {r["id"]: r["content"] for r in chunks.where("id in ('f1.md_0', 'f2.html_0')").collect()} == {"f1.md_0": "<title>t1</title><p>text 1</p>", "f2.html_0": "t2\ntext 2"}
    assert chunks.count() == 40
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("listing") <= 2 and plan.count("Union") == 1  # the two levels of folders, not a branch for each kind of file


def test_texts_are_python_values_a_few_at_a_time():
    import pyarrow as pa

    from parley.functions.tables import SLICE, sliced

    batch = pa.RecordBatch.from_arrays([pa.array(range(10 * SLICE + 1))], ["x"])
    assert [b.num_rows for b in sliced(iter([batch]))] == [SLICE] * 10 + [1]
