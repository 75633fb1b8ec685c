import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from parley.llm import op09_line_frequency as op9
from parley.llm import op10_gam as op10
from tests.llm.helpers import DOCS, ODD, documents, prose, seeded


def brute_signals(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(windows)
    inside = {i + k for i, g in enumerate(windows) if many[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w))


def test_signals(spark):
    rng, vocab = seeded(9)
    texts = [*ODD, "a b c " * 30, prose(rng, 80, vocab) + "\n" + prose(rng, 10, vocab) * 3, "# $ | <a> " * 20, "x y\n\nx y\n x y\n", prose(rng, 30_000, vocab), "spam " * 60_000]
    texts += [prose(rng, rng.randint(1, 200), vocab[:20]) for _ in range(30)]
    got = {r["doc_id"]: r for r in op9.quality_verdicts(documents(spark, texts, extra=True)).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute_signals(t), i


def test_frequent_lines(spark):
    rng, vocab = seeded(10)
    limits = op9.LineLimits(min_docs=5, min_share=0.0)
    banner = "Accept  ALL cookies now please"
    texts = [prose(rng, 60, vocab) + "\n" + (banner if i % 3 == 0 else "") for i in range(60)]
    boiler = [f"Shared line number {k} with some more words in it, twelve or so of them" for k in range(6)]
    texts += [prose(rng, 24, vocab) + "\n" + "\n".join(rng.sample(boiler, 5)) for _ in range(60)]  # mostly shared lines
    copied = prose(rng, 100, vocab)
    texts += [copied] * 40  # copies count once, so their lines are not frequent
    docs = documents(spark, texts, extra=True)
    # every shared line stands in documents of each host
    got = {r["doc_id"]: r for r in op9.quality_verdicts(docs, limits=limits).collect()}
    assert len(got) == len(texts)
    assert all(got[i]["kept"] and got[i]["n_removed"] == (5 if i % 3 == 0 else 0) for i in range(60))
    assert all(got[i]["kept"] and got[i]["n_removed"] == 0 for i in range(120, 160))
    worn = [i for i in range(60, 120) if not got[i]["kept"]]
    assert all((got[i]["base_failed"] or got[i]["n_words"] - got[i]["n_removed"] < 0.25 * got[i]["n_words"]) == (i in worn) for i in range(60, 120))
    kept = op9.drop_low_quality(docs, limits=limits)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    assert kept.where("doc_id = 1").first() == docs.where("doc_id = 1").first()
    stripped = {r["doc_id"]: r["text"] for r in op9.strip_frequent_lines(docs, limits=limits).collect()}
    assert banner not in stripped[0] and stripped[1] == texts[1]


def test_depletion(spark):
    limits = op9.LineLimits(min_docs=3, min_share=0.0)
    rng, vocab = seeded(11)
    lines = [prose(rng, 20, vocab, line=30) for _ in range(5)]
    texts = ["\n".join([*rng.sample(lines, 4), f"own words {i} here"]) for i in range(40)]
    docs = documents(spark, texts).selectExpr("doc_id", "text", "lang", "'one' as source", "n_chars")
    got = op9.quality_verdicts(docs, limits=limits).collect()
    counts = defaultdict(set)
    for i, t in enumerate(texts):
        for x in t.split("\n"):
            counts[x].add(i)
    assert not any(r["kept"] for r in got) and all(r["n_removed"] == 80 for r in got)
    assert op9.drop_low_quality(docs, limits=limits).count() == 0


def test_documents_of_shared_lines_count_each(spark):
    rng, vocab = seeded(13)
    shared = [prose(rng, 10, vocab) for _ in range(12)]
    texts = ["\n".join([*shared, f"own words {i} here"]) for i in range(60)]
    texts += ["  " + texts[0].upper().replace(" ", "  ")] * 3  # copies after normalisation
    docs = documents(spark, texts).selectExpr("doc_id", "text", "'one' as source")
    counts = {r["n_docs"] for r in op9.frequent_lines(op9.line_table(docs)).collect()}
    assert counts == {60}
    assert all(r["n_removed"] == 120 and not r["kept"] for r in op9.quality_verdicts(docs).collect())


def test_the_pipeline_takes_flagged_lines_out(spark):
    from corpus_pipeline import quality_rules

    rng, vocab = seeded(14)
    own = [prose(rng, 80, vocab) for _ in range(30)]
    texts = [f"{t}\n\nAll rights RESERVED by us" for t in own]
    docs = documents(spark, texts).selectExpr("doc_id", "text", "'one' as source", "n_chars").unionByName(documents(spark, own[1:2]).selectExpr("doc_id", "text", "'two' as source", "n_chars"))
    got = quality_rules(spark, docs, "")
    assert got.dtypes == docs.dtypes
    rows = sorted((r["source"], r["doc_id"], r["text"], r["n_chars"]) for r in got.collect())
    assert rows == sorted([("one", i, t + "\n", len(t) + 1) for i, t in enumerate(own)] + [("two", 0, own[1], len(own[1]))])


def test_rows_of_null_and_repeated_keys_are_judged_by_themselves(spark):
    """As SQL does that numbers the rows: a clean and a worn text of one key, worn ones of null keys, hosts apart."""
    import duckdb

    rng, vocab = seeded(15)
    boiler = [prose(rng, 70, vocab, line=100) for _ in range(2)]
    rows = [(i, "\n".join([*boiler, f"own words {i}"]), "h") for i in range(30)]
    rows += [(7, prose(rng, 60, vocab), "h"), (None, boiler[0], "h"), (None, boiler[0], "h"), (None, prose(rng, 60, vocab), "h"), (3, boiler[1], "other"), (3, boiler[1], None), (8, None, "h"), (None, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = sorted((tuple(r) for r in op9.quality_verdicts(docs).collect()), key=repr)
    documents = docs.toPandas()  # noqa: F841 - read by name
    want = sorted((tuple(r) for r in duckdb.sql(op9.ORACLE_SQL).fetchall()), key=repr)
    assert got == want and {r[-1] for r in got if r[0] == 7} == {True, False}
    kept = [(r["doc_id"], r["text"], r["source"]) for r in op9.drop_low_quality(docs).collect()]
    assert sorted(kept, key=repr) == sorted([rows[30], *rows[33:36]], key=repr) and sum(r[-1] for r in want) == 4
    stripped = op9.drop_low_quality(docs, strip=True).where("doc_id is null").collect()
    assert [r["text"] for r in stripped] == [rows[33][1]]


@pytest.mark.parametrize("most", [op9.BROADCAST_LINES, 0])
def test_frequent_lines_leave_texts_by_either_way(spark, monkeypatch, most):
    monkeypatch.setattr(op9, "BROADCAST_LINES", most)
    rng, vocab = seeded(16)
    shared = [f"shared line {k} of many" for k in range(100)]
    rows = [(i % 3 or None, "\n".join([*shared, f"own {i}"]), f"h{i % 2}") for i in range(60)] + [(1, "\n".join(shared[:3]), "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(r["text"] for r in op9.strip_frequent_lines(docs).collect())
    assert got == sorted([f"own {i}" for i in range(60)] + ["\n".join(shared[:3])])


def test_quality_rules_on_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert op9.quality_verdicts(none).count() == 0 and op9.drop_low_quality(none).count() == 0
    odd = spark.createDataFrame([(None, "a b c", None), (1, None, "h"), (1, None, "h")], "doc_id long, text string, source string")
    assert op9.quality_verdicts(odd).count() == 3


def junk(rng, vocab):
    kind = rng.randrange(4)
    w = [rng.choice(vocab) for _ in range(rng.randint(40, 200))]
    if kind == 0:
        return " ".join(x.upper() + "!!" for x in w)
    if kind == 1:
        return " ".join([rng.choice(w)] * len(w))
    if kind == 2:
        return " | ".join(w)
    return " ".join(x + rng.choice(["###", "%%%", "$$$"]) for x in w)


def test_model_tells_junk_from_prose(spark):
    rng, vocab = seeded(12)
    texts = [prose(rng, rng.randint(40, 300), vocab) if i % 2 else junk(rng, vocab) for i in range(500)] + ODD
    docs = documents(spark, texts, extra=True)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(500)] + [(None, 1, 0), (3, None, 0), (10_000, 1, 1)], "doc_id long, quality int, toxic int")
    out = op10.classify(docs, labels).collect()
    assert len(out) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 500]
    assert 60 < len(held) < 140 and np.mean([r["predicted"] == r["doc_id"] % 2 for r in held]) > 0.95


def test_model_without_labels_is_constant(spark):
    docs = documents(spark, ["a b", None])
    for rows in ([], [(0, 1)], [(0, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        assert len({r["score"] for r in op10.classify(docs, labels).collect()}) == 1
    assert op10.classify(docs.limit(0), labels).count() == 0


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = op10.fit(x[:3000], y[:3000], rounds=20, pair_rounds=60, n_pairs=1)
    assert model.pairs == [(0, 1)] and ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def test_distinct_words_nearby_reads_whole_texts():
    rng = np.random.default_rng(4)
    n = np.array([0, 1, 99, 100, 101, 450, 0])
    at = np.concatenate([[0], np.cumsum(n)])
    words = rng.integers(0, 60, at[-1]).astype(np.uint64)
    got = op10._distinct_nearby(words, at)
    for i in range(len(n)):
        parts = [words[at[i] : at[i + 1]][j : j + 100] for j in range(0, n[i], 100)]
        assert got[i] == pytest.approx(np.mean([len(set(p.tolist())) / len(p) for p in parts]) if parts else 0)
