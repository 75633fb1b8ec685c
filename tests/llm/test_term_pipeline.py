"""Ranked search against scores computed one by one."""

import math
import re
from collections import Counter

import pytest

from parley.llm import op13_term_pipeline as op13
from tests.llm.helpers import ODD, UPPER, prose, seeded

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, k):
    """Sorted (item, rank, key, score) for lists of (key, text)."""
    split = [(d, [t.translate(UPPER) for t in TERMS.findall(x or "")]) for d, x in docs]
    N, L = sum(bool(t) for _, t in split), sum(len(t) for _, t in split)
    df = Counter(t for _, ts in split for t in set(ts))
    out = []
    for item, text in items:
        asked = Counter(t.translate(UPPER) for t in TERMS.findall(text or ""))
        scored = []
        for d, ts in split:
            tf, n = Counter(ts), len(ts)
            score = 0
            for t, q in asked.items():
                if tf[t]:
                    m = 75 + (25 * n * N) // L
                    score += q * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 12 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, k=20, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as row", "2 as n", "'x' as doc", "3 as shard", "4 as terms").repartition(3)
    i = spark.createDataFrame(items, "item_id string, text string").selectExpr("*", "1 as row", "2 as bundle", "3 as doc_id", "4 as score")
    return sorted((tuple(r) for r in op13.top_documents(d, i, k, **options).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"owners": 1}, {"owners": 6, "bundle_items": 3, "shard_docs": 32}, {"owners": 2, "bundle_items": 1, "shard_docs": 40}])
def test_equals_brute_force(spark, options):
    rng, vocab = seeded(11)
    weights = [1 / (i + 1) for i in range(len(vocab))]
    text = lambda n: " ".join(rng.choices(vocab, weights, k=n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(150)]
    docs += [(i + 1000, docs[i][1]) for i in range(0, 60)] + [docs[3]] * 3
    items = [(f"q{i}", text(rng.randint(1, 12))) for i in range(12)]
    assert found(spark, docs, items, 5, **options) == brute(docs, items, 5)


def test_odd_texts_ties_and_null_keys(spark):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, "one two"), (90, "One TWO"), (91, "one two"), (91, "one two"), (None, None)]
    items = [("a", "one"), ("a", "one"), (None, "two two x"), ("b", None), ("c", ""), ("d", "absent"), ("e", "中文 éè 12"), ("f", "same a same")]
    got = found(spark, docs, items, 4)
    assert got == brute(docs, items, 4)
    assert [r[2] for r in got if r[0] is None].count(None) <= 1


def test_empty_tables(spark):
    docs, none = [(1, "a b")], []
    assert found(spark, docs, none) == [] and found(spark, none, [("q", "a")]) == [] and found(spark, none, none) == []


def test_hot_terms_and_long_texts(spark):
    rng, vocab = seeded(12)
    docs = [(i, "the " * rng.randint(1, 9) + prose(rng, 8, vocab)) for i in range(400)] + [(999, "the rare " + "x " * 200_000)]
    items = [("q", "the the the rare"), ("r", "the " + " ".join(vocab[:50]))]
    assert found(spark, docs, items, shard_docs=64) == brute(docs, items, 20)


def test_bands_deal_postings_evenly(spark):
    df = spark.createDataFrame([(b, 10) for b in range(8)], "band long, df long")
    assert op13._bands(df, 4) == [2, 4, 6] and op13._bands(df, 1) == []
    assert op13._bands(df.limit(0), 3) == [1 << 30] * 2


def test_weights_as_in_doubles():
    assert op13.weight(10, 10) == math.floor(1000 * math.log(22 / 21)) and op13.weight(1, 0) == math.floor(1000 * math.log(4))
    assert op13.weight(10**12, 1) > 20_000


def test_rows_of_bundles_are_bounded(spark, monkeypatch):
    """Readers and writers hold rows by number, so none may grow with a shard."""
    written, write = {}, op13.materialize

    def seen(df, name):
        written.setdefault(name, []).append(write(df, name))
        return written[name][-1]

    monkeypatch.setattr(op13, "materialize", seen)
    monkeypatch.setattr(op13, "remove", lambda *a: None)
    rng, vocab = seeded(13)
    docs, items = [(i, prose(rng, 30, vocab)) for i in range(900)], [(f"q{i}", prose(rng, 12, vocab)) for i in range(60)]
    got = found(spark, docs, items, 3)
    assert got == brute(docs, items, 3) and len(got) == 180
    for table in written["bundles"] + written["accumulators"]:
        sizes = [f"max(length({c}))" for c, kind in table.dtypes if kind == "binary"]
        assert max(table.selectExpr(*sizes).first()) <= 8 * op13.SLICE_PAIRS
        assert all(kind != "array<string>" for _, kind in table.dtypes)
    assert max(t.count() for t in written["accumulators"]) > 20
