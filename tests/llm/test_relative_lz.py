"""Substring deduplication against brute force over all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from parley.llm import op11_relative_lz as op11
from tests.llm.helpers import DOCS, ODD, documents, prose, seeded


def brute(rows, window):
    """(key, n_words, n_removed, sha256, kept text) of each row (key, text), by looking every window up."""
    split = [(k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in rows]
    least = {}
    for k, ws in split:
        for i in range(len(ws) - window + 1) if k is not None else ():
            g = tuple(ws[i : i + window])
            least[g] = min(least.get(g, k), k)
    out = []
    for k, ws in split:
        gone = set()
        for i in range(len(ws) - window + 1) if k is not None else ():
            if least[tuple(ws[i : i + window])] < k:
                gone |= set(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((k, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def found(df, **options):
    return sorted((tuple(r) for r in op11.deduplicate(df, with_text=True, **options).collect()), key=repr)


def mosaic(rng, vocab, n=40):
    """Texts of shared passages, cut and joined at random places, so that factors meet at all kinds of boundaries."""
    passages = [[rng.choice(vocab) for _ in range(rng.randint(3, 40))] for _ in range(8)]
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 8)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            words += p[a : a + rng.randint(1, 30)]
            words += [rng.choice(vocab) for _ in range(rng.choice([0, 0, 1, 3]))]
        out.append(rng.choice([" ", "\n", " \t "]).join(words))
    return out


@pytest.mark.parametrize("options", [{}, {"max_segments": 1}, {"block_words": 1, "max_segments": 3}, {"anchor": 2}, {"anchor": 8}])
def test_equals_brute_force(spark, options):
    rng, _ = seeded(3)
    rows = list(enumerate(mosaic(rng, ["a", "b", "c", "dé", "A"])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df, window=8, **{"anchor": 4} | options) == brute(rows, 8)


def test_copies_of_whole_texts_and_edits(spark):
    rng, vocab = seeded(4)
    base = prose(rng, 400, vocab)
    texts = [base] * 6 + [base.replace(" ", "  ", 30), base.upper()]
    for _ in range(10):
        words = base.split()
        for _ in range(4):
            words[rng.randrange(len(words))] = "edit"
        texts.append(" ".join(words))
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows, 50)
    assert sum(r[2] for r in got) > 1000


def test_passage_of_fifty_words_goes_and_of_forty_nine_stays(spark):
    rng, vocab = seeded(5)
    p = [f"w{i}" for i in range(50)]
    rows = [(1, " ".join(["x1", *p, "y1"])), (2, " ".join(["x2", *p, "y2"])), (3, " ".join(["x3", *p[:49], "y3"]))]
    got = {r[0]: r for r in found(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got[1][2] == 0 and got[2][2:5:2] == (50, "x2 y2") and got[3][2] == 0


def test_odd_rows_repeated_and_null_keys(spark):
    text = " ".join(str(i % 7) for i in range(30))
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, text), (None, text), (50, text), (50, text), (50, text + " z"), (51, text), (51, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as doc", "2 as mark", "3 as start", "4 as anchor", "array(5) as spans", "6 as _x")
    got = found(df, window=8, anchor=4)
    assert got == brute(rows, 8)
    assert [r[2] for r in got if r[0] == 51] == [30, 30] and [r[2] for r in got if r[0] is None] == [0, 0]


def test_empty_table_and_a_very_long_text(spark):
    assert found(spark.createDataFrame([], DOCS)) == []
    rng = random.Random(6)
    long = " ".join(str(rng.randrange(50_000)) for _ in range(300_000))
    rows = [(1, long), (2, long[100:-100]), (3, "short")]
    assert found(documents(spark, []).sparkSession.createDataFrame(rows, "doc_id long, text string")) == brute(rows, 50)


def test_greedy_factors_cover_each_word_once():
    matches = np.array([3, 2, 1, 0, 0, 4, 3, 2, 1])
    seg, first, size = op11.parse(matches, np.array([0, 5]), np.array([5, 9]))
    assert list(zip(seg.tolist(), first.tolist(), size.tolist())) == [(0, 0, 3), (0, 3, 1), (0, 4, 1), (1, 5, 4)]
