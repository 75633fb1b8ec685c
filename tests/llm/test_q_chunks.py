"""Spelling variants against brute force over all pairs of words."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from parley.llm import op12_q_chunks as op12
from tests.llm.helpers import DOCS, ODD, UPPER, documents, seeded


def edits(word, alphabet):
    """All texts at one inserted, deleted or replaced code point."""
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet}
    return out - {word}


def brute_counts(rows, min_count=5):
    n = Counter()
    for key, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= min_count}


def brute_forms(n):
    alphabet = set("".join(n))
    out = set()
    forms = {}
    for w in n:
        near = [x for x in edits(w, alphabet) if x in n]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        forms[w] = (best if best and n[best] >= 5 * n[w] else None, len(near))
    for w in n:
        root = w
        while forms[root][0]:
            root = forms[root][0]
        form = forms[w][0]
        out.add((w, n[w], forms[w][1], form, n[form] if form else None, root))
    return out


def counts_table(spark, n):
    return spark.createDataFrame(list(n.items()), "word string, n long")


@pytest.mark.parametrize("max_pairs", [op12.MAX_PAIRS, 20, 0])
def test_near_pairs_equal_brute_force(spark, max_pairs):
    rng = random.Random(7)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(500)} | {"aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa", "abababa"}
    want = {tuple(sorted(p, key=lambda w: (len(w), w))) for w in words for x in edits(w, "abé") & words for p in [(w, x)]}
    got = [tuple(r) for r in op12.near_pairs(counts_table(spark, dict.fromkeys(words, 1)).select("word"), max_pairs).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def test_every_edit_of_words_of_all_lengths_is_found(spark):
    rng = random.Random(8)
    base = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyzàé", n)) for n in range(6, 16)]
    words = set(base) | {e for w in base for e in edits(w, "xß")}
    want = sum(1 for w in words for x in edits(w, set("".join(words))) if x in words) // 2
    for max_pairs in (op12.MAX_PAIRS, 0):
        assert op12.near_pairs(counts_table(spark, dict.fromkeys(words, 1)).select("word"), max_pairs).count() == want


def test_forms_chains_and_ties(spark):
    n = {"colour": 1000, "colours": 200, "colourss": 40, "coloursss": 8, "colous": 8, "dollar": 7, "lonely-not": 5, "abcdef": 50, "abcdeg": 50, "abcdeh": 10, "abcdei": 11}
    got = {r["word"]: r for r in op12.variant_forms(counts_table(spark, n)).collect()}
    assert set(map(tuple, got.values())) == brute_forms(n)
    assert got["coloursss"]["root"] == "colour" and got["coloursss"]["form"] == "colourss"
    assert got["abcdeh"]["form"] == "abcdef" and got["abcdei"]["form"] is None and got["dollar"]["n_near"] == 0


def test_whole_query_equals_brute_force(spark):
    rng, vocab = seeded(9)
    base = ["".join(rng.choice("abcdeéÀ×") for _ in range(rng.randint(5, 9))) for _ in range(30)]
    rows = [(i if i % 9 else None, " ".join(rng.choice(base).upper() if rng.random() < 0.2 else rng.choice(base) for _ in range(rng.randint(0, 400))) + rng.choice(["", " don't 12x", "\n"])) for i in range(120)]
    rows += [(i, t) for i, t in enumerate(ODD)] + [(3, rows[3][1])] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n", "3 as run", "4 as h", "5 as _key").repartition(5)
    got = [tuple(r) for r in op12.spelling_variants(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_forms(brute_counts(rows))
    assert any(r[3] for r in got)


def test_empty_tables(spark):
    assert op12.spelling_variants(spark.createDataFrame([], DOCS)).collect() == []
    assert op12.spelling_variants(documents(spark, ODD)).collect() == []
    with pytest.raises(ValueError):
        op12.variant_forms(counts_table(spark, {"abcdef": 1}), ratio=1)


def test_halves_are_disjoint_and_whole(spark):
    word = "abcdefghi"
    row = op12._contributions(spark.createDataFrame([(word,)], "word string"), "chunks").orderBy("part").collect()
    assert [r["piece"] for r in row] == ["abcd", "efghi"]
    for r, other in itertools.permutations(row, 2):
        assert r["left"] + r["right"] == other["piece"]
