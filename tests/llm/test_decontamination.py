import hashlib
import re

import numpy as np

from parley.llm import op05_suffix_array as op5
from tests.llm.helpers import DOCS, ODD, UPPER, documents, prose, seeded


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items, window=13):
    windows = {}
    for i, t in items:
        w = words(t)
        if w:
            n = min(window, len(w))
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    lengths = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[g]
        s = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), s, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def case(spark):
    rng, vocab = seeded(7)
    vocab = vocab[:60]
    items = [prose(rng, rng.randint(14, 60), vocab) for _ in range(15)] + ["short one", "UP down, up", "z", None, "", "!!", "a a a a a a a a a a a a a a a a"]
    texts = [*ODD, "short one", "x short  ONE y", "a " * 40, "b " + "a " * 14 + "b"]
    for i in range(60):
        w = prose(rng, rng.randint(1, 300), vocab).split(" ")
        if i % 2:
            part = items[rng.randrange(15)].split(" ")
            a = rng.randrange(len(part))
            at = rng.randrange(len(w) + 1)
            w[at:at] = part[a : a + rng.randint(1, 40)]
        texts.append(" ".join(w))
    texts += [items[0], items[0] + " " + items[1], (items[2] + " ") * 30]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return texts, items, bench


def test_windows(spark):
    texts, items, bench = case(spark)
    docs = documents(spark, texts, extra=True).repartition(3)
    want = brute(enumerate(texts), enumerate(items))
    assert sorted(map(tuple, op5.contamination(docs, bench).collect())) == want
    for size in (20, 300):
        assert sorted(map(tuple, op5.contamination(docs, bench, block_chars=size).collect())) == want
        kept = op5.remove_contaminated(docs, bench, block_chars=size)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [w[0] for w in want if not w[5]]
    assert len(op5.write_blocks(bench, block_chars=20).files) > 10 and len(op5.write_blocks(bench).files) == 1


def test_rows_with_equal_and_null_keys_are_judged_alone(spark):
    item = " ".join(f"w{i}" for i in range(13))
    docs = spark.createDataFrame([(1, "clean"), (1, f"x {item}"), (None, item), (None, "fine"), (None, item)], "doc_id long, text string")
    bench = spark.createDataFrame([("a", item), ("b", "other " * 20), (None, "third " * 20), ("a", item)], "item_id string, text string")
    for size in (20, 10**6):
        got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in op5.contamination(docs, bench, block_chars=size).collect())
        assert got == [("1", 1, 0, 0, False), ("1", 14, 13, 1, True), ("None", 1, 0, 0, False), ("None", 13, 13, 1, True), ("None", 13, 13, 1, True)]
        assert sorted((r["text"] for r in op5.remove_contaminated(docs, bench, block_chars=size).collect())) == ["clean", "fine"]


def test_longest_matches(spark):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)))], "item_id long, text string")
    docs = documents(spark, ["x " + " ".join(f"w{i}" for i in range(4, 24)) + " y", "nothing"])
    for size in (1, 10**6):
        got = sorted((r["item_word"], r["doc_word"], r["length"]) for r in op5.longest_matches(docs, bench, block_chars=size).collect())
    assert got == [(4 + i, 1 + i, 20 - i) for i in range(8)]


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = documents(spark, ["a b", None])
    assert sorted((r["n_words"], r["n_hit"], r["contaminated"]) for r in op5.contamination(docs, bench).collect()) == [(0, 0, False), (2, 0, False)]
    assert op5.remove_contaminated(docs, bench).count() == 2
    assert op5.contamination(spark.createDataFrame([], DOCS), bench).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n, k in ((1, 1), (50, 2), (300, 5)):
        x = rng.integers(1, k + 1, n)
        got = op5.suffix_array(x, n + 1)
        assert got.tolist() == sorted(range(n), key=lambda i: x[i:].tolist())
