import numpy as np
import pytest
from parley.llm import op01_jaccard_rtree as op1
from parley.llm.shared import KeyFilter, connected_components
from tests.llm.helpers import DOCS, ODD, documents, prose, seeded, white_words


def brute(texts, size, num, den):
    sets = []
    for t in texts:
        w = white_words(t)
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and den * both >= num * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def family(rng, vocab, base, copies, edits):
    out = [base]
    for _ in range(copies):
        w = base.split(" ")
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("size", "num"), [(3, 90), (5, 80)])
def test_components_are_those_of_all_pairs(spark, size, num):
    rng, vocab = seeded(size)
    texts = [*ODD, *ODD]
    for words, copies, edits in ((4, 3, 1), (9, 6, 1), (25, 10, 2), (60, 25, 4), (150, 25, 8), (400, 12, 14)):
        texts += family(rng, vocab, prose(rng, words, vocab), copies, edits)
    chain = prose(rng, 120, vocab).split(" ")
    for i in range(12):  # each links with the next only
        chain = [*chain[3:], *(rng.choice(vocab) for _ in range(3))]
        texts.append(" ".join(chain))
    texts += [prose(rng, rng.randint(3, 80), vocab) for _ in range(60)] + ["w " * 3000 + prose(rng, 3000, vocab)]
    rng.shuffle(texts)
    got = op1.jaccard_components(documents(spark, texts, extra=True).repartition(5), size=size, num=num).collect()
    assert sorted(map(tuple, got)) == brute(texts, size, num, 100)


def test_blocks_of_a_large_cell_lose_nothing(spark, monkeypatch):
    rng, vocab = seeded(3)
    monkeypatch.setattr(op1, "CELL_BLOCK", 7)
    texts = family(rng, vocab, prose(rng, 70, vocab), 60, 5)
    got = op1.jaccard_components(documents(spark, texts)).collect()
    assert sorted(map(tuple, got)) == brute(texts, 3, 90, 100)


def test_keep_one(spark):
    rng, vocab = seeded(4)
    base = prose(rng, 80, vocab)
    docs = documents(spark, ["x y z", base, base, None, None, base + " tail"], extra=True)
    kept = op1.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 3, 4]
    assert sorted(r["doc_id"] for r in op1.keep_one_of_each(docs.unionByName(docs)).collect()) == [0, 1, 3, 4]


def shuffled_bytes(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none = sc._jvm.java.util.ArrayList()
    return sum(x.shuffleWriteBytes() for x in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)))


def test_texts_without_partners_are_not_shuffled(spark):
    rng, _ = seeded(12)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=300)) for _ in range(40)) for _ in range(150)]
    docs = documents(spark, [*texts, texts[3], None, ""]).localCheckpoint()
    before = shuffled_bytes(spark)
    kept = sorted(r["doc_id"] for r in op1.keep_one_of_each(docs, size=5, num=80).collect())
    assert kept == [*range(150), 151, 152]
    assert shuffled_bytes(spark) - before < sum(map(len, texts)) / 4


def test_key_filter_holds_for_every_key(spark):
    keys = spark.range(0, 3000, 3).selectExpr("cast(id as string) as k")
    rows = spark.range(3000).selectExpr("cast(id as string) as k").union(spark.sql("select cast(null as string)"))
    held = [r["k"] for r in KeyFilter(keys, "k").rows(rows, "k").collect()]
    rest = [r["k"] for r in KeyFilter(keys, "k").rows(rows, "k", inside=False).collect()]
    assert set(held) >= set(map(str, range(0, 3000, 3))) and len(held) < 1300
    assert None in rest and len(held) + len(rest) == 3001
    assert KeyFilter(keys.where("k < 0"), "k").rows(rows, "k").count() == 0


def test_repeated_and_null_keys_with_links(spark):
    rng, vocab = seeded(13)
    one, two, three = (prose(rng, 60, vocab) for _ in range(3))
    rows = [(7, one), (3, one), (3, two), (None, one), (None, three), (9, two), (5, three), (5, three), (8, three + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = op1.keep_one_of_each(docs, size=5, num=80).collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == [3, 5]
    assert sorted(r["text"] for r in got if r["doc_id"] is None) == sorted([one, three])


def test_empty_and_null_keys(spark):
    none = spark.createDataFrame([], DOCS)
    assert op1.jaccard_components(none).count() == 0
    rows = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (7, "a b c d")], "doc_id long, text string")
    assert sorted(map(tuple, op1.jaccard_components(rows).collect()), key=str) == [(5, 2, 5), (7, 2, 5), (None, 2, 5)]


def test_tree_bounds_nothing_away():
    rng = np.random.default_rng(0)
    points = rng.poisson(2.0, (500, op1.COUNT_GROUPS)).astype(np.int32)
    points[250:] = np.maximum(points[:250] + rng.integers(-1, 2, (250, op1.COUNT_GROUPS)) * (rng.random((250, op1.COUNT_GROUPS)) < 0.05), 0)
    limit = op1.Threshold(90, 100)
    got = {(int(a), int(b)) for q, p in op1.RTree(points).search(points, limit) for a, b in zip(q, p)}
    sizes = points.sum(1)
    want = {(i, j) for i in range(500) for j in range(500) if np.minimum(points[i], points[j]).sum() >= limit.overlap(sizes[i], sizes[j])}
    assert got == want and len(want) > 700


def test_size_classes_cover_linked_sizes():
    limit = op1.Threshold(90, 100)
    rng = np.random.default_rng(1)
    for n in [1, 2, 3, 5, 9, 10, 11, 19, 20, 37, 100, 501]:
        for extra in range(0, n // 9 + 1):
            a = np.sort(rng.choice(2**62, n, replace=False).astype(np.uint64))
            b = np.sort(np.concatenate([a, rng.choice(2**62, extra, replace=False).astype(np.uint64)]))
            keys = [set(op1.cell_keys(s, np.array([0, len(s)]), limit)[0].tolist()) for s in (a, b)]
            if 100 * n >= 90 * (n + extra):
                assert keys[0] & keys[1], (n, extra)


def test_connected_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (3, 4), (7, 7), (None, 1), *((i, i + 1) for i in range(100, 140))]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, **{i: 100 for i in range(100, 141)}}
