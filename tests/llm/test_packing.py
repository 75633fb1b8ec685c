import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from parley.llm import op03_packing as op3
from tests.llm.helpers import DOCS, ODD, documents, prose, seeded

PATH = public_tokenizers.path("word_bpe_49k.json")


def odd_texts():
    rng, vocab = seeded(5)
    texts = [*ODD, *ODD, "Wow!!! End.. of, (this). a.b,c. X. 1. İstanbul. ΣΑΣ. é. <|ENDOFTEXT|>. don't. it'll.", " wide space.", prose(rng, 9000, vocab), "x" * 3000]
    return texts + [prose(rng, rng.randint(1, 900), vocab) for _ in range(40)]


def test_words_give_the_texts_ids():
    t, texts = Tokenizer.from_file(PATH), odd_texts()
    got = op3.WordEncoder(PATH).encode(texts)
    for text, ids in zip(texts, got):
        assert ids.tolist() == t.encode(text or "", add_special_tokens=False).ids, text


@pytest.mark.parametrize("partitions", [1, 3])
def test_every_id_is_in_one_piece(spark, partitions):
    t, texts = Tokenizer.from_file(PATH), odd_texts()
    whole = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for i, x in enumerate(texts)}
    rows = op3.pack(documents(spark, texts, extra=True).repartition(partitions), PATH).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["length"] > 0 and len(ids) == r["length"] and list(r["ids"]) == ids.tolist()
        assert r["ids_crc32"] == zlib.crc32(ids.tobytes()) and r["doc_tokens"] == len(whole[r["doc_id"]])
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, ids in whole.items():
        at = 0
        for a, n in sorted(by_doc[i]):
            assert a == at
            at += n
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for a, n in sorted(pieces):
            assert a == at
            at += n
        assert at <= op3.CAPACITY
    total = sum(map(len, whole.values()))
    assert len(by_sequence) <= -(-total // op3.CAPACITY) + partitions


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], DOCS)
    assert op3.pack(none, PATH, with_ids=False).count() == 0
    docs = documents(spark, ["same text", None])
    got = Counter(r["doc_id"] for r in op3.pack(docs.unionByName(docs), PATH, with_ids=False).collect())
    assert got == {0: 2, 1: 2}


def test_differencing():
    bins = op3.karmarkar_karp([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in b) for b in bins) in ([14, 16], [15, 15])
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 1000, 300).tolist()
    bins = op3.karmarkar_karp(sizes, 16)
    sums = [sum(sizes[i] for i in b) for b in bins]
    assert sorted(i for b in bins for i in b) == list(range(300)) and max(sums) - min(sums) < 20
    assert [len(b) for b in op3.karmarkar_karp([3, 2], 4)].count(0) == 2 and op3.karmarkar_karp([], 3) == [[], [], []]


def test_window_count_rises_past_the_capacity():
    p = op3.Packer(0, 100, 4)
    p.trim = 0
    for k in range(5):
        p.add(k, np.arange(60, dtype="<u4"))
    p.flush()
    assert p.next == 5  # 300 ids fit three windows, but no two pieces of 60 fit one
    p = op3.Packer(0, 100, 3)
    for k in range(5):
        p.add(k, np.arange(60, dtype="<u4"))
    p.flush()
    assert sum(x[2] for x in p.out) == 300 and max(sum(x[2] for x in p.out if x[5] == s) for s in range(p.next)) <= 100
