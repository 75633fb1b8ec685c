import corpus_pipeline
from parley.llm.op09_line_frequency import LineLimits
from tests.llm.helpers import documents, prose, seeded
from tests.llm.test_decontamination import brute as hits
from tests.llm.test_jaccard import brute as components
from tests.llm.test_quality import brute_signals


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "PII", "packing"]
    assert LineLimits().min_docs == 20


def test_whole_pipeline(spark, tmp_path):
    rng, vocab = seeded(20)
    base = prose(rng, 120, vocab)
    item = prose(rng, 40, vocab)
    texts = [prose(rng, 100, vocab) for _ in range(6)] + [base, base, base + " extra", "too short", None, "spam spam " * 80, prose(rng, 60, vocab) + " " + item, prose(rng, 90, vocab) + " jo.doe@mail1.example.com end"]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    fine = [i for i, t in enumerate(texts) if not brute_signals(t)[5]]
    groups = components([texts[i] for i in fine], 5, 80, 100)
    kept = [fine[i] for i, _, c in groups if i == c]
    kept = [i for i in kept if not hits([(i, texts[i])], [(1, item)])[0][5]]
    assert kept == [0, 1, 2, 3, 4, 5, 6, 13]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
    assert sorted(r["doc_id"] for r in docs.collect()) == kept and "jo.doe" not in docs.where("doc_id = 13").first()["text"]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == set(kept)
    assert packed.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).where("`sum(length)` <> `max(doc_tokens)`").count() == 0
