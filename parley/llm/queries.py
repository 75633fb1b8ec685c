"""The queries of the training-data operators over their whole tables, and their SQL."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parley.llm import op01_jaccard_rtree as op1
from parley.llm import op02_html_blocks as op2
from parley.llm import op03_packing as op3
from parley.llm import op04_feistel_pii as op4
from parley.llm import op05_suffix_array as op5
from parley.llm import op06_secret_forest as op6
from parley.llm import op07_warc as op7
from parley.llm import op08_brown as op8
from parley.llm import op09_line_frequency as op9
from parley.llm import op10_gam as op10
from parley.llm import op11_relative_lz as op11
from parley.llm import op12_q_chunks as op12
from parley.llm import op13_term_pipeline as op13


def tokenizer_path() -> str:
    """The vocabulary file that the packing query uses; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The setting that holds the key of pseudonyms, so that they stay equal between applications.
PSEUDONYM_SETTING = "spark.parley.pseudonymKey"
_session_keys: dict[str, bytes] = {}


def pseudonym_key(spark: SparkSession) -> bytes:
    """The key of PSEUDONYM_SETTING, or else a random one that this application keeps: nobody can undo its pseudonyms, and other applications make other ones."""
    found = spark.conf.get(PSEUDONYM_SETTING, None)
    return found.encode() if found else _session_keys.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1.jaccard_components(table(spark, sf_dir, "documents"))


def op2_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2.main_text(table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3.pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op4_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), pseudonym_key(spark), report=True).drop("spans")


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6.scan(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7.warc_round_trip(table(spark, sf_dir, "pages"))


def op8_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8.brown_scores(table(spark, sf_dir, "documents"))


def op9_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9.quality_verdicts(table(spark, sf_dir, "documents"))


def op10_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11.deduplicate(table(spark, sf_dir, "documents"))


def op12_q_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12.spelling_variants(table(spark, sf_dir, "documents"))


def op13_term_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jaccard_rtree": op1_jaccard_rtree,
        "op2_html_blocks": op2_html_blocks,
        "op3_packing": op3_packing,
        "op4_feistel_pii": op4_feistel_pii,
        "op5_suffix_array": op5_suffix_array,
        "op6_secret_forest": op6_secret_forest,
        "op7_warc": op7_warc,
        "op8_brown": op8_brown,
        "op9_line_frequency": op9_line_frequency,
        "op10_gam": op10_gam,
        "op11_relative_lz": op11_relative_lz,
        "op12_q_chunks": op12_q_chunks,
        "op13_term_pipeline": op13_term_pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_suffix_array": op5.ORACLE_SQL,
        "op7_warc": op7.ORACLE_SQL,
        "op9_line_frequency": op9.ORACLE_SQL,
        "op11_relative_lz": op11.ORACLE_SQL,
        "op12_q_chunks": op12.ORACLE_SQL,
        "op13_term_pipeline": op13.ORACLE_SQL,
    }
