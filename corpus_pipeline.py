"""From raw documents to packed training windows: quality rules, near-duplicates, benchmark decontamination, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last keep the
columns of documents and any further ones; only names that begin with an
underscore are the stages' own. Rows of null or empty texts fail the quality
rules, repeated rows of a key become one in the Jaccard join, and an empty table
stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parley.llm import op01_jaccard_rtree, op03_packing, op04_feistel_pii, op05_suffix_array, op09_line_frequency
from parley.llm.queries import pseudonym_key, table, tokenizer_path
from parley.llm.shared import materialize

#: Near-duplicates: word shingles of this many words, and a Jaccard similarity of at least so many hundredths.
SHINGLE_WORDS, SIMILARITY = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op09_line_frequency.drop_low_quality(docs, strip=True)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op01_jaccard_rtree.keep_one_of_each(docs, size=SHINGLE_WORDS, num=SIMILARITY, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op05_suffix_array.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op04_feistel_pii.pseudonymize(docs, pseudonym_key(spark))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op03_packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("PII", pseudonyms),
    ("packing", packing),
]
#: Token ids and keyed pseudonyms are beyond SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
