"""A corpus pipeline of five stages: each takes (spark, docs, sf_dir) and returns the next's docs.

All but the last return the columns of documents. Each stage works on all rows that it is given, and none fails on
nulls, repeated rows, further columns or an empty table, which gives none. Null and empty texts end in the first stage;
given to a later one they stay: without copies, words of the benchmark, personal data or tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lettermill.llm import bpe, decontaminate, near_dedup, pii, quality
from lettermill.llm.common import table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects; null and empty texts are among them. Rows are judged one by one."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id, rows without one coming last. A repeated id with
    another text is another document; of repeated rows one stays, and texts without words all stay."""
    return near_dedup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the benchmark contaminates. Texts without words stay."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts replaced by its kind; n_chars follows. Null texts stay null."""
    return pii.redact(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of each text's ids and of what they decode to, for every row; a null text has no ids."""
    return bpe.digests(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("PII", without_personal_data),
    ("byte-level BPE", tokenised),
]

#: SQL can't express the stages (expectation-maximisation, sketches, BPE): they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
