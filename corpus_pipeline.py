"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphmend.llm.op1_simhash import keep_one_of_each
from graphmend.llm.op2_packing import pack_documents
from graphmend.llm.op3_quality import keep_good
from graphmend.llm.op5_pii import redact
from graphmend.llm.op9_winnow import drop_contaminated
from graphmend.llm.shared import forget, read_table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each training sequence: its ids, padded, and where each document stands in it."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("packing", packing),
]

#: Fingerprints and tokens can't be expressed in SQL: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            now = written(done, f"stage{i}")
            forget(docs, *done.__dict__.get("reads", ()))
            docs = now
        else:
            docs = done
    return docs
