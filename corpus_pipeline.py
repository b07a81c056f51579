"""The corpus pipeline: five stages over documents, each on all rows that the one before it kept.

Every stage takes nulls, empty and very long texts, repeated rows, further columns and an empty table; what becomes of them is said
in the operator it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import decontaminate, mixing, near_dedup, quality, secrets
from lodeseek.llm.common import cut, free_name, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null texts are judged as empty ones."""
    return quality.drop_poor(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays; empty texts and null ids are no copies of each other."""
    return near_dedup.drop_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document with its text, how often it is taken (0 to 2 times), and so how many of its words.

    The classifier's scores weigh the draw. They are computed again, since the stages between hand on the columns of documents only."""
    mark = free_name(docs, "score")
    scored = quality.score(docs, quality.fit(docs, quality.learnable(table(spark, sf_dir, "labels"))), to=mark)
    return mixing.mix(scored, quality=F.col(mark), carry=docs.columns)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret scan", secrets_stage),
    ("mixing", mixing_stage),
]
#: The classifier and Order MinHash have no SQL form; tests/llm/test_pipeline.py compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, "stage")
    return docs
