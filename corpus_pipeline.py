"""Corpus pipeline: quality filter, near-duplicates, decontamination, personal data, source mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, mixing, neardup, pii, quality
from quire.llm.common import table
from quire.runtime import remove, spread, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of ``sf_dir``.

    Rows are judged one by one, by their texts alone: null and repeated ids are rows like others,
    null and empty texts get the score of an empty passage. Without labels all scores are 0.5, and
    all rows stay. Columns may have any names; an empty table gives an empty one, here and below.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): that with the smallest doc_id.

    Null ids come last, equal ids go by a hash of the text. Null and empty texts are one group.
    """
    return neardup.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; those without words hold none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by the kind's name; null texts stay null."""
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each row as often as it was drawn, numbered by copy_no, which replaces a column of that name.

    Null sources are a source of their own, null texts have size 0; rows of equal ids are drawn one by one.
    """
    return mixing.mixed(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("PII", personal_data),
    ("mixing sources", source_mix),
]

#: SQL can express neither the classifier nor XXH64; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage keeps is written as Parquet into the shared folder, and goes when the next one's is there."""
    docs, behind = spread(table(spark, sf_dir, "documents")), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, path = written(docs)
            if behind:
                remove(spark, behind)
            behind = path
    return docs
