"""From raw documents to packed sequences: quality rules, line dedup, near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, table
from palimpsest.llm.lines import drop_later_lines
from palimpsest.llm.mixing import domain_of, mix_documents
from palimpsest.llm.packing import pack
from palimpsest.llm.quality import keep_clean
from palimpsest.llm.simhash import keep_one_of_each


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects. A null text counts as empty and goes, having too few words; repeated rows fare alike;
    an empty table gives an empty one."""
    return keep_clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are similar to an earlier one; n_chars follows the text.
    Null and empty texts stay as they are, null doc_ids come first, repeated rows fare alike, an empty table stays empty."""
    return drop_later_lines(docs, length="n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest doc_id. Null texts count as empty and are
    near-duplicates of each other; of repeated rows one stays; an empty table stays empty."""
    return keep_one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the budgets choose; one that two epochs take is there twice. Null languages and sources are leaves
    of their own, null texts have no tokens, repeated rows count each, an empty table stays empty."""
    return mix_documents(docs, domain_of(F.col("source"))).drop("epoch")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences, without their ids. A null or empty text is its end id alone, repeated
    rows are packed each, an empty table gives no piece."""
    return pack(docs, ids=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

#: Seeded epochs and retrieval packing have no SQL form; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
