"""The corpus pipeline: quality rules, exact dedup, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.

Defined cases, in every stage: a null text counts as empty and stays null where the row stays; rows that repeat an id are judged by their texts, and a row that
repeats another wholly is a copy of it; very long texts are read whole; extra columns, whatever their names, pass by up to the last stage; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditloom.llm import exact_dedup, jaccard_join, packing, pii, quality
from auditloom.llm.support import materialize, small_batches


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go, those without words among them."""
    small_batches(spark)
    return quality.filter_quality(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays, one of those that repeat it."""
    return exact_dedup.exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the row with the smallest id stays, one of those that repeat it."""
    small_batches(spark)
    return jaccard_join.drop_near_copies(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced in the text; n_chars follows the new text."""
    return pii.sanitise(docs).selectExpr(*[f"cast(length(text) as bigint) as {c}" if c == "n_chars" else f"`{c}`" for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_copies", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL has no form of these stages; tests/llm/test_pipeline.py holds them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
