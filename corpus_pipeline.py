"""Corpus pipeline: quality rules, line dedup, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of its predecessor. All but the last return the columns of `documents`;
`n_chars` follows a text that changes. The last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import linedup, neardup, packing, quality, secrets
from tamis.llm.flat import free_name
from tamis.session import cut_lineage


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the fertility bands reject go."""
    verdict = free_name(docs.columns, "_verdict")
    return quality.judged(docs, verdict).where(f"{verdict}.kept").drop(verdict)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-equal lines one stays; a document without a line left goes."""
    return _sized(linedup.without_repeats(docs, linedup.line_groups(docs)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents the one with the smallest id stays."""
    return neardup.without_copies(docs, neardup.near_duplicates(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are marked over; no document goes."""
    return _sized(secrets.without_secrets(docs, secrets.scan(docs)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as tokens in sequences of 2048."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("secret scans", secret_scan),
          ("best-fit packing", best_fit_packing)]

#: Byte-pair tokens and minwise trees can't be said in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over `documents`; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
