"""From raw documents to packed training sequences.

Stages in their order: quality rules, near duplicates, benchmark decontamination, personal data and
packing.  Each works on all rows that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm.common import plain_columns
from pairloom.llm.decontamination import decontaminate
from pairloom.llm.near_duplicates import without_near_duplicates
from pairloom.llm.packing import pack_documents
from pairloom.llm.personal_data import mask_personal_data
from pairloom.llm.quality import score_quality
from pairloom.session import discard, saved, shared_path, ship, temporary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the weakly supervised quality rules reject."""
    ship(spark)
    rows, text = plain_columns(docs)
    return score_quality(rows, text).where("kept").select(rows.columns).toDF(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates: the one with the least doc_id, rows without one last.

    Rows are told apart by doc_id and text, so null and repeated doc_ids lose and hide nothing.
    """
    ship(spark)
    plain, text = plain_columns(docs)
    names = ["doc_id" if k == docs.columns.index("doc_id") else c for k, c in enumerate(plain.columns)]
    return without_near_duplicates(plain.toDF(*names), text=text).toDF(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item."""
    ship(spark)
    rows, text = plain_columns(docs)
    scanned = decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text=text, keep=rows.columns)
    return scanned.where("not contaminated").select(rows.columns).toDF(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data in the texts."""
    ship(spark)
    return mask_personal_data(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of all documents into sequences of at most 2048."""
    ship(spark)
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", deduplicate),
    ("benchmark decontamination", decontaminated),
    ("personal data", personal_data),
    ("packing", packing),
]
#: SQL can't express the tokenizer, the estimated rules or the packing; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each result is written and read again, and deleted when the next is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_path(spark, name.replace(" ", "_"))
        with temporary(spark):  # what a stage writes on its way goes when its result is written
            docs = saved(stage(spark, docs, sf_dir), path)
        if before:
            discard(spark, before)
        before = path
    return docs
