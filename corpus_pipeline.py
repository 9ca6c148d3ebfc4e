"""A corpus from raw documents to packed training sequences, stage by stage.

Each stage works on all rows that the one before it kept; stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataforge.llm.common import documents, importable, labels, stored
from strataforge.llm.mixing import mixed_documents
from strataforge.llm.packing import pack_documents
from strataforge.llm.secrets import mask_secrets
from strataforge.llm.simhash import one_of_each
from strataforge.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose restored text scores as toxic; the classifier learns from the labelled ones that are not held out."""
    importable(spark)
    return without_toxic(docs, labels(spark, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each class of exact and near copies."""
    importable(spark)
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts; every document stays."""
    importable(spark)
    return mask_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat, keep or leave out documents, so that each source has its target number of words."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place all pieces of all documents in sequences."""
    importable(spark)
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("simhash_near_dedup", near_dedup), ("secret_scans", secrets), ("mixing", mixing), ("packing", packing)]

#: The learned stages cannot be told in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
