"""The corpus pipeline: quality rules, near-duplicate removal, secret redaction, packing.

Each stage works on all that the one before kept, and its decisions take effect: documents that the
quality rules reject go, one document of each near-duplicate group stays, secrets are masked in the
texts, and what is left is packed into sequences. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import near_copies, packing, quality, secret_scan
from tidemark.llm.common import checkpointed, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one_of_each_group(docs)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_dedup), ("secret scans", secret_masking), ("best-fit packing", sequence_packing)]

#: SQL can't express the fingerprints, the network or the tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the checkpoint folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
