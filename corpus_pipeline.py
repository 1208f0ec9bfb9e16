"""The corpus pipeline: toxic documents go, one of each group of near-duplicates stays, documents that hold
benchmark passages go, secrets are cut out of the texts, and what is left is packed into sequences.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all that the stage before it kept; all but
the last return the columns of ``documents``.  Toxicity, near-duplicates and decontamination remove whole
documents; the secret stage keeps every document and replaces the spans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from synthkit.llm.catalog import learnable, table
from synthkit.llm.common import materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from synthkit.llm.toxicity import reject_toxic
    return reject_toxic(docs, learnable(table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from synthkit.llm.simhash_dedup import drop_near_duplicates
    return drop_near_duplicates(docs, size=3, radius=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from synthkit.llm.decontam import decontaminate
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), mode="documents")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from synthkit.llm.secret_scan import redact
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from synthkit.llm.packing import pack_documents
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secrets", secrets), ("packing", packing)]

#: The classifier, SimHash and the tokenizer have no SQL form; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's table is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
