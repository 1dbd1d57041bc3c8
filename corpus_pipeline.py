"""The corpus pipeline: five stages over ``documents``, each writing what the next reads.

Toxicity rejects documents, exact and near de-duplication keep one document of
each group, decontamination removes documents with benchmark passages, and
best-fit packing lays out the rest in bins of fixed length.

Every stage takes tables with null, empty, repeated and very long texts, null ids and
empty tables. Texts without words pass toxicity and decontamination, count as equal
texts in exact dedup where they are null or empty, stay in near-dedup, and have no
piece in the end. Of equal texts the row with the smallest id stays, of a near-duplicate
group that with the smallest id; of rows that repeat its id and text, the one whose other
columns hash lowest. Columns of any other name are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontam, exact_dedup, near_dup, packing, toxicity
from lodestone.llm.common import delete_path, scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose first severity threshold is passed. The model is fitted
    on a bounded sample of the labelled documents among this stage's input."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts the document with the smallest id stays."""
    return exact_dedup.exact_dedup(docs, keep="min")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays (5 words, 0.8)."""
    return near_dup.near_dedup(docs, shingle=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an eight-word window of a benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 8, "documents", 1)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each with its place in a bin."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack_bins),
]

#: SQL expresses neither the fitted model nor near duplicates nor packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's table is deleted once the next one is written; the last stays, as
    the result reads it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
