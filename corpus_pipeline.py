"""From raw documents to packed training sequences: each stage takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontamination, language, near_dedup, packing, pii
from graphloom.llm.common import FEW_ROWS, for_documents, shared_folder, table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents in no language that the corpus's labelled rows teach go."""
    for_documents(spark)
    return language.accept(docs, language.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BagMinHash: one document of each group of copies stays."""
    for_documents(spark)
    return near_dedup.deduplicate(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix automaton: benchmark spans go, and documents that are mostly such."""
    for_documents(spark)
    return decontamination.remove(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers, disguised or not, become marks of their kind."""
    for_documents(spark)
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of balanced attention cost."""
    for_documents(spark, FEW_ROWS)
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("near_dedup", drop_near_copies),
    ("decontamination", remove_benchmark),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: SQL can express neither the tokenizer nor the signatures; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written as Parquet in the shared folder and read again."""
    shared = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared}/pipeline-{uuid.uuid4().hex}/{name}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
