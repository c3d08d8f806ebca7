"""From raw documents to packed training sequences: quality, near copies, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what it returns is written and read
again before the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from claimloom.llm import decontaminate, neardup, packing, quality, secrets
from claimloom.llm.session import delete, read, shared_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject.

    Null and empty texts go; ids may be null or repeat, each row is judged by its text; without labels all with text stay.
    """
    return quality.good(docs, read(spark, sf_dir, "labels"))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies, the one with the least id.

    Two texts under one id are two documents; rows that repeat id and text are one. Null and wordless texts all stay.
    """
    return neardup.dedup(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no long passage with a benchmark item.

    Rows are judged by their texts, whatever their ids; null and short texts stay; without benchmark items all stay.
    """
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their text masked and n_chars counted again; null and empty texts are as they were."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its place in a sequence; null and empty texts have no piece."""
    return packing.packed(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("simhash_neardup", keep_one_copy),
    ("benchmark_decontamination", drop_benchmark),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack),
]

#: Compression, SimHash and packing can't be said in SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between two of them is written to the cluster's shared folder, and deleted when the
    stage after the next has been written. Extra columns go along; empty documents give an empty result."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
            if i:
                delete(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
