"""From raw documents to packed training sequences: five stages, each reading what the one before has written.

All stages but the last return the columns of their input, extra ones too.  Rows with a null id take part like any
other; an empty table stays empty; texts of any length are read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionmill.llm import decontamination, line_dedup, packing, quality_rules, simhash
from opinionmill.session import checkpoint_dir, ship_code

#: The stages' models and hashes are beyond SQL; they are tested against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null, empty and short texts among them.  Repeated rows share a verdict."""
    ship_code(spark)
    return quality_rules.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with an earlier equal or near line go; documents stay, with their new length, those left empty too."""
    ship_code(spark)
    cleaned = line_dedup.dedup_lines(docs).select(*docs.columns)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, of repeated rows one; empty texts are one group."""
    ship_code(spark)
    return simhash.keep_first(docs, shingle_words=3, radius=3)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go; items without text leak nowhere."""
    ship_code(spark)
    return decontamination.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents that are left, at least the end id of each; repeated rows are documents of their own."""
    ship_code(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each of them keeps is written below the checkpoint folder."""
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
