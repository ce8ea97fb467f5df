"""File-to-file workflows: clean, split, prepare, score, predict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prompts import join_components
from ..functions.quads import strip_wrappers
from ..operators.backends import BackendFactory, text_model
from ..functions.components import split_components
from ..operators.cleaning import clean_reviews
from ..operators.pairs import component_pairs, quad_pairs
from ..operators.quad_scores import class_report, dropped_pairs, field_micro_f1
from ..operators.rouge import rouge
from ..operators.sentence_scores import sentence_scores
from ..operators.splitting import TRAIN, assign_split, split_counts, with_review_key
from ..operators.vocabulary import build_vocabulary, encode_pairs
from ..session import cut_lineage
from ..sources import readers, writers
from .opinions import ComponentStage, QuadStage, review_opinions


def clean_file(
    spark: SparkSession, source: str, target: str, fmt: str = "csv", encoding: str = "utf-8", multi_line: bool = True
) -> None:
    """Raw review CSV to cleaned reviews (text only)."""
    raw = readers.read_raw_reviews(spark, source, encoding=encoding, multi_line=multi_line)
    writers.write_cleaned(clean_reviews(raw).select("review_text"), target, fmt)


def split_file(
    spark: SparkSession,
    source: str,
    target: str,
    seed: int = 42,
    mode: str = "exact",
    encoding: str = "utf-8",
    multi_line: bool = True,
) -> DataFrame:
    """Annotated CSV to the split table; returns the rows per split."""
    keyed = with_review_key(readers.read_annotated(spark, source, encoding, multi_line))
    writers.write_splits(assign_split(keyed, "review_key", seed, mode).drop("review_key"), target)
    return split_counts(readers.read_split(spark, target))


def pairs_of(task: str, annotated: DataFrame, model_type: str) -> DataFrame:
    if task == "component":
        return component_pairs(annotated, model_type).withColumnRenamed("review_key", "row_id")
    if task == "quad":
        return quad_pairs(annotated, model_type, keep=("pos",)).withColumnRenamed("pos", "row_id")
    raise ValueError(f"unknown task: {task}")


def token_tables(
    spark: SparkSession, splits: str, cache: str, task: str, model_type: str, vocab_size: int = 32_000
) -> DataFrame:
    """Encoded pairs of every split, kept under ``cache`` per task, model type, vocabulary size and split rows.

    The vocabulary comes from the training split alone; the splits are encoded in one plan with one dictionary.
    """
    length = 512 if task == "component" else 128
    annotated = readers.read_split(spark, splits)

    def build() -> DataFrame:
        parts = [
            pairs_of(task, annotated.where(F.col("split") == split), model_type).withColumn("split", F.lit(split))
            for split in (TRAIN, "validation", "test")
        ]
        pairs = cut_lineage(parts[0].unionByName(parts[1]).unionByName(parts[2]))
        train = pairs.where(F.col("split") == TRAIN)
        vocabulary = build_vocabulary(train, "input_text", "target_text", vocab_size=vocab_size)
        return encode_pairs(pairs, vocabulary, length, length)

    rows = readers.fingerprint(annotated)
    return readers.read_or_build(spark, cache, task, model_type, build, vocab_size, length, rows)


def component_predictions(pairs: DataFrame, factory: BackendFactory, batch_size: int = 8) -> DataFrame:
    """``(row_id, input, reference, prediction)`` of component pairs; sentences joined by `` ; ``."""
    answer = text_model(factory, batch_size)(F.col("input_text"))
    return pairs.select(
        "row_id", F.col("input_text").alias("input"), F.col("target_text").alias("reference"), answer.alias("answer")
    ).select("row_id", "input", "reference", join_components(split_components(F.col("answer"))).alias("prediction"))


def quad_predictions(pairs: DataFrame, factory: BackendFactory, batch_size: int = 8) -> DataFrame:
    """``(row_id, input, reference, prediction)`` of quadruple pairs; brackets and quotes stripped."""
    answer = text_model(factory, batch_size)(F.col("input_text"))
    return pairs.select(
        "row_id", F.col("input_text").alias("input"), F.col("target_text").alias("reference"), answer.alias("answer")
    ).select("row_id", "input", "reference", strip_wrappers(split_components(F.col("answer"))).alias("prediction"))


def evaluate_components(
    spark: SparkSession, pairs: DataFrame, factory: BackendFactory, target: str, batch_size: int = 8, fmt: str = "parquet"
) -> None:
    """Predict, store and score component pairs under ``target``.

    The scores read the stored table, so the model runs once.
    """
    writers.write_predictions(component_predictions(pairs, factory, batch_size), f"{target}/predictions", fmt)
    predictions = readers.read_predictions(spark, f"{target}/predictions", fmt)
    writers.write_metrics(rouge(predictions), f"{target}/scores")
    writers.write_metrics(sentence_scores(predictions), f"{target}/sentence_scores")


def evaluate_quads(
    spark: SparkSession, pairs: DataFrame, factory: BackendFactory, target: str, batch_size: int = 8, fmt: str = "parquet"
) -> None:
    """Predict, store and score quadruple pairs under ``target``; pairs that don't parse are counted."""
    writers.write_predictions(quad_predictions(pairs, factory, batch_size), f"{target}/predictions", fmt)
    predictions = readers.read_predictions(spark, f"{target}/predictions", fmt)
    writers.write_metrics(field_micro_f1(predictions), f"{target}/scores")
    writers.write_metrics(class_report(predictions), f"{target}/class_report")
    writers.write_metrics(dropped_pairs(predictions), f"{target}/dropped_pairs")


def opinions_file(
    spark: SparkSession,
    source: str,
    target: str,
    components: ComponentStage,
    quads: QuadStage,
    fmt: str = "csv",
    encoding: str = "utf-8",
    multi_line: bool = True,
) -> None:
    """Review CSV to the flat opinion table."""
    reviews = readers.read_reviews(spark, source, encoding=encoding, multi_line=multi_line)
    writers.write_opinions(review_opinions(reviews, components, quads), target, fmt)
