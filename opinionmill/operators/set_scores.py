"""Corpus-level sentence overlap and exact match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.components import split_components
from ..functions.text import strip_space
from .rouge import mean_metrics
from .sentence_scores import EPSILON


def set_prf(pairs: DataFrame, reference_col: str = "reference", prediction_col: str = "prediction") -> DataFrame:
    """``(metric, value)``: precision, recall and F1 of the distinct lower-case sentences.

    One aggregation marks on which side each sentence occurs; it takes the place
    of an intersection and two differences.
    """
    def side(col: str, is_prediction: int):
        return F.transform(
            split_components(F.lower(F.coalesce(F.col(col), F.lit("")))),
            lambda s: F.struct(s.alias("sentence"), F.lit(is_prediction).alias("p"), F.lit(1 - is_prediction).alias("r")),
        )

    marked = (
        pairs.select(F.explode(F.concat(side(prediction_col, 1), side(reference_col, 0))).alias("x"))
        .groupBy("x.sentence")
        .agg(F.max("x.p").alias("p"), F.max("x.r").alias("r"))
    )
    both, predicted, expected = F.sum(F.col("p") * F.col("r")), F.sum("p"), F.sum("r")
    ratios = marked.agg(
        F.coalesce(both / (predicted + F.lit(EPSILON)), F.lit(0.0)).alias("precision"),
        F.coalesce(both / (expected + F.lit(EPSILON)), F.lit(0.0)).alias("recall"),
    )
    scored = ratios.withColumn(
        "f1",
        2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F.lit(EPSILON)),
    )
    return mean_metrics(scored, "precision", "recall", "f1")


def exact_match(pairs: DataFrame, reference_col: str = "reference", prediction_col: str = "prediction") -> DataFrame:
    """``(metric, value)``: the share of pairs that are equal after stripping."""
    equal = strip_space(F.col(prediction_col)) == strip_space(F.col(reference_col))
    return mean_metrics(
        pairs.select(F.coalesce(equal, F.lit(False)).cast("double").alias("exact_match")), "exact_match"
    )
