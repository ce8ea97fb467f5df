"""Sentence-level precision, recall, F1 and BLEU of component predictions."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.components import split_components
from ..functions.tokens import words_and_marks
from .rouge import mean_metrics

# The guard in the F1 denominator, the longest BLEU n-gram, the smoothing of empty counts.
EPSILON = 1e-8
BLEU_ORDER = 4
SMOOTHING = 0.1

SENTENCE_METRICS = ("precision", "recall", "f1", "bleu")


def _sides(pairs: DataFrame, id_col: str, reference_col: str, prediction_col: str) -> DataFrame:
    return pairs.select(
        id_col,
        split_components(F.coalesce(F.col(prediction_col), F.lit(""))).alias("_predicted"),
        split_components(F.coalesce(F.col(reference_col), F.lit(""))).alias("_expected"),
    )


def _prf() -> list[Column]:
    predicted, expected = F.col("_predicted"), F.col("_expected")
    # Every predicted sentence found in the reference counts, also a repeated one.
    shared = F.array_intersect(predicted, expected)
    hits = F.size(F.filter(predicted, lambda s: F.array_contains(shared, s)))
    precision = F.coalesce(F.try_divide(hits, F.size(predicted)), F.lit(0.0))
    recall = F.coalesce(F.try_divide(hits, F.size(expected)), F.lit(0.0))
    f1 = F.when(hits > 0, 2 * precision * recall / (precision + recall + F.lit(EPSILON))).otherwise(F.lit(0.0))
    return [precision.alias("precision"), recall.alias("recall"), f1.alias("f1")]


def sentence_prf(
    pairs: DataFrame, id_col: str = "row_id", reference_col: str = "reference", prediction_col: str = "prediction"
) -> DataFrame:
    """``(row_id, precision, recall, f1)`` by exact sentence match, inside each row."""
    return _sides(pairs, id_col, reference_col, prediction_col).select(id_col, *_prf())


def _profile(tokens: list[str]) -> tuple[int, list[Counter]]:
    return len(tokens), [
        Counter(zip(*(tokens[k:] for k in range(n)))) for n in range(1, BLEU_ORDER + 1)
    ]


def _bleu(predicted: tuple[int, list[Counter]], expected: tuple[int, list[Counter]]) -> float:
    """BLEU-4 against one reference, empty counts smoothed, 0 without a shared word."""
    (n_predicted, grams), (n_expected, other) = predicted, expected
    logs = 0.0
    for n, (mine, theirs) in enumerate(zip(grams, other), start=1):
        small, large = (mine, theirs) if len(mine) <= len(theirs) else (theirs, mine)
        clipped = sum(min(count, large[gram]) for gram, count in small.items() if gram in large)
        if n == 1 and not clipped:
            return 0.0
        logs += math.log((clipped or SMOOTHING) / max(1, n_predicted - n + 1)) / BLEU_ORDER
    brevity = 0.0 if n_predicted > n_expected else 1 - n_expected / n_predicted
    return math.exp(brevity + logs)


def mean_best_bleu(predicted: list[list[str]], expected: list[list[str]]) -> float:
    """Each predicted sentence scored against its best reference sentence, averaged."""
    if not len(predicted):
        return 0.0
    references = {tuple(s): _profile(list(s)) for s in expected}
    best: dict[tuple, float] = {}
    for sentence in {tuple(s) for s in predicted}:
        profile = _profile(list(sentence))
        # An identical reference has every n-gram and no brevity penalty: none scores higher.
        same = references.get(sentence)
        candidates = [same] if same else references.values()
        best[sentence] = max((_bleu(profile, r) for r in candidates), default=0.0)
    return math.fsum(best[tuple(s)] for s in predicted) / len(predicted)


@F.pandas_udf(DoubleType())
def _row_bleu(predicted: pd.Series, expected: pd.Series) -> pd.Series:
    return pd.Series([mean_best_bleu(p, e) for p, e in zip(predicted, expected)], dtype="float64")


def _bleu_column() -> Column:
    return _row_bleu(
        F.transform("_predicted", words_and_marks), F.transform("_expected", words_and_marks)
    ).alias("bleu")


def sentence_bleu(
    pairs: DataFrame, id_col: str = "row_id", reference_col: str = "reference", prediction_col: str = "prediction"
) -> DataFrame:
    """``(row_id, bleu)``: mean over predicted sentences of the best BLEU over reference sentences.

    Sentence pairs are compared inside the row and never become rows.
    """
    return _sides(pairs, id_col, reference_col, prediction_col).select(id_col, _bleu_column())


def sentence_scores(
    pairs: DataFrame, id_col: str = "row_id", reference_col: str = "reference", prediction_col: str = "prediction"
) -> DataFrame:
    """``(metric, value)``: means over all rows; rows without predictions count as 0."""
    scored = _sides(pairs, id_col, reference_col, prediction_col).select(id_col, *_prf(), _bleu_column())
    means = mean_metrics(scored, *SENTENCE_METRICS)
    return means.select(F.concat(F.lit("mean_"), F.col("metric")).alias("metric"), "value")
