"""ROUGE-1, ROUGE-2, ROUGE-L and ROUGE-Lsum F-measures (Lin 2004).

Pairs are ``(row_id, reference, prediction)``; tokens are lower-case ``[a-z0-9]+``.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("rouge1", "rouge2", "rougeL", "rougeLsum")


def rouge_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def ngram_overlap(reference: list[str], prediction: list[str], n: int) -> tuple[int, int, int]:
    """Clipped common n-grams, and the n-grams of either side."""
    sides = [Counter(zip(*(tokens[k:] for k in range(n)))) for tokens in (reference, prediction)]
    return sum((sides[0] & sides[1]).values()), sides[1].total(), sides[0].total()


def _places(prediction: list[str]) -> dict[str, int]:
    where: dict[str, int] = {}
    for j, token in enumerate(prediction):
        where[token] = where.get(token, 0) | (1 << j)
    return where


def _next_row(row: int, hits: int, full: int) -> int:
    """The next bit row of the LCS table: a zero at ``j`` is a step up at column ``j``.

    Each row of the table is one integer, updated by the bit-parallel recurrence
    of Hyyrö (2004), so long texts cost words rather than cells.
    """
    hits &= row
    return ((row + hits) | (row - hits)) & full


def lcs_length(reference: list[str], prediction: list[str]) -> int:
    """One row is kept at a time."""
    if not reference or not prediction:
        return 0
    where, full = _places(prediction), (1 << len(prediction)) - 1
    row = full
    for token in reference:
        row = _next_row(row, where.get(token, 0), full)
    return len(prediction) - row.bit_count()


def lcs_positions(reference: list[str], prediction: list[str]) -> set[int]:
    """Positions in ``reference`` of one longest common subsequence, traced from the end.

    Every ``block``-th row is stored, and the rows of one block at a time are made again from there: about
    ``2 * sqrt(n)`` rows in memory instead of ``n``.
    """
    if not reference or not prediction:
        return set()
    where, full = _places(prediction), (1 << len(prediction)) - 1
    block = math.isqrt(len(reference)) + 1
    row, stored = full, [full]
    for i, token in enumerate(reference, 1):
        row = _next_row(row, where.get(token, 0), full)
        if i % block == 0:
            stored.append(row)
    rows: list[int] = []
    loaded = -1

    def length(i: int, j: int, near: int) -> int:
        """Of the first ``i`` and ``j`` tokens; rows ``near - 1`` and ``near`` are in one block."""
        nonlocal rows, loaded
        wanted = (near - 1) // block
        if wanted != loaded:
            rows, loaded = [stored[wanted]], wanted
            for token in reference[wanted * block : (wanted + 1) * block]:
                rows.append(_next_row(rows[-1], where.get(token, 0), full))
        return j - (rows[i - wanted * block] & ((1 << j) - 1)).bit_count()

    i, j, found = len(reference), len(prediction), set()
    here = length(i, j, i)
    while i and j and here:
        if reference[i - 1] == prediction[j - 1]:
            found.add(i - 1)
            i, j, here = i - 1, j - 1, here - 1
            continue
        above = length(i - 1, j, i)
        if above < here:
            j -= 1
        else:
            i -= 1
    return found


def _f(overlap: int, n_prediction: int, n_reference: int) -> float:
    return 2.0 * overlap / (n_prediction + n_reference) if overlap else 0.0


def _union_f(reference: list[list[str]], prediction: list[list[str]]) -> float:
    """Each reference line takes the union of its LCS with every prediction line; tokens are used once."""
    reference = [line for line in reference if line]
    prediction = [line for line in prediction if line]
    free_reference = Counter(token for line in reference for token in line)
    free_prediction = Counter(token for line in prediction for token in line)
    overlap = 0
    for line in reference:
        covered: set[int] = set()
        for other in prediction:
            covered |= lcs_positions(line, other)
        for at in covered:
            token = line[at]
            if free_reference[token] and free_prediction[token]:
                free_reference[token] -= 1
                free_prediction[token] -= 1
                overlap += 1
    return _f(overlap, sum(map(len, prediction)), sum(map(len, reference)))


def _scores(reference: list[list[str]], prediction: list[list[str]], metrics: tuple[str, ...]) -> dict[str, float]:
    """The wanted scores of one pair, given as the tokens of its lines."""
    whole = [[token for line in lines for token in line] for lines in (reference, prediction)]
    own = {
        "rouge1": lambda: _f(*ngram_overlap(*whole, 1)),
        "rouge2": lambda: _f(*ngram_overlap(*whole, 2)),
        "rougeL": lambda: _f(lcs_length(*whole), len(whole[1]), len(whole[0])),
        "rougeLsum": lambda: _union_f(reference, prediction),
    }
    return {name: own[name]() for name in metrics}


def _line_tokens(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), rouge_tokens)


def rouge_scores(
    pairs: DataFrame,
    metrics: tuple[str, ...] = METRICS,
    id_col: str = "row_id",
    reference_col: str = "reference",
    prediction_col: str = "prediction",
) -> DataFrame:
    """``(row_id, *metrics)``, one row per pair.

    A score depends on its pair alone, so this is a narrow step: one Arrow function on the tokens of whole texts
    gives all metrics, and nothing is shuffled.  Rows with equal ids are scored each for itself.
    """

    @F.pandas_udf(", ".join(f"{m} double" for m in metrics))
    def scored(reference: pd.Series, prediction: pd.Series) -> pd.DataFrame:
        rows = [
            _scores([list(line) for line in r], [list(line) for line in p], metrics) for r, p in zip(reference, prediction)
        ]
        return pd.DataFrame(rows, columns=list(metrics), dtype="float64")

    lines = [_line_tokens(F.col(c)) for c in (reference_col, prediction_col)]
    return pairs.select(id_col, scored(*lines).alias("s")).select(id_col, *(F.col(f"s.{m}").alias(m) for m in metrics))


def mean_metrics(scores: DataFrame, *columns: str) -> DataFrame:
    """``(metric, value)``: the plain mean of each score column; NULL without rows."""
    means = scores.agg(*[F.avg(c).alias(c) for c in columns])
    return means.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in columns])).alias("m")
    ).select("m.metric", "m.value")


def rouge(
    pairs: DataFrame, id_col: str = "row_id", reference_col: str = "reference", prediction_col: str = "prediction"
) -> DataFrame:
    """``(metric, value)`` of all four ROUGE means over the pairs."""
    scores = rouge_scores(pairs, METRICS, id_col, reference_col, prediction_col)
    return mean_metrics(scores, *METRICS)


def bootstrap_means(
    scores: DataFrame, *columns: str, id_col: str = "row_id", samples: int = 1000, seed: int = 42
) -> DataFrame:
    """``(metric, value)``: the median of ``samples`` resampled means per score column.

    Each row draws a Poisson(1) weight per sample from the MD5 of id, sample and seed, so the result depends on
    neither partitioning nor engine.  Rows are combined to one line per
    sample inside each task before anything is shuffled.
    """
    # Cumulative Poisson(1) probabilities; larger weights have a chance below 1e-8.
    cumulative, total, term = [], 0.0, 0.36787944117144233
    for k in range(1, 12):
        total += term
        cumulative.append(total)
        term /= k
    drawn_from = F.concat_ws("|", F.col(id_col).cast("string"), F.col("sample").cast("string"), F.lit(str(seed)))
    # The first 12 hexadecimal digits: 48 bits.
    uniform = F.conv(F.substring(F.md5(drawn_from), 1, 12), 16, 10).cast("long") / float(1 << 48)
    weight = F.lit(0)
    for bound in cumulative:
        weight = weight + F.when(F.col("_u") >= bound, 1).otherwise(0)
    drawn = (
        scores.select(id_col, *columns, F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("sample"))
        .withColumn("_u", uniform)
        .withColumn("_w", weight)
    )
    means = drawn.groupBy("sample").agg(
        *[F.try_divide(F.sum(F.col(c) * F.col("_w")), F.sum("_w")).alias(c) for c in columns]
    )
    middle = means.agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in columns])
    return mean_metrics(middle, *columns)
