"""Scores of predicted quadruples, per field and per class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quads import FIELDS, parse_strict

REPORTED = ("aspect", "sentiment")
SUMMARIES = ("accuracy", "macro avg", "weighted avg")


def parsed_pairs(pairs: DataFrame, reference_col: str = "reference", prediction_col: str = "prediction") -> DataFrame:
    """``truth`` and ``guess`` structs of the pairs that parse on both sides."""
    both = F.struct(
        parse_strict(F.col(reference_col)).alias("truth"), parse_strict(F.col(prediction_col)).alias("guess")
    )
    # A generator keeps the pairs: a filter would be pushed down and parse every text twice.
    kept = F.filter(F.array(both), lambda b: b["truth"].isNotNull() & b["guess"].isNotNull())
    return pairs.select(F.explode(kept).alias("both")).select("both.truth", "both.guess")


def dropped_pairs(pairs: DataFrame, reference_col: str = "reference", prediction_col: str = "prediction") -> DataFrame:
    """``(pairs, scored, dropped)``: how many pairs leave the scores because a side does not parse."""
    kept = parse_strict(F.col(reference_col)).isNotNull() & parse_strict(F.col(prediction_col)).isNotNull()
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(kept).alias("scored")).withColumn(
        "dropped", F.col("pairs") - F.col("scored")
    )


def field_micro_f1(
    pairs: DataFrame, reference_col: str = "reference", prediction_col: str = "prediction"
) -> DataFrame:
    """``(metric, value)`` per field; no rows if nothing parsed.

    With one label per row the micro F1 is the share of equal labels.
    """
    parsed = parsed_pairs(pairs, reference_col, prediction_col)
    means = parsed.agg(
        *[F.avg((F.col(f"truth.{f}") == F.col(f"guess.{f}")).cast("double")).alias(f"{f}_f1") for f in FIELDS]
    )
    rows = F.array(*[F.struct(F.lit(f"{f}_f1").alias("metric"), F.col(f"{f}_f1").alias("value")) for f in FIELDS])
    return means.select(F.explode(rows).alias("m")).select("m.*").where(F.col("value").isNotNull())


def confusion(pairs: DataFrame, reference_col: str = "reference", prediction_col: str = "prediction") -> DataFrame:
    """``(field, truth, guess, n)`` for the reported fields."""
    parsed = parsed_pairs(pairs, reference_col, prediction_col)
    rows = F.array(
        *[
            F.struct(F.lit(f).alias("field"), F.col(f"truth.{f}").alias("truth"), F.col(f"guess.{f}").alias("guess"))
            for f in REPORTED
        ]
    )
    return parsed.select(F.explode(rows).alias("x")).select("x.*").groupBy("field", "truth", "guess").agg(
        F.count("*").alias("n")
    )


def label_report(labelled: DataFrame) -> DataFrame:
    """Report from rows ``(field, truth, guess)``; see :func:`class_report`."""
    votes = F.array(
        F.struct(F.col("truth").alias("label"), F.lit(1).alias("is_true"), F.lit(0).alias("is_guess"),
                 (F.col("truth") == F.col("guess")).cast("int").alias("is_hit")),
        F.struct(F.col("guess").alias("label"), F.lit(0).alias("is_true"), F.lit(1).alias("is_guess"),
                 F.lit(0).alias("is_hit")),
    )
    counts = (
        labelled.select("field", F.explode(votes).alias("v"))
        .groupBy("field", F.col("v.label").alias("label"))
        .agg(
            F.sum("v.is_true").alias("support"),
            F.sum("v.is_guess").alias("guessed"),
            F.sum("v.is_hit").alias("hits"),
        )
    )
    zero = F.lit(0.0)
    per_label = counts.select(
        "field", "label", "support", "hits",
        F.coalesce(F.try_divide("hits", "guessed"), zero).alias("precision"),
        F.coalesce(F.try_divide("hits", "support"), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("hits"), F.col("guessed") + F.col("support")), zero).alias("f1"),
    )

    def weighted(c: str):
        return F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support"))

    # One rollup gives each label (a group of its own) and the summaries of its field.
    rolled = per_label.rollup("field", "label").agg(
        F.grouping("label").alias("is_summary"),
        F.grouping("field").alias("is_total"),
        F.sum("support").alias("support"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        weighted("precision").alias("wp"), weighted("recall").alias("wr"), weighted("f1").alias("wf"),
        F.try_divide(F.sum("hits"), F.sum("support")).alias("accuracy"),
    ).where(F.col("is_total") == 0)

    def line(label, precision, recall, f1):
        return F.struct(label.alias("label"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))

    unset = F.lit(None).cast("double")
    macro = (F.col("mp"), F.col("mr"), F.col("mf"))
    lines = F.when(F.col("is_summary") == 0, F.array(line(F.col("label"), *macro))).otherwise(
        F.array(
            line(F.lit(SUMMARIES[0]), unset, unset, F.col("accuracy")),
            line(F.lit(SUMMARIES[1]), *macro),
            line(F.lit(SUMMARIES[2]), F.col("wp"), F.col("wr"), F.col("wf")),
        )
    )
    return rolled.select("field", F.explode(lines).alias("l"), "support").select(
        "field", "l.label", "l.precision", "l.recall", "l.f1", "support"
    )


def class_report(
    pairs: DataFrame, reference_col: str = "reference", prediction_col: str = "prediction"
) -> DataFrame:
    """``(field, label, precision, recall, f1, support)`` for aspect and sentiment.

    One row per label in truth or prediction, then ``accuracy`` (in ``f1``),
    ``macro avg`` and ``weighted avg``.  Undefined ratios are 0.
    """
    parsed = parsed_pairs(pairs, reference_col, prediction_col)
    rows = F.array(
        *[
            F.struct(F.lit(f).alias("field"), F.col(f"truth.{f}").alias("truth"), F.col(f"guess.{f}").alias("guess"))
            for f in REPORTED
        ]
    )
    return label_report(parsed.select(F.explode(rows).alias("x")).select("x.*"))
