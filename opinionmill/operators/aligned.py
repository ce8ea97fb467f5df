"""Predictions matched with references by an explicit key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unmatched_keys(predictions: DataFrame, references: DataFrame, key: str = "row_id") -> DataFrame:
    """``(key, n_predictions, n_references)`` of the keys that are not one to one.

    Both sides are counted in one aggregation, which also finds repeated keys
    and combines hot keys before the shuffle.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    sides = predictions.select(F.col(key), one.alias("p"), none.alias("r")).unionByName(
        references.select(F.col(key), none.alias("p"), one.alias("r"))
    )
    return (
        sides.groupBy(key)
        .agg(F.sum("p").alias("n_predictions"), F.sum("r").alias("n_references"))
        .where((F.col("n_predictions") != 1) | (F.col("n_references") != 1))
    )


def match_pairs(
    predictions: DataFrame,
    references: DataFrame,
    key: str = "row_id",
    prediction_col: str = "prediction",
    reference_col: str = "reference",
    check: bool = True,
) -> DataFrame:
    """``(key, reference, prediction)``, one row per key.

    With ``check`` the rows are grouped by key in the same pass that pairs them, and a key that is not one to one
    fails the job with its counts: neither side is computed twice.  Without it the keys are joined.
    """
    if check:
        none = F.lit(None).cast("string")
        sides = predictions.select(F.col(key), F.col(prediction_col).alias("_p"), none.alias("_r"), F.lit(1).alias("_n"), F.lit(0).alias("_m"))
        sides = sides.unionByName(
            references.select(F.col(key), none.alias("_p"), F.col(reference_col).alias("_r"), F.lit(0).alias("_n"), F.lit(1).alias("_m"))
        )
        grouped = sides.groupBy(key).agg(
            F.max("_r").alias("reference"), F.max("_p").alias("prediction"), F.sum("_n").alias("_n"), F.sum("_m").alias("_m")
        )
        wrong = F.concat(
            F.lit(f"{key}="), F.coalesce(F.col(key).cast("string"), F.lit("NULL")), F.lit(" has "), F.col("_n"),
            F.lit(" predictions and "), F.col("_m"), F.lit(" references"),
        )
        one_to_one = (F.col("_n") == 1) & (F.col("_m") == 1) & F.col(key).isNotNull()
        checked = F.when(one_to_one, F.col("reference")).otherwise(F.raise_error(wrong))
        return grouped.select(key, checked.alias("reference"), "prediction")
    return references.select(F.col(key), F.col(reference_col).alias("reference")).join(
        predictions.select(F.col(key), F.col(prediction_col).alias("prediction")), key
    )
