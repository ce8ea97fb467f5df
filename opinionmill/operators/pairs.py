"""Input / target pairs for the two text-to-text tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.components import key_before_dash
from ..functions.prompts import (
    COMPONENT_SEPARATOR,
    MISSING,
    component_training_input,
    quad_training_input,
    serialise_quad,
)
from .cleaning import require_columns


def _joined_in_order(order: str, text: str) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text))))
    return F.array_join(F.transform(ordered, lambda item: item[text]), COMPONENT_SEPARATOR)


def collect_components(
    df: DataFrame,
    key: Column,
    review_col: str = "Full review",
    component_col: str = "Component sentence",
    pos_col: str = "pos",
    run_length: int = 4096,
) -> DataFrame:
    """``(review_key, review, components)``: the sentences of each review in order.

    ``pos_col`` must be unique within a review.  The review text is the one in
    the last row.  Rows are first joined in runs of neighbouring positions and
    the runs are joined per review, so the rows of one very large review are
    sorted by many tasks and the last step only concatenates.
    """
    pos = F.col(pos_col).cast("long")
    rows = df.where(key.isNotNull()).select(
        key.alias("review_key"),
        pos.alias("pos"),
        (pos - F.pmod(pos, F.lit(run_length))).alias("run"),
        F.coalesce(F.col(f"`{review_col}`").cast("string"), F.lit(MISSING)).alias("review"),
        F.coalesce(F.col(f"`{component_col}`").cast("string"), F.lit(MISSING)).alias("component"),
    )
    runs = rows.groupBy("review_key", "run").agg(
        _joined_in_order("pos", "component").alias("components"),
        F.max_by("review", "pos").alias("review"),
    )
    return runs.groupBy("review_key").agg(
        F.max_by("review", "run").alias("review"),
        _joined_in_order("run", "components").alias("components"),
    )


def component_pairs(
    df: DataFrame,
    model_type: str = "t5",
    id_col: str = "Review ID",
    review_col: str = "Full review",
    component_col: str = "Component sentence",
    pos_col: str = "pos",
    key: Column | None = None,
) -> DataFrame:
    """``(review_key, input_text, target_text)``: a review and its joined sentences."""
    require_columns(df, id_col, review_col, component_col, pos_col)
    key = key_before_dash(F.col(f"`{id_col}`")) if key is None else key
    grouped = collect_components(df, key, review_col, component_col, pos_col)
    return grouped.select(
        "review_key",
        component_training_input(F.col("review"), model_type).alias("input_text"),
        F.col("components").alias("target_text"),
    )


def quad_pairs(
    df: DataFrame,
    model_type: str = "t5",
    component_col: str = "Component sentence",
    label_cols: tuple[str, str, str, str] = ("Aspect Category", "Aspect Terms", "Opinion Terms", "Polarity Sentiment"),
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(*keep, input_text, target_text)``: a sentence and its serialised quadruple."""
    require_columns(df, component_col, *label_cols, *keep)
    return df.select(
        *[F.col(f"`{c}`") for c in keep],
        quad_training_input(F.col(f"`{component_col}`").cast("string"), model_type).alias("input_text"),
        serialise_quad(*[F.col(f"`{c}`").cast("string") for c in label_cols]).alias("target_text"),
    )
