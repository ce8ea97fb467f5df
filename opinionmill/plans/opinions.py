"""Reviews to opinions: segment, predict, parse, one row per component."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.components import segment_review
from ..functions.prompts import quad_prompt
from ..functions.quads import FIELDS, parse_lenient
from ..operators.backends import BackendFactory, predict_components, text_array_model
from ..operators.lexicon import CHUNK_REVIEWS, IN_ROW, lexicon_quad, quads_by_join
from ..session import hold_repeats
from ..sources.readers import fill_reviews
from ..sources.writers import OPINION_COLUMNS

# ``(review_id, review)`` gains ``components: array<string>``.
ComponentStage = Callable[[DataFrame], DataFrame]
# ``(review_id, review, components)`` gains ``quads``: one quadruple struct per component.
QuadStage = Callable[[DataFrame], DataFrame]


def segmenter() -> ComponentStage:
    """Components by punctuation and clause words."""
    return lambda df: df.withColumn("components", segment_review(F.col("review")))


def component_backend(factory: BackendFactory, model_type: str = "t5", batch_size: int = 8) -> ComponentStage:
    """Components from a text-to-text backend."""
    return lambda df: predict_components(df, factory, "review", "components", model_type, batch_size)


def lexicon_backend(lexicon: DataFrame, method: str = IN_ROW) -> QuadStage:
    """Quadruples from a lexicon: inside the rows, or by join for a lexicon of any size; the rows are the same."""

    def stage(df: DataFrame) -> DataFrame:
        if method == IN_ROW:
            return df.withColumn("quads", F.transform("components", lexicon_quad(lexicon)))
        return quads_by_join(df, lexicon, F.col("components"), CHUNK_REVIEWS, "quads")

    return stage


def quad_backend(factory: BackendFactory, model_type: str = "t5", batch_size: int = 8) -> QuadStage:
    """Quadruples from a text-to-text backend, read leniently from its answers."""

    def stage(df: DataFrame) -> DataFrame:
        prompts = F.transform("components", lambda c: quad_prompt(c, model_type))
        answered = df.withColumn("_answers", text_array_model(factory, batch_size)(prompts))
        return answered.withColumn("quads", F.transform("_answers", parse_lenient)).drop("_answers")

    return stage


def review_opinions(reviews: DataFrame, components: ComponentStage, quads: QuadStage) -> DataFrame:
    """``(review_id, review)`` to the flat opinion table.

    One lazy plan without a shuffle.  A review stays one row with its components
    and quadruples as arrays until the last step, so its text is copied once per
    output row and not through every stage.  Its text stands in as many rows of the
    result as it has components: Parquet files written from this session hold it
    once per row group (``hold_repeats``).
    """
    hold_repeats(reviews.sparkSession, "full_review")
    found = quads(components(fill_reviews(reviews.select("review_id", "review"))))
    paired = F.arrays_zip(F.col("components").alias("component"), F.col("quads").alias("quad"))
    # The filter only turns the array into an expression; see explode_components.
    rows = F.posexplode(F.filter(paired, lambda x: x["component"].isNotNull())).alias("pos", "item")
    return found.select("review_id", F.col("review").alias("full_review"), rows).select(
        "review_id",
        "pos",
        "full_review",
        F.col("item.component").alias("component"),
        *[F.col(f"item.quad.{field}").alias(field) for field in FIELDS],
    ).select(*OPINION_COLUMNS)
