"""Batch prediction with an exchangeable backend.

A backend is a factory: ``factory()`` loads a model and returns a function from a
list of input texts to a list of output texts.  Spark builds it once per Python
worker and calls it with at most ``batch_size`` texts, partition by partition.
Only the input text crosses to Python; the other columns stay in the JVM.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.components import split_components
from ..functions.prompts import component_prompt, quad_prompt
from .cleaning import require_columns

Backend = Callable[[list[str]], Sequence[str]]
BackendFactory = Callable[[], Backend]


def answered(backend: Backend, texts: list[str]) -> list[str]:
    """One answer per text; another number would shift every later answer."""
    answers = list(backend(texts))
    if len(answers) != len(texts):
        raise ValueError(f"the backend gave {len(answers)} answers to {len(texts)} texts")
    return answers


def text_model(factory: BackendFactory, batch_size: int = 8) -> Callable[[Column], Column]:
    """A ``Column -> Column`` function that runs the backend on text."""

    def load():
        backend = factory()

        def predict(texts: np.ndarray) -> np.ndarray:
            answers = answered(backend, ["" if text is None else str(text) for text in texts])
            out = np.empty(len(texts), dtype=object)
            out[:] = answers
            return out

        return predict

    return predict_batch_udf(load, return_type=StringType(), batch_size=batch_size)


#: The last model of this Python worker; an older one is let go before the next is loaded.
_LOADED: dict[str, Backend] = {}


def text_array_model(factory: BackendFactory, batch_size: int = 8) -> Callable[[Column], Column]:
    """A function from an array of texts to the array of their answers.

    The texts of many rows are put into the same batches.  A review and its
    components stay one row, so the review text is not repeated for each of them.
    """
    model_id = uuid.uuid4().hex

    @F.pandas_udf(ArrayType(StringType()))
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if model_id not in _LOADED:
            _LOADED.clear()
            _LOADED[model_id] = factory()
        backend = _LOADED[model_id]
        for rows in batches:
            texts = ["" if text is None else text for row in rows if row is not None for text in row]
            answers: list[str] = []
            for at in range(0, len(texts), batch_size):
                answers += answered(backend, texts[at : at + batch_size])
            left = iter(answers)
            yield pd.Series([None if row is None else [next(left) for _ in row] for row in rows], dtype=object)

    return predict


def predict_components(
    df: DataFrame,
    factory: BackendFactory,
    text_col: str = "review",
    out: str = "components",
    model_type: str = "t5",
    batch_size: int = 8,
) -> DataFrame:
    """Add the predicted component sentences of each text as an array."""
    require_columns(df, text_col)
    answer = text_model(factory, batch_size)(component_prompt(F.col(text_col), model_type))
    return df.withColumn("_answer", answer).withColumn(out, split_components(F.col("_answer"))).drop("_answer")


def predict_quads(
    df: DataFrame,
    factory: BackendFactory,
    text_col: str = "component",
    out: str = "prediction",
    model_type: str = "t5",
    batch_size: int = 8,
) -> DataFrame:
    """Add the predicted quadruple text of each component sentence."""
    require_columns(df, text_col)
    return df.withColumn(out, text_model(factory, batch_size)(quad_prompt(F.col(text_col), model_type)))


def explode_components(df: DataFrame, components_col: str = "components") -> DataFrame:
    """One row per component with its position; a review without components gives no row.

    The array is passed as an expression: for a plain column Spark would infer a
    filter on its size, push it below the projection that splits the review, and
    split every review twice.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c != components_col]
    components = F.filter(components_col, lambda c: c.isNotNull())
    return df.select(*others, F.posexplode(components).alias("pos", "component"))
