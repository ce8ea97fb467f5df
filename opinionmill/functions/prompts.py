"""Model input texts and serialised targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_space

# Task prompts, the target format and the missing-value token.
COMPONENT_PROMPT = "Extract component sentences: "
QUAD_PROMPT = "Extract aspect, aspect term, sentiment, and opinion term from: "
QUAD_LABELS = ("aspect: ", ", aspect term: ", ", opinion term: ", ", sentiment: ")
MISSING = "None"
COMPONENT_SEPARATOR = " ; "


def needs_prompt(model_type: str) -> bool:
    """T5 models are told the task in the input; other models get the bare text."""
    return str(model_type).lower().startswith("t5")


def _prompted(prompt: str, text: Column, model_type: str) -> Column:
    return F.concat(F.lit(prompt), text) if needs_prompt(model_type) else text


def component_training_input(review: Column, model_type: str) -> Column:
    return _prompted(COMPONENT_PROMPT, F.coalesce(review, F.lit(MISSING)), model_type)


def quad_training_input(component: Column, model_type: str) -> Column:
    return _prompted(QUAD_PROMPT, F.coalesce(component, F.lit(MISSING)), model_type)


def component_prompt(review: Column, model_type: str = "t5") -> Column:
    """Inference input for a review: one line, stripped, NULL read as empty."""
    line = strip_space(F.replace(F.coalesce(review, F.lit("")), F.lit("\n"), F.lit(" ")))
    return _prompted(COMPONENT_PROMPT, line, model_type)


def quad_prompt(component: Column, model_type: str = "t5") -> Column:
    """Inference input for a component sentence."""
    return _prompted(QUAD_PROMPT, strip_space(component), model_type)


def serialise_quad(aspect: Column, aspect_term: Column, opinion_term: Column, sentiment: Column) -> Column:
    """``aspect: A, aspect term: T, opinion term: O, sentiment: S``; missing or empty is ``None``."""
    pieces = []
    for label, value in zip(QUAD_LABELS, (aspect, aspect_term, opinion_term, sentiment)):
        pieces += [F.lit(label), F.coalesce(F.nullif(value, F.lit("")), F.lit(MISSING))]
    return F.concat(*pieces)


def join_components(components: Column) -> Column:
    return F.array_join(components, COMPONENT_SEPARATOR)
