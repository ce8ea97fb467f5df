"""Component sentences as arrays of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import SPACE
from .text import strip_space

# Sentence ends, and clause words that stand between white space.
_SEGMENT_BREAK = rf"[.!?;]+|,?(?:{SPACE}+(?:but|and|while|although))+{SPACE}+"


def trimmed_pieces(pieces: Column) -> Column:
    """Strip each piece and drop the empty ones."""
    return F.filter(F.transform(pieces, strip_space), lambda piece: piece != "")


def split_components(text: Column) -> Column:
    """The ``;``-separated sentences of a prediction or a reference."""
    return trimmed_pieces(F.split(text, ";", -1))


def segment_review(text: Column) -> Column:
    """Component sentences by punctuation and clause words, without a neural model."""
    return trimmed_pieces(F.split(text, _SEGMENT_BREAK, -1))


def review_key(review_id: Column) -> Column:
    """The first ``REV<digits>`` in an id, or NULL."""
    return F.nullif(F.regexp_extract(review_id, r"(REV\p{Nd}+)", 1), F.lit(""))


def key_before_dash(review_id: Column) -> Column:
    """The part of an id in front of the first ``-``."""
    return F.split_part(review_id, F.lit("-"), F.lit(1))
