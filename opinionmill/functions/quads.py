"""Reading (aspect, aspect term, opinion term, sentiment) out of text.

Every parser returns ``struct<aspect, aspect_term, opinion_term, sentiment>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .patterns import SPACE, WORD
from .text import strip_space

FIELDS = ("aspect", "aspect_term", "opinion_term", "sentiment")
# The markers in front of each field, in the order of FIELDS.
MARKERS = ("aspect:", "aspect term:", "opinion term:", "sentiment:")


def _quad(values: list[Column]) -> Column:
    return F.struct(*[value.alias(field) for field, value in zip(FIELDS, values)])


def _after(text: Column, marker: str) -> Column:
    """The text between the first ``marker`` and the next same one; NULL without a marker."""
    return F.get(F.split(text, marker, -1), F.lit(1))


def _all_or_none(values: list[Column], missing: Column) -> Column:
    """The quadruple if every value was found, else ``missing``; each value is computed once."""
    return let(
        F.array(*values),
        lambda v: F.when(
            F.forall(v, lambda x: x.isNotNull()), _quad([strip_space(F.get(v, F.lit(i))) for i in range(len(FIELDS))])
        ).otherwise(missing),
    )


def _cut_at(text: Column, ends: tuple[str, ...]) -> Column:
    values = [F.get(F.split(_after(text, marker), end, -1), F.lit(0)) for marker, end in zip(MARKERS, ends)]
    nothing = _quad([F.lit(None).cast("string")] * len(FIELDS))
    return _all_or_none([*values, _after(text, MARKERS[3])], nothing)


def parse_lenient(text: Column) -> Column:
    """Cut at markers and commas; all four fields NULL if any marker is missing."""
    return _cut_at(text, (",", ",", ","))


def parse_safe(text: Column) -> Column:
    """Like :func:`parse_lenient`, but a term may hold commas: it ends at the next field."""
    return _cut_at(text, (", aspect term:", ", opinion term:", ", sentiment:"))


def parse_strict(text: Column) -> Column:
    """Each term must end with a comma and the sentiment is one word, else NULL."""
    # The gap before a value may span lines, the value itself may not.
    patterns = [rf"{marker}{SPACE}*([^\n]*?)," for marker in MARKERS[:3]]
    patterns.append(rf"{MARKERS[3]}{SPACE}*({WORD}+)")
    values = [F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(0)) for pattern in patterns]
    return _all_or_none(values, F.lit(None))


def strip_wrappers(pieces: Column) -> Column:
    """The first predicted piece without enclosing brackets and then quotes; NULL if none."""
    return F.btrim(F.btrim(F.get(pieces, F.lit(0)), F.lit("[]")), F.lit("'\""))
