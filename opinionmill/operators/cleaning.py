"""Review cleaning: language filter, normalisation, blank rows, duplicates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.language import PROFILES, UNKNOWN, is_blank, language_from_scores, language_scores
from ..functions.text import clean_text, strip_space

# Fixed value: the text that stands for a review without content.
NO_CONTENT = "No content"


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    """Fail before any job runs if a column is missing."""
    missing = [column for column in columns if column not in df.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}; found: {', '.join(df.columns)}")
    return df


def drop_sentinel(df: DataFrame, text_col: str, sentinel: str = NO_CONTENT) -> DataFrame:
    """Drop NULL texts and the no-content marker (exact match, before cleaning)."""
    return df.where(F.col(text_col).isNotNull() & (F.col(text_col) != sentinel))


def language_of(text: Column, profiles: Mapping[str, Sequence[str]] = PROFILES) -> Column:
    """The language of a text; ``unknown`` if it is blank or undecided."""
    detected = let(language_scores(text, profiles), language_from_scores)
    return F.when(is_blank(text), F.lit(UNKNOWN)).otherwise(detected)


def detect_language(
    df: DataFrame, text_col: str, out: str = "language", profiles: Mapping[str, Sequence[str]] = PROFILES
) -> DataFrame:
    """Add the language of each text."""
    return df.withColumn(out, language_of(F.col(text_col), profiles))


def keep_language(df: DataFrame, language: str = "en", language_col: str = "language") -> DataFrame:
    """Keep one language and drop the helper column."""
    return df.where(F.col(language_col) == language).drop(language_col)


def keep_texts(df: DataFrame, text_col: str, wanted: Callable[[Column], Column]) -> DataFrame:
    """Keep the rows whose text is ``wanted``, for conditions that are costly to compute.

    A generator is used in place of a filter: Spark pushes a filter below the
    projections (and exchanges) that made the text, and would compute it twice.
    """
    kept = F.filter(F.array(F.col(text_col)), wanted)
    columns = [F.col(f"`{c}`") for c in df.columns]
    others = [F.col(f"`{c}`") for c in df.columns if c != text_col]
    return df.select(*others, F.explode(kept).alias(text_col)).select(*columns)


def drop_blank(df: DataFrame, text_col: str) -> DataFrame:
    """Drop rows whose text is empty or white space."""
    return keep_texts(df, text_col, lambda text: strip_space(text) != "")


def keep_first(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """One row per text: the one with the smallest id; ``id_col`` is a unique row key.

    A grouped minimum of the ids is combined before the shuffle, so a text that makes up a third of all rows reaches
    its reducer as one row per map task.  It is a fixed-width value, so texts are hashed and not sorted.  Where other
    columns are carried along, texts are grouped by a hash of 256 bits and the rows of the kept ids are looked up.
    """
    if set(df.columns) == {text_col, id_col}:
        return df.groupBy(text_col).agg(F.min(id_col).alias(id_col)).select(*df.columns)
    kept = df.groupBy(F.sha2(F.col(text_col), 256)).agg(F.min(id_col).alias(id_col)).select(id_col)
    return df.join(kept, id_col, "left_semi").select(*df.columns)


def clean_reviews(
    df: DataFrame,
    text_col: str = "review_text",
    id_col: str = "row_id",
    language: str = "en",
    profiles: Mapping[str, Sequence[str]] = PROFILES,
    detector: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Raw reviews to distinct, cleaned reviews in one language.

    Everything up to the duplicate removal is narrow; that step is the only shuffle.
    The cheap filters come first, so only kept texts are cleaned.  ``detector``
    replaces the function-word profiles, for example by a pandas UDF.
    """
    require_columns(df, text_col, id_col)
    df = drop_sentinel(df, text_col)
    if detector is None:
        df = keep_texts(df, text_col, lambda text: language_of(text, profiles) == language)
    else:
        df = keep_language(df.withColumn("_language", detector(F.col(text_col))), language, "_language")
    df = drop_blank(clean_text(df, text_col), text_col)
    return keep_first(df, text_col, id_col)
