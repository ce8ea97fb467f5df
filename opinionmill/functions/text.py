"""The cleaning steps, each a ``Column -> Column`` function, and their order."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binding import let
from .contractions import expand_contractions
from .entities import decode_entities
from .patterns import DIGIT, SPACE, SPACE_CHARS, WORD_CHARS

# The code point ranges that count as emoji, and the punctuation kept as it is.
EMOJI_CHARS = (
    r"\x{1F600}-\x{1F64F}"
    r"\x{1F300}-\x{1F5FF}"
    r"\x{1F680}-\x{1F6FF}"
    r"\x{1F700}-\x{1F77F}"
    r"\x{1F780}-\x{1F7FF}"
    r"\x{1F800}-\x{1F8FF}"
    r"\x{1F900}-\x{1F9FF}"
    r"\x{1FA00}-\x{1FA6F}"
    r"\x{1FA70}-\x{1FAFF}"
    r"\x{2702}-\x{27B0}"
    r"\x{24C2}-\x{1F251}"
)
KEPT_PUNCTUATION = r""".,;:!?/"\-"""

# The ASCII ranges come first: Java tests class members in order.
_JUNK = rf"[^a-z\x20-\x22,-;A-Z{WORD_CHARS}{SPACE_CHARS}{KEPT_PUNCTUATION}]"

_SPACE_LITERAL = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())


def strip_space(text: Column) -> Column:
    """Drop leading and trailing Unicode white space."""
    return F.btrim(text, F.lit(_SPACE_LITERAL))


def repair_encoding(text: Column) -> Column:
    """Undo UTF-8 bytes that were read as Latin-1, if the whole text allows it."""
    # Pure ASCII is the same in both encodings: only a length comparison is spent on it.
    candidate = (F.octet_length(text) > F.length(text)) & ~text.rlike(r"[^\x{0}-\x{FF}]")
    reread = F.try_validate_utf8(F.encode(text, "ISO-8859-1").cast("string"))
    return F.when(candidate, F.coalesce(reread, text)).otherwise(text)


def remove_tags(text: Column) -> Column:
    """Turn each ``<...>`` within one line into a space."""
    return F.when(text.contains("<"), F.regexp_replace(text, r"<[^\n>]*+>", " ")).otherwise(text)


def collapse_space(text: Column) -> Column:
    """One plain space for each run of white space, none at the ends."""
    # A single plain space is already right, so only other runs are rewritten.
    run = f"{SPACE}(?:(?<! ){SPACE}*+|{SPACE}++)"
    return strip_space(F.regexp_replace(text, run, " "))


def tighten_punctuation(text: Column, space: str = SPACE) -> Column:
    """No white space before a punctuation mark."""
    return F.regexp_replace(text, rf"{space}++(?=[.,;:!?])", "")


def separate_digits(text: Column) -> Column:
    """A space between a digit and the letter after it."""
    return F.regexp_replace(text, f"({DIGIT})([A-Za-z])", "$1 $2")


def separate_sentences(text: Column) -> Column:
    """A space between a sentence end and the capital after it."""
    return F.regexp_replace(text, r"([.!?])([A-Z])", "$1 $2")


def capitalise_sentences(text: Column, space: str = SPACE) -> Column:
    """An upper-case letter after each sentence end; the first letter of the text stays."""
    starts = rf"(?<=[.!?]){space}++(?=[a-z])"

    def rejoined(parts: Column) -> Column:
        raised = F.transform(
            parts,
            lambda part, i: F.when(i == 0, part).otherwise(
                F.concat(F.upper(F.substring(part, 1, 1)), part.substr(F.lit(2), F.length(part)))
            ),
        )
        return F.when(F.size(parts) == 1, text).otherwise(F.array_join(raised, " "))

    return let(F.split(text, starts, -1), rejoined)


def remove_symbols(text: Column) -> Column:
    """Drop runs of other symbols, except runs that begin with an emoji."""
    starts_plain = f"(?<![{EMOJI_CHARS}])(?<!{_JUNK}{_JUNK})"
    return F.regexp_replace(text, f"{_JUNK}{starts_plain}{_JUNK}*+", "")


# The order is part of the result: entities before tags, tags before spacing, and so on.
# Once white space is collapsed it is all plain spaces, which are faster to look for.
CLEANING_STEPS: tuple[Callable[[Column], Column], ...] = (
    strip_space,
    decode_entities,
    repair_encoding,
    remove_tags,
    expand_contractions,
    collapse_space,
    partial(tighten_punctuation, space=" "),
    separate_digits,
    separate_sentences,
    partial(capitalise_sentences, space=" "),
    remove_symbols,
    strip_space,
)


def clean_text(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Run every cleaning step over ``col``; a NULL text becomes ``""``.

    Each step is its own projection, so a step that reads its input more than
    once does not repeat the steps before it.
    """
    out = out or col
    df = df.withColumn(out, F.coalesce(F.col(col).cast("string"), F.lit("")))
    for step in CLEANING_STEPS:
        df = df.withColumn(out, step(F.col(out)))
    return df
