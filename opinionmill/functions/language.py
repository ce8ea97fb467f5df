"""Language identification from function-word profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .dictionary import Dictionary
from .text import strip_space

UNKNOWN = "unknown"

# Frequent function words per language. Callers may pass their own profiles.
PROFILES: dict[str, Sequence[str]] = {
    "en": ("the", "and", "of", "to", "is", "was", "it", "that", "with", "for",
           "this", "are", "but", "not", "have", "be", "by", "you", "from", "they"),
    "fr": ("le", "les", "des", "et", "une", "du", "dans", "est", "pour", "qui",
           "que", "pas", "par", "sur", "avec", "au", "ce", "il", "elle", "nous"),
    "de": ("der", "die", "und", "das", "ist", "nicht", "ein", "eine", "den", "mit",
           "zu", "auf", "von", "dem", "sich", "auch", "es", "für", "wie", "ich"),
    "es": ("el", "los", "las", "y", "una", "es", "por", "con", "para", "del",
           "que", "se", "lo", "como", "pero", "su", "más", "muy", "al", "está"),
    "it": ("il", "gli", "di", "che", "è", "non", "per", "una", "sono", "con",
           "del", "della", "anche", "più", "ma", "si", "nel", "questo", "alla", "molto"),
    "pt": ("o", "os", "as", "um", "uma", "não", "que", "com", "para", "do",
           "da", "em", "por", "mais", "mas", "foi", "muito", "isso", "ao", "são"),
    "nl": ("het", "een", "en", "van", "niet", "dat", "die", "zijn", "op", "voor",
           "met", "ook", "maar", "aan", "er", "om", "naar", "heeft", "deze", "wordt"),
}


def language_scores(text: Column, profiles: Mapping[str, Sequence[str]] = PROFILES) -> Column:
    """``array<struct<hits, language>>``: how many words of each profile ``text`` holds."""
    languages_of: dict[str, list[str]] = {}
    for language, words in profiles.items():
        for word in dict.fromkeys(words):
            languages_of.setdefault(word, []).append(language)
    lookup = Dictionary.of(languages_of, "array<string>")
    words = F.split(F.lower(text), r"[^\p{L}]+", -1)
    votes = F.flatten(F.array_compact(F.transform(words, lookup.get)))
    names = F.array(*[F.lit(language) for language in sorted(profiles)])

    def tally(votes: Column) -> Column:
        return F.transform(
            names,
            lambda name: F.struct(
                F.size(F.filter(votes, lambda vote: vote == name)).alias("hits"), name.alias("language")
            ),
        )

    return let(votes, tally)


def language_from_scores(scores: Column) -> Column:
    """The language with most hits; ``unknown`` without hits or on a tie."""
    most = F.array_max(F.transform(scores, lambda s: s["hits"]))
    winners = let(most, lambda n: F.filter(scores, lambda s: (s["hits"] == n) & (n > 0)))
    return let(
        winners,
        lambda w: F.when(F.size(w) == 1, F.get(w, F.lit(0))["language"]).otherwise(F.lit(UNKNOWN)),
    )


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip_space(text) == "")
