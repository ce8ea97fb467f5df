"""Inputs shared by the queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionmill.functions.binding import let

# Put around every document, so that each cleaning rule has something to do.
NOISE = "  I'm 4k  u can't !great.Next ok. then &lt;i&gt; *** it's U'd? y'all \t "
MOJIBAKE = "cafÃ© "
ENTITIES = "&#233;&#x1F600;&amp;lt;&notit;&nosuch;&#128; &#x110000;"
ENTITIES_DECODED = "é\U0001f600&lt;¬it;&nosuch;€ �"

ORDER_SENTINEL = "4-NOT SPECIFIED"
VOCABULARY_SIZE = 5000


def changed(text: Column) -> Column:
    """The text with one frequent word exchanged, so that some sentences stay equal."""
    return F.replace(F.replace(text, F.lit(" the "), F.lit(" a ")), F.lit(" le "), F.lit(" un "))


def words_of(text: Column) -> Column:
    """All lower-case words of the text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def terms_of(words: Column) -> Column:
    """Every word of five letters, with the next word if that has two."""
    following = lambda i: F.get(words, i + 1)
    found = F.transform(
        words,
        lambda w, i: F.when(
            F.length(w) == 5,
            F.concat(w, F.when(F.length(following(i)) == 2, F.concat(F.lit(" "), following(i))).otherwise(F.lit(""))),
        ),
    )
    return F.array_join(F.array_compact(found), ", ")


def opinions_of(words: Column) -> Column:
    """Every word of six letters."""
    return F.array_join(F.filter(words, lambda w: F.length(w) == 6), ", ")


def labelled_lines(docs: DataFrame) -> DataFrame:
    """Labelled lines: a quadruple for every two words of each document."""

    def quads_of(words: Column) -> Column:
        pairs = F.filter(
            F.transform(words, lambda w, i: F.when(i % 2 == 0, F.array(w, F.coalesce(F.get(words, i + 1), F.lit("NULL"))))),
            lambda p: p.isNotNull(),
        )
        return F.transform(
            pairs,
            lambda p, i: F.array(
                p[0],
                F.col("source"),
                F.when(F.col("lang") != "en", "neutral").when(i % 2 == 0, "positive").otherwise("negative"),
                p[1],
            ),
        )

    quads = let(words_of(F.col("text")), quads_of)
    sentence = F.replace(F.col("text"), F.lit("#"), F.lit(" "))
    return docs.select("doc_id", "lang", F.concat(sentence, F.lit("####"), F.to_json(quads)).alias("value"))


def sentence_backend():
    """A toy component model: sentences of the input, separated the way a model answers."""
    return lambda texts: [text.replace(".", ";") for text in texts]


def quad_backend():
    """A toy quadruple model: the whole component is the term."""
    return lambda texts: [
        f"aspect: Movie, aspect term: {text}, opinion term: None, sentiment: neutral" for text in texts
    ]
