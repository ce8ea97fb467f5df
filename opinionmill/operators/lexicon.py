"""A quadruple model learned by counting labelled terms.

Training and prediction are plain aggregations and lookups, so no neural weights
are needed.  Its scores are not those of a fine-tuned text-to-text model.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.dictionary import Dictionary, in_slots, slot_of
from ..functions.patterns import WORD
from ..functions.prompts import serialise_quad
from ..session import collect_small, write_down

ASPECT, OPINION = "aspect", "opinion"
IMPLICIT = "NULL"
DEFAULT_ASPECT = "Movie"
DEFAULT_SENTIMENT = "neutral"
IN_ROW, JOIN = "in_row", "join"

# A lexicon that is looked up inside the rows travels inside the tasks.
IN_ROW_PHRASES = 100_000
IN_ROW_BYTES = 8 * 1024 * 1024

# A join meets the lexicon once per chunk of so many components or reviews, of so many characters at most.
CHUNK_COMPONENTS, CHUNK_REVIEWS = 8192, 128
CHUNK_CHARS = 1 << 21
# Slots of the dictionary of a chunk, and bits (512 KB at most) that tell the tasks what may be a phrase.
SLOTS = 1024
MARKS_A_PHRASE, MOST_MARKS = 32, 1 << 22


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}+"), F.lit(0))


def _phrases_of(terms: Column) -> Column:
    """The comma-separated terms of a label as lower-case phrases; implicit terms are left out."""
    pieces = F.transform(F.split(terms, ",", -1), lambda term: F.array_join(_words(term), " "))
    return F.filter(pieces, lambda p: (p != "") & (p != IMPLICIT.lower()))


def train_lexicon(
    df: DataFrame, term: str = "term", aspect: str = "aspect", opinion: str = "opinion", sentiment: str = "sentiment"
) -> DataFrame:
    """``(kind, phrase, label, support)``: the most frequent label of each phrase.

    Equal counts go to the alphabetically first label.  A row counts with each side it has: a missing term leaves
    the opinion, and the reverse.
    """
    none = F.array().cast("array<string>")
    sides = {c: F.coalesce(_phrases_of(F.col(c)), none) for c in (term, opinion)}
    labelled = F.concat(
        F.transform(
            sides[term],
            lambda p: F.struct(F.lit(ASPECT).alias("kind"), p.alias("phrase"), F.col(aspect).alias("label")),
        ),
        F.transform(
            sides[opinion],
            lambda p: F.struct(F.lit(OPINION).alias("kind"), p.alias("phrase"), F.col(sentiment).alias("label")),
        ),
    )
    counted = (
        df.select(F.explode(labelled).alias("x"))
        .select("x.*")
        .where(F.col("label").isNotNull())
        .groupBy("kind", "phrase", "label")
        .agg(F.count("*").alias("n"))
    )
    best = F.min(F.struct((-F.col("n")).alias("rank"), F.col("label")))
    return counted.groupBy("kind", "phrase").agg(best.alias("best")).select(
        "kind", "phrase", F.col("best.label").alias("label"), (-F.col("best.rank")).alias("support")
    )


def phrases(words: Column, reach: Column) -> Column:
    """Word sequences that may be phrases: longer first, then from left to right.

    ``reach`` holds, per word, the length of the longest known phrase that begins with it, or NULL.
    """
    longest = F.coalesce(F.array_max(reach), F.lit(0))

    def of_length(n: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))),
            lambda at: (F.get(reach, at - 1) >= n) & (at + n - 1 <= F.size(words)),
        )
        return F.transform(starts, lambda at: F.array_join(F.slice(words, at, n), " "))

    none = F.array().cast("array<string>")
    lengths = F.reverse(F.sequence(F.lit(1), longest))
    return F.when(longest > 0, F.flatten(F.transform(lengths, of_length))).otherwise(none)


def quad_of(aspect: Column, opinion: Column) -> Column:
    """The quadruple of two hits ``struct<phrase, label>``, either of which may be missing."""
    return F.struct(
        F.coalesce(aspect["label"], F.lit(DEFAULT_ASPECT)).alias("aspect"),
        F.coalesce(aspect["phrase"], F.lit(IMPLICIT)).alias("aspect_term"),
        F.coalesce(opinion["phrase"], F.lit(IMPLICIT)).alias("opinion_term"),
        F.coalesce(opinion["label"], F.lit(DEFAULT_SENTIMENT)).alias("sentiment"),
    )


def lexicon_quad(lexicon: DataFrame, in_row_phrases: int = IN_ROW_PHRASES) -> Callable[[Column], Column]:
    """A function from a component to its quadruple; raises if the lexicon is too large to travel inside the tasks.

    The first phrase in the lexicon wins, longer phrases before shorter ones.
    """
    small = collect_small(
        lexicon.select("kind", "phrase", "label"), in_row_phrases, IN_ROW_BYTES, "phrase", "label"
    )
    labels: dict[str, dict[str, str]] = {}
    # Only word sequences that begin like a known phrase are built.
    reach: dict[str, int] = {}
    for row in small:
        labels.setdefault(row["phrase"], {})[row["kind"]] = row["label"]
        first, n_words = row["phrase"].split(" ")[0], row["phrase"].count(" ") + 1
        reach[first] = max(n_words, reach.get(first, 0))
    lookup = Dictionary.of(labels, f"struct<{ASPECT}:string,{OPINION}:string>")
    reached = Dictionary.of(reach, "int")

    def hits(words: Column) -> Column:
        found = let(F.transform(words, reached.get), lambda far: F.transform(
            phrases(words, far), lambda p: F.struct(p.alias("phrase"), lookup.get(p).alias("labels"))
        ))
        return F.filter(found, lambda h: h["labels"].isNotNull())

    def first_hit(found: Column, kind: str) -> Column:
        hit = F.get(F.filter(found, lambda h: h["labels"][kind].isNotNull()), F.lit(0))
        return F.struct(hit["phrase"].alias("phrase"), hit["labels"][kind].alias("label"))

    # One nested expression: the word and phrase arrays never become columns.
    return lambda component: let(
        let(_words(F.coalesce(component, F.lit(""))), hits),
        lambda found: quad_of(first_hit(found, ASPECT), first_hit(found, OPINION)),
    )


def _with_quad(df: DataFrame, quad: Column) -> DataFrame:
    return df.withColumn("_quad", quad).select(*[F.col(f"`{c}`") for c in df.columns], "_quad.*")


def predict_with_lexicon(
    df: DataFrame,
    lexicon: DataFrame,
    component_col: str = "component",
    method: str = IN_ROW,
) -> DataFrame:
    """Add ``aspect, aspect_term, opinion_term, sentiment`` to each component, with equal rows by either method.

    ``in_row`` looks the lexicon up inside each row, without a shuffle, and raises if the lexicon is too large for
    that.  ``join`` takes a lexicon of any size.  The caller chooses, so a job doesn't change its plan with its data.
    """
    if method == IN_ROW:
        return _with_quad(df, lexicon_quad(lexicon)(F.col(component_col)))
    if method == JOIN:
        return predict_by_join(df, lexicon, component_col)
    raise ValueError(f"unknown method: {method}")


def predict_by_join(df: DataFrame, lexicon: DataFrame, component_col: str) -> DataFrame:
    """``predict_with_lexicon`` by joins."""
    found = quads_by_join(df, lexicon, F.array(F.col(component_col)), CHUNK_COMPONENTS, "_quads")
    return _with_quad(found, F.get("_quads", F.lit(0))).drop("_quads")


def _marks(entries: DataFrame) -> Callable[..., Column]:
    """Whether the values may be a phrase of ``entries``, or the first word and the number of words of one.

    One bit per hash; a lexicon too large for these bits lets more through, and the join drops that.
    """
    wanted = min(MOST_MARKS, max(1024, MARKS_A_PHRASE * entries.count()))
    words = 1 << ((wanted - 1) // 64).bit_length()
    split = F.split("phrase", " ")
    hashes = F.array(F.xxhash64("phrase"), F.xxhash64(split[0], F.size(split)))
    at = lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(words - 1)).cast("int")
    bit = lambda h: h.bitwiseAND(F.lit(63)).cast("int")
    marked = entries.where(F.col("phrase").isNotNull()).select(F.explode(hashes).alias("h")).groupBy(at(F.col("h")).alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("h")))).alias("bits")
    )
    table = [0] * words
    for row in marked.collect():
        table[row["at"]] = row["bits"]
    bits = F.from_json(F.lit(json.dumps(table)), "array<bigint>")

    def may_be(*values: Column) -> Column:
        h = F.xxhash64(*values)
        return F.getbit(F.get(bits, at(h)), bit(h)) == 1

    return may_be


def _candidates(entries: DataFrame) -> Callable[[Column], Column]:
    """A function from a text to its word sequences that may be phrases, with commas: longer first, then from left to right."""
    sizes = entries.where(F.col("phrase").isNotNull()).select(F.size(F.split("phrase", " ")).alias("n")).distinct().collect()
    if not sizes:
        return lambda text: F.lit("")
    lengths = F.from_json(F.lit(json.dumps(sorted((row["n"] for row in sizes), reverse=True))), "array<int>")
    may_be = _marks(entries)

    def of_length(words: Column, n: Column) -> Column:
        begun = F.transform(
            words,
            lambda word, at: F.when(
                (at + n <= F.size(words)) & may_be(word, n), F.array_join(F.slice(words, at + 1, n), " ")
            ),
        )
        return F.filter(begun, lambda p: p.isNotNull() & may_be(p))

    return lambda text: let(
        _words(F.coalesce(text, F.lit(""))), lambda words: F.array_join(
            F.flatten(F.transform(lengths, lambda n: of_length(words, n))), ","
        )
    )


def _chunk_of(row: Column, chars: Column, per_chunk: int) -> Column:
    """The chunk of a row: rows near each other and of about the same length, fewer where they are long."""
    at_most, rows, kind = CHUNK_CHARS // per_chunk, per_chunk, 0
    chunk = None
    while rows > 1:
        numbered = (row - F.pmod(row, F.lit(rows))) * 16 + kind
        chunk = F.when(chars <= at_most, numbered) if chunk is None else chunk.when(chars <= at_most, numbered)
        at_most, rows, kind = at_most * 4, rows // 4, kind + 1
    return row * 16 + kind if chunk is None else chunk.otherwise(row * 16 + kind)


def quads_by_join(df: DataFrame, lexicon: DataFrame, components: Column, per_chunk: int, out: str) -> DataFrame:
    """Add the quadruple of each of ``components``, an array of texts, as the array ``out``.

    Rows are written to the checkpoint folder with a number first, so those with missing or equal keys stay apart, and
    with their word sequences that may be phrases.  Up to ``per_chunk`` rows near each other are a chunk.
    The lexicon is joined with the different sequences of each chunk: a frequent phrase meets it once per chunk and not
    once per place, so no key is hot.  What is found goes back to the chunk as a dictionary.
    """
    labels = F.map_from_entries(F.collect_list(F.struct("kind", "label")))
    entries = write_down(lexicon.groupBy("phrase").agg(labels.alias("labels")))
    chars = F.aggregate(components, F.lit(0).cast("long"), lambda n, text: n + F.coalesce(F.length(text), F.lit(0)))
    row = F.monotonically_increasing_id()
    # One text a row, with a line for each component: arrays of small texts take more room than the texts.
    candidates = _candidates(entries)
    lines = F.array_join(F.transform(components, lambda text: F.concat(candidates(text), F.lit("\n"))), "")
    numbered = write_down(
        df.select("*", row.alias("_row"), lines.alias("_said"), chars.alias("_chars")),
        compression="zstd",
    )
    numbered = numbered.withColumn("_chunk", _chunk_of(F.col("_row"), F.col("_chars"), per_chunk))

    every = F.split(F.translate("_said", "\n", ","), ",")
    said = numbered.select("_chunk", F.explode(F.array_distinct(every)).alias("phrase")).distinct()
    known = said.join(entries, "phrase").withColumn("_slot", slot_of(F.col("phrase"), SLOTS))
    entry = F.struct("phrase", "labels")
    slots = known.repartition("_chunk").groupBy("_chunk", "_slot").agg(F.map_from_entries(F.collect_list(entry)).alias("_map"))
    dictionaries = slots.groupBy("_chunk").agg(F.collect_list(F.struct("_slot", "_map")).alias("_maps")).select(
        "_chunk", in_slots(F.col("_maps")).alias("_known")
    )

    lookup = Dictionary(F.col("_known"), SLOTS)

    def quad(phrases_said: Column) -> Column:
        hits = F.filter(
            F.transform(F.split(phrases_said, ","), lambda p: F.struct(p.alias("phrase"), lookup.get(p).alias("labels"))),
            lambda h: h["labels"].isNotNull(),
        )

        def first_hit(found: Column, kind: str) -> Column:
            hit = F.get(F.filter(found, lambda h: F.map_contains_key(h["labels"], kind)), F.lit(0))
            return F.struct(hit["phrase"].alias("phrase"), F.try_element_at(hit["labels"], F.lit(kind)).alias("label"))

        return let(hits, lambda found: quad_of(first_hit(found, ASPECT), first_hit(found, OPINION)))

    def said_of(text: Column) -> Column:
        return let(F.split(text, "\n"), lambda parts: F.slice(parts, 1, F.size(parts) - 1))

    kept = [F.col(f"`{c}`") for c in df.columns]
    chunks = numbered.groupBy("_chunk").agg(F.collect_list(F.struct(*kept, "_said")).alias("_rows"))
    with_quads = F.transform(
        "_rows",
        lambda r: F.struct(*[r.getField(c).alias(c) for c in df.columns], F.transform(said_of(r.getField("_said")), quad).alias(out)),
    )
    return chunks.join(dictionaries, "_chunk", "left").select(F.explode(with_quads).alias("_item")).select("_item.*")


def quad_text(df: DataFrame, out: str = "prediction") -> DataFrame:
    """Serialise the four predicted columns in the model output format."""
    return df.withColumn(
        out, serialise_quad(F.col("aspect"), F.col("aspect_term"), F.col("opinion_term"), F.col("sentiment"))
    )


def save_lexicon(lexicon: DataFrame, path: str) -> None:
    lexicon.write.mode("overwrite").parquet(path)


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
