"""Token ids: a vocabulary counted from text, and fixed-length encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.dictionary import Dictionary
from ..functions.tokens import attention_mask, mask_labels, pad_to, words_and_marks
from ..session import collect_small, cut_lineage
from .skew import salted_join

PAD_ID = 0
UNKNOWN_ID = 1
FIRST_ID = 2

IN_ROW, JOIN = "in_row", "join"

# A vocabulary that is looked up inside the rows travels inside the tasks.
IN_ROW_TOKENS = 100_000
IN_ROW_BYTES = 8 * 1024 * 1024


def build_vocabulary(df: DataFrame, *text_cols: str, vocab_size: int = 32_000) -> DataFrame:
    """``(token, n, token_id)`` of the ``vocab_size`` most frequent tokens.

    A fixed vocabulary size is part of what a text-to-text model is; every other
    token gets the unknown id.  Equal counts are ordered by token.
    """
    if len(text_cols) == 1:
        token_arrays = words_and_marks(F.col(text_cols[0]))
    else:
        token_arrays = F.flatten(
            F.array(*[F.coalesce(words_and_marks(F.col(c)), F.array().cast("array<string>")) for c in text_cols])
        )
    counted = (
        df.select(F.explode(token_arrays).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    )
    frequent = counted.where(F.col("n") >= _lowest_count(counted, vocab_size).scalar())
    order = [F.col("n").desc(), F.col("token").asc()]
    # The sort and the window see about vocab_size rows, not every token.
    return frequent.orderBy(*order).limit(vocab_size).select(
        "token", "n", (F.row_number().over(Window.orderBy(*order)) + F.lit(FIRST_ID - 1)).alias("token_id")
    )


def _lowest_count(counted: DataFrame, vocab_size: int) -> DataFrame:
    """One value: a power of two that at least ``vocab_size`` tokens reach, if there are so many.

    Tokens are counted per binary length of their count, 63 groups at most.
    Without this bound every partition would send ``vocab_size`` rows to the
    task that merges the most frequent ones.
    """
    length = F.length(F.bin("n"))
    reached = F.sum("tokens").over(Window.orderBy(F.col("length").desc()))
    return (
        counted.groupBy(length.alias("length"))
        .agg(F.count("*").alias("tokens"))
        .select("length", reached.alias("reached"))
        .agg(F.coalesce(F.max(F.when(F.col("reached") >= vocab_size, F.col("length"))), F.lit(1)).alias("length"))
        .select(F.pow(F.lit(2.0), F.col("length") - 1).cast("long").alias("n"))
    )


def encode(
    df: DataFrame,
    text_col: str,
    vocabulary: DataFrame,
    out: str = "ids",
    max_length: int | None = None,
    method: str = IN_ROW,
) -> DataFrame:
    """Add ``out: array<int>``, the token ids of ``text_col`` in order, with equal rows by either method.

    ``in_row`` looks the vocabulary up inside each row, without a shuffle, and raises if it is too large for that.
    ``join`` takes a vocabulary of any size.
    """
    if method == IN_ROW:
        return df.withColumn(out, ids_in_row(text_col, in_row_dictionary(vocabulary), max_length))
    if method == JOIN:
        return encode_by_join(df, text_col, vocabulary, out, max_length)
    raise ValueError(f"unknown method: {method}")


def in_row_dictionary(vocabulary: DataFrame) -> Dictionary:
    """The vocabulary as a lookup inside the rows; collected once, whatever it is used for."""
    small = collect_small(vocabulary.select("token", "token_id"), IN_ROW_TOKENS, IN_ROW_BYTES, "token")
    return Dictionary.of({row["token"]: row["token_id"] for row in small}, "int")


def ids_in_row(text_col: str, lookup: Dictionary, max_length: int | None = None) -> Column:
    return F.transform(_tokens(text_col, max_length), lambda t: F.coalesce(lookup.get(t), F.lit(UNKNOWN_ID)))


def _tokens(text_col: str, max_length: int | None) -> Column:
    tokens = words_and_marks(F.coalesce(F.col(text_col), F.lit("")))
    return F.slice(tokens, 1, max_length) if max_length else tokens


def encode_by_join(
    df: DataFrame, text_col: str, vocabulary: DataFrame, out: str = "ids", max_length: int | None = None
) -> DataFrame:
    """``encode`` by a join; rows are numbered and written down first, so missing and repeated keys stay apart."""
    df = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
    id_col = "_row"
    exploded = df.select(id_col, F.posexplode(_tokens(text_col, max_length)).alias("at", "token"))
    ids = (
        salted_join(exploded, vocabulary.select("token", "token_id"), "token", "left")
        .select(id_col, "at", F.coalesce("token_id", F.lit(UNKNOWN_ID)).alias("token_id"))
        .groupBy(id_col)
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("at", "token_id"))), lambda item: item["token_id"]
            ).alias(out)
        )
    )
    whole = df.join(ids, id_col, "left").withColumn(out, F.coalesce(F.col(out), F.array().cast("array<int>")))
    return whole.drop(id_col)


def fixed_length(ids: Column, length: int) -> Column:
    """``struct<ids, mask>`` of exactly ``length`` elements."""
    return F.struct(pad_to(ids, length, PAD_ID).alias("ids"), attention_mask(ids, length).alias("mask"))


def encode_pairs(
    pairs: DataFrame,
    vocabulary: DataFrame,
    max_input_length: int = 512,
    max_target_length: int = 512,
    method: str = IN_ROW,
) -> DataFrame:
    """Add ``input_ids``, ``attention_mask`` and ``labels`` to input / target pairs.

    Component pairs use 512 / 512, quadruple pairs 128 / 128.
    """
    columns = pairs.columns
    lengths = {"_in": ("input_text", max_input_length), "_out": ("target_text", max_target_length)}
    if method == IN_ROW:
        lookup = in_row_dictionary(vocabulary)
        df = pairs.withColumns({out: ids_in_row(c, lookup, n) for out, (c, n) in lengths.items()})
    else:
        df = pairs
        for out, (c, n) in lengths.items():
            df = encode(df, c, vocabulary, out, n, method)
    return df.select(
        *columns,
        let(F.col("_in"), lambda ids: fixed_length(ids, max_input_length)).alias("_features"),
        mask_labels(pad_to(F.col("_out"), max_target_length, PAD_ID), PAD_ID).alias("labels"),
    ).select(
        *columns,
        F.col("_features.ids").alias("input_ids"),
        F.col("_features.mask").alias("attention_mask"),
        "labels",
    )
