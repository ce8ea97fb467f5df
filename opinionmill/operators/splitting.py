"""Train / validation / test split by review, so that no review is in two splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.components import review_key
from .skew import salted_join

TRAIN, VALIDATION, TEST = "train", "validation", "test"

# Length of the hash prefix that ids are counted by: 16 ** 4 groups at most.
_PREFIX = 4


def with_review_key(df: DataFrame, id_col: str = "Review ID", out: str = "review_key") -> DataFrame:
    """Add the review key and drop the rows without one."""
    return df.withColumn(out, review_key(F.col(id_col))).where(F.col(out).isNotNull())


def _hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary"))


def _rank_key(key: Column, seed: int) -> Column:
    """A string that orders the keys at random, the same way in every run."""
    return F.concat(_hash(key, seed), F.lit(":"), key)


def split_cuts(df: DataFrame, key_col: str, seed: int = 42) -> DataFrame:
    """One row ``cuts: struct<train, validation>``: the last rank key of each split.

    A fifth of the keys (rounded up) is held out and half of that (rounded up)
    is the test part.  The cut points are found without sorting all keys: keys
    are counted per hash prefix, the running count names the prefix a cut falls
    in, and only the keys of those two prefixes are ranked.
    """
    key = F.col(key_col)
    keys = df.where(key.isNotNull()).select(key.cast("string").alias("key")).distinct().select(
        _rank_key(F.col("key"), seed).alias("rank_key"),
        F.substring(_hash(F.col("key"), seed), 1, _PREFIX).alias("prefix"),
    )
    # At most 16 ** _PREFIX rows reach the two windows below.
    running = keys.groupBy("prefix").agg(F.count("*").alias("n")).select(
        "prefix",
        "n",
        F.sum("n").over(Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )
    held = F.ceil(F.lit(0.2) * F.col("total"))
    tested = F.ceil(F.lit(0.5) * held)
    ends = F.array(
        F.struct(F.lit(TRAIN).alias("split"), (F.col("total") - held).alias("rank")),
        F.struct(F.lit(VALIDATION).alias("split"), (F.col("total") - tested).alias("rank")),
    )
    targets = (
        running.select("prefix", "upto", "n", F.explode(ends).alias("end"))
        .where((F.col("end.rank") <= F.col("upto")) & (F.col("end.rank") > F.col("upto") - F.col("n")))
        .select(
            "prefix", F.col("end.split").alias("split"), (F.col("end.rank") - F.col("upto") + F.col("n")).alias("nth")
        )
    )
    # Two rows at most: one per cut.
    nth = F.row_number().over(Window.partitionBy("split").orderBy("rank_key"))
    return (
        keys.join(F.broadcast(targets), "prefix")
        .withColumn("place", nth)
        .where(F.col("place") == F.col("nth"))
        .agg(
            F.struct(
                F.max(F.when(F.col("split") == TRAIN, F.col("rank_key"))).alias(TRAIN),
                F.max(F.when(F.col("split") == VALIDATION, F.col("rank_key"))).alias(VALIDATION),
            ).alias("cuts")
        )
    )


def assign_split(df: DataFrame, key_col: str = "review_key", seed: int = 42, mode: str = "exact") -> DataFrame:
    """Add ``split``; rows are labelled in place, without a shuffle or a join.

    ``exact``: 80/10/10 of the distinct keys to the unit, by comparing each
    row's rank key with two cut points.  ``hash``: by hash bucket, 80/10/10 in
    expectation, with no pass over the keys, and stable when reviews are added.
    """
    key = F.col(key_col).cast("string")
    if mode == "hash":
        bucket = F.conv(F.substring(_hash(key, seed), 1, 8), 16, 10).cast("long") % 10
        label = F.when(bucket < 8, TRAIN).when(bucket == 8, VALIDATION).otherwise(TEST)
    elif mode == "exact":
        cuts = split_cuts(df, key_col, seed).scalar()
        rank = _rank_key(key, seed)
        label = F.when(rank <= cuts[TRAIN], TRAIN).when(rank <= cuts[VALIDATION], VALIDATION).otherwise(TEST)
    else:
        raise ValueError(f"unknown split mode: {mode}")
    return df.where(key.isNotNull()).withColumn("split", label)


def split_keys(df: DataFrame, key_col: str = "review_key", seed: int = 42, mode: str = "exact") -> DataFrame:
    """The distinct keys with their split."""
    return assign_split(df.select(key_col).distinct(), key_col, seed, mode)


def rows_of_split(df: DataFrame, keys: DataFrame, split: str, key_col: str = "review_key") -> DataFrame:
    """The rows whose key belongs to ``split``, by a semi join on the key.

    The keys grow with the data, so Spark chooses the strategy by their size; the
    rows of a very large review are dealt over several tasks.
    """
    return salted_join(df, keys.where(F.col("split") == split).select(key_col), key_col, "left_semi")


def split_counts(df: DataFrame) -> DataFrame:
    """Rows per split."""
    return df.groupBy("split").agg(F.count("*").alias("rows"))
