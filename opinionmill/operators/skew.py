"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it has more than one row in so many; there can't be more heavy keys than that.
SHARE = 1000


def salted_join(
    left: DataFrame, right: DataFrame, key: str, how: str = "inner", salts: int = 64, counts: DataFrame | None = None,
    distinct: bool = False,
) -> DataFrame:
    """Join on ``key`` with the rows of each heavy left key dealt over ``salts`` tasks.

    The right side has at most one row per key; only the rows of heavy keys are repeated.  Heavy keys are counted
    over all left rows, combined before the shuffle, and there are fewer than ``SHARE`` of them, so they are sent to
    every task.  The salt of a row is a hash of its values, the same when a task is run again.

    ``counts`` (the key and ``_n``, its left rows) spares that pass where it is known; keys that are not in ``right``
    may be left out.  ``distinct`` leaves one of equal rows; they share key and salt, so they have met for the join and
    are not shuffled again.
    """
    if counts is None:
        counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    counts = counts.select(F.col(key).alias("_key"), "_n")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).scalar()
    heavy = counts.where(F.col("_n") * SHARE > total).select("_key", F.lit(True).alias("_heavy"))

    def marked(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(heavy), F.col(key) == F.col("_key"), "left").drop("_key")

    salt = F.when(F.col("_heavy"), F.pmod(F.xxhash64(*left.columns), F.lit(salts))).otherwise(0).cast("int")
    every = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    dealt = marked(left).withColumn("_salt", salt).drop("_heavy")
    repeated = marked(right).withColumn("_salt", F.explode(every)).drop("_heavy")
    joined = dealt.join(repeated, [key, "_salt"], how)
    return (joined.distinct() if distinct else joined).drop("_salt")
