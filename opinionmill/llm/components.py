"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _star(pairs: DataFrame, own: bool) -> DataFrame:
    """Point the neighbours of each ``u`` at the smallest of them, ``u`` included."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    pointed = pairs.join(least, "u").select("u", "v", "m")
    out = pointed.where(F.col("v") > F.col("u")) if not own else pointed
    edges = out.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if own:
        edges = edges.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return edges.where("a != b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of ``edges``; the component is its smallest node.

    Alternates two star steps: each node's larger neighbours, then its smaller ones, are linked to the smallest
    neighbour, until nothing changes.  Every step keeps at most as many edges as it got, minima are combined
    before the shuffle, and each round is written to the checkpoint folder.  Null nodes and loops are ignored.
    """
    now = cut_lineage(
        edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
        .where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    state = _state(now)
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = _star(both, own=False)
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        now = cut_lineage(_star(down, own=True))
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    """Number of edges and an order-free digest: two numbers, however many edges there are."""
    mixed = F.xxhash64("a", "b")
    return tuple(
        edges.agg(
            F.count("*"), F.sum(mixed.cast("decimal(20,0)")), F.bit_xor(mixed)
        ).first()
    )
