"""Near-duplicate documents by SimHash fingerprints and covering locality-sensitive hashing.

Fingerprint: every shingle of ``shingle_words`` words votes with its XXH64 (seed 42) for 64 bits; a bit is set if
it is set in over half of the hashes.

Search: give bit ``i`` a vector ``phi(i)`` of ``radius + 1`` bits.  Table ``v`` (any non-zero vector) compares the
bits with odd ``<phi(i), v>``.  If two fingerprints differ in at most ``radius`` bits, some ``v`` is orthogonal to
all of their vectors, so they are equal under that mask: no pair within the radius is missed.  With radius 3 there
are 15 masks of about 34 bits.

A bucket is a set of *different* fingerprints; copies were grouped before.  Buckets of two are compared at once,
buckets up to ``bucket_limit`` are compared inside a row of at most that many numbers, and any larger bucket is
linked exactly through shared neighbours (``_dense_links``), whose output is in proportion to its members.  Only
the links that connect a bucket are emitted, never all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import components
from .texts import lower_words, slices

CHUNK = 1 << 15


def fingerprint(text: str, shingle_words: int = 3) -> int:
    """The 64-bit fingerprint of one text; 0 if it has no word."""
    words = lower_words(text)
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, CHUNK):
        part = words[start : start + CHUNK + shingle_words - 1]
        grams = zip(*(part[k:] for k in range(shingle_words))) if len(part) >= shingle_words else [part]
        hashes = np.array([digest(b" ".join(g), 42) for g in grams], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > n, bitorder="little")
    return int(packed.view("<u8")[0])


def fingerprint_column(text: F.Column | str, shingle_words: int = 3):
    """A column with the fingerprint as a signed long."""

    @F.arrow_udf("long")
    def fingerprints(column: pa.Array) -> pa.Array:
        out = [fingerprint(t, shingle_words) for texts in slices(column) for t in texts]
        return pa.array(np.array(out, dtype=np.uint64).view(np.int64))

    return fingerprints.asNondeterministic()(text)


def masks(radius: int) -> list[int]:
    """One mask per table; unsigned 64-bit numbers."""
    vectors = (1 << (radius + 1)) - 1
    phi = [1 + i % vectors for i in range(64)]
    return [sum(1 << i for i in range(64) if bin(phi[i] & v).count("1") % 2) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _spanning(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links within the radius that connect what all such links connect; at most ``len(values) - 1``."""
    x = np.sort(np.array(values, dtype=np.int64)).view(np.uint64)
    left, links = np.arange(len(x)), []
    while len(left):
        # Grow one component from its first member; what it has reached is not compared again.
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near, front = front[0], front[1:]
            hit = np.bitwise_count(x[left] ^ x[near]) <= radius
            links += [(int(x[near].view(np.int64)), int(x[i].view(np.int64))) for i in left[hit]]
            front, left = np.concatenate([front, left[hit]]), left[~hit]
    return links


def _spanning_column(values, radius: int):
    @F.arrow_udf("array<struct<a: long, b: long>>")
    def spanning(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        return pa.array([[{"a": a, "b": b} for a, b in _spanning(v.as_py(), radius)] for v in column], type=kind)

    return spanning.asNondeterministic()(values)


def _dense_links(members: DataFrame, radius: int) -> DataFrame:
    """Exact links of large buckets, in proportion to their members.

    ``members`` (table, key, fp) agree on the bits of the mask.  Two of them are within the radius if and only if
    some value ``z`` is within ``radius // 2`` bits of one and ``radius - radius // 2`` bits of the other, all
    among the bits that the mask leaves free.  At each ``z`` everything is linked to the smallest member of the
    nearer kind, so a group of k gives k - 1 links and none of them is longer than the radius.
    """
    from itertools import combinations

    spark, near, far = members.sparkSession, radius // 2, radius - radius // 2
    flips = [
        (t, _signed(sum(1 << b for b in bits)), n)
        for t, mask in enumerate(masks(radius))
        for n in range(far + 1)
        for bits in combinations([i for i in range(64) if not mask >> i & 1], n)
    ]
    # One row for each table and flip: a number fixed by the radius alone.
    table = spark.createDataFrame(flips, "t int, flip long, n int")
    variants = members.join(F.broadcast(table), "t").select("t", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"), "n", "fp")
    anchors = (
        variants.where(F.col("n") <= near).groupBy("t", "z").agg(F.min("fp").alias("a"))
    )
    return variants.join(anchors, ["t", "z"]).where("a != fp").select("a", F.col("fp").alias("b")).distinct()


def near_links(fingerprints: DataFrame, radius: int = 3, bucket_limit: int = 4096) -> DataFrame:
    """Links ``a, b`` between different fingerprints (column ``fp``) that connect every pair within ``radius`` bits.

    Null fingerprints are ignored.
    """
    tables = F.array(
        *(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks(radius)))
    )
    keyed = fingerprints.where("fp is not null").select("fp").distinct().select("fp", F.explode(tables).alias("k")).select("k.t", "k.key", "fp")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    sizes = cut_lineage(sizes)
    pairs = sizes.where(f"n = 2 and bit_count(a ^ b) <= {radius}").select("a", "b")
    larger = sizes.where("n > 2").select("t", "key", "n")
    shared = keyed.join(larger, ["t", "key"])
    middle = (
        shared.where(F.col("n") <= bucket_limit)
        .groupBy("t", "key")
        .agg(F.collect_list("fp").alias("fps"))  # at most bucket_limit numbers
        .select(F.explode(_spanning_column(F.col("fps"), radius)).alias("l"))
        .select("l.a", "l.b")
    )
    links = pairs.unionByName(middle)
    if larger.where(F.col("n") > bucket_limit).limit(1).count():
        links = links.unionByName(_dense_links(shared.where(F.col("n") > bucket_limit).select("t", "key", "fp"), radius))
    return links.distinct()


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 3,
    radius: int = 3,
    bucket_limit: int = 4096,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_hash, fp, label, component_id``.

    ``component_id`` is the smallest id that is reachable over links of at most ``radius`` differing bits, ``label``
    the smallest fingerprint.  A null or empty text has the fingerprint zero and is linked like any other.  Rows
    with a null id take part and get the component of their fingerprint; if no row of the component has an id, it is
    null.  Repeated rows and ids stay as they are.  Other columns are ignored; an empty table gives an empty result.
    Texts of any length count whole.
    """
    text = F.col(text_col)
    prints = cut_lineage(
        docs.select(
            F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), fingerprint_column(text, shingle_words).alias("fp")
        )
    )
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    joined = components(near_links(nodes, radius, bucket_limit)).select(F.col("node").alias("fp"), "component")
    labelled = nodes.join(joined, "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("label"))
    labelled = cut_lineage(labelled)
    least = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_print = labelled.select("fp", "label").join(least, "label").select("fp", "label", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "text_hash", "fp", "label", "component_id")


def keep_first(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 3,
    radius: int = 3,
    bucket_limit: int = 4096,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one per group stays: that with the smallest id.

    Among rows that share this id the one with the smallest hash of its text stays, of equal rows any.  A null id
    comes after all others.
    """
    groups = simhash_groups(docs, id_col, text_col, shingle_words, radius, bucket_limit)
    kept = (
        groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("label")
        .agg(F.min("doc_id").alias("_id"), F.min("text_hash").alias("_hash"))
        .select("_hash", F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("_id"))
    )
    rows = docs.select(
        F.struct("*").alias("_row"),
        F.xxhash64(F.col(text_col)).alias("_hash"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
    )
    return rows.join(kept, ["_hash", "_id"], "left_semi").dropDuplicates(["_hash", "_id"]).select("_row.*")
