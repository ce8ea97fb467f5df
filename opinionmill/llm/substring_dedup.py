"""Removal of long word passages that repeat, by compaction of a de Bruijn graph.

An edge is a window of ``window`` consecutive words, a vertex what two following windows share.  Only repeated edges
are kept and followed:

1. **Pieces.**  Following edges of a text that have the same minimiser (their least hash of ``anchor`` words, at the
   same place) are one piece, so a text gives a row for about every 12 words, not for every word.  Equal edges have
   equal minimisers: an edge whose minimiser stands at one place only is not repeated.
2. **Repeated paths.**  Of the pieces whose minimiser stands at two places or more, those with equal words are repeated
   as a whole; the others may still hold repeated edges and are opened.
3. **Compaction.**  A repeated piece that is always followed by the same one, which always follows it, is joined with
   it: the links are grouped, tested for branches and joined back, and a running number along each text gives the
   nonbranching paths.  Every place of a path runs through the whole of it.
4. **Verification.**  Each path, and each edge of an opened piece, goes back to its text by its source coordinates and is
   compared by 128 bits of its words; what stands at two coordinates is repeated.
5. **Removal.**  Words that a repeated edge covers leave their text.

Equal texts are one source: all their edges repeat if there are two of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import salted_join
from ..session import write_down
from .texts import POWERS, SLICE_ROWS, STEP

#: Random values of the bytes, one table for each hash.
BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, (3, 256), dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def spans_hashed(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of ``values[s:e]`` for every span, in one pass over the values."""
    up, down = POWERS.upto(len(values) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(values * up[: len(values)], dtype=np.uint64)])
        return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and last offsets of the words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text."""
    points = np.frombuffer(raw, dtype=np.uint8)
    inner = (points != 32) & ((points < 9) | (points > 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inner, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def minimisers(anchors: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of every ``width`` following values, the leftmost if several are equal."""
    count = len(anchors) - width + 1
    bits = np.uint64(20)
    if len(anchors) >> 20:
        return np.lib.stride_tricks.sliding_window_view(anchors >> bits, width).argmin(axis=1) + np.arange(count)
    # The place stands in the low bits, so the least value names it and the leftmost of equal ones is the least.
    least, reach = (anchors >> bits << bits) | np.arange(len(anchors), dtype=np.uint64), 1
    while 2 * reach <= width:
        least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
    if reach < width:
        least = np.minimum(least[:count], least[width - reach :])
    return (least & np.uint64((1 << 20) - 1)).astype(np.int64)


def pieces_of(raw: bytes, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, hash of the words, first edge and number of edges of the pieces of a text."""
    starts, ends = words_of(raw)
    edges = len(starts) - window + 1
    if edges < 1:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    words = spans_hashed(BYTES[0][np.frombuffer(raw, dtype=np.uint8)], starts, ends)
    at = np.arange(len(starts) - anchor + 1)
    anchors = spans_hashed(words, at, at + anchor)
    least = minimisers(anchors, window - anchor + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    n = np.diff(np.append(first, edges))
    content = spans_hashed(_mixed(words ^ np.uint64(STEP)), first, first + n + window - 1)
    return anchors[least[first]].view(np.int64), content.view(np.int64), first, n


def _texts(column: pa.Array) -> Iterator[list[bytes]]:
    """The texts of an Arrow column as UTF-8, a few at a time; null counts as empty."""
    for start in range(0, len(column), SLICE_ROWS):
        some = column.slice(start, SLICE_ROWS)
        yield [v.as_buffer().to_pybytes() if v.is_valid else b"" for v in some]


def _lists(parts: list[dict[str, np.ndarray]], kind: pa.DataType) -> pa.Array:
    """A list column with the rows of each part."""
    fields = [kind.value_type.field(i) for i in range(kind.value_type.num_fields)]
    columns = [
        pa.array(np.concatenate([p[f.name] for p in parts]) if parts else [], type=f.type) for f in fields
    ]
    sizes = [len(p[fields[0].name]) for p in parts]
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, fields=fields))


PIECES = pa.list_(pa.struct([("m", pa.int64()), ("c", pa.int64()), ("at", pa.int32()), ("n", pa.int32())]))


def piece_column(text: Column, window: int, anchor: int) -> Column:
    @F.arrow_udf("array<struct<m: long, c: long, at: int, n: int>>")
    def cut(column: pa.Array) -> pa.Array:
        parts = []
        for some in _texts(column):
            rows = [dict(zip(("m", "c", "at", "n"), pieces_of(t, window, anchor))) for t in some]
            parts.append(_lists(rows, PIECES))
        return pa.concat_arrays(parts) if parts else pa.array([], type=PIECES)

    return cut.asNondeterministic()(text)


def packed(text: Column) -> Column:
    """Texts made smaller before they are shuffled."""

    @F.arrow_udf("binary")
    def shrunk(column: pa.Array) -> pa.Array:
        small = zstandard.ZstdCompressor(level=1)
        return pa.array([small.compress(t) for some in _texts(column) for t in some], type=pa.binary())

    return shrunk.asNondeterministic()(text)


def _unpacked(column: pa.Array) -> Iterator[bytes]:
    large = zstandard.ZstdDecompressor()
    for v in column:
        yield large.decompress(v.as_buffer().to_pybytes())


CHECKS = pa.list_(pa.struct([("s1", pa.int64()), ("s2", pa.int64()), ("at", pa.int32()), ("n", pa.int32())]))


def _numbers(lists: pa.Array, *names: str) -> Iterator[list[np.ndarray]]:
    """The fields of each list of structs as arrays; a null list is empty."""
    fields = [lists.values.field(n).to_numpy(zero_copy_only=False) for n in names]
    offsets, valid = lists.offsets.to_numpy(), lists.is_valid().to_pylist()
    for i, there in enumerate(valid):
        own = slice(offsets[i], offsets[i + 1]) if there else slice(0, 0)
        yield [f[own] for f in fields]


def check_column(text: Column, spans: Column, window: int) -> Column:
    """128 bits of the words of each span; opened pieces give one row for each of their edges."""

    @F.arrow_udf("array<struct<s1: long, s2: long, at: int, n: int>>")
    def checked(column: pa.Array, wanted: pa.Array) -> pa.Array:
        rows = []
        for raw, (opened, at, n) in zip(_unpacked(column), _numbers(wanted, "opened", "at", "n")):
            times = np.where(opened, n, 1)
            inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            first, edges = np.repeat(at, times) + inside, np.repeat(np.where(opened, 1, n), times)
            points, (starts, ends) = np.frombuffer(raw, dtype=np.uint8), words_of(raw)
            s1, s2 = (
                spans_hashed(spans_hashed(table[points], starts, ends), first, first + edges + window - 1).view(np.int64)
                for table in BYTES[1:]
            )
            rows.append({"s1": s1, "s2": s2, "at": first, "n": edges})
        return _lists(rows, CHECKS)

    return checked.asNondeterministic()(text, spans)


def _place(*columns: str) -> Column:
    return F.xxhash64(*columns)


def repeated_spans(docs: DataFrame, text_col: str = "text", window: int = 35, anchor: int = 12) -> DataFrame:
    """``t, at, n``: runs of ``n`` edges from word ``at`` on that stand at two coordinates or more.

    ``t`` is the MD5 of the text.  Runs of one text don't overlap but may touch.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sources = docs.select(F.unhex(F.md5(text)).alias("t"), text.alias("text"))
    pieces = write_down(
        sources.select("t", F.explode(piece_column(F.col("text"), window, anchor)).alias("p")).select("t", "p.*")
    )
    # Minimisers at two places: equal texts are one source, so their places are equal too.
    place = _place("t", "at")
    met = pieces.groupBy("m").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count("*").alias("_n"))
    met = write_down(met.where("low < high").select("m", "_n"))
    # The place is not stored: a hash takes as much disk as the rest of a row, and a column of the row gives it.
    shared = write_down(salted_join(pieces, met.select("m"), "m", counts=met, distinct=True)).withColumn("x", place)
    kinds = write_down(
        shared.groupBy("m", "c").agg(
            F.min("x").alias("first"), (F.min("x") < F.max("x")).alias("whole"), F.count("*").alias("places")
        )
    )
    several = kinds.groupBy("m").agg((F.min("c") < F.max("c")).alias("mixed"), F.count("*").alias("_n"))
    kinds = salted_join(kinds, several.drop("_n"), "m", counts=several).where("whole or mixed").select(
        F.xxhash64("m", "c").alias("p"), F.col("m").alias("_m"), F.col("c").alias("_c"), "whole", "mixed", "first",
        F.col("places").alias("_n"),
    )
    of_path = salted_join(shared.withColumn("p", F.xxhash64("m", "c")), kinds.drop("_n"), "p", counts=kinds)
    typed = write_down(
        of_path.where("m = _m and c = _c").select(
            "t", "at", "n", "p", "whole", (F.col("mixed") & (~F.col("whole") | (F.col("x") == F.col("first")))).alias("opened")
        )
    )
    # A text's places in order, with the path of the next and of the last piece if they touch.
    along = Window.partitionBy("t").orderBy("at")
    follows = F.lag(F.col("at") + F.col("n")).over(along) == F.col("at")
    linked = typed.where("whole").select(
        "t", "at", "n", "p",
        F.when(F.lead("at").over(along) == F.col("at") + F.col("n"), F.lead("p").over(along)).alias("after"),
        F.when(follows, F.lag("p").over(along)).alias("before"),
    )

    def sole(column: str) -> Column:
        """Whether all places have the same neighbour there."""
        same = (F.min(column) == F.max(column)) & (F.count(column) == F.count("*"))
        return F.coalesce(same, F.lit(False))

    # Counts of a salted join are read for the heavy keys and for the join: stored, they are not computed for each.
    ends = write_down(
        linked.groupBy("p").agg(
            sole("after").alias("one_after"), sole("before").alias("one_before"), F.count("*").alias("_n")
        )
    )
    joined = F.col("one_before") & F.lag("one_after").over(along) & follows
    runs = salted_join(typed.where("whole").select("t", "at", "n", "p"), ends.drop("_n"), "p", counts=ends)
    numbered = runs.select("t", "at", "n", F.when(joined, 0).otherwise(1).alias("begins")).withColumn(
        "run", F.sum("begins").over(along)
    )
    paths = numbered.groupBy("t", "run").agg(F.min("at").alias("at"), F.sum("n").cast("int").alias("n"))
    wanted = paths.select("t", F.lit(False).alias("opened"), "at", "n").unionByName(
        typed.where("opened").select("t", "opened", "at", "n")
    )
    lists = wanted.groupBy("t").agg(F.collect_list(F.struct("opened", "at", "n")).alias("spans"))
    texts = sources.select("t", packed(F.col("text")).alias("z")).dropDuplicates(["t"])
    checks = write_down(
        texts.join(lists, "t").select("t", F.explode(check_column(F.col("z"), F.col("spans"), window)).alias("c")).select("t", "c.*")
    )
    # A path is repeated with its whole words; an edge of an opened piece by itself.
    spot = _place("t", "at")
    same = checks.groupBy("s1", "s2").agg(F.min(spot).alias("low"), F.max(spot).alias("high"), F.count("*").alias("_n"))
    same = write_down(same.where("low < high").select("s1", F.col("s2").alias("_2"), "_n"))
    return salted_join(checks, same.drop("_n"), "s1", counts=same).where("s2 = _2").select("t", "at", "n")


RESULT = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())])


def removal_column(text: Column, spans: Column, copies: Column, window: int, with_text: bool) -> Column:
    @F.arrow_udf("n_words long, n_removed long, kept string, kept_sha256 string")
    def removed(column: pa.Array, runs: pa.Array, times: pa.Array) -> pa.Array:
        rows = []
        for raw, (at, edges), n in zip(_unpacked(column), _numbers(runs, "at", "n"), times.to_pylist()):
            words = raw.split()
            if n > 1:
                stays = np.full(len(words), len(words) < window)
            else:
                change = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + edges + window - 1, -1)
                stays = np.cumsum(change[:-1]) == 0
            kept = b" ".join(compress(words, stays.tolist()) if not stays.all() else words)
            rows.append(
                {"n_words": len(words), "n_removed": len(words) - int(stays.sum()), "kept": kept.decode("utf-8", "replace") if with_text else None,
                 "kept_sha256": hashlib.sha256(kept).hexdigest()}
            )
        return pa.array(rows, type=RESULT)

    return removed.asNondeterministic()(text, spans, copies)


def dedup_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, anchor: int = 12, with_text: bool = True
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept, kept_sha256``.

    Every word leaves that is covered by a window of ``window`` words whose sequence also starts anywhere else, in this
    text or another; windows are those of the input.  ``kept`` has the other words, joined by one space.  Null texts are
    empty, texts shorter than a window stay whole, repeated rows are copies of each other; null and repeated ids stay;
    other columns are ignored; an empty table gives no rows.  A text of any length is read whole by one task; tables
    have rows for its pieces, never for pairs of places.
    """
    if not 0 < anchor <= window:
        raise ValueError("anchor must be between 1 and window")
    runs = repeated_spans(docs, text_col, window, anchor).groupBy("t").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sources = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text)).alias("t"), text.alias("text"))
    texts = sources.select("t", packed(F.col("text")).alias("z"))
    # Copies are met in their task before the shuffle.
    once = texts.groupBy("t").agg(F.first("z").alias("z"), F.count("*").alias("copies"))
    results = once.join(runs, "t", "left").select(
        "t", removal_column(F.col("z"), F.col("runs"), F.col("copies"), window, with_text).alias("r")
    )
    out = salted_join(sources.select("doc_id", "t"), results, "t").select("doc_id", "r.*")
    return out if with_text else out.drop("kept")
