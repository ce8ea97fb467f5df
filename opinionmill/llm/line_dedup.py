"""Line deduplication over the corpus by a deletion-neighbourhood join; DataFrame functions only.

Lines are sequences of words.  A line goes if an earlier line is equal, or, for lines of ``min_words`` words and
more, if an earlier line is within one edit (a word put in, left out or replaced).  Earlier means a smaller
document id, then a smaller line number.

1. Equal lines meet under two 64-bit hashes; the earliest place is a grouped minimum.
2. One edit leaves the first or the last half of a line as it was.  Only lines that share such a half with another
   line can have a neighbour, so only they emit variants, and only at the places outside the shared half.
3. A variant is a line with one word left out (``gap`` false), or the line itself, split at the same place (``gap``
   true).  Its key hashes what stands before and after the place: sums of one hash per word and position, so the
   keys of a line cost as much as its words.  Equal keys mean one edit at that place.
4. Each key keeps the earliest member of either kind, so a key shared by millions of lines gives each of them one
   partner and no pairs.  The edit distance to that partner is then verified on the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BLANKS = "[\\x20\\x09-\\x0D]+"
LAST = (1 << 63) - 1
PLACES = 1 << 31


def _hashes(value: Column, name: str) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(value).alias(f"{name}1"), F.xxhash64(F.lit(1), value).alias(f"{name}2")]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The key of each row (id and hashes of the text, so that repeated ids stay apart) and its text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("d"), *_hashes(text, "r"), text.alias("t"))


def _lines(rows: DataFrame) -> DataFrame:
    """Lines with a word: row key, ``pos``, ``first`` (place in the order of all lines), hashes and the line."""
    cut = rows.select("d", "r1", "r2", F.posexplode(F.split("t", "\n", -1)).alias("pos", "line"))
    return cut.where(F.col("line").rlike("[^\\x20\\x09-\\x0D]")).select(
        "d",
        "r1",
        "r2",
        "pos",
        (F.col("d").cast("decimal(20,0)") * F.lit(PLACES).cast("decimal(11,0)") + F.col("pos")).cast("decimal(38,0)").alias("first"),
        *_hashes(F.col("line"), "h"),
        "line",
    )


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, BLANKS), "")


def _halves(words: Column, count: Column) -> list[Column]:
    """Hashes of the first and last k words, k half of this length, then half of one word less if that differs."""
    keys = []
    for less in (0, 1):
        k = F.floor((count - less) / 2).cast("int")
        new = F.lit(True) if not less else count % 2 == 0
        keys += [
            F.when(new, F.xxhash64(F.lit("first"), k, F.slice(words, F.lit(1), k))),
            F.when(new, F.xxhash64(F.lit("last"), k, F.slice(words, -k, k))),
        ]
    return keys


def _near(lines: DataFrame, distinct: DataFrame, broadcast_rows: int) -> DataFrame:
    """``h1, h2`` of the different lines (with hashes ``k0..k3`` of halves) that have an earlier line within one edit."""
    sides = [F.struct(F.col(f"k{i}").alias("half"), F.lit(i % 2 == 1).alias("last")) for i in range(4)]
    halves = distinct.select("h1", "h2", "first", F.explode(F.array(*sides)).alias("x")).where("x.half is not null").select("h1", "h2", "first", "x.*")
    # A half of more than one line.  It is told by the lines' own columns, so that both sides of the join below read
    # the same exchange and the texts are split into words once.
    ends = [f(c).alias(f"{n}_{c}") for c in ("h1", "h2", "first") for n, f in (("low", F.min), ("high", F.max))]
    several = " or ".join(f"low_{c} < high_{c}" for c in ("h1", "h2", "first"))
    shared = halves.groupBy("half").agg(*ends).where(several).select("half")
    wanted = cut_lineage(
        halves.join(shared, "half", "left_semi")
        .groupBy("h1", "h2", "first")
        .agg(F.bool_or(~F.col("last")).alias("first_half"), F.bool_or("last").alias("last_half"))
    )
    small = wanted.count() <= broadcast_rows
    texts = lines.join(F.broadcast(wanted) if small else wanted, ["h1", "h2", "first"])
    candidates = cut_lineage(
        texts.groupBy("h1", "h2", "first", "first_half", "last_half")
        .agg(F.min("line").alias("line"))
        .select("h1", "h2", "first", "first_half", "last_half", _words(F.col("line")).alias("words"))
    )

    one = candidates.select(
        "h1", "h2", "first", "first_half", "last_half", F.size("words").alias("n"), F.posexplode("words").alias("i", "word")
    )
    # 40 bits of each hash: sums of millions of them stay within a long.
    ahead = one.withColumn("p", F.shiftright(F.xxhash64("i", "word"), 24)).withColumn(
        "s", F.shiftright(F.xxhash64(F.col("n") - F.col("i"), "word"), 24)
    )
    line = Window.partitionBy("h1", "h2")
    upto = line.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    sums = ahead.select(
        "h1",
        "h2",
        "first",
        "n",
        "i",
        (F.sum("p").over(upto) - F.col("p")).alias("before"),
        (F.sum("s").over(line) - F.sum("s").over(upto)).alias("after"),
        "p",
        "s",
        "first_half",
        "last_half",
    )
    # An edit from the middle on leaves the first half, one up to the middle the last.
    outside = (F.col("first_half") & (2 * F.col("i") >= F.col("n") - 2)) | (F.col("last_half") & (2 * F.col("i") <= F.col("n")))

    def variant(gap: bool, at: Column, before: Column, after: Column) -> Column:
        key = F.xxhash64(before, after)
        return F.struct(key.alias("key"), F.lit(gap).alias("gap"), at.alias("at"))

    here = F.col("i")
    variants = sums.where(outside).select(
        "h1",
        "h2",
        "first",
        F.explode(
            F.array_compact(
                F.array(
                    variant(False, here, F.col("before"), F.col("after")),
                    variant(True, here, F.col("before"), F.col("after") + F.col("s")),
                    F.when(here == F.col("n") - 1, variant(True, here + 1, F.col("before") + F.col("p"), F.lit(0).cast("long"))),
                )
            )
        ).alias("v"),
    ).select("h1", "h2", "first", "v.key", "v.gap", "v.at")
    earliest = (
        variants.groupBy("key")
        .agg(
            F.count("*").alias("members"),
            F.min(F.when(~F.col("gap"), F.col("first"))).alias("left_out"),
            F.min(F.when(F.col("gap"), F.col("first"))).alias("whole"),
        )
        .where("members > 1 and left_out is not null")
        .select("key", "left_out", "whole")
    )
    partner = F.when(F.col("gap"), F.col("left_out")).otherwise(F.least("left_out", "whole"))
    pairs = (
        variants.join(earliest, "key")
        .select("h1", "h2", "first", "gap", "at", partner.alias("other"))
        .where("other < first")
        .dropDuplicates(["h1", "h2", "other", "gap", "at"])
    )
    checked = pairs.join(candidates.select("h1", "h2", F.col("words").alias("a")), ["h1", "h2"]).join(
        candidates.select(F.col("first").alias("other"), F.col("words").alias("b")), "other"
    )
    # Words before the place are equal, and so are those after it, whichever side leaves one out.
    a, b, at = F.col("a"), F.col("b"), F.col("at")
    a_from = at + F.when(F.col("gap"), 1).otherwise(2)
    b_from = at + F.when(F.col("gap") | (F.size(b) == F.size(a)), 2).otherwise(1)
    same = (F.slice(a, F.lit(1), at) == F.slice(b, F.lit(1), at)) & (
        F.slice(a, a_from, F.size(a)) == F.slice(b, b_from, F.size(b))
    )
    apart = F.abs(F.size(a) - F.size(b)) <= 1
    return checked.where(apart & same).select("h1", "h2").distinct()


def _dropped(rows: DataFrame, min_words: int, broadcast_rows: int) -> DataFrame:
    """Row key, ``gone`` (positions that go) and ``near`` (how many of them have no equal earlier line)."""
    lines = _lines(rows)
    words = _words(F.col("line"))
    measured = lines.withColumn("words", words).withColumn("n", F.size("words")).where(F.col("n") >= min_words)
    distinct = (
        measured.select("h1", "h2", "first", *(k.alias(f"k{i}") for i, k in enumerate(_halves(F.col("words"), F.col("n")))))
        .groupBy("h1", "h2")
        .agg(F.min("first").alias("first"), *(F.min(f"k{i}").alias(f"k{i}") for i in range(4)))
    )
    near = _near(lines, distinct, broadcast_rows).withColumn("near", F.lit(True))
    places = lines.groupBy("h1", "h2").agg(F.min("d").alias("d0"), F.max("d").alias("d1"))
    # Written down, so that the join below reads both sides from plain exchanges: only then can Spark deal the places
    # of a very common line over several tasks.
    flagged = cut_lineage(
        places
        .join(near, ["h1", "h2"], "left")
        .where("near or d0 < d1")
        .select("h1", "h2", "d0", F.coalesce("near", F.lit(False)).alias("near"))
    )
    gone = lines.select("d", "r1", "r2", "pos", "h1", "h2").join(flagged, ["h1", "h2"]).where("near or d > d0")
    return gone.groupBy("d", "r1", "r2").agg(
        F.collect_set("pos").alias("gone"),
        F.collect_set(F.when(F.col("near") & (F.col("d") == F.col("d0")), F.col("pos"))).alias("near"),
    )


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 5,
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """``docs`` with all its columns, ``text`` without the lines that have an earlier equal or near line.

    Three columns are added: ``lines`` with a word, ``lines_removed``, and of those ``lines_near``, which only had a
    near one.  Lines without a word stay.  No row is dropped: a text all of whose lines stand earlier becomes
    empty.  A null text is empty.  Rows with a null id come last.  Rows of one id count as one document, each of
    them keeps its first copy of a line; equal rows stay equal.  Existing columns named like the three are replaced.

    Lines shorter than ``min_words`` are compared for equality only: from five words on, one edit leaves four fifths
    of the line, with fewer one replaced word makes another line.  Candidate lines are sent to all tasks if they are
    at most ``broadcast_rows`` (two hashes and a place each); beyond that the lines are shuffled to them.
    """
    keyed = docs.select(
        F.struct("*").alias("_row"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("d"),
        *_hashes(F.coalesce(F.col(text_col), F.lit("")), "r"),
    )
    marks = _dropped(_rows(docs, id_col, text_col), min_words, broadcast_rows)
    joined = keyed.join(marks, ["d", "r1", "r2"], "left")
    lines = F.split(F.coalesce(F.col(f"_row.`{text_col}`"), F.lit("")), "\n", -1)
    every = F.sequence(F.lit(0), F.size("_l") - 1)
    # Within a row the first copy stays: equal lines fall together; lines without a word are told apart by place.
    told = F.transform(
        F.array_except(every, F.coalesce("gone", F.array().cast("array<int>"))),
        lambda i: F.when(F.get("_l", i).rlike("[^\\x20\\x09-\\x0D]"), F.get("_l", i)).otherwise(
            F.concat(F.lit("\n"), i.cast("string"), F.lit("\n"), F.get("_l", i))
        ),
    )
    kept = F.transform(F.array_distinct(told), lambda x: F.when(x.startswith("\n"), F.substring_index(x, "\n", -1)).otherwise(x))
    full = lambda lines: F.size(F.filter(lines, lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    out = joined.withColumn("_l", lines).withColumn("_k", kept)
    names = [c for c in docs.columns if c not in ("lines", "lines_removed", "lines_near")]
    return out.select(
        *(F.array_join("_k", "\n").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in names),
        full(F.col("_l")).cast("long").alias("lines"),
        (full(F.col("_l")) - full(F.col("_k"))).cast("long").alias("lines_removed"),
        F.coalesce(F.size("near"), F.lit(0)).cast("long").alias("lines_near"),
    )
