"""Personal data by generated candidates and gradient-boosted trees; DataFrame functions and Spark ML only.

Generators with high recall propose spans that may overlap.  Spans of four kinds with a check of their own (mail
address, IP address, card number with Luhn digit, international phone number) are kept whenever the check holds.
Boosted trees learn from exactly those checks: candidates that pass are positive, those that fail negative, as are
dates, amounts, versions and codes, unless another generator claims the place (a passing span, or one of a generator
without a check): those say nothing.  The features (format and context, not the checks) carry over to spans that no
check covers, such as a phone number without country code.  Per kind, the threshold is the lowest score that keeps
``precision`` on held-out texts, against the negatives of all kinds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from ..session import cut_lineage

# Kinds in order.  Repeats are possessive: nothing that follows could take a character back, and the
# pattern engine then loops instead of recursing on long texts.  ``\G`` lets a match begin where the last one ended.
BASE_KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
    "account": r"(?<![A-Za-z0-9])[0-9]{9,15}(?![A-Za-z0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4})(?![0-9.])",
    "amount": r"(?<![0-9.,])[0-9]{1,3}(?:[.,][0-9]{3})+(?:[.,][0-9]{2})?(?![0-9])",
    "version": r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}(?:\.[0-9]{1,3})?(?![0-9.])",
    "code": r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])[A-Za-z]{1,4}[-_]?[0-9]{4,15}(?![A-Za-z0-9])",
}
#: The kind whose positives calibrate a generator without a check.  The two can't overlap: a local number's runs of
#: digits have at most four, an account's at least nine.
LIKE = {"local_phone": "phone", "account": "card"}
#: Generators of what is no personal data; they teach the trees and the thresholds and give no spans.
PLAIN = ("date", "amount", "version", "code")
NEEDS = {"email": "@", "phone": "+"}

FEATURES = (
    "chars", "digits", "letters", "separators", "dots", "spaces", "parentheses", "plus", "at", "groups", "longest_run",
    "different", "left_letter", "left_digit", "right_letter", "right_digit", "left_space", "right_space", "quoted",
    "named",
)
CONTEXT = 24
STRETCH = 1024
HINTS = "(?i)(mail|phone|tel|call|fax|mobil|card|visa|konto|account|iban|\\bip\\b|addr|kontakt|contact)"


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a text of digits has a valid check digit."""
    digits = F.transform(F.split(F.reverse(number), ""), lambda c: c.cast("int"))
    worth = F.transform(digits, lambda x, i: F.when(i % 2 == 0, x).otherwise(F.when(x > 4, x * 2 - 9).otherwise(x * 2)))
    return F.aggregate(worth, F.lit(0), lambda total, x: total + F.coalesce(x, F.lit(0))) % 10 == 0


def valid(kind: str, text: Column) -> Column:
    """The check of a base kind; false for the other generators."""
    digits = digits_of(text)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        small = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(
            F.split(text, "\\."), lambda p: (F.length(small(p)) <= 3) & (F.substring(small(p), 1, 3).cast("int") <= 255)
        )
    if kind == "card":
        # The digit sum is worked out only where the length fits.
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(False)


#: Items that a fold adds one by one; see ``_scan``.
RUN = 64


def _scan(values: Column, add: Callable[[Column, Column], Column], levels: int = 3) -> Column:
    """For each of ``values`` what ``add`` makes of 0 and all before it.

    A fold copies its state with each item, so only runs of ``RUN`` items are folded into arrays; where a run begins
    comes from the scan of the runs' totals.
    """
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")

    def running(run: Column, first: Column) -> Column:
        return F.aggregate(
            run,
            F.struct(first.alias("at"), none.alias("out")),
            lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"],
        )

    def by_runs(own: Column) -> Column:
        run = lambda number: F.slice(own, number * RUN + 1, F.lit(RUN))
        numbers = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / RUN).cast("int"))
        totals = F.when(F.size(own) > 0, F.transform(numbers, lambda i: F.aggregate(run(i), zero, add))).otherwise(none)
        return let(
            _scan(totals, add, levels - 1),
            lambda firsts: F.flatten(F.transform(firsts, lambda first, i: running(run(i), first))),
        )

    return let(values, by_runs) if levels > 1 else running(values, zero)


def _places(pieces: Column, found: Column) -> Column:
    """Where each match starts: after the pieces up to it and the matches before it."""
    # Of each match its own length and that of the piece after it, so that the sums begin with the first piece's.
    sizes = F.transform(found, lambda m, i: (F.length(m) + F.length(F.get(pieces, i + 1))).cast("long"))
    return F.transform(_scan(sizes, lambda at, x: at + x), lambda at: at + F.length(F.get(pieces, F.lit(0))))


def _end(text: Column) -> Column:
    return F.substring(text, -CONTEXT, CONTEXT)


def candidates_of(kind: str, text: Column) -> Column:
    """All matches of a generator: ``kind, start, end, token, left, right, ok``; code points, end exclusive.

    ``left`` holds up to ``CONTEXT`` characters, as far back as the match before last.  The time grows with the
    length of the text, however many matches it has: contexts come from the pieces between matches, never from the
    whole text.
    """
    pattern = PATTERNS[kind]
    none = F.lit("")

    def spans(found: Column, pieces: Column, places: Column) -> Column:
        def span(m: Column, i: Column) -> Column:
            before = F.concat(
                _end(F.coalesce(F.get(pieces, i - 1), none)),
                _end(F.when(i > 0, F.get(found, i - 1)).otherwise(none)),
                _end(F.get(pieces, i)),
            )
            after = F.concat(F.substring(F.get(pieces, i + 1), 1, 2), F.substring(F.coalesce(F.get(found, i + 1), none), 1, 2))
            start = F.get(places, i)
            return F.struct(
                F.lit(kind).alias("kind"),
                start.alias("start"),
                (start + F.length(m)).alias("end"),
                m.alias("token"),
                _end(before).alias("left"),
                F.substring(after, 1, 2).alias("right"),
                valid(kind, m).alias("ok"),
            )

        return F.transform(found, span)

    matches = let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: let(
            F.split(text, pattern, -1),
            lambda pieces: let(_places(pieces, found), lambda places: spans(found, pieces, places)),
        ),
    )
    empty = F.array().cast("array<struct<kind: string, start: bigint, end: bigint, token: string, left: string, right: string, ok: boolean>>")
    present = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike("[0-9]")
    return F.when(present, matches).otherwise(empty)


def with_features(spans: DataFrame) -> DataFrame:
    """Format and context of ``token``, ``left`` and ``right`` as numbers."""
    token, left, right = F.col("token"), F.col("left"), F.col("right")
    count = lambda chars: F.length(F.regexp_replace(token, f"[^{chars}]", ""))
    mark = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    runs = F.split(token, "[^0-9]+")
    values = {
        "chars": F.length(token),
        "digits": count("0-9"),
        "letters": count("A-Za-z"),
        "separators": count("\\x20().-"),
        "dots": count("."),
        "spaces": count("\\x20"),
        "parentheses": count("()"),
        "plus": count("+"),
        "at": count("@"),
        "groups": F.size(F.array_remove(runs, "")),
        "longest_run": F.aggregate(runs, F.lit(0), lambda a, r: F.greatest(a, F.length(r))),
        "different": F.size(F.array_distinct(F.split(digits_of(F.substring(token, 1, 64)), ""))),
        "left_letter": mark(left.rlike("[A-Za-z]$")),
        "left_digit": mark(left.rlike("[0-9]$")),
        "right_letter": mark(right.rlike("^[A-Za-z]")),
        "right_digit": mark(right.rlike("^[0-9]")),
        "left_space": mark(left.rlike("(^|\\s)$")),
        "right_space": mark(right.rlike("^(\\s|$)")),
        "quoted": mark(left.rlike("[\"'=]$")),
        "named": mark(left.rlike(HINTS)),
    }
    # A plus sign is what tells the checked phone numbers from the others, so the trees must not see it.
    values["plus"] = F.lit(0)
    return spans.withColumns({f: values[f].cast("double") for f in FEATURES})


def _learn(spans: DataFrame, sample: int, rounds: int, depth: int):
    """The boosted trees, from at most ``sample`` candidates chosen by hash; None unless both classes are there."""
    chosen = (
        spans.where(F.col("told") & (F.col("fold") != 0))
        .orderBy(F.xxhash64("r1", "kind", "start", "token"), "r1", "r2", "kind", "start")
        .limit(sample)
        .select(F.col("ok").cast("double").alias("label"), *FEATURES)
    )
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(chosen).select("label", "features")
    rows = cut_lineage(rows.coalesce(4))
    classes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if min(classes.get(0.0, 0), classes.get(1.0, 0)) < 10:
        return None
    return GBTClassifier(maxIter=rounds, maxDepth=depth, seed=7, maxBins=32).fit(rows)


def _thresholds(scored: DataFrame, precision: float) -> dict[str, float]:
    """Per base kind the lowest of 101 scores from which on ``precision`` of the held-out candidates are right.

    Held against each kind's right ones are the wrong ones of all kinds: a format that is no personal data is one for
    every generator.
    """
    bins = (
        scored.where((F.col("fold") == 0) & F.col("told"))
        .groupBy(F.when(F.col("ok"), F.col("kind")).alias("kind"), F.floor(F.col("score") * 100).alias("bin"))
        .agg(F.count("*").alias("n"))
        .collect()
    )
    counts = {(b["kind"], b["bin"]): b["n"] for b in bins}
    out: dict[str, float] = {}
    for kind in BASE_KINDS:
        wrong = right = 0
        # Down through scores that no held-out candidate has, too: they cost no precision.
        for score in range(100, 49, -1):
            wrong, right = wrong + counts.get((None, score), 0), right + counts.get((kind, score), 0)
            if right < precision * (wrong + right):
                break
            if right:
                out[kind] = score / 100
    return out


def find_personal_data(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = 20_000,
    rounds: int = 10,
    depth: int = 3,
    precision: float = 0.98,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``spans``, an array of ``kind, start, end``, by kind, then start.

    Base spans that pass their check are all there.  Added are spans of the other generators that the trees score
    above the threshold of the kind they are like, unless they overlap a base span.  Without ten passing and ten
    failing candidates nothing is learned and nothing added.

    Null texts are empty; null and repeated ids and rows stay; other columns are ignored; an empty table gives no row.
    ``sample`` bounds what is learned from (equal rows are taken by hash, then place); candidates are sought, scored and
    counted for thresholds in all different texts, of any length: time and memory grow with it and no faster.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("r1"), F.xxhash64(F.lit(1), text).alias("r2"), text.alias("t"))
    found = cut_lineage(
        raw.select("doc_id", "r1", "r2", *(candidates_of(k, F.col("t")).alias(k) for k in PATTERNS))
        .select("doc_id", "r1", "r2", F.concat(*PATTERNS).alias("all"))
    )
    base = F.transform(
        F.filter("all", lambda s: s["ok"] & s["kind"].isin(*BASE_KINDS)),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    rows = found.select("doc_id", "r1", "r2", base.alias("base"))
    # Copies of a text have the same candidates, so each text is looked at once.
    some = found.where(F.size("all") > 0).select("r1", "r2", "all").dropDuplicates(["r1", "r2"])
    spans = with_features(_told(some.select("r1", "r2", F.explode("all").alias("s")).select("r1", "r2", "s.*")))
    spans = cut_lineage(spans.withColumn("fold", F.pmod(F.col("r1"), F.lit(4))))
    model = _learn(spans, sample, rounds, depth)
    span_type = "array<struct<kind: string, start: bigint, end: bigint>>"
    if model is None:
        return rows.select("doc_id", F.col("base").cast(span_type).alias("spans"))
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(spans)
    scored = model.transform(assembled).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    limits = _thresholds(scored, precision)
    chosen = F.lit(False)
    for kind, like in LIKE.items():
        if like in limits:
            chosen = chosen | ((F.col("kind") == kind) & (F.col("score") >= limits[like]))
    added = (
        scored.where(chosen & F.col("free"))
        .groupBy(F.col("r1").alias("_r1"), F.col("r2").alias("_r2"))
        .agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("more"))
    )
    joined = rows.join(added, (F.col("r1") == F.col("_r1")) & (F.col("r2") == F.col("_r2")), "left")
    none = F.array().cast("array<struct<start: bigint, end: bigint, kind: string>>")
    more = [
        F.transform(
            F.filter(F.coalesce("more", none), _is(k)),
            lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
        )
        for k in LIKE
    ]
    return joined.select("doc_id", F.concat("base", *more).cast(span_type).alias("spans"))


def _told(spans: DataFrame) -> DataFrame:
    """Add ``free``, that no passing span overlaps, and ``told``, that the candidate is one to learn from.

    Told are passing spans, and failing ones that no passing span and no generator without a check claims.  Each
    candidate asks at its end for the furthest end of the spans that start before it: a running maximum over the places
    of one text, whose copies are gone, and no pairs.
    """
    own, claim = F.col("kind").isin(*BASE_KINDS) & F.col("ok"), F.col("kind").isin(*LIKE)
    # At one place a question (0) comes before a span that starts there (1).
    begins = F.when(own | claim, F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("order"))))
    asks = F.array(F.struct(F.col("end").alias("at"), F.lit(0).alias("order")))
    events = spans.select("*", F.explode(F.concat(asks, F.coalesce(begins, F.array().cast("array<struct<at: bigint, order: int>>")))).alias("e")).select("*", "e.*").drop("e")
    before = Window.partitionBy("r1", "r2").orderBy("at", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = lambda which: F.max(F.when((F.col("order") == 1) & which, F.col("end"))).over(before)
    met = lambda end: F.coalesce(F.col(end) > F.col("start"), F.lit(False))
    asked = events.withColumns({"_own": reach(own), "_claim": reach(own | claim)}).where("order = 0")
    told = own | (~claim & ~F.col("ok") & ~met("_claim"))
    return asked.withColumns({"free": ~met("_own"), "told": told}).drop("at", "order", "_own", "_claim")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans that overlap are one, of the first one's kind.

    The text is cut into stretches of ``STRETCH`` characters once, and a piece is taken from the stretches it lies in.
    """
    ordered = F.array_sort(
        spans, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(b["end"] - a["end"]).cast("int")
    )

    def between(parts: Column, low: Column, high: Column) -> Column:
        first = F.floor(low / STRETCH)
        own = F.array_join(F.slice(parts, (first + 1).cast("int"), (F.floor(high / STRETCH) - first + 1).cast("int")), "")
        return F.substring(own, (low - first * STRETCH + 1).cast("int"), (high - low).cast("int"))

    def replaced(parts: Column, own: Column, reach: Column) -> Column:
        heads = F.filter(
            F.transform(own, lambda s, i: F.struct(F.get(reach, i).alias("low"), s["start"].cast("long").alias("high"), s["kind"].alias("kind"))),
            lambda h: h["high"] >= h["low"],
        )
        pieces = F.transform(heads, lambda h: F.concat(between(parts, h["low"], h["high"]), F.lit("["), h["kind"], F.lit("]")))
        last = F.coalesce(F.array_max(F.transform(own, lambda s: s["end"])), F.lit(0)).cast("long")
        return F.concat(F.array_join(pieces, ""), between(parts, last, F.greatest(last, F.length(text).cast("long"))))

    stretches = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % STRETCH), F.lit(0))
    return let(stretches, lambda parts: let(ordered, lambda own: let(
        _scan(F.transform(own, lambda s: s["end"].cast("long")), lambda far, end: F.greatest(far, end)),
        lambda reach: replaced(parts, own, reach),
    )))


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _is(kind: str):
    return lambda span: span["kind"] == kind


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans, from ``find_personal_data``."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))
