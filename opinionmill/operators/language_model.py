"""Language identification learned from labelled texts: hashed character n-grams and scripts.

Letters are lower-cased, everything else parts words, and each word stands between spaces.  A text is its character
n-grams of one to three characters, hashed into a fixed number of buckets; a language is the smoothed logarithm of each
bucket's share.  The script of most letters decides first which languages are asked; the language whose texts make the
n-grams likeliest wins, and a text whose two best languages are too close is ``unknown``.

Counting is one pass that keeps one table of buckets per task and one grouped sum; scoring is a lookup of whole Arrow
batches in the model, whose size depends on the number of languages and buckets alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.language import UNKNOWN

BUCKETS = 16_381
LENGTHS = (1, 2, 3)
FACTORS = (7_919, 104_729, 1_299_709)
STEP = 1_000_003

#: Weights are whole millionths of a natural logarithm, so sums don't depend on their order.
SCALE = 1_000_000

# First code points of the blocks of letters that tell scripts apart; what follows the last one of a
# script up to the next line is "other".
SCRIPTS = (
    (0x0041, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "other"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
    (0x30000, "other"),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_BOUNDS = np.array([first for first, _ in SCRIPTS])
_SCRIPT_OF = np.array([0, *(SCRIPT_NAMES.index(name) for _, name in SCRIPTS)])

#: A script belongs to a language if it has at least this share of the letters of its labelled texts.
SCRIPT_SHARE = 0.01


def letters_of(text: Column) -> Column:
    """Lower-case letters; all other characters become one space, at both ends too.  Null is empty."""
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")
    return F.concat(F.lit(" "), F.btrim(words), F.lit(" "))


def _points(letters: str) -> np.ndarray:
    return np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


def buckets_of(points: np.ndarray) -> np.ndarray:
    """The bucket of every n-gram, repeats included; a text without letters has none."""
    if len(points) < 3:
        return np.zeros(0, dtype=np.int64)
    out = []
    for n in LENGTHS:
        count = len(points) - n + 1
        h = np.full(count, n * STEP, dtype=np.int64)
        for k in range(n):
            h += points[k : k + count] * FACTORS[k]
        out.append(h % BUCKETS)
    return np.concatenate(out)


def scripts_of(points: np.ndarray) -> np.ndarray:
    """The number of letters in each script."""
    kinds = _SCRIPT_OF[np.searchsorted(_BOUNDS, points[points != 32], side="right")]
    return np.bincount(kinds, minlength=len(SCRIPT_NAMES))


@dataclass(frozen=True)
class LanguageModel:
    """``weights[b, l]``: the logarithm of the share of bucket ``b`` in language ``l``; ``scripts[s, l]``: known there."""

    names: tuple[str, ...]
    weights: np.ndarray
    scripts: np.ndarray

    def identify(self, letters: str, margin: int) -> tuple[str, int | None]:
        """The language and by how much it leads, in millionths; no lead without a second language."""
        points = _points(letters)
        found = buckets_of(points)
        if not len(found):
            return UNKNOWN, None
        asked = np.flatnonzero(self.scripts[scripts_of(points).argmax()])
        if not len(asked):
            return UNKNOWN, None
        scores = self.weights[found].sum(axis=0)[asked]
        order = np.argsort(-scores, kind="stable")
        if len(asked) == 1:
            return self.names[asked[0]], None
        lead = int(scores[order[0]] - scores[order[1]])
        return (self.names[asked[order[0]]] if lead >= margin and lead > 0 else UNKNOWN), lead


def count_ngrams(df: DataFrame, text_col: str, language_col: str) -> DataFrame:
    """``language, kind, place, n``: counts per bucket (``ngram``) and letters per script (``script``) of each language.

    Rows without a language are left out.  Each task adds its rows up before they are grouped.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, letters in zip(batch.column("language").to_pylist(), batch.column("letters").to_pylist()):
                points = _points(letters)
                if language not in grams:
                    grams[language] = np.zeros(BUCKETS, dtype=np.int64)
                    scripts[language] = np.zeros(len(SCRIPT_NAMES), dtype=np.int64)
                found = buckets_of(points)
                if len(found):
                    grams[language] += np.bincount(found, minlength=BUCKETS)
                    scripts[language] += scripts_of(points)
        for kind, counted in (("ngram", grams), ("script", scripts)):
            for language, values in counted.items():
                places = np.flatnonzero(values)
                yield pa.record_batch(
                    [pa.array([language] * len(places), pa.string()), pa.array([kind] * len(places), pa.string()),
                     pa.array(places.astype(np.int32)), pa.array(values[places])],
                    ["language", "kind", "place", "n"],
                )

    rows = df.where(F.col(language_col).isNotNull()).select(
        F.col(language_col).cast("string").alias("language"), letters_of(F.col(text_col)).alias("letters")
    )
    counted = rows.mapInArrow(count, "language string, kind string, place int, n long")
    return counted.groupBy("language", "kind", "place").agg(F.sum("n").alias("n"))


def model_from_counts(counts: DataFrame, smoothing: float = 0.5, max_languages: int = 1000) -> LanguageModel:
    """The model of counted n-grams; what reaches the driver is bounded by buckets times languages."""
    names = [r["language"] for r in counts.select("language").distinct().limit(max_languages + 1).collect()]
    if len(names) > max_languages:
        raise ValueError(f"over {max_languages} languages")
    names.sort()
    table = counts.toArrow()
    grams = np.zeros((BUCKETS, len(names)), dtype=np.int64)
    scripts = np.zeros((len(SCRIPT_NAMES), len(names)), dtype=np.int64)
    at = np.array([names.index(x) for x in table["language"].to_pylist()], dtype=np.int64)
    place, n = table["place"].to_numpy(), table["n"].to_numpy()
    is_gram = np.array([k == "ngram" for k in table["kind"].to_pylist()], dtype=bool)
    grams[place[is_gram], at[is_gram]] = n[is_gram]
    scripts[place[~is_gram], at[~is_gram]] = n[~is_gram]
    shares = (grams + smoothing) / (grams.sum(axis=0) + smoothing * BUCKETS)
    weights = np.rint(np.log(shares) * SCALE).astype(np.int64)
    known = scripts * (1 / SCRIPT_SHARE) >= np.maximum(1, scripts.sum(axis=0))
    return LanguageModel(tuple(names), weights, known)


def train_language_model(df: DataFrame, text_col: str, language_col: str, smoothing: float = 0.5) -> LanguageModel:
    """Learn from all rows that have a language; one pass, nothing but the counts leaves the tasks."""
    return model_from_counts(count_ngrams(df, text_col, language_col), smoothing)


def identified(text: Column, model: LanguageModel, margin: float = 1.0) -> Column:
    """``struct<language, lead>`` of each text.

    ``margin`` is the natural logarithm of how many times likelier the best language must be than the second; closer
    texts, blank ones, nulls and scripts of no language are ``unknown``.  Whole texts are scored.
    """
    least = round(margin * SCALE)

    @F.arrow_udf("language string, lead long")
    def found(column: pa.Array) -> pa.Array:
        rows = [model.identify(letters, least) for letters in column.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["language", "lead"]
        )

    return found.asNondeterministic()(letters_of(text))


def detector(model: LanguageModel, margin: float = 1.0) -> Callable[[Column], Column]:
    """For ``clean_reviews(..., detector=...)``."""
    return lambda text: identified(text, model, margin)["language"]


def identify_language(
    df: DataFrame, text_col: str, model: LanguageModel, out: str = "language", lead: str | None = None, margin: float = 1.0
) -> DataFrame:
    """Add the language of each text, and with ``lead`` how far it leads."""
    columns = [F.col(f"`{c}`") for c in df.columns if c not in (out, lead)]
    both = df.select(*columns, identified(F.col(f"`{text_col}`"), model, margin).alias("_found"))
    kept = [F.col(f"`{c}`") for c in both.columns if c != "_found"]
    return both.select(*kept, F.col("_found.language").alias(out), *([F.col("_found.lead").alias(lead)] if lead else []))


def save_language_model(spark: SparkSession, model: LanguageModel, path: str) -> None:
    """One Parquet row per language."""
    rows = [
        (name, model.weights[:, i].tolist(), [SCRIPT_NAMES[s] for s in np.flatnonzero(model.scripts[:, i])])
        for i, name in enumerate(model.names)
    ]
    spark.createDataFrame(rows, "language string, weights array<long>, scripts array<string>").write.mode("overwrite").parquet(path)


def load_language_model(spark: SparkSession, path: str) -> LanguageModel:
    rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["language"])
    weights = np.array([r["weights"] for r in rows], dtype=np.int64).T.reshape(BUCKETS, len(rows))
    scripts = np.array([[s in r["scripts"] for r in rows] for s in SCRIPT_NAMES], dtype=bool).reshape(len(SCRIPT_NAMES), len(rows))
    return LanguageModel(tuple(r["language"] for r in rows), weights, scripts)
