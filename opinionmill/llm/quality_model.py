"""Quality classifier with supervised subword embeddings.

A document is the mean of the vectors of its words, word n-grams and character n-grams (hashed into ``buckets`` rows,
capitals kept apart), and a softmax layer turns the mean into class probabilities.  Vectors and layer are learned together by stochastic
gradient descent in numpy, on a bounded sample of labelled documents.  As the layer is linear in the mean, a text
is scored with one number per bucket, the vector's product with the layer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import slices

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
POWERS = np.cumprod(np.full(64, 0x100000001B3, dtype=np.uint64))


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled documents that are learned from; all texts are used whole."""

    buckets: int = 1 << 18
    dimensions: int = 16
    ngrams: tuple[int, ...] = (3, 4)
    word_ngrams: tuple[int, ...] = (2, 3)
    epochs: int = 20
    rate: float = 0.5
    sample: int = 2000
    seed: int = 7


@dataclass
class Model:
    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    @property
    def weights(self) -> np.ndarray:
        return (self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float32)

    @property
    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MULTIPLIER
    return ((h ^ (h >> np.uint64(32))) % np.uint64(buckets)).astype(np.int32)


def features(text: str, settings: Settings) -> np.ndarray:
    """Buckets of the words, of n consecutive words, and of the n-grams within a word and its two borders; repeats count."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    points = np.concatenate([[32], points, [32]]).astype(np.uint64)
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    points[blank] = 32
    inner = ~blank
    starts = np.flatnonzero(inner & np.concatenate([[True], blank[:-1]]))
    if not len(starts):
        return np.zeros(0, dtype=np.int32)
    out = []
    place = np.arange(len(points))
    first = np.repeat(starts, np.diff(np.append(starts, len(points))))
    at = (place[starts[0] :] - first) % 64
    mixed = np.where(inner[starts[0] :], points[starts[0] :] * POWERS[at], np.uint64(0))
    words = np.add.reduceat(mixed, starts - starts[0]) + np.uint64(1)
    out.append(_bucket(words, settings.buckets))
    for n in settings.word_ngrams:
        count = len(words) - n + 1
        if count < 1:
            continue
        h = np.full(count, n, dtype=np.uint64)
        for k in range(n):
            h = h * MULTIPLIER + words[k : k + count]
        out.append(_bucket(h, settings.buckets))
    blanks = np.concatenate([[0], np.cumsum(blank)])
    for n in settings.ngrams:
        count = len(points) - n + 1
        if count < 1:
            continue
        h = np.full(count, n, dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + points[k : k + count]
        whole = blanks[n - 1 : n - 1 + count] == blanks[1 : 1 + count]
        out.append(_bucket(h[whole], settings.buckets))
    return np.concatenate(out)


def sparse_features(text: Column, settings: Settings) -> Column:
    kind = pa.struct([("index", pa.list_(pa.int32())), ("share", pa.list_(pa.float32()))])

    @F.arrow_udf("index array<int>, share array<float>")
    def counted(column: pa.Array) -> pa.Array:
        rows = []
        for texts in slices(column):
            for t in texts:
                index, counts = np.unique(features(t, settings), return_counts=True)
                rows.append({"index": index, "share": (counts / max(1, counts.sum())).astype(np.float32)})
        return pa.array(rows, type=kind)

    return counted.asNondeterministic()(text)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], settings: Settings) -> Model:
    """Stochastic gradient descent over (buckets, shares, class); the rate falls to zero."""
    random = np.random.default_rng(settings.seed)
    vectors = random.uniform(-1, 1, (settings.buckets, settings.dimensions)).astype(np.float32) / settings.dimensions
    layer = np.zeros((settings.dimensions, 2), dtype=np.float32)
    classes = np.bincount([c for _, _, c in rows], minlength=2) if rows else np.zeros(2)
    bias = np.log((classes + 1) / (classes.sum() + 2)).astype(np.float32)
    steps, done = settings.epochs * len(rows), 0
    for _ in range(settings.epochs):
        for i in random.permutation(len(rows)):
            index, share, label = rows[i]
            if not len(index):
                continue
            rate = settings.rate * (1 - done / steps)
            done += 1
            own = vectors[index]
            mean = share @ own
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= 0.01 * rate * p
            # A mean over hundreds of vectors moves each of them little; the step is scaled by their number.
            vectors[index] = own - (rate * min(len(index), 200)) * share[:, None] * back[None, :]
    return Model(vectors, layer, bias)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, settings: Settings
) -> Model:
    """Learn from at most ``settings.sample`` labelled documents, chosen by a hash of their id.

    Labels that are null or that contradict each other for one id are left out.  Of an id that ``docs`` repeats, one
    text is learned from, that of the least hash, chosen before anything is collected.  Without any label the model
    says one half.
    """
    agreed = (
        labels.where(f"{id_col} is not null and {label_col} is not null")
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label_col).cast("int").alias("low"), F.max(label_col).cast("int").alias("high"))
        .where("low = high and low in (0, 1)")
    )
    # Ids and classes only, at most ``sample`` rows: small enough to be sent to every task.
    chosen = agreed.orderBy(F.xxhash64("id"), "id").limit(settings.sample).select("id", F.col("low").alias("label"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    once = (
        docs.select(F.col(id_col).alias("id"), text.alias("text"))
        .join(F.broadcast(chosen), "id")
        .groupBy("id", "label")
        .agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    )
    found = once.select("id", "label", sparse_features(F.col("text"), settings).alias("f")).toArrow()
    rows = sorted(zip(found["id"].to_pylist(), found["label"].to_pylist(), found["f"]), key=lambda row: row[0])
    return fit([(f["index"].values.to_numpy(), f["share"].values.to_numpy(), label) for _, label, f in rows], settings)


def score_column(text: Column, model: Model, settings: Settings) -> Column:
    """The probability of class 1 of each text; an empty or null text has that of the offset alone."""
    weights, offset = model.weights, model.offset

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        out = []
        for texts in slices(column):
            for t in texts:
                own = features(t, settings)
                z = offset + (float(weights[own].mean(dtype=np.float64)) if len(own) else 0.0)
                out.append(1 / (1 + np.exp(-np.clip(z, -60, 60))))
        return pa.array(out, type=pa.float64())

    return scored.asNondeterministic()(text)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; a null id is not held out, and has no label either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.7,
    settings: Settings = Settings(),
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    Only the text is scored; labels are learned from rows that are not held out.  Null and repeated ids and rows stay,
    null texts are empty, other columns are ignored, an empty table gives no row, and equal texts have equal scores.  A
    text is read whole, whatever its length.
    """
    learnable = labels.where(~held_out(F.col(id_col)))
    model = train(docs, learnable, id_col, text_col, label_col, settings)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        held_out(F.col(id_col)).alias("held_out"),
        score_column(F.col(text_col), model, settings).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
