"""Training with a validation split: mini-batch gradient steps, warm-up and decay, early stop, checkpoints.

A text is its hashed words, each counting one over the root of the text's length.  The rows of a step are those of one
slice of the training table; every task adds its rows' gradient up, the sums are grouped on Spark, and the driver holds
the weights alone, whose size is the number of features times the number of classes.  After each epoch the validation
rows are scored, the state is written down, and training ends when they have not become better for some epochs; the
weights of the best epoch are returned.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import words_and_marks
from ..session import write_down


@dataclass(frozen=True)
class Schedule:
    """``batches`` steps make an epoch; the rate rises over ``warm_up`` steps and then falls to zero at the last one."""

    epochs: int = 20
    batches: int = 8
    rate: float = 0.02
    warm_up: int = 8
    weight_decay: float = 0.01
    patience: int = 3
    n_features: int = 1 << 14
    max_classes: int = 100

    def rate_at(self, step: int) -> float:
        """The rate of a step, counted from 0."""
        last = self.epochs * self.batches
        if step < self.warm_up:
            return self.rate * (step + 1) / self.warm_up
        return self.rate * (last - step) / max(1, last - self.warm_up)


@dataclass
class TextModel:
    """``weights[f, c]``; the row after the last feature is the constant."""

    labels: tuple[str, ...]
    weights: np.ndarray

    @property
    def n_features(self) -> int:
        return len(self.weights) - 1


@dataclass
class _State:
    """What a run needs to go on: adaptive moments, steps done, the best epoch, and the numbers of each epoch."""

    weights: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    best: np.ndarray
    history: list[dict]

    @classmethod
    def fresh(cls, n_features: int, classes: int) -> _State:
        return cls(*(np.zeros((n_features + 1, classes)) for _ in range(4)), [])


def word_features(text: Column, n_features: int) -> Column:
    """The feature of each word, repeats included; null is empty."""
    words = words_and_marks(F.lower(F.coalesce(text, F.lit(""))))
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(n_features)).cast("int"))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int | None]]:
    lists = batch.column("features")
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    labels = batch.column("label").to_pylist() if "label" in batch.schema.names else [None] * len(lists)
    for i, label in enumerate(labels):
        yield values[offsets[i] : offsets[i + 1]], label


def _shares(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = weights[-1] + (weights[features].sum(axis=0) / math.sqrt(len(features)) if len(features) else 0.0)
    z = np.exp(z - z.max())
    return z / z.sum()


def _summed(rows: DataFrame, weights: np.ndarray, with_gradient: bool) -> tuple[np.ndarray | None, float, int, int]:
    """Gradient, loss, right answers and rows, added up per task and then on Spark."""
    size, classes = weights.shape
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        gradient = np.zeros_like(own) if with_gradient else None
        loss, right, n = 0.0, 0, 0
        for batch in batches:
            for features, label in _rows(batch):
                p = _shares(features, own)
                loss -= math.log(max(p[label], 1e-300))
                right += int(p.argmax() == label)
                n += 1
                if with_gradient:
                    p[label] -= 1
                    gradient[-1] += p
                    if len(features):
                        np.add.at(gradient, features, p / math.sqrt(len(features)))
        places = np.flatnonzero(gradient) if with_gradient else np.zeros(0, dtype=np.int64)
        values = gradient.ravel()[places] if with_gradient else np.zeros(0)
        yield pa.record_batch(
            [pa.array(np.concatenate([[-3, -2, -1], places]).astype(np.int64)), pa.array(np.concatenate([[loss, right, n], values]))],
            ["place", "v"],
        )

    parts = rows.select("label", "features").mapInArrow(add, "place long, v double")
    table = parts.groupBy("place").agg(F.sum("v").alias("v")).toArrow()
    shared.unpersist()
    sums = dict(zip(table["place"].to_pylist(), table["v"].to_pylist()))
    loss, right, n = (sums.pop(k, 0.0) for k in (-3, -2, -1))
    gradient = np.zeros(size * classes) if with_gradient else None
    if with_gradient and sums:
        gradient[list(sums)] = list(sums.values())
    return (gradient.reshape(size, classes) if with_gradient else None), loss, int(right), int(n)


def _step(state: _State, gradient: np.ndarray, rate: float, step: int, decay: float) -> None:
    """Adaptive moments with decoupled weight decay; the constant is not decayed."""
    state.mean += 0.1 * (gradient - state.mean)
    state.square += 0.001 * (gradient**2 - state.square)
    mean, square = state.mean / (1 - 0.9 ** (step + 1)), state.square / (1 - 0.999 ** (step + 1))
    state.weights[:-1] *= 1 - rate * decay
    state.weights -= rate * mean / (np.sqrt(square) + 1e-8)


def _save(spark: SparkSession, path: str, labels: list[str], schedule: Schedule, state: _State) -> None:
    """One table per epoch: rows appear only when the whole table has been written."""
    about = json.dumps({"labels": labels, "schedule": asdict(schedule), "history": state.history})
    kinds = [(name, getattr(state, name).ravel().tolist()) for name in ("weights", "mean", "square", "best")]
    rows = [("about", about, None), *((k, None, v) for k, v in kinds)]
    frame = spark.createDataFrame(rows, "kind string, about string, numbers array<double>").coalesce(1)
    frame.write.mode("overwrite").parquet(f"{path}/epoch-{len(state.history):05d}")


def _load(spark: SparkSession, path: str, labels: list[str], schedule: Schedule) -> _State | None:
    """The state after the last whole epoch of the same labels and schedule; None if there is none."""
    found = None
    for epoch in range(1, schedule.epochs + 1):
        try:
            rows = {r["kind"]: r for r in spark.read.parquet(f"{path}/epoch-{epoch:05d}").collect()}
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
                break
            raise
        about = json.loads(rows["about"]["about"])
        if about["labels"] != labels or about["schedule"] != asdict(schedule):
            raise ValueError(f"{path} holds another run")
        shape = (schedule.n_features + 1, len(labels))
        found = _State(*(np.array(rows[k]["numbers"]).reshape(shape) for k in ("weights", "mean", "square", "best")), about["history"])
    return found


def _ended(history: list[dict], schedule: Schedule) -> bool:
    best = min(range(len(history)), key=lambda i: (history[i]["validation_loss"], i)) if history else 0
    return len(history) >= schedule.epochs or len(history) - 1 - best >= schedule.patience > 0


def train_with_validation(
    train: DataFrame,
    validation: DataFrame,
    text_col: str,
    label_col: str,
    schedule: Schedule = Schedule(),
    checkpoint: str | None = None,
    stop_after: int | None = None,
) -> tuple[TextModel, list[dict]]:
    """The model of the epoch with the least validation loss, and the numbers of every epoch.

    Rows without a label are left out, validation rows with a label that was never learned too; null texts are empty;
    equal rows count as often as they stand there; slices are made by a hash of the text, so they don't depend on
    partitions.  With ``checkpoint`` each epoch is written there, and a run that was cut off goes on from the last whole
    one; ``stop_after`` ends this call after so many epochs in all.  An empty training table raises.
    """
    spark = train.sparkSession
    counted = train.where(F.col(label_col).isNotNull()).groupBy(F.col(label_col).cast("string").alias("l")).agg(F.lit(1))
    labels = sorted(r["l"] for r in counted.limit(schedule.max_classes + 1).collect())
    if not labels or len(labels) > schedule.max_classes:
        raise ValueError(f"{len(labels)} labels; between 1 and {schedule.max_classes} are needed")
    number = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label_col).cast("string")) - 1

    def prepared(df: DataFrame) -> DataFrame:
        text = F.col(f"`{text_col}`")
        rows = df.where(F.col(label_col).isNotNull()).select(
            number.cast("int").alias("label"), word_features(text, schedule.n_features).alias("features"),
            F.pmod(F.xxhash64(F.lit(42), F.coalesce(text, F.lit(""))), F.lit(schedule.batches)).cast("int").alias("slice"),
        )
        return write_down(rows.where("label >= 0"))

    rows, held = prepared(train), prepared(validation)
    state = (checkpoint and _load(spark, checkpoint, labels, schedule)) or _State.fresh(schedule.n_features, len(labels))
    while not _ended(state.history, schedule) and (stop_after is None or len(state.history) < stop_after):
        epoch, losses, seen = len(state.history), 0.0, 0
        for batch in range(schedule.batches):
            step = epoch * schedule.batches + batch
            gradient, loss, _, n = _summed(rows.where(F.col("slice") == batch), state.weights, True)
            losses, seen = losses + loss, seen + n
            if n:
                _step(state, gradient / n, schedule.rate_at(step), step, schedule.weight_decay)
        _, loss, right, n = _summed(held, state.weights, False)
        now = loss / n if n else losses / max(1, seen)
        if not state.history or now < min(h["validation_loss"] for h in state.history):
            state.best = state.weights.copy()
        state.history.append(
            {"epoch": epoch + 1, "train_loss": losses / max(1, seen), "validation_loss": now, "validation_right": right,
             "validation_rows": n, "rate": schedule.rate_at((epoch + 1) * schedule.batches - 1)}
        )
        if checkpoint:
            _save(spark, checkpoint, labels, schedule, state)
    return TextModel(tuple(labels), state.best), state.history


def best_epoch(history: list[dict]) -> int:
    return min(history, key=lambda h: (h["validation_loss"], h["epoch"]))["epoch"]


def predict_text(df: DataFrame, model: TextModel, text_col: str, out: str = "predicted", score: str | None = None) -> DataFrame:
    """Add the likeliest label of each text, and its probability as ``score``; the first label wins a tie."""
    shared = df.sparkSession.sparkContext.broadcast(model.weights)
    labels = model.labels

    @F.arrow_udf("label string, share double")
    def found(features: pa.Array) -> pa.Array:
        batch = pa.record_batch([features], ["features"])
        shares = [_shares(f, shared.value) for f, _ in _rows(batch)]
        return pa.StructArray.from_arrays(
            [pa.array([labels[s.argmax()] for s in shares], pa.string()), pa.array([float(s.max()) for s in shares], pa.float64())],
            ["label", "share"],
        )

    columns = [F.col(f"`{c}`") for c in df.columns if c not in (out, score)]
    features = word_features(F.col(f"`{text_col}`"), model.n_features)
    both = df.select(F.struct(*columns).alias("_row"), found.asNondeterministic()(features).alias("_found"))
    return both.select("_row.*", F.col("_found.label").alias(out), *([F.col("_found.share").alias(score)] if score else []))
