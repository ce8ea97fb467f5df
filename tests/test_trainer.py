"""Training with a validation split against a plain numpy loop."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinionmill.operators import trainer as T

SCHEDULE = T.Schedule(epochs=4, batches=3, rate=0.1, warm_up=2, n_features=64, patience=2)
WORDS = {"good": ["great", "fun", "lovely"], "bad": ["awful", "poor", "slow"], "odd": ["strange", "weird"]}


def rows(n, shift=0):
    out = []
    for i in range(n):
        label = sorted(WORDS)[(i + shift) % 3]
        out.append((f"a {WORDS[label][i % len(WORDS[label])]} film number {i % 5}", label))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "text string, label string")


def slow_training(spark, train, held, schedule):
    def table(data):
        df = frame(spark, data).where("label is not null").select(
            "label", T.word_features(F.col("text"), schedule.n_features).alias("f"),
            F.pmod(F.xxhash64(F.lit(42), F.coalesce("text", F.lit(""))), F.lit(schedule.batches)).alias("s"),
        )
        return [tuple(r) for r in df.collect()]

    train, held = table(train), table(held)
    labels = sorted({r[0] for r in train})
    x = lambda f: np.append(np.bincount(f, minlength=schedule.n_features) / math.sqrt(max(1, len(f))), 1.0) if len(f) else np.append(np.zeros(schedule.n_features), 1.0)
    w = np.zeros((schedule.n_features + 1, len(labels)))
    mean, square, history, step = np.zeros_like(w), np.zeros_like(w), [], 0

    def shares(f):
        z = x(np.array(f, dtype=int)) @ w
        e = np.exp(z - z.max())
        return e / e.sum()

    for epoch in range(schedule.epochs):
        for batch in range(schedule.batches):
            own = [r for r in train if r[2] == batch]
            g = sum(np.outer(x(np.array(f, dtype=int)), shares(f) - (np.arange(len(labels)) == labels.index(y))) for y, f, _ in own) / max(1, len(own))
            if own:
                rate = schedule.rate_at(step)
                mean = 0.9 * mean + 0.1 * g
                square = 0.999 * square + 0.001 * g**2
                w[:-1] *= 1 - rate * schedule.weight_decay
                w -= rate * (mean / (1 - 0.9 ** (step + 1))) / (np.sqrt(square / (1 - 0.999 ** (step + 1))) + 1e-8)
            step += 1
        known = [r for r in held if r[0] in labels]
        history.append(-sum(math.log(shares(f)[labels.index(y)]) for y, f, _ in known) / len(known))
    return history


def test_training_matches_a_plain_loop(spark):
    train = rows(40) + [(None, "good"), ("no label", None), ("", "bad")]
    held = rows(15, 1) + [("unseen label", "new"), (None, "odd")]
    _, history = T.train_with_validation(frame(spark, train).repartition(3), frame(spark, held), "text", "label", SCHEDULE)
    expected = slow_training(spark, train, held, SCHEDULE)
    assert np.allclose([h["validation_loss"] for h in history], expected[: len(history)], atol=1e-9)
    assert {h["validation_rows"] for h in history} == {16}


def test_a_cut_off_run_goes_on(spark, tmp_path):
    train, held = frame(spark, rows(40)), frame(spark, rows(15, 1))
    whole, history = T.train_with_validation(train, held, "text", "label", SCHEDULE)
    path = str(tmp_path / "run")
    T.train_with_validation(train, held, "text", "label", SCHEDULE, checkpoint=path, stop_after=2)
    resumed, later = T.train_with_validation(train, held, "text", "label", SCHEDULE, checkpoint=path)
    assert len(later) == len(history) and np.allclose(resumed.weights, whole.weights, atol=1e-9)
    with pytest.raises(ValueError, match="another run"):
        T.train_with_validation(train, held, "text", "label", T.Schedule(epochs=4, n_features=64), checkpoint=path)


def test_it_stops_early_and_keeps_the_best(spark):
    swapped = [(t, {"good": "bad", "bad": "odd", "odd": "good"}[y]) for t, y in rows(15)]
    schedule = T.Schedule(epochs=6, batches=2, rate=0.3, warm_up=0, n_features=64, patience=1)
    model, history = T.train_with_validation(frame(spark, rows(30)), frame(spark, swapped), "text", "label", schedule)
    assert len(history) == 2 and T.best_epoch(history) == 1
    one, _ = T.train_with_validation(frame(spark, rows(30)), frame(spark, swapped), "text", "label", schedule, stop_after=1)
    assert np.allclose(model.weights, one.weights, atol=1e-9)


def test_predictions(spark):
    schedule = T.Schedule(epochs=5, batches=2, rate=0.2, warm_up=1, n_features=256)
    model, _ = T.train_with_validation(frame(spark, rows(60)), frame(spark, rows(20, 2)), "text", "label", schedule)
    out = T.predict_text(spark.createDataFrame([(1, "an awful film"), (2, "fun"), (3, None)], "id long, text string"), model, "text", "p", "s")
    got = {r["id"]: r for r in out.collect()}
    assert out.columns == ["id", "text", "p", "s"] and got[1]["p"] == "bad" and got[2]["p"] == "good" and 0 < got[3]["s"] < 1
    with pytest.raises(ValueError):
        T.train_with_validation(frame(spark, []), frame(spark, rows(3)), "text", "label", schedule)
    assert T.train_with_validation(frame(spark, rows(9)), frame(spark, []), "text", "label", schedule, stop_after=1)[1][0]["validation_rows"] == 0


def test_rates():
    s = T.Schedule(epochs=2, batches=5, rate=1.0, warm_up=2)
    assert [round(s.rate_at(k), 3) for k in range(10)] == [0.5, 1.0, 1.0, 0.875, 0.75, 0.625, 0.5, 0.375, 0.25, 0.125]
