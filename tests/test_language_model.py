"""Learned language identification."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinionmill.operators import cleaning
from opinionmill.operators import language_model as L

TRAIN = [
    ("en", "the film was good and the actors were better than that"),
    ("en", "this is the story of a thing that they thought was there"),
    ("de", "der Film war nicht schlecht und die Schauspieler sind großartig"),
    ("de", "das ist eine Geschichte über einen Mann, der nichts versteht"),
    ("ru", "это хороший фильм про любовь и дружбу"),
    ("el", "η ταινία ήταν πολύ καλή"),
    (None, "no label"),
    ("en", None),
]


def frame(spark, rows, schema="lang string, text string"):
    return spark.createDataFrame(rows, schema)


def slow_counts(rows):
    out = Counter()
    for lang, text in rows:
        words = " ".join(re.findall(r"[^\W\d_]+", (text or "").lower()))
        if lang is None or not words:
            continue
        padded = f" {words} "
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                h = n * L.STEP + sum(ord(padded[i + k]) * L.FACTORS[k] for k in range(n))
                out[lang, "ngram", h % L.BUCKETS] += 1
        for c in padded:
            if c != " ":
                out[lang, "script", L.SCRIPT_NAMES.index([name for first, name in L.SCRIPTS if ord(c) >= first][-1])] += 1
    return out


def test_counts_match_brute_force(spark):
    got = {tuple(r)[:3]: r["n"] for r in L.count_ngrams(frame(spark, TRAIN).repartition(3), "text", "lang").collect()}
    assert got == slow_counts(TRAIN)


def test_scores_match_brute_force(spark):
    model = L.train_language_model(frame(spark, TRAIN), "text", "lang")
    assert model.names == ("de", "el", "en", "ru")
    counts = slow_counts(TRAIN)
    rng = random.Random(1)
    texts = [" ".join(rng.choices(TRAIN[0][1].split() + TRAIN[2][1].split(), k=rng.randint(1, 9))) for _ in range(40)]
    got = L.identify_language(frame(spark, [(t,) for t in texts], "text string"), "text", model, "l", "lead").collect()
    for r in got:
        scores = {}
        for lang in ("de", "en"):
            total = sum(n for (x, kind, _), n in counts.items() if x == lang and kind == "ngram")
            scores[lang] = sum(
                n * round(math.log((counts[lang, "ngram", place] + 0.5) / (total + 0.5 * L.BUCKETS)) * L.SCALE)
                for (_, kind, place), n in slow_counts([("x", r["text"])]).items() if kind == "ngram"
            )
        best, second = sorted(scores.values(), reverse=True)
        assert r["lead"] == best - second
        assert r["l"] == (max(scores, key=scores.get) if best - second >= L.SCALE else "unknown")


def test_scripts_decide_first(spark):
    model = L.train_language_model(frame(spark, TRAIN), "text", "lang")
    rows = ["фильм", "ταινία", "הסרט", "the 映画 film was good", "映画映画映画 a", "", None, "12 34 !", "x" * 200_000]
    got = [tuple(r) for r in L.identify_language(frame(spark, [(t,) for t in rows], "text string"), "text", model, "l", "lead").select("l", "lead").collect()]
    assert got[:2] == [("ru", None), ("el", None)]
    assert [g[0] for g in got[2:8]] == ["unknown", "en", "unknown", "unknown", "unknown", "unknown"]
    assert got[8][0] in ("de", "en", "unknown")


def test_ties_and_margin_are_unknown(spark):
    model = L.train_language_model(frame(spark, [("a", "fgo"), ("b", "bar")]), "text", "lang")
    rows = frame(spark, [("fgo",), ("bar",), ("zzz",), ("fgo bar",)], "text string")
    assert [r["language"] for r in L.identify_language(rows, "text", model).collect()] == ["a", "b", "unknown", "unknown"]
    assert {r["language"] for r in L.identify_language(rows, "text", model, margin=1e6).collect()} == {"unknown"}


def test_model_is_kept_and_empty_tables_are_taken(spark, tmp_path):
    model = L.train_language_model(frame(spark, TRAIN), "text", "lang")
    L.save_language_model(spark, model, str(tmp_path / "m"))
    loaded = L.load_language_model(spark, str(tmp_path / "m"))
    assert loaded.names == model.names and np.array_equal(loaded.weights, model.weights) and np.array_equal(loaded.scripts, model.scripts)
    none = L.train_language_model(frame(spark, []), "text", "lang")
    assert L.identify_language(frame(spark, TRAIN), "text", none).where("language != 'unknown'").count() == 0
    out = L.identify_language(frame(spark, [("en", "the film", "old")], "lang string, text string, language string"), "text", model)
    assert out.columns == ["lang", "text", "language"] and out.first()["language"] == "en"


def test_as_a_detector_of_the_cleaner(spark):
    model = L.train_language_model(frame(spark, TRAIN), "text", "lang")
    rows = spark.createDataFrame([(1, "the actors were good"), (2, "nicht schlecht der Film")], "row_id long, review_text string")
    assert [r["row_id"] for r in cleaning.clean_reviews(rows, detector=L.detector(model)).collect()] == [1]


@pytest.mark.parametrize("parts", [1, 7])
def test_models_do_not_depend_on_partitions(spark, parts):
    df = spark.range(500).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("lang"), F.md5(F.col("id").cast("string")).alias("text")
    )
    model = L.train_language_model(df.repartition(parts), "text", "lang")
    assert int(model.weights.sum()) == int(L.train_language_model(df, "text", "lang").weights.sum())
