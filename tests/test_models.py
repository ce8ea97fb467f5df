import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from checks import queries
from opinionmill.functions.components import segment_review
from opinionmill.operators import backends as B
from opinionmill.operators import classifier, lexicon
from opinionmill.plans import opinions
from opinionmill.session import REPEATS
from opinionmill.sources import writers
from opinionmill.sources.writers import OPINION_COLUMNS

from .conftest import executed_plan

LABELLED = [
    ("part two", "Movie", "hoping", "positive"),
    ("acting", "Acting", "great", "positive"),
    ("acting", "Acting", "poor", "negative"),
    ("acting", "Movie", "poor", "negative"),
    ("plot", "Story", "too slow", "negative"),
    ("NULL", "Acting", "terrible", "negative"),
    ("Jason, Dwayne Johnson", "Acting", "slow", "neutral"),
    ("tie", "Story", "odd", "positive"),
    ("tie", "Movie", "odd", "negative"),
    (None, "Story", "x", "positive"),
]


def labelled(spark):
    return spark.createDataFrame(LABELLED, "term string, aspect string, opinion string, sentiment string")


def test_lexicon_training(spark):
    got = {(r["kind"], r["phrase"]): (r["label"], r["support"]) for r in lexicon.train_lexicon(labelled(spark)).collect()}
    assert got[("aspect", "acting")] == ("Acting", 2)
    assert got[("aspect", "dwayne johnson")] == ("Acting", 1)
    assert got[("aspect", "tie")] == ("Movie", 1)
    assert got[("opinion", "odd")] == ("negative", 1)
    assert ("aspect", "null") not in got and ("opinion", "x") in got


def test_lexicon_prediction_in_row_and_by_join(spark):
    model = lexicon.train_lexicon(labelled(spark))
    df = spark.createDataFrame(
        [(1, "The ACTING was great"), (2, "the plot was too slow"), (3, "slow, but Dwayne Johnson"), (4, "nothing"), (5, "")],
        "id long, component string",
    )
    expected = {
        1: ("Acting", "acting", "great", "positive"),
        2: ("Story", "plot", "too slow", "negative"),
        3: ("Acting", "dwayne johnson", "slow", "neutral"),
        4: ("Movie", "NULL", "NULL", "neutral"),
        5: ("Movie", "NULL", "NULL", "neutral"),
    }
    inline = lexicon.predict_with_lexicon(df, model)
    joined = lexicon.predict_with_lexicon(df, model, method="join")
    for found in (inline, joined):
        assert {r["id"]: (r["aspect"], r["aspect_term"], r["opinion_term"], r["sentiment"]) for r in found.collect()} == expected
    assert "Exchange" not in executed_plan(inline)
    with pytest.raises(ValueError, match="too large"):
        lexicon.lexicon_quad(model, in_row_phrases=2)
    with pytest.raises(ValueError, match="unknown method"):
        lexicon.predict_with_lexicon(df, model, method="guess")
    for method in ("in_row", "join"):
        empty = lexicon.predict_with_lexicon(df, model.where("false"), method=method).collect()
        assert {r["aspect_term"] for r in empty} == {"NULL"} and len(empty) == 5


def test_both_methods_agree_on_missing_and_repeated_ids(spark):
    model = lexicon.train_lexicon(labelled(spark))
    reviews = spark.createDataFrame(
        [(None, "The acting was great. The plot"), (1, "slow plot"), (1, "great acting"), (1, "great acting"), (2, None)],
        "review_id long, review string",
    )
    found = [
        sorted(map(str, opinions.review_opinions(reviews, opinions.segmenter(), opinions.lexicon_backend(model, m)).collect()))
        for m in ("in_row", "join")
    ]
    assert found[0] == found[1] and len(found[0]) == 5


def test_join_fills_every_position(spark):
    model = lexicon.train_lexicon(labelled(spark))
    texts = ["so. the acting. so. so. too slow plot. so", "so. so", "", "plot", "great. so. so. acting", None, "so. the the plot"]
    reviews = spark.createDataFrame(list(enumerate(texts)), "review_id long, review string")
    for lexicon_df in (model, model.where("false")):
        found = [
            sorted(map(str, opinions.review_opinions(reviews, opinions.segmenter(), opinions.lexicon_backend(lexicon_df, m)).collect()))
            for m in ("in_row", "join")
        ]
        assert found[0] == found[1] and len(found[0]) == 15


def test_join_takes_the_words_from_the_texts_once(spark):
    model = lexicon.train_lexicon(labelled(spark)).localCheckpoint()
    rows = spark.createDataFrame([(i, "The acting was great") for i in range(20)], "id long, component string")
    plan = lexicon.predict_with_lexicon(rows, model, method="join")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "posexplode(_words" not in plan
    reviews = rows.select(F.col("id").alias("review_id"), F.col("component").alias("review"))
    found = opinions.review_opinions(reviews, opinions.segmenter(), opinions.lexicon_backend(model, "join"))
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_join_over_several_chunks(spark, monkeypatch):
    model = lexicon.train_lexicon(labelled(spark))
    words = ["the", "acting", "was", "great", "part", "two", "so", "too", "slow", "plot", "a", "ACTING", ";"]
    rng = random.Random(4)
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(200)] + [None, "", "plot " * 300]
    monkeypatch.setattr(lexicon, "CHUNK_COMPONENTS", 7)
    monkeypatch.setattr(lexicon, "CHUNK_CHARS", 100)
    rows = spark.createDataFrame([(i % 50, t) for i, t in enumerate(texts)], "id long, component string")
    found = [sorted(map(str, lexicon.predict_with_lexicon(rows, model, method=m).collect())) for m in ("in_row", "join")]
    assert found[0] == found[1] and len(found[0]) == len(texts)
    # Marks that are nearly all set only let more through.
    monkeypatch.setattr(lexicon, "MOST_MARKS", 64)
    monkeypatch.setattr(lexicon, "SLOTS", 2)
    assert sorted(map(str, lexicon.predict_with_lexicon(rows, model, method="join").collect())) == found[0]


def test_join_keeps_nothing_per_place(spark, tmp_path):
    model = lexicon.train_lexicon(labelled(spark)).localCheckpoint()
    rows = spark.createDataFrame([(i, "great acting, great acting, great acting") for i in range(100)], "id long, component string")
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    found = lexicon.predict_with_lexicon(rows, model, method="join")
    assert {tuple(r)[2:] for r in found.collect()} == {("Acting", "acting", "great", "positive")}
    if before:
        spark.sparkContext.setCheckpointDir(before)
    tables = [spark.read.parquet(str(p)) for p in tmp_path.glob("*/table-*")]
    assert tables and max(t.count() for t in tables) == 100


def test_join_of_the_lexicon_is_over_different_phrases(spark):
    model = lexicon.train_lexicon(labelled(spark)).localCheckpoint()
    rows = spark.createDataFrame([(i, "great acting. so great") for i in range(500)], "id long, component string").coalesce(1)
    plan = lexicon.predict_with_lexicon(rows, model, method="join")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" in plan and "_heavy" not in plan


def test_terms_are_taken_before_labels_are_joined(spark, tmp_path):
    spark.createDataFrame([("d1", "lorem is alpha ab, follow", "en", "web"), ("d2", None, "fr", "web"), ("d3", "other words", "de", "web")],
                          "doc_id string, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("d1", 1, 0), ("d2", 0, 1)], "doc_id string, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = queries.labelled_documents(spark, str(tmp_path)).drop("text")
    assert sorted(map(tuple, found.collect())) == [
        ("d1", "lorem is, alpha ab", "Story", "follow", "positive"), ("d2", None, "Acting", None, "negative"),
    ]
    # The texts are not shuffled for the join, only their terms.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("regexp_extract_all")


def test_opinions_store_a_review_once(spark, tmp_path):
    rng = random.Random(1)
    texts = [". ".join(f"{rng.getrandbits(8000):x}" for _ in range(60)) for _ in range(12)]
    reviews = spark.createDataFrame(list(enumerate(texts)), "review_id long, review string").coalesce(1)
    found = opinions.review_opinions(reviews, opinions.segmenter(), opinions.lexicon_backend(lexicon.train_lexicon(labelled(spark))))
    found.write.parquet(str(tmp_path / "plain"))
    writers.write_opinions(found, str(tmp_path / "written"), "parquet")
    for name in ("plain", "written"):
        assert sum(p.stat().st_size for p in (tmp_path / name).glob("*.parquet")) < 3 * sum(map(len, texts))
        rows = spark.read.parquet(str(tmp_path / name)).groupBy("review_id").agg(F.count("*"), F.min("full_review"), F.max("full_review"))
        assert sorted(map(tuple, rows.collect())) == [(i, 60, t, t) for i, t in enumerate(texts)]


def test_long_review_after_short_ones_is_not_held_row_by_row(spark, tmp_path):
    rng = random.Random(2)
    short = [f"{rng.getrandbits(200):x}" for _ in range(30000)]
    long = ". ".join(f"{rng.getrandbits(800):x}" for _ in range(500))
    reviews = spark.createDataFrame(list(enumerate([*short, long])), "review_id long, review string").coalesce(1)
    found = opinions.review_opinions(reviews, opinions.segmenter(), opinions.lexicon_backend(lexicon.train_lexicon(labelled(spark))))
    found.write.parquet(str(tmp_path / "plain"))
    writers.write_opinions(found, str(tmp_path / "written"), "parquet")
    for name in ("plain", "written"):
        groups = [pq.ParquetFile(p).metadata for p in (tmp_path / name).glob("*.parquet")]
        assert sum(g.num_rows for g in groups) == 30500
        # Its text 500 times over takes 50 MB; a writer stops at 16 MB and a hundred rows.
        sizes = [g.row_group(i).column(2) for g in groups for i in range(g.num_row_groups)]
        assert {c.path_in_schema for c in sizes} == {"full_review"}
        assert max(c.total_uncompressed_size for c in sizes) < 40 * 2**20
        assert not any(c.is_stats_set for c in sizes)


def test_opinions_written_without_session_settings(spark, tmp_path):
    kept = {k: spark.conf.get(k, None) for k in REPEATS}
    for key in kept:
        spark.conf.unset(key)
    text = [". ".join(f"{random.Random(i).getrandbits(8000):x}" for _ in range(60)) for i in range(12)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "review_id long, full_review string").coalesce(1)
    table = rows.select("*", F.posexplode(F.array_repeat(F.lit("c"), 60)).alias("pos", "component")).select(
        "review_id", "pos", "full_review", "component", *[F.lit("x").alias(c) for c in OPINION_COLUMNS[4:]]
    )
    writers.write_opinions(table, str(tmp_path / "o"), "parquet")
    assert sum(p.stat().st_size for p in (tmp_path / "o").glob("*.parquet")) < 2 * sum(map(len, text))
    for key, value in kept.items():
        if value is not None:
            spark.conf.set(key, value)


def test_training_keeps_rows_with_one_side(spark):
    rows = [("plot", "Story", None, "neutral"), (None, "Movie", "superb", "positive"), (None, "Movie", None, "neutral")]
    df = spark.createDataFrame(rows, "term string, aspect string, opinion string, sentiment string")
    assert sorted(map(tuple, lexicon.train_lexicon(df).collect())) == [("aspect", "plot", "Story", 1), ("opinion", "superb", "positive", 1)]


def test_long_phrases_are_found(spark):
    term = "the very long ending of it"
    df = spark.createDataFrame([(term, "Story", "a bit too slow for me now", "negative")], "term string, aspect string, opinion string, sentiment string")
    model = lexicon.train_lexicon(df)
    rows = spark.createDataFrame([(f"But {term}, was a bit too slow for me now!",)], "component string")
    for method in ("in_row", "join"):
        got = lexicon.predict_with_lexicon(rows, model, method=method).first()
        assert (got["aspect"], got["aspect_term"], got["opinion_term"]) == ("Story", term, "a bit too slow for me now")


def test_backends_must_answer_every_text(spark):
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "id long, text string").coalesce(1)
    arrays = texts.groupBy().agg(F.collect_list("text").alias("texts"))
    for wrong in (lambda t: t[:-1], lambda t: ["one"], lambda t: [*t, "extra"], lambda t: []):
        for df in (
            texts.select(B.text_model(lambda w=wrong: w, 3)(F.col("text"))),
            arrays.select(B.text_array_model(lambda w=wrong: w, 3)(F.col("texts"))),
        ):
            with pytest.raises(Exception, match="answers to 3 texts"):
                df.collect()


def test_a_worker_keeps_one_model(spark):
    frame = spark.createDataFrame([(["a"],)], "texts array<string>").coalesce(1)

    def count():
        return lambda texts: [str(len(B._LOADED)) for _ in texts]

    for _ in range(3):
        assert frame.select(B.text_array_model(count)(F.col("texts")).alias("n")).first()["n"] in (["0"], ["1"])


def shout():
    sizes = []

    def run(texts):
        sizes.append(len(texts))
        assert max(sizes) <= 3
        return [f" {t.upper()} ;; {len(t)} ;" for t in texts]

    return run


def test_component_backend(spark):
    df = spark.createDataFrame([(i, f"text\n{i} ") for i in range(10)] + [(10, None)], "id long, review string")
    got = {r["id"]: r["components"] for r in B.predict_components(df, shout, batch_size=3, model_type="bart").collect()}
    assert got[4] == ["TEXT 4", "6"] and got[10] == ["0"]
    with pytest.raises(ValueError):
        B.predict_components(df, shout, text_col="nothing")


def test_quad_backend_has_one_python_step(spark):
    df = spark.createDataFrame([(1, " a ")], "id long, component string")
    found = B.predict_quads(df, shout, batch_size=3, model_type="t5")
    prompt = "Extract aspect, aspect term, sentiment, and opinion term from: a"
    assert found.first()["prediction"] == f" {prompt.upper()} ;; {len(prompt)} ;"
    assert executed_plan(found).count("ArrowEvalPython") == 1


def quad_model():
    return lambda texts: [f"aspect: A, aspect term: {t[:3]}, opinion term: o, sentiment: s" for t in texts]


def component_model():
    return lambda texts: [t.replace(".", " ; ") for t in texts]


def test_review_opinions_with_backends(spark):
    df = spark.createDataFrame([(1, "one x. two"), (2, None), (3, "")], "review_id long, review string")
    found = opinions.review_opinions(
        df, opinions.component_backend(component_model, "bart"), opinions.quad_backend(quad_model, "bart")
    )
    assert found.columns == list(OPINION_COLUMNS)
    rows = [tuple(r) for r in found.orderBy("review_id", "pos").collect()]
    assert rows == [
        (1, 0, "one x. two", "one x", "A", "one", "o", "s"),
        (1, 1, "one x. two", "two", "A", "two", "o", "s"),
    ]


def test_review_opinions_with_lexicon(spark):
    df = spark.createDataFrame([(1, "The acting was great but the plot was too slow.")], "review_id long, review string")
    found = opinions.review_opinions(
        df, opinions.segmenter(), opinions.lexicon_backend(lexicon.train_lexicon(labelled(spark)))
    )
    assert [tuple(r)[4:] for r in found.orderBy("pos").collect()] == [
        ("Acting", "acting", "great", "positive"), ("Story", "plot", "too slow", "negative"),
    ]
    plan = executed_plan(found)
    assert "Exchange" not in plan and "Python" not in plan
    # The review is split once.
    assert plan.count("although") == 1


def test_classifier(spark, tmp_path):
    rows = [("good great film", "positive"), ("great fun", "positive"), ("bad awful film", "negative"), ("awful mess", "negative")] * 5
    df = spark.createDataFrame(rows, "text string, sentiment string")
    model = classifier.train_classifier(df, "text", "sentiment", n_features=256)
    path = str(tmp_path / "model")
    classifier.save_model(model, path)
    new = spark.createDataFrame([(1, "great"), (2, "awful"), (3, None)], "id long, text string")
    for fitted in (model, classifier.load_model(path)):
        got = {r["id"]: r["predicted"] for r in classifier.predict_class(new, fitted, "text").collect()}
        assert got[1] == "positive" and got[2] == "negative" and got[3] in ("positive", "negative")


def test_segments_of_whole_texts(spark):
    text = "word " * 30000 + ". end"
    df = spark.createDataFrame([(text,)], "t string")
    pieces = df.select(segment_review(F.col("t"))).first()[0]
    assert len(pieces) == 2 and pieces[0].count("word") == 30000
