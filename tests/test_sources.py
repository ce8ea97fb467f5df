import json

import pytest
from pyspark.sql import functions as F

from opinionmill.operators.vocabulary import build_vocabulary
from opinionmill.plans import opinions, workflows
from opinionmill.sources import readers, writers


def write(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def test_raw_reviews(spark, tmp_path):
    path = write(tmp_path / "raw.csv", ',stars,review_text\n7,1,"a ""quoted"",\nline"\n8,2,\n9,3,No content\n')
    df = readers.read_raw_reviews(spark, path)
    assert df.columns == ["row_id", "review_text"]
    assert [r["review_text"] for r in df.orderBy("row_id").collect()] == ['a "quoted",\nline', None, "No content"]
    with pytest.raises(ValueError, match="review"):
        readers.read_reviews(spark, path)
    with pytest.raises(FileNotFoundError):
        readers.read_raw_reviews(spark, str(tmp_path / "none.csv"))


def test_encoding_and_missing_reviews(spark, tmp_path):
    path = write(tmp_path / "reviews.csv", "id,review\n3,café\n4,\n", "latin-1")
    df = readers.read_reviews(spark, path, id_col="id", encoding="ISO-8859-1")
    assert {tuple(r) for r in df.collect()} == {("3", "café"), ("4", "")}


HEADER = "Review ID,Full review,Component sentence,Aspect Category,Aspect Terms,Opinion Terms,Polarity Sentiment\n"


def annotated_csv(tmp_path, n=20):
    rows = [
        f"REV{i}-{j},review {i},part {j} of {i},Story,{'NULL' if j else 'plot'},slow,negative\n"
        for i in range(n) for j in range(2)
    ]
    return write(tmp_path / "annotated.csv", HEADER + "".join(rows))


def test_annotated(spark, tmp_path):
    df = readers.read_annotated(spark, annotated_csv(tmp_path, 2))
    rows = df.orderBy("pos").collect()
    assert [r["Aspect Terms"] for r in rows] == ["plot", None, "plot", None]
    assert len(df.columns) == 8


def test_quad_lines(spark, tmp_path):
    path = write(
        tmp_path / "quads.txt",
        'I like it####[["it", "Movie", "positive", "like"]]\n'
        "He said 'no', bad####"
        '[["a, b", "Acting", "negative", "bad"], ["NULL", "Story", "neutral", "said"]]\n'
        "no labels here\n"
        'broken####[["it", "Mov\n'
        "none####[]\n",
    )
    rows = [tuple(r) for r in readers.read_quad_lines(spark, path).orderBy("sentence", "pos").collect()]
    assert [r[1:] for r in rows] == [
        ("He said 'no', bad", 0, "a, b", "Acting", "negative", "bad", False),
        ("He said 'no', bad", 1, "NULL", "Story", "neutral", "said", False),
        ("I like it", 0, "it", "Movie", "positive", "like", False),
        ("broken", None, None, None, None, None, True),
        ("no labels here", None, None, None, None, None, True),
        ("none", None, None, None, None, None, False),
    ]
    assert len({r[0] for r in rows}) == 5


def test_split_files(spark, tmp_path):
    target = str(tmp_path / "splits")
    counts = workflows.split_file(spark, annotated_csv(tmp_path), target)
    assert {r["split"]: r["rows"] for r in counts.collect()} == {"train": 32, "validation": 4, "test": 4}
    test = readers.read_split(spark, target, "test")
    assert test.count() == 4
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_clean_file(spark, tmp_path):
    source = write(tmp_path / "raw.csv", ",review_text\n0,The film is the best !\n1,the film is the best!\n2,The film is the best!\n")
    workflows.clean_file(spark, source, str(tmp_path / "clean"))
    got = spark.read.option("header", True).csv(str(tmp_path / "clean"))
    assert got.columns == ["review_text"]
    assert sorted(r[0] for r in got.collect()) == ["The film is the best!", "the film is the best!"]


def test_token_tables_are_kept_per_model(spark, tmp_path):
    splits, cache = str(tmp_path / "splits"), str(tmp_path / "cache")
    workflows.split_file(spark, annotated_csv(tmp_path), splits)
    t5 = workflows.token_tables(spark, splits, cache, "component", "t5")
    bart = workflows.token_tables(spark, splits, cache, "component", "bart")
    assert t5.count() == bart.count() == 20
    row = t5.where("row_id = 'REV3'").first()
    assert len(row["input_ids"]) == len(row["attention_mask"]) == len(row["labels"]) == 512
    assert row["target_text"] == "part 0 of 3 ; part 1 of 3"
    assert row["input_text"] == "Extract component sentences: review 3"
    assert bart.where("row_id = 'REV3'").first()["input_text"] == "review 3"
    quads = workflows.token_tables(spark, splits, cache, "quad", "t5")
    assert quads.count() == 40 and len(quads.first()["input_ids"]) == 128

    def fail():
        raise AssertionError("must be read from the cache")

    readers.read_or_build(spark, cache, "other", "t5", lambda: t5, 1)
    assert readers.read_or_build(spark, cache, "other", "t5", fail, 1).count() == 20
    with pytest.raises(AssertionError):
        readers.read_or_build(spark, cache, "other", "t5", fail, 2)
    small = workflows.token_tables(spark, splits, cache, "component", "t5", vocab_size=3)
    assert small.select(F.max(F.array_max("input_ids"))).first()[0] <= 4
    with pytest.raises(ValueError):
        workflows.pairs_of("other", t5, "t5")


def echo():
    return lambda texts: [t.removeprefix("Extract component sentences: ") for t in texts]


def constant_quad():
    return lambda texts: ["['aspect: Story, aspect term: plot, opinion term: slow, sentiment: negative']" for _ in texts]


def test_evaluation_files(spark, tmp_path):
    pairs = spark.createDataFrame(
        [("r1", "Extract component sentences: a b ; c", "a b ; c"), ("r2", "Extract component sentences: x ; y", "x ; z")],
        "row_id string, input_text string, target_text string",
    )
    target = str(tmp_path / "component")
    workflows.evaluate_components(spark, pairs, echo, target)
    scores = {r["metric"]: r["value"] for r in spark.read.json(f"{target}/scores").collect()}
    assert scores["rouge1"] == pytest.approx((1 + 0.5) / 2)
    sentence = {r["metric"]: r["value"] for r in spark.read.json(f"{target}/sentence_scores").collect()}
    assert sentence["mean_precision"] == pytest.approx(0.75)
    stored = readers.read_predictions(spark, f"{target}/predictions", "parquet").orderBy("row_id").collect()
    assert [tuple(r) for r in stored][1] == ("r2", "Extract component sentences: x ; y", "x ; z", "x ; y")

    quads = spark.createDataFrame(
        [("1", "t", "aspect: Story, aspect term: None, opinion term: slow, sentiment: negative")],
        "row_id string, input_text string, target_text string",
    )
    target = str(tmp_path / "quad")
    workflows.evaluate_quads(spark, quads, constant_quad, target)
    scores = {r["metric"]: r["value"] for r in spark.read.json(f"{target}/scores").collect()}
    assert scores == {"aspect_f1": 1.0, "aspect_term_f1": 0.0, "opinion_term_f1": 1.0, "sentiment_f1": 1.0}
    report = spark.read.json(f"{target}/class_report").where("field = 'aspect' and label = 'Story'").first()
    assert report["f1"] == 1.0 and report["support"] == 1


def test_opinions_file(spark, tmp_path):
    source = write(tmp_path / "reviews.csv", 'id,review\n1,"The plot was slow. Fine"\n2,\n')
    lexicon = spark.createDataFrame([("aspect", "plot", "Story", 1), ("opinion", "slow", "negative", 1)],
                                    "kind string, phrase string, label string, support long")
    target = str(tmp_path / "opinions")
    workflows.opinions_file(spark, source, target, opinions.segmenter(), opinions.lexicon_backend(lexicon))
    rows = spark.read.option("header", True).csv(target).orderBy("pos").collect()
    assert [tuple(r)[3:] for r in rows] == [
        ("The plot was slow", "Story", "plot", "slow", "negative"), ("Fine", "Movie", "NULL", "NULL", "neutral"),
    ]
    with pytest.raises(ValueError):
        writers.write_table(spark.range(1), target, "xml")


def test_metrics_file_is_json(spark, tmp_path):
    target = tmp_path / "m"
    writers.write_metrics(spark.createDataFrame([("f1", 0.5)], "metric string, value double"), str(target))
    lines = [json.loads(x) for p in target.glob("*.json") for x in p.read_text().splitlines()]
    assert lines == [{"metric": "f1", "value": 0.5}]


def test_vocabulary_from_several_columns(spark):
    df = spark.createDataFrame([("a a", "b"), (None, "a")], "x string, y string")
    assert {r["token"]: r["n"] for r in build_vocabulary(df, "x", "y").collect()} == {"a": 3, "b": 1}
    assert df.select(F.col("x")).count() == 2
