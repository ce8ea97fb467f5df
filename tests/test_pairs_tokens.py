import pytest
from pyspark.sql import functions as F

from opinionmill.functions import components as C
from opinionmill.functions.tokens import attention_mask, mask_labels, pad_to, words_and_marks
from opinionmill.operators import pairs as P
from opinionmill.operators import vocabulary as V
from opinionmill.operators.backends import explode_components

ANNOTATED = "`Review ID` string, `Full review` string, `Component sentence` string, pos long"


def test_components_in_order_from_shuffled_rows(spark):
    rows = [("REV1-1", "old", "b", 11), ("REV1-0", "older", "a", 10), ("REV1-2", "last", None, 12), ("REV2-0", None, "z", 5)]
    df = spark.createDataFrame(rows, ANNOTATED).repartition(3)
    t5 = {r["review_key"]: (r["input_text"], r["target_text"]) for r in P.component_pairs(df, "t5").collect()}
    assert t5 == {
        "REV1": ("Extract component sentences: last", "a ; b ; None"),
        "REV2": ("Extract component sentences: None", "z"),
    }
    bart = {r["review_key"]: r["input_text"] for r in P.component_pairs(df, "bart").collect()}
    assert bart == {"REV1": "last", "REV2": "None"}


def test_a_large_review_is_joined_in_runs(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "REV0-x").otherwise(F.concat(F.lit("REV"), F.col("id"), F.lit("-x"))).alias("Review ID"),
        F.concat(F.lit("r"), F.col("id")).alias("Full review"),
        F.concat(F.lit("c"), F.col("id")).alias("Component sentence"),
        F.col("id").alias("pos"),
    ).orderBy(F.rand(1))
    grouped = P.collect_components(df, C.review_key(F.col("`Review ID`")), run_length=64)
    hot = grouped.where("review_key = 'REV0'").first()
    ids = [i for i in range(5000) if i % 3 == 0]
    assert hot["components"] == " ; ".join(f"c{i}" for i in ids)
    assert hot["review"] == f"r{ids[-1]}"
    assert grouped.count() == 5000 - len(ids) + 1


def test_quad_pairs(spark):
    df = spark.createDataFrame(
        [(7, "s", "Story", None, "", "negative")],
        "pos long, `Component sentence` string, `Aspect Category` string, `Aspect Terms` string, "
        "`Opinion Terms` string, `Polarity Sentiment` string",
    )
    row = P.quad_pairs(df, "T5", keep=("pos",)).first()
    assert tuple(row) == (
        7,
        "Extract aspect, aspect term, sentiment, and opinion term from: s",
        "aspect: Story, aspect term: None, opinion term: None, sentiment: negative",
    )
    assert P.quad_pairs(df, "bart").first()["input_text"] == "s"
    with pytest.raises(ValueError):
        P.quad_pairs(df.drop("Aspect Terms"), "t5")


def test_arrays(spark):
    df = spark.createDataFrame([([5, 6, 7],), ([],), ([1, 2, 3, 4, 5, 6],)], "ids array<int>")
    ids = F.col("ids")
    rows = df.select(pad_to(ids, 5, 0), attention_mask(ids, 5), mask_labels(pad_to(ids, 5, 0), 0)).collect()
    assert [list(r) for r in rows] == [
        [[5, 6, 7, 0, 0], [1, 1, 1, 0, 0], [5, 6, 7, -100, -100]],
        [[0] * 5, [0] * 5, [-100] * 5],
        [[1, 2, 3, 4, 5], [1] * 5, [1, 2, 3, 4, 5]],
    ]


def test_vocabulary_and_both_encodings(spark):
    df = spark.createDataFrame(
        [(1, "b a, b é"), (2, "a b zz"), (3, ""), (4, None)], "id long, text string"
    )
    vocabulary = V.build_vocabulary(df, "text", vocab_size=4)
    ids = {r["token"]: r["token_id"] for r in vocabulary.collect()}
    assert ids == {"b": 2, "a": 3, ",": 4, "zz": 5}
    expected = {1: [2, 3, 4, 2, 1], 2: [3, 2, 5], 3: [], 4: []}
    inline = V.encode(df, "text", vocabulary)
    joined = V.encode(df, "text", vocabulary, method="join")
    assert {r["id"]: r["ids"] for r in inline.collect()} == expected
    assert {r["id"]: r["ids"] for r in joined.collect()} == expected
    with pytest.raises(ValueError, match="unknown method"):
        V.encode(df, "text", vocabulary, method="guess")
    odd = spark.createDataFrame([(None, "a b"), (1, "b"), (1, "a"), (1, "a")], "id long, text string")
    both = [sorted(map(str, V.encode(odd, "text", vocabulary, method=m).collect())) for m in ("in_row", "join")]
    assert both[0] == both[1] and len(both[0]) == 4


def test_encode_pairs(spark):
    pairs = spark.createDataFrame([(1, "a b c", "b")], "id long, input_text string, target_text string")
    vocabulary = V.build_vocabulary(pairs, "input_text", "target_text")
    row = V.encode_pairs(pairs, vocabulary, 4, 2).first()
    assert (row["input_ids"], row["attention_mask"], row["labels"]) == ([3, 2, 4, 0], [1, 1, 1, 0], [2, -100])


def test_words_and_marks(spark):
    df = spark.createDataFrame([("It's 4_k, déjà!!",)], "t string")
    assert df.select(words_and_marks(F.col("t"))).first()[0] == ["It", "'", "s", "4_k", ",", "déjà", "!", "!"]


def test_components(spark):
    df = spark.createDataFrame(
        [(1, "The acting was great but the plot was too slow."), (2, " ;; "), (3, "a ; b;c "), (4, "Button, and while x. Y")],
        "id long, t string",
    )
    segments = {r["id"]: r["c"] for r in df.select("id", C.segment_review(F.col("t")).alias("c")).collect()}
    assert segments == {
        1: ["The acting was great", "the plot was too slow"], 2: [], 3: ["a", "b", "c"], 4: ["Button", "x", "Y"],
    }
    rows = explode_components(df.select("id", C.split_components(F.col("t")).alias("components")))
    assert [tuple(r) for r in rows.where("id = 3").orderBy("pos").collect()] == [(3, 0, "a"), (3, 1, "b"), (3, 2, "c")]
    assert rows.where("id = 2").count() == 0
    keys = spark.createDataFrame([("REV1-2-3",), ("abc",)], "t string")
    assert [r[0] for r in keys.select(C.key_before_dash(F.col("t"))).collect()] == ["REV1", "abc"]
