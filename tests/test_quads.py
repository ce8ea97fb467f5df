from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opinionmill.functions import quads as Q
from opinionmill.functions.prompts import (
    component_prompt,
    component_training_input,
    quad_prompt,
    quad_training_input,
    serialise_quad,
)

FULL = "aspect: Acting, aspect term: acting, opinion term: superb, sentiment: Positive"
NONE = (None,) * 4
CASES = [
    (FULL, ("Acting", "acting", "superb", "Positive"), ("Acting", "acting", "superb", "Positive")),
    ("aspect: Acting, aspect term: a, b, opinion term: x, sentiment: Negative",
     ("Acting", "a", "x", "Negative"), ("Acting", "a", "x", "Negative")),
    (FULL + "!", ("Acting", "acting", "superb", "Positive!"), ("Acting", "acting", "superb", "Positive")),
    ("aspect: A aspect term: t, opinion term: o, sentiment: S",
     ("A aspect term: t", "t", "o", "S"), ("A aspect term: t", "t", "o", "S")),
    ("aspect: A, aspect term: t, opinion term: o", NONE, None),
    ("aspect: A, aspect term: t, opinion term: o sentiment: S", ("A", "t", "o sentiment: S", "S"), None),
    ("aspect:, aspect term:, opinion term:, sentiment: !", ("", "", "", "!"), None),
    ("aspect: A,\naspect term:\n t,opinion term: o, sentiment: S sentiment: T",
     ("A", "t", "o", "S"), ("A", "t", "o", "S")),
    ("", NONE, None),
    (None, NONE, None),
]


def parse(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [
        None if r["q"] is None else tuple(r["q"][f] for f in Q.FIELDS)
        for r in df.select("i", fn(F.col("t")).alias("q")).orderBy("i").collect()
    ]


def test_lenient_and_strict(spark):
    texts = [c[0] for c in CASES]
    assert parse(spark, Q.parse_lenient, texts) == [c[1] for c in CASES]
    assert parse(spark, Q.parse_strict, texts) == [c[2] for c in CASES]


def test_safe_keeps_commas(spark):
    text = "aspect: Acting, aspect term: Jason, Dwayne, opinion term: more, much more, sentiment: positive"
    assert parse(spark, Q.parse_safe, [text, FULL, "", None]) == [
        ("Acting", "Jason, Dwayne", "more, much more", "positive"), ("Acting", "acting", "superb", "Positive"), NONE, NONE,
    ]


WORD = st.text("abcXYZ é'!", min_size=1, max_size=8).map(str.strip).filter(bool)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(WORD, WORD, WORD, st.sampled_from(["positive", "negative"])), min_size=20, max_size=40))
def test_parse_undoes_serialise(spark, rows):
    df = spark.createDataFrame(rows, "a string, t string, o string, s string")
    text = serialise_quad(*[F.col(c) for c in "atos"])
    for parser in (Q.parse_lenient, Q.parse_safe, Q.parse_strict):
        out = df.select("*", parser(text).alias("q")).collect()
        assert [tuple(r["q"]) for r in out] == [tuple(r[c] for c in "atos") for r in out]


def test_serialise_missing(spark):
    df = spark.createDataFrame([("Story", None, "", "negative")], "a string, t string, o string, s string")
    assert df.select(serialise_quad(*[F.col(c) for c in "atos"])).first()[0] == (
        "aspect: Story, aspect term: None, opinion term: None, sentiment: negative"
    )


def test_strip_wrappers(spark):
    df = spark.createDataFrame([(["['x']", "y"],), (['"a" ]'],), ([],), (None,)], "p array<string>")
    assert [r[0] for r in df.select(Q.strip_wrappers(F.col("p"))).collect()] == ["x", 'a" ', None, None]


def test_prompts(spark):
    df = spark.createDataFrame([(" a\nb ",), (None,)], "t string")
    t = F.col("t")
    rows = df.select(
        component_prompt(t, "t5"), component_prompt(t, "bart"), quad_prompt(t, "t5"),
        component_training_input(t, "T5-base"), quad_training_input(t, "bart"),
    ).collect()
    assert list(rows[0]) == [
        "Extract component sentences: a b", "a b",
        "Extract aspect, aspect term, sentiment, and opinion term from: a\nb",
        "Extract component sentences:  a\nb ", " a\nb ",
    ]
    assert list(rows[1]) == [
        "Extract component sentences: ", "", None, "Extract component sentences: None", "None",
    ]
