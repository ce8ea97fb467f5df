import pandas as pd
import pytest
from pyspark.sql import functions as F

from opinionmill.operators import cleaning
from opinionmill.operators.skew import salted_join

from .conftest import executed_plan


def raw(spark, rows):
    return spark.createDataFrame(rows, "row_id long, review_text string")


def test_clean_reviews(spark):
    rows = [
        (5, "The film is great !"),
        (2, "The film  is great!"),
        (1, "No content"),
        (3, None),
        (4, "Le film est pour les enfants et dans une salle."),
        (6, "   "),
        (7, "No Content of the film is what it was to be"),
        (8, "the of and is ***"),
    ]
    got = {r["row_id"]: r["review_text"] for r in cleaning.clean_reviews(raw(spark, rows)).collect()}
    assert got == {
        2: "The film is great!",
        7: "No Content of the film is what it was to be",
        8: "the of and is",
    }


def test_language(spark):
    rows = [
        (1, "this is the film that they have"),
        (2, "der Film ist nicht für mich und das"),
        (3, "el libro y los niños con una"),
        (4, ""),
        (5, "12 34"),
        (6, None),
        (7, "xyzzy"),
    ]
    got = {r["row_id"]: r["language"] for r in cleaning.detect_language(raw(spark, rows), "review_text").collect()}
    assert got == {1: "en", 2: "de", 3: "es", 4: "unknown", 5: "unknown", 6: "unknown", 7: "unknown"}


def test_language_tie_and_own_profiles(spark):
    profiles = {"a": ("foo", "both"), "b": ("bar", "both")}
    rows = [(1, "foo bar"), (2, "Foo both"), (3, "both")]
    got = cleaning.detect_language(raw(spark, rows), "review_text", "l", profiles).collect()
    assert {r["row_id"]: r["l"] for r in got} == {1: "unknown", 2: "a", 3: "unknown"}


def test_keep_first_with_other_columns_and_a_hot_text(spark):
    df = spark.range(3000).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("text"),
        (F.col("id") * 2).alias("other"),
    ).repartition(7)
    got = {r["text"]: (r["row_id"], r["other"]) for r in cleaning.keep_first(df, "text", "row_id").collect()}
    expected = {}
    for i in range(3000):
        expected.setdefault("hot" if i % 3 == 0 else f"t{i % 50}", (i, i * 2))
    assert got == expected


def test_one_exchange_and_no_python(spark):
    plan = executed_plan(cleaning.clean_reviews(raw(spark, [(1, "a")])))
    assert plan.count("Exchange") == 1
    assert "Python" not in plan
    # The cleaning chain and the language scores appear once each.
    assert plan.count("1F600") == 1
    assert plan.count("split(lower(") == 1


def test_missing_column(spark):
    with pytest.raises(ValueError, match="review_text"):
        cleaning.clean_reviews(spark.createDataFrame([(1, "a")], "row_id long, text string"))


def test_own_detector(spark):
    @F.pandas_udf("string")
    def detector(texts: pd.Series) -> pd.Series:
        return texts.str.len().astype(str)

    got = cleaning.clean_reviews(raw(spark, [(1, "abc"), (2, "abcd")]), language="4", detector=detector).collect()
    assert [tuple(r) for r in got] == [(2, "abcd")]


def test_salted_join_equals_a_join(spark):
    left = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("k"), "id"
    ).repartition(11)
    right = spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left", "left_semi"):
        salted, plain = salted_join(left, right, "k", how, 4), left.join(right, "k", how)
        assert salted.columns == plain.columns
        assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))


def test_a_hot_key_of_one_partition_lands_in_several_tasks(spark):
    left = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), "id").coalesce(1)
    right = spark.range(4000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = salted_join(left, right, "k").where("k = 0").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 1


def test_texts_are_not_sorted_by_the_duplicate_removal(spark):
    from .conftest import executed_plan

    for columns in (["text", "id"], ["text", "id", "other"]):
        df = spark.range(5).select(F.lit("a").alias("text"), "id", F.lit("x").alias("other")).select(*columns)
        plan = executed_plan(cleaning.keep_first(df, "text", "id"))
        assert "SortAggregate" not in plan
