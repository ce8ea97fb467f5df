import math

import pytest
from pyspark.sql import functions as F

from opinionmill.operators import splitting as S

from .conftest import executed_plan


def rows(spark, n_keys):
    """Key ``i`` has ``i % 4 + 1`` rows; key 0 has a third of all rows."""
    data = [(f"REV{i}-{j}", i) for i in range(n_keys) for j in range(i % 4 + 1)]
    data += [(f"REV0-{j}", 0) for j in range(10, 10 + len(data) // 2)]
    return S.with_review_key(spark.createDataFrame(data, "`Review ID` string, i long"))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 10, 11, 33, 240])
def test_sizes_and_no_leak(spark, n):
    got = S.assign_split(rows(spark, n)).select("review_key", "split").distinct().collect()
    assert len(got) == n, "a key is in two splits"
    held = math.ceil(0.2 * n)
    tested = math.ceil(0.5 * held)
    counts = {"train": n - held, "validation": held - tested, "test": tested}
    for split, size in counts.items():
        assert sum(r["split"] == split for r in got) == size


def test_row_order_and_partitions_do_not_matter(spark):
    df = rows(spark, 40)
    one = {tuple(r) for r in S.assign_split(df.coalesce(1)).select("review_key", "split").collect()}
    two = {tuple(r) for r in S.assign_split(df.orderBy(F.rand(3)).repartition(5)).select("review_key", "split").collect()}
    other = {tuple(r) for r in S.assign_split(df, seed=7).select("review_key", "split").collect()}
    assert one == two != other


def test_hash_mode(spark):
    got = S.assign_split(rows(spark, 2000), mode="hash").select("review_key", "split").distinct().groupBy("split").count()
    shares = {r["split"]: r["count"] / 2000 for r in got.collect()}
    assert abs(shares["train"] - 0.8) < 0.05 and abs(shares["validation"] - 0.1) < 0.03
    assert "Exchange" not in executed_plan(S.assign_split(rows(spark, 5), mode="hash"))
    with pytest.raises(ValueError):
        S.assign_split(rows(spark, 5), mode="other")


def test_rows_are_labelled_without_a_join(spark):
    plan = executed_plan(S.assign_split(rows(spark, 5)))
    outer = [line for line in plan.splitlines() if not line.lstrip().startswith(":")]
    assert not any("Exchange" in line or "Join" in line for line in outer)


def test_semi_join_equals_labels(spark):
    df = rows(spark, 30)
    labelled, keys = S.assign_split(df), S.split_keys(df)
    for split in ("train", "validation", "test"):
        direct = labelled.where(F.col("split") == split).select("Review ID").collect()
        joined = S.rows_of_split(df, keys, split).select("Review ID").collect()
        assert sorted(direct) == sorted(joined)
    assert {r["split"]: r["rows"] for r in S.split_counts(labelled).collect()} == {
        r["split"]: r["count"] for r in labelled.groupBy("split").count().collect()
    }


def test_rows_without_key_are_dropped(spark):
    ids = [("REV12-1",), ("REV12-2",), ("X-3",), (None,), ("REV-4",)]
    got = S.with_review_key(spark.createDataFrame(ids, "`Review ID` string")).collect()
    assert [r["review_key"] for r in got] == ["REV12", "REV12"]
