"""Salted joins give the rows of a plain join, whatever the skew."""

import pytest
from pyspark.sql import functions as F

from quillworks.operators.skew import key_groups, salted_join


@pytest.fixture(scope="module")
def sides(spark):
    """A third of the left rows share one key, some have none, some match nothing."""
    left = spark.range(6000).select(
        F.col("id").alias("row"),
        F.when(F.col("id") % 3 == 0, 7)
        .when(F.col("id") % 50 == 1, None)
        .otherwise(F.col("id") % 900)
        .alias("k"),
    )
    right = spark.range(800).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    return left, right.unionByName(right.filter("k % 5 = 0"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_same_rows_as_a_plain_join(sides, how):
    left, right = sides
    plain = left.join(right, "k", how)
    salted = salted_join(left, right, ["k"], how, ["row"], target_rows=5)
    assert salted.columns == plain.columns
    assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))


def test_groups_follow_the_row_count(sides):
    left, _ = sides
    counts = {r.k: r["count"] for r in left.dropna().groupBy("k").count().collect()}
    listed = {r.k: r.groups for r in key_groups(left.dropna(), ["k"], target_rows=5).collect()}
    assert listed == {k: -(-n // 5) for k, n in counts.items() if n > 5}
    # A third of the rows under one key, and keys below a thousandth of the rows: both are listed.
    assert listed[7] > 300 and any(counts[k] * 1000 <= left.count() + 2000 for k in listed)
    assert key_groups(left, ["k"]).collect() == []


def test_no_task_holds_more_than_its_share(sides):
    left, right = sides
    target = 50
    groups = key_groups(left.select("k").dropna(), ["k"], target)
    salt = F.pmod(F.xxhash64("row"), F.coalesce("groups", F.lit(1)))
    largest = left.dropna().join(groups, "k", "left").groupBy("k", salt).count().agg(F.max("count"))
    assert largest.first()[0] <= 2 * target
    assert salted_join(left, right, ["k"], "left", ["row"], target).count() == left.join(right, "k", "left").count()


def test_other_joins_are_refused(sides):
    with pytest.raises(ValueError):
        salted_join(*sides, ["k"], "full", ["row"])
