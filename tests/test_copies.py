import random

import pytest
from pyspark.sql import functions as F

from hirelens import config
from hirelens.operators.copies import expand_copies, join_copies, join_matches, with_copies
from tests.conftest import bag


def test_copies_round_trip(spark, monkeypatch):
    monkeypatch.setattr(config, "COPIES_PER_ROW", 2)
    df = spark.createDataFrame([(1, "a")] * 7 + [(2, None)] * 3 + [(3, "c")], "k long, v string")
    assert bag(expand_copies(with_copies(df))) == bag(df)
    assert expand_copies(df) is df


@pytest.mark.parametrize("seed", [1, 2])
def test_join_matches_equals_left_join(spark, seed):
    pick = random.Random(seed)
    keys = [None, 1, 1, 1, 1, 2, 2, 3, 4, 5]
    left = spark.createDataFrame([(pick.choice(keys), i) for i in range(60)], "k long, l int")
    right = spark.createDataFrame([(pick.choice(keys), i % 3) for i in range(40)], "k long, r int")
    assert bag(expand_copies(join_matches(left, right, ["k"]))) == bag(left.join(right, "k", "left"))


def test_copies_of_both_sides_multiply(spark):
    left = spark.createDataFrame([(1, 2), (2, 3)], "k long, copies long")
    right = spark.createDataFrame([(1, 5)], "k long, copies long")
    assert bag(join_copies(left, right, ["k"])) == [(1, 10), (2, 3)]
    assert bag(join_copies(left, right, ["k"], "inner")) == [(1, 10)]
    assert bag(join_copies(left, spark.createDataFrame([(1,)], "k long"), ["k"])) == [
        (1, 2), (2, 3),
    ]


def test_only_pieces_beyond_the_first_are_moved(spark, monkeypatch):
    monkeypatch.setattr(config, "COPIES_PER_ROW", 10)
    df = spark.range(0, 90, 1, 3).select("id", F.expr("if(id = 5, 25L, 3L)").alias("copies"))
    df = df.withColumn("was", F.spark_partition_id())
    rows = expand_copies(df).withColumn("task", F.spark_partition_id()).collect()
    assert len(rows) == 89 * 3 + 25
    moved = [r for r in rows if r.task >= 3]
    assert all(r.task == r.was for r in rows if r.task < 3)
    assert len(moved) == 15 and {r.id for r in moved} == {5}
