"""Leave-last-out and time splits, and row numbering."""

import pytest
from pyspark.sql import functions as F

from talentweave.operators import interactions, ordering


def rows(spark, data):
    return spark.createDataFrame(data, "user_id string, job_id string, level int, row_index long")


def split_of(df):
    return {r["row_index"]: r["split"] for r in df.collect()}


def test_one_two_and_three_positives(spark):
    data = [("a", "j1", 2, 0), ("b", "j1", 2, 1), ("b", "j2", 3, 2), ("c", "j1", 2, 3), ("c", "j2", 2, 4), ("c", "j3", 2, 5), ("c", "j4", 1, 6)]
    got = split_of(interactions.leave_last_out(rows(spark, data)))
    assert got == {0: "train", 1: "train", 2: "test", 3: "train", 4: "valid", 5: "test", 6: "train"}


def test_browsed_rows_count_in_the_first_generation(spark):
    data = [("a", "j1", 1, 0), ("a", "j2", 1, 1)]
    assert split_of(interactions.leave_last_out(rows(spark, data), 1)) == {0: "train", 1: "test"}
    assert split_of(interactions.leave_last_out(rows(spark, data), 2)) == {0: "train", 1: "train"}


def test_repeated_pair_can_be_in_train_and_test(spark):
    data = [("a", "j1", 2, 0), ("a", "j2", 2, 1), ("a", "j1", 3, 2)]
    split = interactions.leave_last_out(rows(spark, data))
    assert [tuple(r) for r in interactions.split_overlap(split).collect()] == [("a", "j1")]


def test_each_user_has_one_test_row_at_most(spark):
    data = [(f"u{i % 7}", f"j{i % 5}", i % 4, i) for i in range(300)]
    split = interactions.leave_last_out(rows(spark, data))
    assert split.count() == 300
    assert split.where("split = 'test'").groupBy("user_id").count().where("count > 1").count() == 0


def test_time_split_truncates(spark):
    df = spark.createDataFrame([(i, 100 - i) for i in range(17)], "id long, ts long")
    got = interactions.time_split(df, "ts", "id").groupBy("split").count()
    # 17 rows: test from int(17 * 0.8) = 13, valid from int(13 * 0.9) = 11
    assert {r["split"]: r["count"] for r in got.collect()} == {"train": 11, "valid": 2, "test": 4}


def test_empty_time_split(spark):
    df = spark.createDataFrame([], "id long, ts long")
    assert interactions.time_split(df, "ts", "id").count() == 0


def test_global_position_is_dense_and_ordered(spark):
    df = spark.range(1000).select(F.xxhash64("id").alias("k"), "id").repartition(7)
    got = sorted((r["position"], r["k"]) for r in ordering.global_position(df, ["k", "id"]).collect())
    assert [p for p, _ in got] == list(range(1000)) and [k for _, k in got] == sorted(k for _, k in got)


def test_position_in_group_with_a_hot_group(spark):
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("g"), "id")
    got = ordering.position_in_group(df, ["g"], ["id"])
    assert got.groupBy("g").agg(F.max("position").alias("m"), F.count("*").alias("n")).where("m <> n - 1").count() == 0


def test_exploded_range_crosses_chunks(spark):
    df = spark.createDataFrame([("a", 25), ("b", 3), ("c", 0)], "k string, n long")
    got = ordering.exploded_range(df, F.col("n"), "i", chunk=4).groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("i").alias("d"), F.max("i").alias("m"))
    assert {tuple(r) for r in got.collect()} == {("a", 25, 25, 24), ("b", 3, 3, 2)}


@pytest.mark.parametrize(("last", "expected"), [(False, "x"), (True, "z")])
def test_first_and_last_occurrence(spark, last, expected):
    df = spark.createDataFrame([("k", "y", 2), ("k", "x", 1), ("k", "z", 3)], "k string, v string, row_index long")
    assert ordering.first_occurrence(df, ["k"], "row_index", last).first()["v"] == expected


def test_systematic_sample(spark):
    got = sorted(r["id"] for r in ordering.systematic_sample(spark.range(10), "id", 4).collect())
    assert got == [0, 2, 4, 6, 8]
