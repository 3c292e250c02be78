"""Negative sampling invariants, including a user that owns most rows."""

import pytest
from pyspark.sql import functions as F

from talentweave.operators import negatives


@pytest.fixture(scope="module")
def data(spark):
    jobs = spark.createDataFrame([(j, f"t{j % 3}", f"c{j % 2}") for j in range(40)], "job_id long, job_type string, city string")
    rows = [(0, j) for j in range(0, 36)] + [(u, (u * 5) % 40) for u in range(1, 12)]
    train = spark.createDataFrame(rows, "user_id long, job_id long")
    known = train.union(spark.createDataFrame([(1, 39), (2, 38)], "user_id long, job_id long"))
    return jobs, train, known


def overlap(sampled, known):
    return sampled.select("user_id", "negative_id").join(known.toDF("user_id", "negative_id"), ["user_id", "negative_id"]).count()


def test_uniform_negatives_are_complete_and_unknown(data):
    jobs, train, known = data
    got = negatives.uniform_negatives(train, jobs, known, 3, 11).cache()
    assert got.count() == 3 * train.count()
    assert got.groupBy("user_id", "job_id", "draw").count().where("count > 1").count() == 0
    assert overlap(got, known) == 0
    # the hot user has four free jobs only and reuses them
    assert got.where("user_id = 0").select("negative_id").distinct().count() == 4
    again = negatives.uniform_negatives(train.repartition(7), jobs, known, 3, 11)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in again.collect()}
    other = negatives.uniform_negatives(train, jobs, known, 3, 12)
    assert {tuple(r) for r in got.collect()} != {tuple(r) for r in other.collect()}


def test_pool_returns_all_when_few_are_left(data):
    jobs, train, known = data
    users = train.select("user_id").distinct()
    got = negatives.sampled_pool(users, jobs, known, 10, 3)
    counts = {r["user_id"]: r["count"] for r in got.groupBy("user_id").count().collect()}
    assert counts.pop(0) == 4 and set(counts.values()) == {10}


def test_structural_negatives_share_the_bucket(data):
    jobs, train, known = data
    got = negatives.structural_negatives(train, jobs, known, 5)
    assert got.count() > 0
    a, b = jobs.toDF("job_id", "t1", "c1"), jobs.toDF("negative_id", "t2", "c2")
    assert got.join(a, "job_id").join(b, "negative_id").where("t1 <> t2 or c1 <> c2 or job_id = negative_id").count() == 0
    assert overlap(got, known) == 0


def test_structural_negatives_answer_every_pair(spark):
    jobs = spark.createDataFrame([(i, "t" if i < 40 else "u", "c") for i in range(41)], "job_id int, job_type string, city string")
    known = spark.createDataFrame([(1, i) for i in range(39)] + [(2, 40)], "user_id int, job_id int")
    got = {(r["user_id"], r["job_id"]): r["negative_id"] for r in negatives.structural_negatives(known, jobs, known, 3).collect()}
    # all but one job of the bucket are known; the other user knows its whole bucket
    assert got == {**{(1, i): 39 for i in range(39)}, (2, 40): None}


def test_semantic_and_mixed(spark, data):
    jobs, train, known = data
    job_vectors = jobs.select(F.col("job_id").alias("id"), F.array(F.cos("job_id"), F.sin("job_id")).alias("vector"))
    user_vectors = train.select("user_id").distinct().select(F.col("user_id").alias("id"), F.array(F.cos("user_id"), F.sin("user_id")).alias("vector"))
    semantic = negatives.semantic_negatives(user_vectors, job_vectors, known, 5)
    assert semantic.join(known, ["user_id", "job_id"]).count() == 0
    assert {r["user_id"]: r["count"] for r in semantic.groupBy("user_id").count().collect()}[0] == 4
    uniform = negatives.uniform_negatives(train, jobs, known, 4, 1)
    structural = negatives.structural_negatives(train, jobs, known, 1)
    before = negatives.mixed_negatives(train, uniform, semantic, structural, 0, 3, 1)
    assert [r["source"] for r in before.select("source").distinct().collect()] == ["uniform"]
    after = negatives.mixed_negatives(train, uniform, semantic, structural, 4, 3, 1)
    assert after.count() == uniform.count() and after.select("source").distinct().count() == 3
    assert overlap(after, known) == 0
