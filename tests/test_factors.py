"""Pairwise factors: gradients, draws, independence of partitions, and what they are for."""

import random

import numpy as np
import pytest

from talentweave.operators import evaluation, factors, scoring
from talentweave.operators.dense import dense_rankings


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(2)
    rows = [rng.normal(size=(3, 4)) for _ in range(3)]
    slopes = factors.gradients(*rows, 0.1)[1:]

    def value(parts):
        return factors.gradients(*parts, 0.1)[0].sum() + 0.05 * sum((p * p).sum() for p in parts)

    for k in range(3):
        for at in np.ndindex(3, 4):
            up, down = ([p.copy() for p in rows] for _ in range(2))
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert slopes[k][at] == pytest.approx((value(up) - value(down)) / 2e-6, abs=1e-5)


def test_free_jobs():
    assert factors.free_job(3, {3, 4, 0}, 5) == 1
    assert factors.free_job(2, set(), 5) == 2
    assert factors.free_job(0, {0, 1}, 2) == -1


@pytest.fixture(scope="module")
def tastes(spark):
    """Five groups of people who take jobs of their own group, and one popular job in each other group."""
    rng = random.Random(4)
    train, test = set(), set()
    for user in range(60):
        own = [j for j in range(50) if j % 5 == user % 5]
        picked = rng.sample(own, 5)
        train |= {(user, j) for j in picked[:4]} | {(user, rng.choice([0, 1, 2]))}
        test.add((user, picked[4]))
    test -= train
    frame = lambda rows: spark.createDataFrame(sorted(rows), "user_id long, job_id long")
    return frame(train), frame(test)


def test_one_result_whatever_the_partitions(spark, tastes):
    train, _ = tastes
    users, jobs = train.select("user_id").distinct(), spark.range(50).withColumnRenamed("id", "job_id")
    found = []
    for n in (1, 5):
        got = factors.pairwise_factors(train.repartition(n), users.repartition(n), jobs.repartition(n), dim=4, epochs=1, blocks=2)
        found.append({(side, r.id): tuple(r.vector) for side in ("users", "jobs") for r in getattr(got, side).collect()})
    assert found[0] == found[1] and len(found[0]) == 110


def test_better_than_popularity(spark, tastes):
    train, test = tastes
    users, jobs = train.select("user_id").distinct(), spark.range(50).withColumnRenamed("id", "job_id")
    got = factors.pairwise_factors(train, users, jobs, dim=8, epochs=12, blocks=2, rate=0.3)
    assert got.losses[-1] < 0.6 * got.losses[0]
    learned = dense_rankings(got.users, got.jobs, 10, train)
    popular = scoring.popularity_rankings(users, jobs, train, train, 10)
    ndcg = [evaluation.evaluate_v2(r, test).first()["ndcg@10"] for r in (learned, popular)]
    assert ndcg[0] > 1.5 * ndcg[1]
