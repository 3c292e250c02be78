"""Path attention and pair head: slopes, attention, training, missing vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentweave.operators import pathmodel
from talentweave.operators.pathmodel import Pairs, Shape

SHAPE = Shape(dim=3, rules=2, attention=4, hidden=5)


def _pairs(seed: int = 0) -> tuple[Pairs, np.ndarray]:
    """Four pairs: two shared and a gap, no skills at all, gaps only, three shared."""
    rng = np.random.default_rng(seed)
    owner = np.array([0, 0, 0, 2, 2, 3, 3, 3])
    shared = np.array([1, 0, 1, 0, 0, 1, 1, 1], bool)
    one = lambda *s: rng.normal(size=s)
    return Pairs(one(4, 3), one(4, 3), one(4, 2), one(8, 3), owner, shared), np.array([1.0, 0.0, 1.0, 0.0])


def test_slopes_equal_finite_differences():
    pairs, label = _pairs()
    theta = SHAPE.start(3) + 0.1
    slopes = pathmodel.loss_and_slopes(SHAPE, theta, pairs, label)[1]
    for at in range(SHAPE.size):
        step = np.zeros(SHAPE.size)
        step[at] = 1e-6
        up, down = (pathmodel.loss_and_slopes(SHAPE, theta + s, pairs, label)[0] for s in (step, -step))
        assert slopes[at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_score_equals_plain_loops():
    pairs, _ = _pairs(5)
    theta = SHAPE.start(1)
    m = SHAPE.unpacked(theta)
    got, weights = pathmodel.scores(SHAPE, theta, pairs), pathmodel.attention(SHAPE, theta, pairs)
    at = 0
    for i in range(4):
        own = [r for r in range(8) if pairs.owner[r] == i]
        shared, gaps = [r for r in own if pairs.shared[r]], [r for r in own if not pairs.shared[r]]
        logits = [np.tanh(np.concatenate([pairs.skills[r], pairs.user[i], pairs.job[i]]) @ m["a"] + m["a0"]) @ m["u"] for r in shared]
        alpha = np.exp(logits) / np.exp(logits).sum() if shared else []
        assert np.allclose(weights[at : at + len(shared)], alpha)
        at += len(shared)
        path = sum((w * pairs.skills[r] for w, r in zip(alpha, shared, strict=True)), np.zeros(3))
        gap = np.mean([pairs.skills[r] for r in gaps], axis=0) if gaps else np.zeros(3)
        x = np.concatenate([pairs.user[i], pairs.job[i], path, gap, pairs.rules[i]])
        head = pathmodel.gelu(x @ m["w"] + m["w0"]) @ m["v"] + m["v0"][0]
        assert got[i] == pytest.approx(pairs.user[i] @ pairs.job[i] / np.sqrt(3) + head)


def test_quasi_newton_finds_a_minimum():
    curve = np.diag([1.0, 30.0, 400.0])
    theta, values = pathmodel.quasi_newton(lambda t: (float((t - 1) @ curve @ (t - 1)), 2 * curve @ (t - 1)), np.array([5.0, -3.0, 2.0]), 60)
    assert np.allclose(theta, 1, atol=1e-3)
    assert all(b <= a for a, b in zip(values, values[1:], strict=False))


@pytest.fixture(scope="module")
def market(spark):
    """A pair is good if the user has the one skill of the job that matters, "s0"; vectors say which skill is which."""
    rng = np.random.default_rng(4)
    skills = [f"s{i}" for i in range(6)]
    users = [(u, [s for s in skills if rng.random() < 0.5], float(u % 3)) for u in range(40)] + [(99, [], 0.0)]
    jobs = [(j, ["s0", *rng.choice(skills[1:], 2, replace=False).tolist(), "unheard"]) for j in range(10)]
    vectors = [(s, rng.normal(size=3).tolist()) for s in skills]
    people = spark.createDataFrame(users, "user_id long, skills array<string>, years double")
    posts = spark.createDataFrame(jobs, "job_id long, skills array<string>")
    side = lambda n: spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(n - 1)], "id long, vector array<double>")
    labelled = [(u, j, float("s0" in own)) for u, own, _ in users for j in range(10)]
    pairs = spark.createDataFrame(labelled, "user_id long, job_id long, label double")
    rules = [F.col("years"), F.size("job_skills")]
    return pathmodel.pair_inputs(pairs, people, posts, side(40), side(10), spark.createDataFrame(vectors, "skill string, vector array<double>"), rules, 3)


def test_training_finds_what_matters(spark, market):
    shape = Shape(3, 2, 4, 8)
    model = pathmodel.train_path_model(market.repartition(3), shape, steps=25, decay=1e-4)
    assert model.losses[-1] < 0.3 * model.losses[0]
    scored = pathmodel.score_paths(model, market).join(market.select("user_id", "job_id", "label", "shared"), ["user_id", "job_id"]).collect()
    assert len(scored) == 410
    assert sum((r.score > 0) == (r.label == 1) for r in scored) > 385
    for r in scored:
        assert len(r.attention) == sum(r.shared) and (not r.attention or sum(r.attention) == pytest.approx(1))


def test_no_pairs(market):
    shape = Shape(3, 2)
    model = pathmodel.train_path_model(market.limit(0), shape, steps=2)
    assert model.theta.shape == (shape.size,)
    assert pathmodel.score_paths(model, market.limit(0)).count() == 0
