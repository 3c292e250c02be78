"""Blocks of pairs: the same scores and slopes as pair by pair, each vector once, users of many pairs dealt out."""

from math import erf, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentweave.operators import pathmodel
from talentweave.operators.pathmodel import Pairs, Shape
from talentweave.operators.relations import normal_share

def _rules():
    return [F.col("years"), F.size("job_skills")]


@pytest.fixture(scope="module")
def sides(spark):
    """Users 7 and 8 lack a vector, user 9 lacks skills and comes twice, job 5 lacks skills, "unheard" lacks a vector."""
    rng = np.random.default_rng(2)
    vector = lambda: rng.normal(size=3).tolist()
    users = [(u, [f"s{i}" for i in range(5) if (u + i) % 3], float(u)) for u in range(9)] + [(9, None, 1.0), (9, None, 1.0)]
    jobs = [(j, [f"s{j}", f"s{(j + 2) % 5}", "unheard"]) for j in range(5)] + [(5, [])]
    people = spark.createDataFrame(users, "user_id long, skills array<string>, years double")
    posts = spark.createDataFrame(jobs, "job_id long, skills array<string>")
    of_users = spark.createDataFrame([(u, vector()) for u in (0, 1, 2, 3, 4, 5, 6, 9)], "id long, vector array<double>")
    of_jobs = spark.createDataFrame([(j, vector()) for j in range(6)], "id long, vector array<double>")
    skills = spark.createDataFrame([(f"s{i}", vector()) for i in range(5)], "skill string, vector array<double>")
    pairs = spark.createDataFrame([(u, j, float((u + j) % 2)) for u in range(11) for j in range(7)], "user_id long, job_id long, label double")
    return pairs, (people, posts, of_users, of_jobs, skills)


def _blocks(sides, block_pairs: int):
    pairs, tables = sides
    return pathmodel.pair_blocks(pairs, pathmodel.path_tables(*tables, 3), _rules(), block_pairs)


def _scored(model, inputs):
    rows = pathmodel.score_paths(model, inputs).collect()
    return sorted((r.user_id, r.job_id, round(r.score, 9), [round(w, 9) for w in r.attention]) for r in rows)


@pytest.mark.parametrize("block_pairs", [4, 1000])
def test_blocks_score_as_rows_do(sides, block_pairs):
    model = pathmodel.PathModel(Shape(3, 2, 4, 5), Shape(3, 2, 4, 5).start(1) + 0.1, [])
    pairs, tables = sides
    rows = _scored(model, pathmodel.pair_inputs(pairs, *tables, _rules(), 3))
    assert len(rows) == 11 * 6
    assert _scored(model, _blocks(sides, block_pairs)) == rows


def test_blocks_train_as_rows_do(sides):
    pairs, tables = sides
    shape = Shape(3, 2, 4, 5)
    by_row = pathmodel.train_path_model(pathmodel.pair_inputs(pairs, *tables, _rules(), 3), shape, 4)
    by_block = pathmodel.train_path_model(_blocks(sides, 4), shape, 4)
    assert np.allclose(by_row.theta, by_block.theta, atol=1e-8)


def test_a_block_holds_a_vector_once(sides):
    (block,) = _blocks(sides, 1000).collect()
    assert (len(block.pairs), len(block.people), len(block.posts), len(block.skills)) == (66, 11, 6, 5)
    dealt = _blocks(sides, 4).collect()
    assert max(len(b.pairs) for b in dealt) < 30 and sum(len(b.pairs) for b in dealt) == 66


def test_shared_vectors_have_summed_slopes():
    rng = np.random.default_rng(3)
    shape, owner = Shape(3, 2, 4, 5), np.array([0, 0, 2, 3, 3, 3])
    few = Pairs(rng.normal(size=(2, 3)), rng.normal(size=(3, 3)), rng.normal(size=(4, 2)), rng.normal(size=(2, 3)), owner,
                np.array([1, 0, 1, 1, 1, 0], bool), np.array([0, 0, 1, 1]), np.array([2, 0, 2, 1]), np.array([0, 1, 1, 0, 1, 1]))
    each = Pairs(few.user[few.user_at], few.job[few.job_at], few.rules, few.skills[few.skill_at], owner, few.shared)
    label, theta = np.array([1.0, 0.0, 0.0, 1.0]), shape.start(5)
    (a, left), (b, right) = (pathmodel.loss_and_slopes(shape, theta, p, label) for p in (few, each))
    assert a == pytest.approx(b) and np.allclose(left, right)


def test_share_of_a_standard_normal():
    x = np.concatenate([np.linspace(-12, 12, 4001), [np.inf, -np.inf]])
    assert np.allclose(normal_share(x), [0.5 * (1 + erf(v / sqrt(2))) for v in x], rtol=0, atol=1e-15)
    assert np.isnan(normal_share(np.array([np.nan])))[0]
