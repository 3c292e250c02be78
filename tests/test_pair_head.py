"""The pair head over cells of vectors, against Spark ML's head over pair rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentweave.operators import pairhead, rerank
from talentweave.operators.pairhead import numbered_vectors, score_interactions, train_interaction_head, vector_cells

DIM = 3


def sides(spark, n=12, m=9):
    rng = np.random.default_rng(5)

    def table(count):
        rows = [(i, [float(x) for x in (*rng.normal(size=DIM - 1), 1.0)]) for i in range(count)]
        return spark.createDataFrame(rows, "id long, vector array<double>")

    return table(n), table(m)


def labelled(spark):
    rng = np.random.default_rng(6)
    rows = [(u, j, float(rng.random() < 0.2 + 0.5 * (u % 3 == j % 3))) for u in range(13) for j in range(9) if (u + j) % 4]
    return spark.createDataFrame(rows, "user_id long, job_id long, label double")


def expected(pairs, users, jobs, steps_of):
    """Scores of the head that Spark ML fits to rows with whole features."""
    rows = rerank.attach_vectors(pairs, users, jobs)
    rows = rows.withColumn("interaction", rerank.interaction_vector(F.col("user_vector"), F.col("job_vector")))
    model = rerank.train_pair_model(rows, [], ["interaction"])
    residual = F.aggregate(F.zip_with("user_vector", "job_vector", lambda x, y: x * y), F.lit(0.0), lambda a, v: a + v)
    return steps_of(rerank.score_pairs(model, rows, ["interaction"], residual))


def as_dict(df):
    found = [(r["user_id"], r["job_id"], r["score"]) for r in df.collect()]
    assert len({f[:2] for f in found}) == len(found)
    return {f[:2]: f[2] for f in found}


@pytest.mark.parametrize("block_rows, cell_pairs", [(8192, 1 << 20), (4, 5)])
def test_scores_are_those_of_the_row_form(spark, block_rows, cell_pairs):
    users, jobs = sides(spark)
    pairs = labelled(spark)
    u, j = numbered_vectors(users), numbered_vectors(jobs)
    cells = vector_cells(pairs, u, j, block_rows, cell_pairs)
    got = as_dict(score_interactions(train_interaction_head(cells), vector_cells(pairs.drop("label"), u, j, block_rows, cell_pairs)))
    want = expected(pairs, users, jobs, as_dict)
    assert got.keys() == want.keys()  # user 12 has no vector
    assert max(abs(got[k] - want[k]) for k in want) < 1e-4


def test_cells_hold_each_vector_once_and_every_pair(spark):
    users, jobs = sides(spark)
    cells = vector_cells(labelled(spark), numbered_vectors(users), numbered_vectors(jobs)).collect()
    assert sum(len(c["pairs"]) for c in cells) == labelled(spark).where("user_id < 12").count()
    for c in cells:
        for side in ("user", "job"):
            rows = [r["row"] for r in c[f"{side}s"]]
            assert len(rows) == len(set(rows)) and set(rows) == {p[f"{side}_row"] for p in c["pairs"]}


def test_repeated_ids_give_a_score_each(spark):
    users, jobs = sides(spark, 3, 3)
    u, j = numbered_vectors(users.union(users.where("id = 1"))), numbered_vectors(jobs)
    pairs = labelled(spark)
    head = train_interaction_head(vector_cells(pairs, u, j))
    found = score_interactions(head, vector_cells(pairs.where("user_id = 1"), u, j))
    assert found.groupBy("job_id").count().where("count = 2").count() == pairs.where("user_id = 1 and job_id < 3").count()


def test_one_label_gives_no_coefficients(spark):
    users, jobs = sides(spark)
    head = train_interaction_head(vector_cells(labelled(spark).where("label = 1"), numbered_vectors(users), numbered_vectors(jobs)))
    assert not head.coefficients.any() and head.intercept == np.inf


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    cell = pairhead.Cell(rng.normal(size=(4, DIM)), rng.normal(size=(5, DIM)), rng.integers(0, 4, 30), rng.integers(0, 5, 30))
    label = rng.integers(0, 2, 30).astype(float)
    theta = rng.normal(size=4 * DIM + 1)

    def loss(t):
        return pairhead.loss_and_slopes(cell, label, t[1:], t[0])[0]

    slopes = pairhead.loss_and_slopes(cell, label, theta[1:], theta[0])[1:]
    for at, slope in enumerate(slopes):
        step = np.zeros_like(theta)
        step[at] = 1e-6
        assert (loss(theta + step) - loss(theta - step)) / 2e-6 == pytest.approx(slope, abs=1e-5)

