"""Approximate neighbours against the exact answer: recall, hot lists in slices, exclusions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentweave.operators import neighbours
from talentweave.operators.dense import dense_rankings

SETTINGS = {"lists": 12}


@pytest.fixture(scope="module")
def crowd(spark):
    """1,500 unit vectors; a third lie close around one point."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 16))
    x[:500] = x[0] + 0.1 * x[:500]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(4)


def _found(df):
    return {(r.user_id, r.job_id): (r.score, r.rank) for r in df.collect()}


def test_recall_with_hot_lists(crowd):
    asked = crowd.where(F.col("id") % 25 == 0)
    own = asked.select(F.col("id").alias("user_id"), F.col("id").alias("job_id"))
    exact = dense_rankings(asked, crowd, 10, own)
    got = neighbours.approximate_rankings(asked, crowd, 10, own, **SETTINGS)
    row = neighbours.recall(got, exact).first()
    assert (row.queries, row.neighbours) == (60, 600) and row.recall >= 0.9
    # slices change where the work is done, not the result
    cut = neighbours.approximate_rankings(asked, crowd, 10, own, slice_rows=40, query_rows=7, **SETTINGS)
    assert _found(cut) == _found(got)
    right = _found(exact)
    assert all(right[p][0] == pytest.approx(s) for p, (s, _) in _found(got).items() if p in right)


def test_excluded_items_make_room_for_others(spark, crowd):
    asked = crowd.where("id = 3")
    hidden = spark.createDataFrame([(3, i) for i in range(400)], "user_id long, job_id long")
    got = neighbours.approximate_rankings(asked, crowd, 20, hidden, widen=2, **SETTINGS)
    assert sorted(r.rank for r in got.collect()) == list(range(1, 21))
    assert got.where("job_id < 400").count() == 0


def test_codes_are_close_to_vectors():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8))
    index = neighbours.fit(x, 6, 4, 64, 0.95, 5, 1)
    places, codes = index.placed(x)
    wide = 2
    back = np.stack([index.centres[p] + np.concatenate([index.books[i, c] for i, c in enumerate(code)]) for p, code in zip(places, codes, strict=True)])
    assert back.shape == (400, 4 * wide)
    assert ((back - x) ** 2).mean() < 0.15 * x.var()
    own = np.flatnonzero(places == places[0])
    assert np.allclose(index.scores(x[:3], int(places[0]), codes[own]), x[:3] @ back[own].T)


def test_nothing_to_find(spark, crowd):
    assert neighbours.approximate_rankings(crowd, crowd.limit(0), 3, **SETTINGS).count() == 0
    assert neighbours.approximate_rankings(crowd.limit(0), crowd, 3, **SETTINGS).count() == 0
    one = spark.createDataFrame([(1, [1.0] * 16), (2, None)], "id long, vector array<double>")
    assert _found(neighbours.approximate_rankings(crowd.where("id = 5"), one, 3, **SETTINGS)).keys() == {(5, 1)}
    with pytest.raises(ValueError, match="divide"):
        neighbours.approximate_rankings(crowd, crowd, 3, parts=5)
