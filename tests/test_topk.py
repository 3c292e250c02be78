"""Blocked top-k against brute force, whatever the block sizes."""

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentweave.operators import topk
from talentweave.operators.dense import dense_groups_visited, dense_rankings, unit_vectors
from talentweave.operators.topk import blocked_topk, sparse_product, term_keys

rng = np.random.default_rng(5)


def brute(scores, k, hidden=frozenset(), min_score=None):
    out = set()
    for u, row in enumerate(scores):
        free = [(-round(float(s), 9), j) for j, s in enumerate(row) if (u, j) not in hidden and (min_score is None or s > min_score)]
        out |= {(u, j, rank) for rank, (_, j) in enumerate(sorted(free)[:k], start=1)}
    return out


def found(df):
    return {(r["user_id"], r["job_id"], r["rank"]) for r in df.collect()}


@pytest.fixture(scope="module")
def sparse(spark):
    left = [[f"t{x}" for x in rng.choice(30, 6)] for _ in range(40)]
    right = [[f"t{x}" for x in rng.choice(30, 5, replace=False)] for _ in range(70)]
    scores = np.array([[sum(float(a == b) for a in q for b in i) for i in right] for q in left])

    def frame(rows):
        return spark.createDataFrame(list(enumerate(rows)), "id long, terms array<string>").select("id", term_keys(F.col("terms")).alias("keys"))

    return frame(left), frame(right), scores


unweighted = partial(sparse_product, keys="keys", weights=None)


@pytest.mark.parametrize("blocks", [{}, {"query_block_rows": 7, "item_block_rows": 9}])
@pytest.mark.parametrize("k", [1, 5, 70, 500])
def test_sparse_with_ties_and_exclusions(spark, sparse, blocks, k):
    queries, items, scores = sparse
    hidden = {(u, j) for u in range(40) for j in range(70) if (u * 7 + j) % 11 == 0} | {(3, j) for j in range(70)}
    exclude = spark.createDataFrame(sorted(hidden), "user_id long, job_id long")
    assert found(blocked_topk(queries, items, k, unweighted, exclude, **blocks)) == brute(scores, k, hidden)


def test_positive_scores_only(sparse):
    queries, items, scores = sparse
    assert found(blocked_topk(queries, items, 70, unweighted, min_score=0.0, query_block_rows=9)) == brute(scores, 70, min_score=0.0)


def test_postings_in_small_portions(sparse, monkeypatch):
    queries, items, scores = sparse
    monkeypatch.setattr(topk, "_CELLS", 150)
    assert found(blocked_topk(queries, items, 5, unweighted)) == brute(scores, 5)


def test_dense_and_self_exclusion(spark):
    vectors = rng.normal(size=(60, 8))
    vectors[4] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "n long, v array<double>")
    unit = vectors / np.where((n := np.linalg.norm(vectors, axis=1, keepdims=True)) > 0, n, 1)
    rows = unit_vectors(df, "n", "v")
    self_pairs = rows.select(F.col("id").alias("user_id"), F.col("id").alias("job_id"))
    got = found(dense_rankings(rows, rows, 10, self_pairs, query_block_rows=13, item_block_rows=17))
    assert got == brute(unit @ unit.T, 10, {(i, i) for i in range(60)})


@pytest.mark.parametrize("k", [1, 7, 500])
def test_groups_are_skipped_without_loss(spark, k):
    """Clusters of vectors, of unlike length, with one that holds a third of all items."""
    centres = rng.normal(size=(12, 6)) * rng.uniform(0.5, 3, size=(12, 1))
    which = np.where(rng.random(400) < 0.33, 0, rng.integers(0, 12, 400))
    items = np.round(centres[which] + rng.normal(size=(400, 6)) * 0.1, 3)
    items[50:60] = items[50]  # ties
    asks = np.round(centres[rng.integers(0, 12, 40)] + rng.normal(size=(40, 6)) * 0.3, 3)
    asks[3] = 0
    frame = lambda rows: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, vector array<double>")
    hidden = {(u, j) for u in range(40) for j in range(400) if (u + j) % 13 == 0}
    exclude = spark.createDataFrame(sorted(hidden), "user_id long, job_id long")
    got = found(dense_rankings(frame(asks), frame(items), k, exclude, query_block_rows=11, item_block_rows=15))
    assert got == brute(asks @ items.T, k, hidden)
    visits = dense_groups_visited(frame(asks), frame(items), k, exclude, item_block_rows=15).agg(F.sum("visited"), F.sum("groups"), F.count("*")).first()
    assert visits[2] == 40 and (visits[0] < 0.4 * visits[1] if k == 1 else visits[0] <= visits[1])


def test_string_ids(spark):
    queries = spark.createDataFrame([("q", [1.0])], "id string, vector array<double>")
    items = spark.createDataFrame([("b", [1.0]), ("a", [1.0]), ("c", [2.0])], "id string, vector array<double>")
    got = sorted((r["rank"], r["job_id"]) for r in dense_rankings(queries, items, 3).collect())
    assert got == [(1, "c"), (2, "a"), (3, "b")]


def test_no_items_or_queries(spark):
    queries = spark.createDataFrame([("q", [1.0])], "id string, vector array<double>")
    assert dense_rankings(queries, queries.limit(0), 3).count() == 0
    assert dense_rankings(queries.limit(0), queries, 3).count() == 0


def test_block_counts_bound_rows_and_use_the_cores():
    assert topk.block_counts(10, 10, 100, 100, 8) == (1, 1)
    assert topk.block_counts(1000, 250, 100, 100, 8) == (10, 3)
    assert topk.block_counts(20_000, 2_000, 30_000, 30_000, 8) == (8, 1)
