"""Ranking metrics on hand-made rankings."""

from math import log2

import pytest

from talentweave.operators import evaluation as e


def rankings(spark, rows):
    data = [(u, j, r) for u, jobs in rows.items() for r, j in enumerate(jobs, start=1)]
    return spark.createDataFrame(data, "user_id string, job_id string, rank int")


def relevant(spark, rows):
    return spark.createDataFrame([(u, j) for u, jobs in rows.items() for j in jobs], "user_id string, job_id string")


def test_recall_and_ndcg_of_one_user(spark):
    ranked, wanted = rankings(spark, {"u": ["a", "b", "c"]}), relevant(spark, {"u": ["a", "c"]})
    row = e.user_metrics(ranked, wanted, (1, 3)).first()
    assert row["recall@1"] == 0.5
    assert 0 < row["ndcg@3"] < 1


def test_macro_report(spark):
    row = e.evaluate_v1(rankings(spark, {"u1": ["j2", "j1"]}), relevant(spark, {"u1": ["j1"]}), 2).first()
    assert row["recall@2"] == 1.0 and row["hitrate@2"] == 1.0 and row["mrr"] == 0.5 and row["user_count"] == 1.0


@pytest.mark.parametrize(
    ("ranked", "wanted", "ndcg", "mrr"),
    [(["5", "1", "2"], "5", 1.0, 1.0), (["9", "8", "5", "1"], "5", 1 / log2(4), 1 / 3), (["1", "2", "3"], "99", 0.0, 0.0)],
)
def test_anchor_values(spark, ranked, wanted, ndcg, mrr):
    row = e.evaluate_v2(rankings(spark, {"0": ranked}), relevant(spark, {"0": [wanted]}), (10,)).first()
    assert row["ndcg@10"] == pytest.approx(ndcg) and row["mrr"] == pytest.approx(mrr)


def test_users_without_ranking_are_zero_or_skipped(spark):
    ranked, wanted = rankings(spark, {"a": ["x"]}), relevant(spark, {"a": ["x"], "b": ["x"]})
    zero = e.evaluate_v1(ranked, wanted, 1).first()
    skip = e.evaluate_v2(ranked, wanted, (1,)).first()
    assert zero["user_count"] == 2 and zero["recall@1"] == 0.5
    assert skip["eval_users"] == 1 and skip["recall@1"] == 1.0


def test_no_relevant_users_gives_zeros(spark):
    row = e.evaluate_v1(rankings(spark, {"a": ["x"]}), relevant(spark, {"a": []}), 3).first()
    assert row["user_count"] == 0 and row["recall@3"] == 0.0


def test_k_zero_gives_zero_precision(spark):
    row = e.user_metrics(rankings(spark, {"a": ["x"]}), relevant(spark, {"a": ["x"]}), (0,)).first()
    assert row["precision@0"] == 0.0


def test_metrics_of_hits_equal_pair_metrics(spark):
    ranked, wanted = rankings(spark, {"a": ["x", "y", "z"], "b": ["y"]}), relevant(spark, {"a": ["y", "z", "w"], "b": ["q"]})
    hits = ranked.join(wanted, ["user_id", "job_id"]).select("user_id", "rank")
    sizes = spark.createDataFrame([("a", 3), ("b", 1)], "user_id string, relevant long")
    left = {r["user_id"]: r.asDict() for r in e.user_metrics(ranked, wanted, (2,)).collect()}
    right = {r["user_id"]: r.asDict() for r in e.metrics_of_hits(hits, sizes, (2,)).collect()}
    assert left == right


def test_seed_summary_and_t_test(spark):
    rows = spark.createDataFrame([("m", 1, 1.0), ("m", 2, 3.0), ("s", 1, 2.0)], "model string, seed int, ndcg double")
    found = {r["model"]: r for r in e.seed_summary(rows).collect()}
    assert found["m"]["ndcg"] == 2.0 and found["m"]["ndcg_std"] == 1.0 and found["s"]["ndcg_std"] is None
    ndcg = spark.createDataFrame(
        [("a", 1, u, v) for u, v in zip("xyz", (0.5, 0.4, 0.9))] + [("b", 1, u, v) for u, v in zip("xyz", (0.1, 0.2, 0.3))],
        "model string, seed int, user_id string, ndcg double",
    )
    row = e.paired_t_test(ndcg, "a", "b", 1).first()
    assert row["users"] == 3 and row["mean_diff"] == pytest.approx(0.4) and row["t"] == pytest.approx(3.4641016, rel=1e-6)
