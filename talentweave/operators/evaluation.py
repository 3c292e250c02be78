"""Ranking metrics per user and their macro averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KS = (10, 50)


def _ideal_dcg(hits: Column) -> Column:
    places = F.sequence(F.lit(1), hits)
    return F.aggregate(places, F.lit(0.0), lambda acc, p: acc + 1.0 / F.log2(p + 1.0))


def user_metrics(
    rankings: DataFrame, relevant: DataFrame, ks: Sequence[int] = KS, missing: str = "skip"
) -> DataFrame:
    """One row per evaluated user: reciprocal rank, and recall / precision / NDCG / hit rate at each k.

    ``missing='skip'`` leaves out users without any ranking, ``'zero'`` scores them 0. The rankings meet
    the relevant pairs on (user, job), and only counts per user are shuffled after that.
    """
    wanted = relevant.select("user_id", "job_id").distinct()
    if missing == "skip":
        ranked_users = rankings.where(F.col("rank") == 1).select("user_id")
        wanted = wanted.join(ranked_users, "user_id", "left_semi")
    hits = wanted.join(rankings.select("user_id", "job_id", "rank"), ["user_id", "job_id"], "left")
    per_user = hits.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"), *_hit_aggregates(ks))
    return per_user.select("user_id", *_metric_columns(ks))


def metrics_of_hits(hits: DataFrame, sizes: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """Same metrics from (user_id, rank) of the hits and (user_id, relevant) counts.

    For relevance by a shared property, where listing the relevant pairs would be quadratic.
    """
    per_user = hits.groupBy("user_id").agg(*_hit_aggregates(ks))
    joined = sizes.select("user_id", F.col("relevant").alias("_n")).join(per_user, "user_id", "left")
    counted = [c for c in joined.columns if c.startswith(("_hits", "_dcg"))]
    return joined.fillna(0, counted).select("user_id", *_metric_columns(ks))


def _hit_aggregates(ks: Sequence[int]) -> list[Column]:
    aggregates = [F.min("rank").alias("_first")]
    for k in ks:
        inside = F.col("rank") <= k
        aggregates += [
            F.count_if(inside).alias(f"_hits{k}"),
            F.sum(F.when(inside, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"_dcg{k}"),
        ]
    return aggregates


def _metric_columns(ks: Sequence[int]) -> list[Column]:
    columns = [F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("mrr")]
    for k in ks:
        got = F.col(f"_hits{k}")
        columns += [
            (got / F.col("_n")).alias(f"recall@{k}"),
            ((got / F.lit(float(k))) if k > 0 else F.lit(0.0)).alias(f"precision@{k}"),
            ((F.col(f"_dcg{k}") / _ideal_dcg(F.least(F.col("_n"), F.lit(k)))) if k > 0 else F.lit(0.0)).alias(f"ndcg@{k}"),
            F.when(got > 0, 1.0).otherwise(0.0).alias(f"hitrate@{k}"),
        ]
    return columns


def macro_report(per_user: DataFrame, count_name: str = "eval_users") -> DataFrame:
    """One row: the average of every metric and the number of users (zeros when there is none)."""
    names = [c for c in per_user.columns if c != "user_id"]
    averages = [F.coalesce(F.avg(F.col(f"`{c}`")), F.lit(0.0)).alias(c) for c in names]
    return per_user.agg(*averages, F.count(F.lit(1)).cast("double").alias(count_name))


def evaluate_v1(rankings: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Macro report at one k; users without a ranking count as zero."""
    return macro_report(user_metrics(rankings, relevant, [k], "zero"), "user_count")


def evaluate_v2(rankings: DataFrame, relevant: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """Macro report at several k; users without a ranking are skipped."""
    return macro_report(user_metrics(rankings, relevant, ks, "skip"))


def user_ndcg(rankings: DataFrame, relevant: DataFrame, model: str, seed: int, k: int = KS[0]) -> DataFrame:
    """(model, seed, user_id, ndcg) rows for later significance tests."""
    metrics = user_metrics(rankings, relevant, [k])
    return metrics.select(
        F.lit(model).alias("model"), F.lit(seed).alias("seed"), "user_id", F.col(f"`ndcg@{k}`").alias("ndcg")
    )


def seed_summary(metrics: DataFrame) -> DataFrame:
    """Mean of every metric over the seeds of a model; population deviation when there are several."""
    names = [c for c in metrics.columns if c not in ("model", "seed")]
    aggregates = [F.count(F.lit(1)).alias("n_seeds")]
    for name in names:
        column = F.col(f"`{name}`")
        aggregates += [
            F.avg(column).alias(name),
            F.when(F.count(F.lit(1)) > 1, F.stddev_pop(column)).alias(f"{name}_std"),
        ]
    return metrics.groupBy("model").agg(*aggregates)


def paired_t_test(ndcg: DataFrame, model_a: str, model_b: str, seed: int) -> DataFrame:
    """Paired t statistic of two models' per-user NDCG: (users, mean_diff, t)."""
    rows = ndcg.where(F.col("seed") == seed)
    a = rows.where(F.col("model") == model_a).select("user_id", F.col("ndcg").alias("_a"))
    b = rows.where(F.col("model") == model_b).select("user_id", F.col("ndcg").alias("_b"))
    diff = F.col("_a") - F.col("_b")
    stats = a.join(b, "user_id").agg(
        F.count(F.lit(1)).alias("users"), F.avg(diff).alias("mean_diff"), F.stddev_samp(diff).alias("_sd")
    )
    t = F.col("mean_diff") / (F.nullif(F.col("_sd"), F.lit(0.0)) / F.sqrt("users"))
    return stats.select("users", "mean_diff", t.alias("t"))
