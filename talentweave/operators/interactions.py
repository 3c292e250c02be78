"""Behaviour rows: levels, restriction to known sides, leave-last-out and time splits, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import behaviour_level
from ..functions.text import normalize_value
from .ordering import global_position, top_per_group

PAIR = ["user_id", "job_id"]


def interactions_from_actions(actions: DataFrame, strict: bool = True, keep_zero: bool = False) -> DataFrame:
    """Behaviour rows with level 1-3 from raw action rows; rows without ids are rejected.

    ``strict`` reads only the flag ``1`` (second generation); otherwise ``1.0`` and ``true`` count too.
    ``keep_zero`` keeps rows without any behaviour (first generation counts them).
    """
    level = behaviour_level(F.col("browsed"), F.col("delivered"), F.col("satisfied"), strict)
    rows = actions.select(
        normalize_value(F.col("user_id")).alias("user_id"),
        normalize_value(F.col("jd_no")).alias("job_id"),
        level.alias("level"),
        "row_index",
    ).where((F.col("user_id") != "") & (F.col("job_id") != ""))
    return rows if keep_zero else rows.where(F.col("level") > 0)


def restrict_to_known(interactions: DataFrame, users: DataFrame, jobs: DataFrame) -> DataFrame:
    """Keep rows whose user and job both exist."""
    return interactions.join(users.select("user_id"), "user_id", "left_semi").join(
        jobs.select("job_id"), "job_id", "left_semi"
    )


def jobs_with_behaviour(jobs: DataFrame, interactions: DataFrame) -> DataFrame:
    """Keep jobs that occur in the behaviour rows."""
    return jobs.join(interactions.select("job_id").distinct(), "job_id", "left_semi")


def leave_last_out(interactions: DataFrame, min_level: int = 2) -> DataFrame:
    """Add ``split``: a user's last positive row is test, the one before valid, the rest train.

    Three positives give all three splits, two give train and test, one stays in train; rows under
    ``min_level`` are train. Only the last two positives per user leave a task, and the label joins
    back on (user, row index), a unique key, so a hot user stays spread out.
    """
    positives = interactions.where(F.col("level") >= min_level).select("user_id", "row_index")
    counts = positives.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    last_two = top_per_group(positives, ["user_id"], [F.desc("row_index")], 2, "_back")
    held_out = (
        last_two.join(counts, "user_id")
        .where(((F.col("_back") == 1) & (F.col("_n") >= 2)) | ((F.col("_back") == 2) & (F.col("_n") >= 3)))
        .select("user_id", "row_index", F.when(F.col("_back") == 1, "test").otherwise("valid").alias("_held"))
    )
    return (
        interactions.join(held_out, ["user_id", "row_index"], "left")
        .withColumn("split", F.coalesce("_held", F.lit("train")))
        .drop("_held")
    )


def time_split(
    df: DataFrame, ts: str, key: str, valid_ratio: float = 0.1, test_ratio: float = 0.2
) -> DataFrame:
    """Global split by time: the last part is test, the last part of the remainder valid.

    Only the two boundary keys are looked up by position; rows are then labelled by comparison.
    """
    order = global_position(df.select(ts, key), [ts, key])
    n = order.count()
    test_start = int(n * (1 - test_ratio))
    valid_start = int(test_start * (1 - valid_ratio))
    bounds = {
        r["position"]: r for r in order.where(F.col("position").isin(valid_start, test_start)).collect()
    }

    def from_boundary(position: int) -> Column:
        if position not in bounds:
            return F.lit(False)
        edge = bounds[position]
        return F.struct(ts, key) >= F.struct(F.lit(edge[ts]).alias(ts), F.lit(edge[key]).alias(key))

    split = F.when(from_boundary(test_start), "test").when(from_boundary(valid_start), "valid").otherwise("train")
    return df.withColumn("split", split)


def positives(interactions: DataFrame, *splits: str, min_level: int = 2) -> DataFrame:
    """Distinct (user, job) positive pairs of the named splits (all splits when none is named)."""
    rows = interactions.where(F.col("level") >= min_level)
    if splits:
        rows = rows.where(F.col("split").isin(*splits))
    return rows.select(*PAIR).distinct()


def browsed_pairs(interactions: DataFrame) -> DataFrame:
    return interactions.where(F.col("level") == 1).select(*PAIR).distinct()


def seen_pairs(interactions: DataFrame) -> DataFrame:
    """Every positive of any split, and every browsed pair: what a hard negative must avoid."""
    return positives(interactions).union(browsed_pairs(interactions)).distinct()


def positive_sets(interactions: DataFrame, min_level: int = 2) -> DataFrame:
    """Size of every user's positive set per split (the sets themselves stay in long form)."""
    return (
        interactions.where(F.col("level") >= min_level)
        .select("user_id", "split", "job_id")
        .distinct()
        .groupBy("user_id", "split")
        .agg(F.count(F.lit(1)).alias("jobs"))
    )


def split_overlap(interactions: DataFrame, min_level: int = 2) -> DataFrame:
    """Pairs found both in train and in test (splits are per row, sets per job)."""
    return positives(interactions, "train", min_level=min_level).intersect(
        positives(interactions, "test", min_level=min_level)
    )


def dataset_stats(users: DataFrame, jobs: DataFrame, interactions: DataFrame, min_level: int = 1) -> DataFrame:
    """(item, value) counts: candidates, jobs, interactions, positives, distinct positives per split."""
    positive = F.col("level") >= min_level
    rows = interactions.agg(
        F.count(F.lit(1)).alias("interaction_count"),
        F.count_if(positive).alias("positive_interaction_count"),
    )
    pairs = (
        interactions.where(positive)
        .select("split", *PAIR)
        .distinct()
        .groupBy()
        .agg(*[F.count_if(F.col("split") == s).alias(f"{s}_positive_count") for s in ("train", "valid", "test")])
    )
    sides = users.agg(F.count(F.lit(1)).alias("candidate_count")), jobs.agg(F.count(F.lit(1)).alias("job_count"))
    return _as_items(*sides, rows, pairs)


def run_metadata(users: DataFrame, jobs: DataFrame, interactions: DataFrame, skill_vocab: DataFrame) -> DataFrame:
    """(item, value) counts of a second-generation run, with average skills per user and job."""
    positive = F.col("level") >= 2
    return _as_items(
        users.agg(F.count(F.lit(1)).alias("users"), F.avg(F.size("skill_ids")).alias("avg_user_skills")),
        jobs.agg(F.count(F.lit(1)).alias("jobs"), F.avg(F.size("skill_ids")).alias("avg_job_skills")),
        interactions.agg(
            F.count(F.lit(1)).alias("interactions"),
            F.count_if(positive).alias("positives"),
            F.count_if(positive & (F.col("split") == "train")).alias("train_pos"),
            F.count_if(F.col("split") == "valid").alias("valid_pos"),
            F.count_if(F.col("split") == "test").alias("test_pos"),
        ),
        skill_vocab.agg(F.count(F.lit(1)).alias("skill_vocab")),
    )


def _as_items(*one_row_frames: DataFrame) -> DataFrame:
    """Turn one-row aggregates into (item, value) rows."""
    items = None
    for frame in one_row_frames:
        pairs = F.explode(
            F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in frame.columns])
        )
        rows = frame.select(pairs.alias("_i")).select("_i.*")
        items = rows if items is None else items.union(rows)
    return items
