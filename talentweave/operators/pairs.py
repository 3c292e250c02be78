"""User-job pairs joined to both profiles, and skill lists in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_profiles(pairs: DataFrame, users: DataFrame, jobs: DataFrame) -> DataFrame:
    """Pair rows with the user columns and the job columns prefixed by ``job_``.

    Both lookups are inner equi-joins on unique ids; AQE splits a user or job that owns many pairs.
    """
    renamed = [F.col(c).alias(f"job_{c}") for c in jobs.columns if c != "job_id"]
    return pairs.join(users, "user_id").join(jobs.select("job_id", *renamed), "job_id")


def skill_entries(df: DataFrame, id_col: str, skills: str = "skills", weights: str | None = None) -> DataFrame:
    """(id, skill, weight) rows of a skill list; the weight is 1.0 where no weight list is named."""
    weight_of = F.col(weights) if weights else F.transform(skills, lambda s: F.lit(1.0))
    return df.select(id_col, F.inline(F.arrays_zip(F.col(skills).alias("skill"), weight_of.alias("weight"))))


def skill_frequency(df: DataFrame, skills: str = "skills") -> DataFrame:
    """Number of rows whose skill list holds each skill."""
    return df.select(F.explode(F.array_distinct(skills)).alias("skill")).groupBy("skill").agg(
        F.count(F.lit(1)).alias("frequency")
    )


def shared_skill_counts(pairs: DataFrame, users: DataFrame, jobs: DataFrame) -> DataFrame:
    """Shared-skill count, coverage and gap size of given pairs."""
    joined = attach_profiles(pairs, users.select("user_id", "skills"), jobs.select("job_id", "skills"))
    shared = F.size(F.array_intersect("job_skills", "skills"))
    return joined.select(
        "user_id",
        "job_id",
        shared.alias("shared"),
        F.size(F.array_except("job_skills", "skills")).alias("missing"),
    )


def normalize_skill_list(df: DataFrame, id_col: str, skills: str, aliases: DataFrame | None) -> DataFrame:
    """Skill lists with aliases resolved, distinct, in order of first occurrence.

    ``aliases`` holds (alias, canonical) with trimmed lower-case aliases; unknown skills pass through.
    """
    tags = df.select(id_col, F.posexplode(skills).alias("_pos", "_raw"))
    tags = tags.withColumn("_skill", F.trim("_raw"))
    if aliases is not None:
        names = aliases.select(F.col("alias").alias("_key"), F.col("canonical").alias("_name"))
        tags = tags.withColumn("_key", F.lower("_skill")).join(names, "_key", "left")
        tags = tags.withColumn("_skill", F.coalesce("_name", "_skill"))
    listed = (
        tags.where(F.col("_skill") != "")
        .groupBy(id_col)
        .agg(F.array_sort(F.collect_list(F.struct("_pos", "_skill"))).alias("_list"))
        .select(id_col, F.array_distinct(F.transform("_list", lambda e: e["_skill"])).alias("_names"))
    )
    empty = F.array().cast("array<string>")
    return df.join(listed, id_col, "left").withColumn(skills, F.coalesce("_names", empty)).drop("_names")
