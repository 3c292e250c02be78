"""Pair features and rule scores as expressions over a joined user-job pair row.

A pair row carries the user columns (``skills``, ``live_city`` …) and the job columns prefixed
with ``job_`` as produced by :func:`talentweave.operators.pairs.attach_profiles`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------------------------
RULE_V1_WEIGHTS = {
    "coverage": 0.50,
    "missing": 0.10,
    "city": 0.15,
    "education": 0.10,
    "experience": 0.10,
    "type": 0.05,
    "paths": 0.03,
}
RULE_V2_WEIGHTS = {"coverage": 3.0, "city": 1.0, "type": 1.5, "degree": 0.3, "years": 0.3}
# Names of the seven first-generation pair features, in vector order.
FEATURE_NAMES = [
    "required_skill_coverage",
    "missing_skill_ratio",
    "city_match",
    "education_match",
    "experience_match",
    "job_type_match",
    "skill_path_count_log1p",
]
# ---------------------------------------------------------------------------------------------


def head(values: Column, limit: int | None) -> Column:
    """The first ``limit`` values, or all of them."""
    return values if limit is None else F.slice(values, 1, limit)


def flag(condition: Column) -> Column:
    """1.0 / 0.0; NULL counts as no."""
    return F.when(condition, 1.0).otherwise(0.0)


def shared_skills(user_skills: Column, job_skills: Column) -> Column:
    """Job skills the user has, in job order."""
    return F.array_intersect(job_skills, user_skills)


def gap_skills(user_skills: Column, job_skills: Column) -> Column:
    """Job skills the user lacks, in job order."""
    return F.array_except(job_skills, user_skills)


def coverage(shared_count: Column, job_count: Column) -> Column:
    return shared_count / F.greatest(F.lit(1), job_count)


def pair_features_v1() -> list[Column]:
    """Seven features; an unstated degree, year or type requirement gives 0."""
    n_job = F.size(F.array_distinct("job_skills"))
    n_shared = F.size(shared_skills(F.col("skills"), F.col("job_skills")))
    cities = F.concat("city_ids", "desired_city_ids")
    return [
        coverage(n_shared, n_job).alias(FEATURE_NAMES[0]),
        coverage(n_job - n_shared, n_job).alias(FEATURE_NAMES[1]),
        flag(F.array_contains(cities, F.col("job_city"))).alias(FEATURE_NAMES[2]),
        flag((F.col("job_min_degree") != "") & (F.col("degree_rank") >= F.col("job_min_degree_rank"))).alias(FEATURE_NAMES[3]),
        flag((F.col("job_min_years") != 0) & (F.col("years") >= F.col("job_min_years"))).alias(FEATURE_NAMES[4]),
        flag((F.col("job_job_type") != "") & F.array_contains("desired_types", F.col("job_job_type"))).alias(FEATURE_NAMES[5]),
        F.log1p(n_shared.cast("double")).alias(FEATURE_NAMES[6]),
    ]


def rule_score_v1() -> Column:
    """Weighted sum of the seven first-generation features."""
    w = RULE_V1_WEIGHTS
    return (
        w["coverage"] * F.col(FEATURE_NAMES[0])
        + w["missing"] * (1.0 - F.col(FEATURE_NAMES[1]))
        + w["city"] * F.col(FEATURE_NAMES[2])
        + w["education"] * F.col(FEATURE_NAMES[3])
        + w["experience"] * F.col(FEATURE_NAMES[4])
        + w["type"] * F.col(FEATURE_NAMES[5])
        + w["paths"] * F.col(FEATURE_NAMES[6])
    )


def pair_features_v2() -> list[Column]:
    """Second-generation features: requirements are compared even when unstated (0 >= 0 holds)."""
    n_job = F.size("job_skills")
    n_shared = F.size(shared_skills(F.col("skills"), F.col("job_skills")))
    cities = F.concat("desired_cities", F.array("live_city"))
    return [
        coverage(n_shared, n_job).alias("coverage"),
        coverage(n_job - n_shared, n_job).alias("missing"),
        flag(F.array_contains(cities, F.col("job_city"))).alias("city"),
        flag(F.col("degree_rank") >= F.col("job_min_degree_rank")).alias("degree"),
        flag(F.col("years") >= F.col("job_min_years")).alias("experience"),
        flag(F.array_contains("desired_types", F.col("job_job_type"))).alias("type"),
        F.log1p(n_shared.cast("double")).alias("paths"),
    ]


def path_and_gap(limit: int | None = None) -> list[Column]:
    """Shared and missing skills of the pair, in job order."""
    return [
        head(shared_skills(F.col("skills"), F.col("job_skills")), limit).alias("path_skills"),
        head(gap_skills(F.col("skills"), F.col("job_skills")), limit).alias("gap_skills"),
    ]


def structured_numeric(degree: Column, years: Column) -> Column:
    """Degree and years scaled for a vector model."""
    return F.array(degree / 8.0, F.log1p(years) / 4.0)


# Required / preferred skill variant -----------------------------------------------------------


def requirement_features() -> list[Column]:
    """Coverage of required and preferred skills, city, degree equality, years threshold."""
    required, preferred = F.array_distinct("job_required_skills"), F.array_distinct("job_preferred_skills")
    skills = F.col("skills")

    def share(wanted: Column) -> Column:
        return coverage(F.size(F.array_intersect(wanted, skills)), F.size(wanted))

    def equal_and_stated(a: str, b: str) -> Column:
        return flag((F.col(a) != "") & (F.col(b) != "") & (F.col(a) == F.col(b)))

    return [
        share(required).alias("required_skill_coverage"),
        share(preferred).alias("preferred_skill_coverage"),
        equal_and_stated("expected_city", "job_city").alias("city_match"),
        equal_and_stated("education", "job_education_requirement").alias("education_match"),
        flag(F.col("experience_years") >= F.col("job_experience_requirement")).alias("experience_match"),
    ]


def requirement_score() -> Column:
    skill = 0.8 * F.col("required_skill_coverage") + 0.2 * F.col("preferred_skill_coverage")
    return 0.5 * skill + 0.2 * F.col("education_match") + 0.2 * F.col("experience_match") + 0.1 * F.col("city_match")


def requirement_path_counts() -> list[Column]:
    """Shared and missing skill counts as doubles."""
    required, preferred, skills = F.col("job_required_skills"), F.col("job_preferred_skills"), F.col("skills")

    def count(array: Column) -> Column:
        return F.size(array).cast("double")

    return [
        count(F.array_intersect(required, skills)).alias("shared_required_skill_count"),
        count(F.array_intersect(preferred, skills)).alias("shared_preferred_skill_count"),
        count(F.array_except(required, skills)).alias("missing_required_skill_count"),
        count(F.array_intersect(F.concat(required, preferred), skills)).alias("skill_path_count"),
    ]
