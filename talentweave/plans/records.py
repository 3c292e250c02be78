"""Profiles and processed tables from raw rows, in both generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import degree_rank, parse_years
from ..functions.text import join_non_empty, normalize_value, split_multi_value, split_tags, tokenize_text
from ..operators.interactions import interactions_from_actions, jobs_with_behaviour, leave_last_out, restrict_to_known, run_metadata
from ..operators.ordering import first_occurrence
from ..operators.vocabulary import (
    SkillGate, build_vocabulary, gate_decisions, ids_of_tags, match_dictionary, text_fields, top_skills, user_tags,
)
from ..session import broadcast_if_small, cut_lineage, written



def _cell(table: DataFrame, name: str) -> Column:
    return normalize_value(F.col(name)) if name in table.columns else F.lit("")


def candidates_v1(users: DataFrame, as_of_year: int, max_tokens: int | None = None) -> DataFrame:
    """First-generation candidate rows; skills are the tokens of the experience field."""
    desired = split_multi_value(_cell(users, "desire_jd_type_id"))
    industries = F.concat(split_multi_value(_cell(users, "desire_jd_industry_id")), split_multi_value(_cell(users, "cur_industry_id")))
    experience, degree = _cell(users, "experience"), _cell(users, "cur_degree_id")
    return users.select(
        _cell(users, "user_id").alias("user_id"),
        join_non_empty(experience, F.concat_ws(" ", desired), F.concat_ws(" ", industries), _cell(users, "cur_jd_type")).alias("text"),
        tokenize_text(experience, max_tokens).alias("skills"),
        split_multi_value(_cell(users, "live_city_id")).alias("city_ids"),
        split_multi_value(_cell(users, "desire_jd_city_id")).alias("desired_city_ids"),
        industries.alias("industries"),
        desired.alias("desired_types"),
        degree.alias("degree"),
        degree_rank(degree).alias("degree_rank"),
        parse_years(_cell(users, "start_work_date"), as_of_year).alias("years"),
        *(["row_index"] if "row_index" in users.columns else []),
    ).where(F.col("user_id") != "")


def jobs_v1(jobs: DataFrame, as_of_year: int, max_tokens: int | None = None) -> DataFrame:
    """First-generation job rows; skills are the tokens of title, type and description."""
    title, kind, degree = _cell(jobs, "jd_title"), _cell(jobs, "jd_sub_type"), _cell(jobs, "min_edu_level")
    text = join_non_empty(title, kind, _cell(jobs, "job_description"))
    return jobs.select(
        _cell(jobs, "jd_no").alias("job_id"),
        title.alias("title"),
        text.alias("text"),
        tokenize_text(text, max_tokens).alias("skills"),
        _cell(jobs, "city").alias("city"),
        kind.alias("job_type"),
        degree.alias("min_degree"),
        degree_rank(degree).alias("min_degree_rank"),
        parse_years(_cell(jobs, "min_years"), as_of_year).alias("min_years"),
        *(["row_index"] if "row_index" in jobs.columns else []),
    ).where(F.col("job_id") != "")


def users_v2(users: DataFrame, tags: DataFrame, vocabulary: DataFrame, as_of_year: int, max_skills: int | None = None,
             max_text_tags: int | None = None) -> DataFrame:
    """Second-generation user rows; ``tags`` holds the (user_id, pos, tag) rows the gate kept."""
    kept = tags.groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda e: e["tag"]).alias("_tags")
    )
    types = split_tags(_cell(users, "desire_jd_type_id"))
    industries = F.concat(split_tags(_cell(users, "desire_jd_industry_id")), split_tags(_cell(users, "cur_industry_id")))
    degree = _cell(users, "cur_degree_id")
    base = users.select(
        _cell(users, "user_id").alias("user_id"),
        _cell(users, "live_city_id").alias("live_city"),
        split_tags(_cell(users, "desire_jd_city_id")).alias("desired_cities"),
        types.alias("desired_types"),
        industries.alias("industries"),
        degree_rank(degree).alias("degree_rank"),
        parse_years(_cell(users, "start_work_date"), as_of_year).alias("years"),
        _cell(users, "cur_jd_type").alias("_type"),
        degree.alias("_degree"),
    ).where(F.col("user_id") != "")
    no_tags, no_ids = F.array().cast("array<string>"), F.array().cast("array<int>")
    joined = base.join(kept, "user_id", "left").join(ids_of_tags(tags, vocabulary, max_skills), "user_id", "left")
    text_tags = F.coalesce("_tags", no_tags)
    text_tags = text_tags if max_text_tags is None else F.slice(text_tags, 1, max_text_tags)
    return joined.select(
        "user_id",
        F.coalesce("skill_ids", no_ids).alias("skill_ids"),
        "live_city", "desired_cities", "desired_types", "industries", "degree_rank", "years",
        join_non_empty(
            F.concat_ws(" ", text_tags), F.concat_ws(" ", "desired_types"),
            F.concat_ws(" ", "industries"), F.col("_type"), F.col("_degree"),
        ).alias("text"),
    )


def jobs_v2(jobs: DataFrame, skills: DataFrame, as_of_year: int, max_text_chars: int | None = None,
            max_match_chars: int | None = None) -> DataFrame:
    """Second-generation job rows; ``skills`` holds (id, skill_ids, skill_weights) of the matched texts."""
    title, kind, description = _cell(jobs, "jd_title"), _cell(jobs, "jd_sub_type"), _cell(jobs, "job_description")
    cuts = [n for n in (max_match_chars, max_text_chars) if n is not None]
    shown = F.substring(description, 1, min(cuts)) if cuts else description
    base = jobs.select(
        _cell(jobs, "jd_no").alias("job_id"),
        title.alias("title"),
        _cell(jobs, "city").alias("city"),
        kind.alias("job_type"),
        degree_rank(_cell(jobs, "min_edu_level")).alias("min_degree_rank"),
        parse_years(_cell(jobs, "min_years"), as_of_year).alias("min_years"),
        join_non_empty(title, kind, shown).alias("text"),
    ).where(F.col("job_id") != "")
    joined = base.join(skills.withColumnRenamed("id", "job_id"), "job_id", "left")
    return joined.select(
        "job_id", "title", "city", "job_type", "min_degree_rank", "min_years",
        F.coalesce("skill_ids", F.array().cast("array<int>")).alias("skill_ids"),
        F.coalesce("skill_weights", F.array().cast("array<double>")).alias("skill_weights"),
        "text",
    )


def preprocess(
    users: DataFrame, jobs: DataFrame, actions: DataFrame, as_of_year: int, gate: SkillGate | None = None,
    reference: DataFrame | None = None, min_count: int = 2, max_job_skills: int | None = None, max_user_skills: int | None = None,
    title_weight: float = 2.0, max_desc_chars: int | None = None, max_text_chars: int | None = None,
    max_text_tags: int | None = None,
) -> dict[str, DataFrame]:
    """Raw tables to ``users``, ``jobs``, ``interactions``, ``skill_vocab`` and ``meta``."""
    gate = gate or SkillGate(enabled=False)
    user_rows = users.where(_cell(users, "user_id") != "").withColumn("user_id", _cell(users, "user_id"))
    # each step is read by several others, so it is written once
    user_rows = written(first_occurrence(user_rows, ["user_id"], "row_index", last=True), "user_rows")
    all_tags = written(user_tags(user_rows), "tags")
    vocabulary = cut_lineage(build_vocabulary(all_tags, min_count, gate, reference))
    judged = gate_decisions(all_tags.select(F.col("tag").alias("token")).distinct(), gate, reference)
    kept_tokens = judged.where("keep").select(F.col("token").alias("tag"))
    tags = all_tags.join(broadcast_if_small(cut_lineage(kept_tokens)), "tag", "left_semi")

    interactions = written(interactions_from_actions(actions, strict=True), "interactions")
    job_rows = jobs.withColumn("job_id", _cell(jobs, "jd_no")).where(F.col("job_id") != "")
    seen = written(jobs_with_behaviour(first_occurrence(job_rows, ["job_id"], "row_index", last=True), interactions), "job_rows")
    weights = gate_decisions(vocabulary.select(F.col("skill").alias("token"), "skill_id"), gate, reference)
    terms = weights.select(F.col("token").alias("skill"), "skill_id", "weight")
    texts = seen.select("job_id", _cell(seen, "jd_title").alias("title"), _cell(seen, "job_description").alias("description"))
    matches = match_dictionary(text_fields(texts, title_weight, max_desc_chars), terms, gate.enabled and gate.strict_ascii_boundaries)
    out_users = written(users_v2(user_rows, tags, vocabulary, as_of_year, max_user_skills, max_text_tags), "users")
    out_jobs = written(jobs_v2(seen, top_skills(matches, max_job_skills), as_of_year, max_text_chars, max_desc_chars), "jobs")
    split = written(leave_last_out(restrict_to_known(interactions, out_users, out_jobs), min_level=2), "split")
    return {
        "users": out_users,
        "jobs": out_jobs,
        "interactions": split,
        "skill_vocab": vocabulary,
        "meta": run_metadata(out_users, out_jobs, split, vocabulary),
    }
