"""Batch recommendation: a table of requests in, ranked and explained items out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import degree_rank
from ..functions.features import requirement_features, requirement_score
from ..functions.text import split_multi_value, tokenize_text
from ..operators.evidence import first_generation_evidence
from ..operators.lexical import bm25_rankings_v1, hashed_rankings, tokens_table
from ..operators.ordering import position_in_group
from ..operators.pairs import attach_profiles
from ..operators.scoring import rule_rankings_v1
from ..session import broadcast_if_small, cut_lineage

STORED_MODEL = "graph"
COMPUTED_MODELS = ("rule", "bm25", "semantic_hash")
MAX_TOP_K = 100
FALLBACK_WARNING = "Stored ranking is unavailable for this candidate; falling back to rule ranking."

PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("candidate_id", T.StringType()),
        T.StructField("skills", T.ArrayType(T.StringType())),
        T.StructField("experience_text", T.StringType()),
        T.StructField("desired_city_ids", T.ArrayType(T.StringType())),
        T.StructField("current_city_ids", T.ArrayType(T.StringType())),
        T.StructField("industries", T.ArrayType(T.StringType())),
        T.StructField("desired_job_types", T.ArrayType(T.StringType())),
        T.StructField("degree", T.StringType()),
        T.StructField("years_experience", T.DoubleType()),
    ]
)
REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("candidate_id", T.StringType()),
        T.StructField("candidate_profile", PROFILE_SCHEMA),
        T.StructField("model", T.StringType()),
        T.StructField("top_k", T.IntegerType()),
        T.StructField("include_explanations", T.BooleanType()),
    ]
)
CANDIDATE_COLUMNS = ["user_id", "text", "skills", "city_ids", "desired_city_ids", "industries", "desired_types", "degree", "degree_rank", "years"]


def profile_to_candidate(profiles: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """Candidate rows of ad-hoc profiles (a ``candidate_profile`` struct): explicit skills first, then text tokens."""
    p = "candidate_profile."
    none = F.array().cast("array<string>")

    def listed(name: str) -> Column:
        return F.coalesce(F.col(p + name), none)

    explicit = F.flatten(F.transform(listed("skills"), lambda v: split_multi_value(v)))
    words = F.coalesce(F.col(p + "experience_text"), F.lit(""))
    text = F.concat_ws(" ", words, *[F.concat_ws(" ", listed(c)) for c in ("skills", "industries", "desired_job_types")])
    degree = F.coalesce(F.col(p + "degree"), F.lit(""))
    return profiles.withColumns(
        {
            "user_id": F.coalesce(F.nullif(F.col(p + "candidate_id"), F.lit("")), F.lit("anonymous")),
            "text": F.trim(text),
            "skills": F.array_distinct(F.concat(explicit, tokenize_text(words, max_tokens))),
            "city_ids": listed("current_city_ids"),
            "desired_city_ids": listed("desired_city_ids"),
            "industries": listed("industries"),
            "desired_types": listed("desired_job_types"),
            "degree": degree,
            "degree_rank": degree_rank(degree),
            "years": F.coalesce(F.col(p + "years_experience"), F.lit(0.0)),
        }
    )


def resolve_requests(requests: DataFrame, candidates: DataFrame, stored_model: str = STORED_MODEL) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): accepted requests carry their candidate columns, rejected ones an error code.

    The model is checked first, then the candidate; a profile takes precedence over an id.
    """
    supported = [*COMPUTED_MODELS, stored_model]
    asked = requests.withColumn("model", F.lower(F.trim(F.coalesce("model", F.lit(stored_model))))).withColumn(
        "top_k", F.least(F.greatest(F.coalesce("top_k", F.lit(10)), F.lit(1)), F.lit(MAX_TOP_K))
    ).withColumn("include_explanations", F.coalesce("include_explanations", F.lit(True)))
    known = candidates.select(*CANDIDATE_COLUMNS)
    # requests without an id would all meet in one task
    looked_up = asked.join(known.select(F.col("user_id").alias("_known")), F.col("candidate_id") == F.col("_known"), "left")
    error = (
        F.when(~F.col("model").isin(supported), "UNSUPPORTED_MODEL")
        .when(F.col("candidate_profile").isNotNull(), None)
        .when(F.col("candidate_id").isNull(), "MISSING_CANDIDATE")
        .when(F.col("_known").isNull(), "CANDIDATE_NOT_FOUND")
    )
    judged = looked_up.withColumn("error_code", error).drop("_known")
    valid = judged.where(F.col("error_code").isNull())
    head = ["request_id", "model", "top_k", "include_explanations"]
    by_profile = profile_to_candidate(valid.where(F.col("candidate_profile").isNotNull())).select(*head, *CANDIDATE_COLUMNS)
    by_id = (
        valid.where(F.col("candidate_profile").isNull())
        .select(*head, F.col("candidate_id").alias("user_id"))
        .join(known, "user_id")
        .select(*head, *CANDIDATE_COLUMNS)
    )
    rejected = judged.where(F.col("error_code").isNotNull()).select("request_id", "candidate_id", "model", "error_code")
    return by_profile.unionByName(by_id), rejected


def recommend(
    requests: DataFrame, candidates: DataFrame, jobs: DataFrame, stored_rankings: DataFrame | None = None,
    stored_model: str = STORED_MODEL, bm25_tokens: int | None = None, hashed_tokens: int | None = None,
    document_tokens: int | None = None,
) -> dict[str, DataFrame]:
    """``items`` (one row per recommended job with evidence) and ``rejects`` (failed requests).

    Every request ranks the whole catalogue by its model and keeps ``top_k``. A stored ranking is used
    where it names at least one existing job; otherwise the request falls back to rules with a warning.
    """
    accepted, rejected = resolve_requests(requests, candidates, stored_model)
    accepted = cut_lineage(accepted)
    # rankings are computed per request, so the request id stands in for the query id
    queries = accepted.withColumn("_candidate", F.col("user_id")).withColumn("user_id", F.col("request_id"))

    stored = stored_rankings if stored_rankings is not None else jobs.sparkSession.createDataFrame([], "user_id string, job_id string, rank int")
    wants_stored = queries.where(F.col("model") == stored_model)
    known = stored.join(jobs.select("job_id"), "job_id", "left_semi").select(F.col("user_id").alias("_candidate"), "job_id", F.col("rank").alias("_stored"))
    offered = wants_stored.select("user_id", "_candidate", "top_k").join(known, "_candidate")
    order = W.partitionBy("user_id").orderBy("_stored")
    from_store = offered.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MAX_TOP_K).where(F.col("rank") <= F.col("top_k"))
    from_store = from_store.select("user_id", "job_id", F.round(1.0 / F.col("rank"), 6).alias("score"), "rank", F.lit(stored_model).alias("used"))

    served = from_store.where(F.col("rank") == 1).select("user_id")
    fallback = wants_stored.join(served, "user_id", "left_anti")
    by_rule = queries.where(F.col("model") == "rule").unionByName(fallback)

    def tokens(df: DataFrame, key: str, limit: int | None) -> DataFrame:
        return tokens_table(df, key, tokenize_text(F.col("text"), limit))

    parts = [from_store, rule_rankings_v1(by_rule, jobs, None, MAX_TOP_K).withColumn("used", F.lit("rule"))]
    for_bm25 = queries.where(F.col("model") == "bm25")
    if not for_bm25.isEmpty():
        parts.append(bm25_rankings_v1(for_bm25, jobs, MAX_TOP_K, None, bm25_tokens, document_tokens).withColumn("used", F.lit("bm25")))
    for_hash = queries.where(F.col("model") == "semantic_hash")
    if not for_hash.isEmpty():
        hashed = hashed_rankings(tokens(for_hash, "user_id", hashed_tokens), tokens(jobs, "job_id", document_tokens), MAX_TOP_K)
        parts.append(hashed.withColumn("used", F.lit("semantic_hash")))
    ranked = parts[0]
    for part in parts[1:]:
        ranked = ranked.unionByName(part)

    warned = fallback.select("user_id", F.array(F.lit(FALLBACK_WARNING)).alias("_warning"))
    requested = queries.join(warned, "user_id", "left").withColumn(
        "warnings", F.coalesce("_warning", F.array().cast("array<string>"))
    ).drop("_warning", "model")
    pairs = ranked.join(requested, "user_id").where(F.col("rank") <= F.col("top_k"))
    pairs = pairs.withColumn("request_id", F.col("user_id")).withColumn("user_id", F.col("_candidate")).drop("_candidate")
    renamed = [F.col(c).alias(f"job_{c}") for c in jobs.columns if c != "job_id"]
    joined = pairs.join(jobs.select("job_id", *renamed), "job_id")
    explained = first_generation_evidence(joined)
    nothing = F.array().cast("array<string>")

    def shown(name: str) -> Column:
        return F.when(F.col("include_explanations"), F.col(name)).otherwise(nothing).alias(name)

    items = explained.select(
        "request_id", F.col("user_id").alias("candidate_id"), F.col("used").alias("model"), "top_k", "rank", "job_id",
        F.col("job_title").alias("title"), "score", F.col("job_city").alias("city_id"), F.col("job_job_type").alias("job_type"),
        shown("matched_skills"), shown("missing_skills"), shown("graph_paths"), shown("reasons"), "feature_evidence", "warnings",
    )
    return {"items": items, "rejects": rejected}


def health(candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """(item, count) of candidates and jobs."""

    def counted(df: DataFrame, item: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(item).alias("item"), "count")

    return counted(candidates, "candidates").union(counted(jobs, "jobs"))


# Documented extras: the other direction, sorting and pages ------------------------------------


def match_percent(score: Column, best: Column) -> Column:
    """Score as a whole percentage of the best possible score."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round(100.0 * score / best))).cast("int")


def paged(rows: DataFrame, group: str, sort_by: Column, tie: str, page: int, page_size: int) -> DataFrame:
    """One page per group with the group's total and number of pages; a group may be of any size."""
    numbered = position_in_group(rows.withColumn("_key", sort_by), [group], [F.desc("_key"), F.asc(tie)], "_pos")
    totals = numbered.groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    first = (page - 1) * page_size
    inside = numbered.where((F.col("_pos") >= first) & (F.col("_pos") < first + page_size))
    return inside.join(broadcast_if_small(totals), group).select(
        *[c for c in rows.columns], F.lit(page).alias("page"), (F.col("_pos") + 1).alias("place"), "total",
        F.ceil(F.col("total") / page_size).cast("long").alias("total_pages"),
    )


# Requirement variant and profile checks -------------------------------------------------------


def requirement_scores(pairs: DataFrame, users: DataFrame, jobs: DataFrame) -> DataFrame:
    """Features and weighted score of pairs under required and preferred skills."""
    joined = attach_profiles(pairs, users, jobs).select("user_id", "job_id", *requirement_features())
    return joined.withColumn("score", requirement_score())


def invalid_profiles(rows: DataFrame, required: list[str]) -> DataFrame:
    """Rows lacking a required value, with the reason naming the first one missing."""
    reason = F.lit(None).cast("string")
    for name in reversed(required):
        reason = F.when(F.coalesce(F.col(name).cast("string"), F.lit("")) == "", f"{name} is required").otherwise(reason)
    return rows.withColumn("reason", reason).where(F.col("reason").isNotNull())
