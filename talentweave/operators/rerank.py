"""Collaborative factors, node inputs, pair models and the two-stage ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import structured_numeric
from ..session import broadcast_if_small, cut_lineage
from .dense import dense_rankings, dot, unit
from .ordering import dense_index
from .scoring import two_stage

RECALL_K = 500


def _int_id(name: str) -> Column:
    """ALS takes 32-bit ids; a larger one must not wrap around silently."""
    fits = F.col(name) < (1 << 31)
    return F.when(fits, F.col(name).cast("int")).otherwise(F.raise_error(F.lit("more users or jobs than ALS can number"))).alias(name)


def als_factors(
    pairs: DataFrame, rank: int = 32, iterations: int = 10, regularization: float = 0.05, alpha: float = 10.0, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """User and job factors (id, vector) from implicit train pairs (user_id, job_id, level)."""
    users = cut_lineage(dense_index(pairs, "user_id", "_u"))
    jobs = cut_lineage(dense_index(pairs, "job_id", "_j"))
    ratings = (
        pairs.groupBy("user_id", "job_id").agg(F.max("level").cast("float").alias("rating"))
        .join(users, "user_id").join(jobs, "job_id")
        .select(_int_id("_u"), _int_id("_j"), "rating")
    )
    model = ALS(
        userCol="_u", itemCol="_j", ratingCol="rating", implicitPrefs=True, rank=rank, maxIter=iterations,
        regParam=regularization, alpha=alpha, seed=seed,
    ).fit(ratings)

    def named(factors: DataFrame, index: DataFrame, position: str, key: str) -> DataFrame:
        vectors = factors.select(F.col("id").cast("long").alias(position), F.transform("features", lambda x: x.cast("double")).alias("vector"))
        return index.join(vectors, position).select(F.col(key).alias("id"), "vector")

    return named(model.userFactors, users, "_u", "user_id"), named(model.itemFactors, jobs, "_j", "job_id")


def split_nodes(nodes: DataFrame, user_type: str, job_type: str) -> tuple[DataFrame, DataFrame]:
    """Propagated nodes (``c:…`` / ``j:…``) back as (id, vector) of users and jobs."""

    def side(prefix: str, id_type: str) -> DataFrame:
        mine = nodes.where(F.col("node").startswith(prefix))
        return mine.select(F.expr("substring(node, 3)").cast(id_type).alias("id"), "vector")

    return side("c:", user_type), side("j:", job_type)


def tagged_nodes(users: DataFrame, jobs: DataFrame) -> DataFrame:
    """(node, vector) of user and job vectors."""
    return users.select(F.concat(F.lit("c:"), "id").alias("node"), "vector").unionByName(
        jobs.select(F.concat(F.lit("j:"), "id").alias("node"), "vector")
    )


def category_codes(values: DataFrame, name: str) -> DataFrame:
    """(value, code): dense codes from 1 in value order, 0 is left for unknown."""
    coded = dense_index(values.where(F.col(name) != ""), name, "_code")
    return coded.select(name, (F.col("_code") + 1).cast("int").alias("code"))


def node_inputs(
    users: DataFrame, jobs: DataFrame, text_vectors_users: DataFrame, text_vectors_jobs: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Model inputs per user and per job: text vector, city and type codes, scaled degree and years.

    Cities and types share one code table between users and jobs; a user's type is its first desired one.
    """
    first_type = F.coalesce(F.get("desired_types", F.lit(0)), F.lit(""))
    cities = category_codes(users.select(F.col("live_city").cast("string").alias("value")).union(jobs.select(F.col("city").cast("string"))), "value")
    types = category_codes(users.select(first_type.alias("value")).union(jobs.select("job_type")), "value")

    def side(df: DataFrame, key: str, city: Column, kind: Column, degree: str, years: str, text: DataFrame) -> DataFrame:
        rows = df.select(
            F.col(key).alias("id"), city.cast("string").alias("_city"), kind.alias("_type"),
            structured_numeric(F.col(degree), F.col(years)).alias("structured"),
        )
        coded = rows.join(broadcast_if_small(cities.select(F.col("value").alias("_city"), F.col("code").alias("city_code"))), "_city", "left")
        coded = coded.join(broadcast_if_small(types.select(F.col("value").alias("_type"), F.col("code").alias("type_code"))), "_type", "left")
        return coded.fillna(0, ["city_code", "type_code"]).join(text, "id", "left").select(
            "id", "city_code", "type_code", "structured", "vector"
        )

    return (
        side(users, "user_id", F.col("live_city"), first_type, "degree_rank", "years", text_vectors_users),
        side(jobs, "job_id", F.col("city"), F.col("job_type"), "min_degree_rank", "min_years", text_vectors_jobs),
    )


def fuse_vectors(inputs: DataFrame, dim: int) -> DataFrame:
    """(id, vector): text vector with structured numbers and hashed city and type indicators added at fixed places."""
    def indicator(code: Column, name: str) -> Column:
        drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(name), code.cast("string"))), 1, 15), 16, 10).cast("long")
        return F.when(code > 0, drawn % dim).otherwise(-1)

    places = F.sequence(F.lit(0), F.lit(dim - 1))
    city, kind = indicator(F.col("city_code"), "city"), indicator(F.col("type_code"), "type")
    extra = F.transform(
        F.arrays_zip(places.alias("p"), F.array_repeat(F.struct(city.alias("c"), kind.alias("t"), F.col("structured").alias("s")), dim).alias("x")),
        lambda e: F.when(e["p"] == e["x"]["c"], 0.1).otherwise(0.0) + F.when(e["p"] == e["x"]["t"], 0.1).otherwise(0.0)
        + F.when(e["p"] == 0, e["x"]["s"][0]).when(e["p"] == 1, e["x"]["s"][1]).otherwise(0.0) * 0.1,
    )
    base = F.coalesce(F.transform("vector", lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), dim))
    return inputs.select("id", F.zip_with(base, extra, lambda a, b: a + b).alias("vector"))


# Pair models ----------------------------------------------------------------------------------


def interaction_vector(user: Column, job: Column) -> Column:
    """[u, j, |u - j|, u * j]."""
    return F.concat(user, job, F.zip_with(user, job, lambda a, b: F.abs(a - b)), F.zip_with(user, job, lambda a, b: a * b))


def residual_dot(local_user: Column, local_job: Column, global_user: Column, global_job: Column) -> Column:
    """(local dot + global dot) / sqrt 2 of unit vectors."""
    return (dot(local_user, local_job) + dot(global_user, global_job)) / F.sqrt(F.lit(2.0))


def concat_views(local: DataFrame, overall: DataFrame) -> DataFrame:
    """(id, vector) of the two unit vectors side by side, scaled so that a dot product is the residual score."""
    scale = F.sqrt(F.sqrt(F.lit(2.0)))
    joined = local.select("id", unit(F.col("vector")).alias("_a")).join(
        overall.select("id", unit(F.col("vector")).alias("_b")), "id", "left"
    )
    return joined.select("id", F.transform(F.concat("_a", "_b"), lambda x: x).alias("_v"), scale.alias("_s")).select(
        "id", F.transform(F.arrays_zip(F.col("_v").alias("x"), F.array_repeat("_s", F.size("_v")).alias("s")), lambda e: e["x"] / e["s"]).alias("vector")
    )


def attach_vectors(pairs: DataFrame, users: DataFrame, jobs: DataFrame) -> DataFrame:
    """Pairs with ``user_vector`` and ``job_vector``."""
    return pairs.join(users.select(F.col("id").alias("user_id"), F.col("vector").alias("user_vector")), "user_id").join(
        jobs.select(F.col("id").alias("job_id"), F.col("vector").alias("job_vector")), "job_id"
    )


def scaled_dot(dim: int) -> Column:
    return dot(F.col("user_vector"), F.col("job_vector")) / F.sqrt(F.lit(float(dim)))


def train_pair_model(labelled: DataFrame, numeric: Sequence[str], vectors: Sequence[str] = (), regularization: float = 0.01) -> PipelineModel:
    """Logistic head over numeric columns and array columns; ``label`` is 1.0 for positives."""
    prepared = _as_vectors(labelled, vectors)
    stages = [
        VectorAssembler(inputCols=[*numeric, *[f"_{v}" for v in vectors]], outputCol="_raw", handleInvalid="error"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=False, withStd=True),
        LogisticRegression(featuresCol="features", labelCol="label", regParam=regularization, maxIter=50),
    ]
    return Pipeline(stages=stages).fit(prepared)


def _as_vectors(df: DataFrame, vectors: Sequence[str]) -> DataFrame:
    for name in vectors:
        df = df.withColumn(f"_{name}", array_to_vector(F.col(name)))
    return df


def score_pairs(model: PipelineModel, pairs: DataFrame, vectors: Sequence[str] = (), residual: Column | None = None) -> DataFrame:
    """(user_id, job_id, score): raw margin of the head plus an optional residual term."""
    margin = F.get(vector_to_array("rawPrediction"), F.lit(1))
    scored = model.transform(_as_vectors(pairs, vectors))
    return scored.select("user_id", "job_id", (margin + residual if residual is not None else margin).alias("score"))


def labelled_pairs(train: DataFrame, negatives: DataFrame) -> DataFrame:
    """(user_id, job_id, label) of positives and sampled negatives."""
    return train.select("user_id", "job_id").distinct().withColumn("label", F.lit(1.0)).unionByName(
        negatives.select("user_id", F.col("negative_id").alias("job_id")).distinct().withColumn("label", F.lit(0.0))
    )


def pair_levels(train_pairs: DataFrame, interactions: DataFrame, default: int = 2) -> DataFrame:
    """(user_id, job_id, level): behaviour level of train pairs, the last train row wins, else the default."""
    rows = interactions.where((F.col("level") >= 2) & (F.col("split") == "train"))
    levels = rows.groupBy("user_id", "job_id").agg(F.max_by("level", "row_index").alias("_level"))
    return train_pairs.select("user_id", "job_id").join(levels, ["user_id", "job_id"], "left").select(
        "user_id", "job_id", F.coalesce("_level", F.lit(default)).alias("level")
    )


def recall_and_rerank(
    user_vectors: DataFrame, job_vectors: DataFrame, exclude: DataFrame, score_head, topn: int = 1000, recall_k: int = RECALL_K, **blocks: int
) -> DataFrame:
    """Dot-product recall of ``topn`` jobs, the first ``recall_k`` re-ordered by ``score_head(pairs)``."""
    first = cut_lineage(dense_rankings(user_vectors, job_vectors, topn, exclude, **blocks))
    head = first.where(F.col("rank") <= recall_k).select("user_id", "job_id")
    return two_stage(first, score_head(head), recall_k)
