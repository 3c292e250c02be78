"""Roles of the given tables: who is a user, a job, an action, a text, a vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .functions.fields import behaviour_level
from .operators.interactions import jobs_with_behaviour, leave_last_out, restrict_to_known
from .plans.experiments import Bundle
from .session import cut_lineage, written

AS_OF_YEAR = 2024
MIN_VIEWS = 2


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; its schema is looked up once."""
    path = f"{folder}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def actions(spark: SparkSession, folder: str) -> DataFrame:
    """Raw action rows: one flag per event type, the item named in the event properties."""
    events = table(spark, folder, "events")
    flag = {"browsed": "view", "delivered": "click", "satisfied": "purchase"}
    return events.select(
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("jd_no"),
        *[F.when(F.col("event_type") == v, "1").otherwise("0").alias(k) for k, v in flag.items()],
        F.col("event_id").alias("row_index"),
    )


def levels(spark: SparkSession, folder: str) -> DataFrame:
    """Behaviour rows with a level above 0 and their natural keys."""
    raw = actions(spark, folder)
    level = behaviour_level(F.col("browsed"), F.col("delivered"), F.col("satisfied"), strict=True)
    return raw.select("user_id", F.col("jd_no").alias("job_id"), level.alias("level"), "row_index").where(
        F.col("user_id").isNotNull() & F.col("job_id").isNotNull() & (F.col("level") > 0)
    )


def all_jobs(spark: SparkSession, folder: str) -> DataFrame:
    kind, brand = F.lower("p_type"), F.lower("p_brand")
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("job_id"),
        F.col("p_name").alias("title"),
        (F.col("p_size") % 25).cast("string").alias("city"),
        kind.alias("job_type"),
        (F.col("p_size") % 9).cast("int").alias("min_degree_rank"),
        F.floor(F.col("p_size") / 10).cast("double").alias("min_years"),
        F.array_distinct(F.concat(F.split("p_name", " "), F.array(brand, kind))).alias("skills"),
        F.concat_ws(" ", "p_name", kind, brand).alias("text"),
        brand.alias("brand"),
        (F.col("p_partkey") % 7).cast("int").alias("priority"),
    )


def jobs(spark: SparkSession, folder: str, behaviour: DataFrame | None = None) -> DataFrame:
    """Catalogue: jobs with any behaviour (``behaviour``: the levels where they are at hand)."""
    return jobs_with_behaviour(all_jobs(spark, folder), levels(spark, folder) if behaviour is None else behaviour)


def users(spark: SparkSession, folder: str, behaviour: DataFrame | None = None) -> DataFrame:
    """Profiles of the users with behaviour: the skills and types met in at least two of all the jobs a user viewed."""
    behaviour = levels(spark, folder) if behaviour is None else behaviour
    viewed = behaviour.where(F.col("level") == 1).select("user_id", "job_id").distinct()
    met = viewed.join(all_jobs(spark, folder).select("job_id", "skills", "job_type"), "job_id")
    values = met.select("user_id", F.explode(F.concat(
        F.transform("skills", lambda s: F.struct(F.lit(True).alias("is_skill"), s.alias("value"))),
        F.array(F.struct(F.lit(False).alias("is_skill"), F.col("job_type").alias("value"))),
    )).alias("v")).select("user_id", "v.*")
    # a job holds a value once, so rows are jobs
    often = values.groupBy("user_id", "is_skill", "value").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= MIN_VIEWS)
    learnt = often.groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_skill"), F.col("value")))).alias("_skills"),
        F.array_sort(F.collect_list(F.when(~F.col("is_skill"), F.col("value")))).alias("_types"),
    )
    none = F.array().cast("array<string>")
    people = table(spark, folder, "customer").withColumnRenamed("c_custkey", "user_id")
    active = people.join(behaviour.select("user_id").distinct(), "user_id", "left_semi").join(learnt, "user_id", "left")
    return active.select(
        "user_id",
        F.col("c_nationkey").cast("string").alias("live_city"),
        F.array(((F.col("c_nationkey") + 1) % 25).cast("string")).alias("desired_cities"),
        F.coalesce("_skills", none).alias("skills"),
        F.coalesce("_types", none).alias("desired_types"),
        (1 + F.col("user_id") % 8).cast("int").alias("degree_rank"),
        F.floor(F.abs("c_acctbal") / 1000).cast("double").alias("years"),
        F.concat_ws(" ", F.concat_ws(" ", F.coalesce("_skills", none)), F.concat_ws(" ", F.coalesce("_types", none))).alias("text"),
        F.array(F.col("c_nationkey").cast("string")).alias("city_ids"),
        F.array(((F.col("c_nationkey") + 1) % 25).cast("string")).alias("desired_city_ids"),
        F.array(F.lower("c_mktsegment")).alias("industries"),
    )


def jobs_with_stated_degree(spark: SparkSession, folder: str, behaviour: DataFrame | None = None) -> DataFrame:
    """Catalogue with the degree label column of the first generation; rank 0 means unstated."""
    return jobs(spark, folder, behaviour).withColumn(
        "min_degree", F.when(F.col("min_degree_rank") == 0, "").otherwise(F.col("min_degree_rank").cast("string"))
    )


def interactions(spark: SparkSession, folder: str, min_level: int = 2, behaviour: DataFrame | None = None) -> DataFrame:
    """Split behaviour rows restricted to known users and jobs."""
    known = restrict_to_known(
        levels(spark, folder) if behaviour is None else behaviour,
        table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id")),
        table(spark, folder, "part").select(F.col("p_partkey").alias("job_id")),
    )
    return leave_last_out(known, min_level)


def bundle(spark: SparkSession, folder: str) -> Bundle:
    """The three processed tables, written once because every model reads them many times."""
    behaviour = written(levels(spark, folder), "levels")  # actions are parsed once
    return Bundle(
        cut_lineage(users(spark, folder, behaviour)), cut_lineage(jobs(spark, folder, behaviour)),
        cut_lineage(interactions(spark, folder, behaviour=behaviour)),
    )


def node_vectors(spark: SparkSession, folder: str, known: Bundle | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, vector) of users and jobs: users count up from the first stored vector, jobs down from the last.

    ``known`` gives the processed tables where they are at hand.
    """
    people, posts = (users(spark, folder), jobs(spark, folder)) if known is None else (known.users, known.jobs)
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    last = vectors.agg(F.max("vec_id").alias("last"))
    user_side = people.select(F.col("user_id").alias("vec_id")).join(vectors, "vec_id")
    job_side = posts.select("job_id").withColumn("vec_id", last.scalar() - F.col("job_id")).join(vectors, "vec_id")
    return user_side.select(F.col("vec_id").alias("id"), "vector"), job_side.select(F.col("job_id").alias("id"), "vector")


# Knowledge-graph build ------------------------------------------------------------------------


def raw_users(spark: SparkSession, folder: str) -> DataFrame:
    """``table1_user`` from customers: nations are cities, segments industries."""
    people = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    return people.select(
        F.col("c_custkey").cast("string").alias("user_id"),
        F.col("n_name").alias("live_city_id"),
        F.concat_ws(",", "n_name", F.concat(F.lit("NATION_"), (F.col("c_nationkey") + 1) % 25)).alias("desire_jd_city_id"),
        F.lower("c_mktsegment").alias("desire_jd_industry_id"),
        F.element_at(F.array(F.lit("ECONOMY/PROMO"), F.lit("LARGE"), F.lit("-")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("desire_jd_type_id"),
        F.col("c_mktsegment").alias("cur_industry_id"),
        F.lit("SMALL").alias("cur_jd_type"),
        F.element_at(F.array(F.lit("本科"), F.lit("硕士"), F.lit("null"), F.lit("大专")), (F.col("c_custkey") % 4 + 1).cast("int")).alias("cur_degree_id"),
        F.concat(F.lit("20"), F.lpad((F.col("c_custkey") % 24).cast("string"), 2, "0")).alias("start_work_date"),
        F.concat_ws("|", "c_mktsegment", F.concat(F.lit("Tier "), F.floor(F.abs("c_acctbal") / 1000)), F.lit("团队"), F.lit("Python/SQL")).alias("experience"),
        F.col("c_custkey").alias("row_index"),
    )


def raw_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """``table2_jd`` from parts; the company is the lowest-numbered supplier that shipped the part."""
    shipped = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("s_suppkey"))
    parts = table(spark, folder, "part").join(shipped, "p_partkey", "left").join(
        table(spark, folder, "supplier").select("s_suppkey", "s_name"), "s_suppkey", "left"
    )
    return parts.select(
        F.col("p_partkey").cast("string").alias("jd_no"),
        F.col("p_name").alias("jd_title"),
        F.coalesce("s_name", F.lit("")).alias("company_name"),
        F.concat(F.lit("NATION_"), F.col("p_size") % 25).alias("city"),
        F.col("p_type").alias("jd_sub_type"),
        F.element_at(F.array(F.lit("本科"), F.lit(""), F.lit("高中")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("min_edu_level"),
        (F.col("p_size") % 10).cast("string").alias("min_years"),
        F.concat_ws("，", F.concat(F.lit(" "), F.col("p_brand")), "p_type", F.lit("熟练"), F.col("p_name")).alias("job_description"),
        F.col("p_partkey").alias("row_index"),
    )


def raw_actions(spark: SparkSession, folder: str) -> DataFrame:
    rows = actions(spark, folder)
    return rows.select(F.col("user_id").cast("string").alias("user_id"), F.col("jd_no").cast("string").alias("jd_no"),
                       "browsed", "delivered", "satisfied", "row_index")
