"""Readers of processed tables, vectors, stored rankings, graph statistics and occupation references."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_token, normalize_value, standard_name, task_phrases

RANKING_SCHEMA = "user_id string, job_id string, rank int"
REFERENCE_SCHEMA = T.StructType(
    [
        *[T.StructField(c, T.ArrayType(T.StringType())) for c in
          ("career_categories", "occupation_terms", "work_type_terms", "standard_terms", "task_terms")],
        # items may be objects or plain strings, so they are read as JSON text
        T.StructField("occupations", T.ArrayType(T.StringType())),
        T.StructField("standards", T.ArrayType(T.StringType())),
    ]
)
OCCUPATION = "name string, careerName string, career_name string, task string, works array<struct<name: string>>"
STANDARD = "name string, standardInfoName string"


def read_graph_stats(spark: SparkSession, path: str) -> DataFrame:
    """(item, count) of an exported statistics file; blank counts are 0."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    number = F.nullif(normalize_value(F.col("count")), F.lit("")).cast("double").cast("long")
    return rows.select(normalize_value(F.col("item")).alias("item"), F.coalesce(number, F.lit(0)).cast("long").alias("count"))


def read_processed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """users, jobs, interactions and skill_vocab tables of a run."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in ("users", "jobs", "interactions", "skill_vocab")}


def read_vectors(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """(id, vector) tables of users, jobs and skills; the key is a column, not a row position."""
    return {name: spark.read.parquet(f"{folder}/emb_{name}") for name in ("user", "job", "skill")}


def read_rankings(spark: SparkSession, path: str) -> DataFrame:
    """Stored (user_id, job_id, rank); a missing path or a table of another shape gives no rows."""
    empty = spark.createDataFrame([], RANKING_SCHEMA)
    try:
        table = spark.read.parquet(path)
    except AnalysisException:
        return empty
    if not {"user_id", "job_id", "rank"} <= set(table.columns):
        return empty
    return table.select(F.col("user_id").cast("string"), F.col("job_id").cast("string"), F.col("rank").cast("int"))


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (kind, term) of an occupation reference JSON: occupation, category, work_type, standard, task."""
    return reference_terms(spark.read.option("multiLine", True).schema(REFERENCE_SCHEMA).json(path))


def reference_terms(raw: DataFrame) -> DataFrame:
    """Flatten reference documents into distinct (kind, term) rows."""

    def cleaned(column: Column) -> Column:
        return F.lower(clean_token(column))

    def listed(kind: str, column: str) -> DataFrame:
        return raw.select(F.lit(kind).alias("kind"), F.explode(column).alias("_t")).select("kind", cleaned(F.col("_t")).alias("term"))

    def parsed(column: str, schema: str) -> DataFrame:
        items = raw.select(F.explode(column).alias("_raw")).where(F.col("_raw").isNotNull())
        return items.withColumn("_o", F.when(F.col("_raw").startswith("{"), F.from_json("_raw", schema)))

    def many(rows: DataFrame, kind: str, values: Column) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), F.explode(values).alias("term"))

    occupations = parsed("occupations", OCCUPATION)
    standards = parsed("standards", STANDARD)
    plain = F.col("_o").isNull()
    names = F.transform(F.array("_o.name", "_o.careerName", "_o.career_name"), cleaned)
    parts = [
        listed("category", "career_categories"),
        listed("occupation", "occupation_terms"),
        listed("work_type", "work_type_terms"),
        listed("standard", "standard_terms"),
        listed("task", "task_terms"),
        many(occupations.where(~plain), "occupation", names),
        many(occupations.where(plain), "occupation", F.array(cleaned(F.col("_raw")))),
        many(occupations.where(~plain), "work_type", F.transform("_o.works", lambda w: cleaned(w["name"]))),
        many(occupations.where(~plain), "task", task_phrases(F.col("_o.task"))),
        many(standards.where(~plain), "standard", F.transform(F.array("_o.name", "_o.standardInfoName"), standard_name)),
        many(standards.where(plain), "standard", F.array(standard_name(F.col("_raw")))),
    ]
    terms = parts[0]
    for part in parts[1:]:
        terms = terms.unionByName(part)
    return terms.where(F.coalesce("term", F.lit("")) != "").distinct()
