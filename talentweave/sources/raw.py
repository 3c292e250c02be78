"""Raw tab-separated tables: lenient rows, all strings, stable row index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_value
from ..operators.ordering import capped_by_order, first_rows
from ..session import broadcast_if_small, cut_lineage

BOM = "﻿"
FILLER_JOBS = 500


def read_table(spark: SparkSession, path: str | Sequence[str], max_rows: int | None = None) -> DataFrame:
    """String columns named by the header line, plus a 0-based ``row_index`` in file order.

    Short rows are padded with empty strings, surplus tabs stay in the last column, invalid bytes become
    replacement characters, blank lines keep their place. The index comes from row counts per file split,
    so the rows themselves are neither sorted nor shuffled.
    """
    lines = (
        spark.read.option("lineSep", "\n").text(path)
        .select(
            F.regexp_replace(F.expr("make_valid_utf8(value)"), r"[\r\n]+$", "").alias("line"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_at"),
        )
    )
    first = lines.where(F.col("_start") == 0).orderBy("_file", "_at").select("line").first()
    header_line = first[0].removeprefix(BOM) if first else ""
    columns = header_line.split("\t")

    splits = lines.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = W.orderBy("_file", "_start").rowsBetween(W.unboundedPreceding, -1)
    offsets = cut_lineage(
        splits.select("_file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    indexed = lines.join(broadcast_if_small(offsets), ["_file", "_start"]).select(
        "line", (F.col("_offset") + F.col("_at") - F.col("_first") - 1).alias("row_index")
    )
    parts = F.split("line", "\t", len(columns))
    cells = [F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)]
    return first_rows(indexed.where(F.col("row_index") >= 0).select(*cells, "row_index"), max_rows)


def preview(table: DataFrame, width: int = 80) -> DataFrame:
    """(column, sample) of the first row, values cut for display."""
    names = [c for c in table.columns if c != "row_index"]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.substring(F.col(c), 1, width).alias("sample")) for c in names])
    return table.where(F.col("row_index") == 0).select(F.inline(cells))


def _one_row_per_id(rows: DataFrame, key: str) -> DataFrame:
    """A repeated id keeps the place of its first row and the content of its last one."""
    rest = [c for c in rows.columns if c not in (key, "row_index")]
    merged = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col("row_index")).alias("_r"), F.min("row_index").alias("row_index"))
    return merged.select(key, "_r.*", "row_index").select(*rows.columns)


def users_in_actions(users: DataFrame, interactions: DataFrame, max_users: int | None = None) -> DataFrame:
    """User rows seen in the actions, optionally only the first ``max_users`` in file order."""
    rows = users.withColumn("user_id", normalize_value(F.col("user_id"))).where(F.col("user_id") != "")
    known = rows.join(interactions.select("user_id").distinct(), "user_id", "left_semi")
    return capped_by_order(_one_row_per_id(known, "user_id"), max_users, ["row_index"])


def jobs_for_actions(jobs: DataFrame, interactions: DataFrame, max_jobs: int | None = None) -> DataFrame:
    """Jobs seen in the actions; with ``max_jobs`` also the first 500 jobs of the file, and not more than that many."""
    rows = jobs.withColumn("jd_no", normalize_value(F.col("jd_no"))).where(F.col("jd_no") != "")
    distinct_jobs = _one_row_per_id(rows, "jd_no")
    demanded = interactions.select(F.col("job_id").alias("jd_no")).distinct()
    if not max_jobs:
        return distinct_jobs.join(demanded, "jd_no", "left_semi")
    filler = capped_by_order(distinct_jobs.select("jd_no", "row_index"), min(max_jobs, FILLER_JOBS), ["row_index"])
    wanted = filler.select("jd_no").union(demanded).distinct()
    return capped_by_order(distinct_jobs.join(wanted, "jd_no", "left_semi"), max_jobs, ["row_index"])
