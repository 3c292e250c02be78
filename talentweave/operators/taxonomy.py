"""Occupation taxonomy: tree flattening and occupation deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import first_occurrence


def _rounds(pointers: DataFrame) -> int:
    """Rounds of doubling until every pointer (code, up) has passed its root; raises where one never does."""
    # a chain of n codes is passed after log2(n) doublings; whatever still points somewhere then goes round a cycle
    limit, rounds = pointers.count().bit_length() + 1, 0
    while not pointers.where("up is not null").isEmpty():
        if rounds == limit:
            raise ValueError("the taxonomy has a cycle")
        step = pointers.select(F.col("code").alias("up"), F.col("up").alias("_next")).distinct()
        pointers = cut_lineage(pointers.join(step, "up", "left").select("code", F.col("_next").alias("up")))
        rounds += 1
    return rounds


def flatten_tree(nodes: DataFrame) -> DataFrame:
    """(career_code, name, parent_code, path, has_children) of a (career_code, parent_code, name) table.

    Rows whose parent is missing are roots. Pointers to ancestors 1, 2, 4, ... steps away are followed, so the number of
    rounds grows with the logarithm of the depth; a row's path is the path of its ancestor's stretch and its own. Pointers
    alone go first: one that is still alive after more rounds than the longest chain needs lies on or under a cycle, which
    raises before any path grows.
    """
    base = cut_lineage(nodes.select("career_code", "parent_code", "name"))
    codes = base.where("career_code is not null").select(F.col("career_code").alias("up")).distinct()
    parents = base.withColumn("up", F.col("parent_code")).join(codes.withColumn("_known", F.lit(True)), "up", "left")
    state = cut_lineage(parents.select("career_code", "parent_code", "name", F.when(F.col("_known"), F.col("up")).alias("up"), F.array("name").alias("path")))
    rounds = _rounds(cut_lineage(state.where("career_code is not null").select(F.col("career_code").alias("code"), "up")))
    for _ in range(rounds):
        stretch = state.select(F.col("career_code").alias("up"), F.col("up").alias("_next"), F.col("path").alias("_above"))
        joined = state.join(stretch, "up", "left")
        path = F.when(F.col("_above").isNull(), F.col("path")).otherwise(F.concat("_above", "path"))
        state = cut_lineage(joined.select("career_code", "parent_code", "name", F.col("_next").alias("up"), path.alias("path")))
    with_children = base.select(F.col("parent_code").alias("career_code")).distinct().withColumn("_c", F.lit(True))
    found = state.select("career_code", "parent_code", "name", "path").join(with_children, "career_code", "left")
    return found.withColumn("has_children", F.col("_c").isNotNull()).drop("_c")


def latest_occupations(rows: DataFrame) -> DataFrame:
    """One row per (career_code, version_id), the last loaded wins; rows without either key are rejected."""
    valid = rows.where((F.coalesce("career_code", F.lit("")) != "") & F.col("version_id").isNotNull())
    return first_occurrence(valid, ["career_code", "version_id"], "row_index", last=True)
