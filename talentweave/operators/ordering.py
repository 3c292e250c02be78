"""Row numbering, first occurrences, top-k: the ordering jobs that must not run in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage


def global_position(df: DataFrame, order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """0-based position of every row in the given total order, without a one-task sort.

    Rows are range-partitioned and sorted inside their partitions, and the result is written once so
    that both branches below see the same partitions. Only the partition sizes are summed up in one
    place. ``order`` must end in a unique key.
    """
    in_partition = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    ordered = cut_lineage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", in_partition)
    )
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        ordered.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_row"))
        .drop("_part", "_row", "_offset")
    )


def position_in_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str = "position"
) -> DataFrame:
    """0-based position of every row inside its group; a group may be larger than one task can sort."""
    numbered = global_position(df, [*group, *order], "_at")
    starts = numbered.groupBy(*group).agg(F.min("_at").alias("_start"))
    return numbered.join(starts, list(group)).withColumn(name, F.col("_at") - F.col("_start")).drop("_at", "_start")


def first_rows(df: DataFrame, n: int | None, index: str = "row_index") -> DataFrame:
    """Deterministic prefix by the row index; no cut when ``n`` is missing or not positive."""
    return df if not n or n <= 0 else df.where(F.col(index) < n)


def capped_by_order(df: DataFrame, n: int | None, order: Sequence[Column | str]) -> DataFrame:
    """The first ``n`` rows in a total order; each task keeps ``n`` rows before the merge."""
    return df if not n or n <= 0 else df.orderBy(*order).limit(n)


def first_occurrence(df: DataFrame, keys: Sequence[str], order: str, last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by ``order``.

    An aggregate with map-side combine, so a key that owns a third of all rows sends one row per task.
    """
    pick = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.col(order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, name: str = "rank"
) -> DataFrame:
    """First ``n`` rows of every group with their 1-based rank.

    Spark limits each group to ``n`` rows per task before the shuffle (``WindowGroupLimit``), so a hot
    group costs at most ``n`` rows per task.
    """
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def exploded_range(df: DataFrame, length: Column, name: str, chunk: int = 8192) -> DataFrame:
    """One row per 0 <= ``name`` < ``length``, made in chunks: a long range never sits in one array or one task."""
    starts = df.withColumn("_len", length.cast("long")).where(F.col("_len") > 0).withColumn(
        "_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_len") - 1, F.lit(chunk).cast("long")))
    )
    # only ranges longer than one chunk are worth spreading
    short, long = starts.where(F.col("_len") <= chunk), starts.where(F.col("_len") > chunk)
    pieces = short.unionByName(long.repartition(F.xxhash64(*df.columns, "_from")))
    last = F.least(F.col("_len"), F.col("_from") + chunk) - 1
    return pieces.withColumn(name, F.explode(F.sequence(F.col("_from"), last))).drop("_len", "_from")


def systematic_sample(df: DataFrame, key: str, size: int) -> DataFrame:
    """Every (count // size)-th row in key order."""
    numbered = global_position(df, [key], "_at")
    step = F.greatest(F.lit(1), F.floor(F.lit(numbered.count()) / size))
    return numbered.where(F.col("_at") % step == 0).drop("_at")


def dense_index(df: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct keys with dense ids in key order."""
    return global_position(df.select(key).distinct(), [key], name)
