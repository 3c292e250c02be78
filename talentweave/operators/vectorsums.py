"""Sums and means of vectors by key, with one buffer per key that holds a whole vector."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small

HUB = 1_000_000


def hub_slices(edges: DataFrame, keys: list[str], spread_by: str, limit: int = HUB) -> tuple[DataFrame, bool]:
    """``edges`` with a column ``slice``, and whether any key has more than ``limit`` rows.

    Rows of such a key are dealt to slices of about ``limit`` rows by the hash of ``spread_by``; all others are in slice 0.
    At most one key in ``limit`` rows is a hub, so the list of hubs is short beside the edges.
    """
    hubs = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit)
    if hubs.isEmpty():
        return edges.withColumn("slice", F.lit(0)), False
    wide = edges.join(broadcast_if_small(hubs), keys, "left")
    drawn = F.pmod(F.xxhash64(spread_by), F.ceil(F.col("_rows") / limit)).cast("int")
    return wide.withColumn("slice", F.coalesce(drawn, F.lit(0))).drop("_rows"), True


def vector_sums(rows: DataFrame, keys: list[str], weight: str | None = None, slices: bool = False, mean: bool = False) -> DataFrame:
    """(keys, vector): element-wise sum, weighted sum, or mean of the column ``vector`` (array of doubles).

    Every task adds its rows up first and passes on one vector per key. With ``slices`` the rows are added up by
    (keys, ``slice``) and the slices afterwards, so that no task meets all partial sums of a hub. Rows without a vector
    do not count; a key with none of them gives no row. Weights are above 0 and are not used for means.
    """
    used = rows.where(F.col("vector").isNotNull()).withColumn("_n", F.lit(1))
    vector = array_to_vector(F.col("vector"))
    first = [*keys, "slice"] if slices else keys
    total = Summarizer.sum(vector, F.col(weight)) if weight else Summarizer.sum(vector)
    added = used.groupBy(*first).agg(vector_to_array(total).alias("vector"), F.sum("_n").alias("_n"))
    if slices:
        added = added.groupBy(*keys).agg(vector_to_array(Summarizer.sum(vector)).alias("vector"), F.sum("_n").alias("_n"))
    if not mean:
        return added.select(*keys, "vector")
    # the count travels as an array so that the division stays one expression over both
    counts = F.array_repeat(F.col("_n"), F.size("vector"))
    return added.select(*keys, F.zip_with("vector", counts, lambda x, n: x / n).alias("vector"))
