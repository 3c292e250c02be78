"""Shards along a Hilbert curve: neighbours on the curve are near in every dimension, so each shard is a compact cell.

* Each dimension is quantised to ``2**bits`` cells by quantiles of the whole table (equal depth: a value held by a third
  of the rows does not squeeze the others into one cell). Texts are compared whole, in byte order; their quantiles come
  from the running sum of the distinct values' counts.
* The cells' Hilbert index orders the rows; rows of one cell come by size, text checksum and id, so equal texts of equal
  metadata are neighbours. Positions come from range partitions and their sizes, never from one sorting task.
* The order is cut into runs: shard s holds the positions from ceil(s n / shards) on, so row counts differ by at most 1
  (law ``rows``), and ``slot`` counts from 0 inside a shard.

Files written by shard then have narrow minimum and maximum statistics in each dimension, and filters on any of them
skip most files.

Defined cases: a null dimension is its lowest cell; a null text has size 1 (no bytes plus one) and checksum 0; repeated
rows get slots of their own; an empty table gives no rows; other columns come through.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.ordering import global_position
from ..session import cut_lineage

LAW = "rows"


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer cells (points x dimensions), after Skilling (2004)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    # undo the excess rotations from the highest bit down
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(dims):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn, bit = np.zeros_like(x[0]), 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where((x[dims - 1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, StringType)


def text_cuts(df: DataFrame, name: str, bits: int) -> list[str]:
    """The values that hold the ranks i n / 2**bits of a text column's n values, each once, in order."""
    counts = df.select(F.col(name).alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    parts = cut_lineage(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.sum("n").alias("size"))
    offsets = sizes.select("part", (F.sum("size").over(W.orderBy("part")) - F.col("size")).alias("offset"))
    total = parts.agg(F.sum("n")).first()[0]
    if not total:
        return []
    inside = F.sum("n").over(W.partitionBy("part").orderBy("value"))
    placed = parts.withColumn("inside", inside).join(F.broadcast(offsets), "part").withColumn("upto", F.col("offset") + F.col("inside"))
    held = placed.where(f"least((upto * {2**bits}) div {total}, {2**bits - 1}) > ((upto - n) * {2**bits}) div {total}")
    return sorted(r.value for r in held.select("value").collect())


def cuts(df: DataFrame, dimensions: Sequence[str], bits: int) -> dict[str, list]:
    """Inner cell bounds of every dimension: at most 2**bits - 1 quantiles each."""
    shares = [i / 2**bits for i in range(1, 2**bits)]
    numbers = [d for d in dimensions if not is_text(df, d)]
    found = {d: text_cuts(df, d, bits) for d in dimensions if d not in numbers}
    if numbers:
        row = df.agg(*[F.percentile_approx(F.col(d).cast("double"), shares, 10_000).alias(str(i)) for i, d in enumerate(numbers)]).first()
        found |= {d: sorted(set(row[i] or [])) for i, d in enumerate(numbers)}
    return found


def with_curve(df: DataFrame, dimensions: Sequence[str], bits: int = 5) -> DataFrame:
    """``df`` with its rows' index along the curve in column ``curve``."""
    bounds = cuts(df, dimensions, bits)
    texts = {d for d in dimensions if is_text(df, d)}

    def value(d: str) -> Column:
        """A number, or the cell of a text: the bounds up to it."""
        if d not in texts:
            return F.col(d).cast("double")
        inner = F.array(*[F.lit(x) for x in bounds[d]]).cast("array<string>")
        return F.when(F.col(d).isNull(), 0).otherwise(F.size(F.filter(inner, lambda x: x <= F.col(d)))).cast("double")

    numbers = {d: bounds[d] for d in dimensions if d not in texts}

    @F.pandas_udf("long")
    def curve(*values: pd.Series) -> pd.Series:
        # a null becomes NaN and, below every bound, the lowest cell
        cells = [
            np.searchsorted(np.array(numbers[d], float), v.astype(float).fillna(-np.inf), side="right") if d in numbers else v.to_numpy().astype(np.int64)
            for d, v in zip(dimensions, values, strict=True)
        ]
        return pd.Series(hilbert_index(np.stack(cells, axis=1), bits))

    return df.withColumn("curve", curve(*[value(d) for d in dimensions]))


def sharded(df: DataFrame, dimensions: Sequence[str], ties: Sequence[str], shards: int = 16, bits: int = 5) -> DataFrame:
    """``df`` with columns shard and slot."""
    placed = global_position(with_curve(df, dimensions, bits), ["curve", *ties], "_at")
    rows = placed.count()
    shard = F.expr(f"(_at * {shards}) div {max(rows, 1)}")
    first = F.expr(f"(shard * {rows} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_at") - first).drop("_at", "curve")


def document_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, lang, source, n_chars, size, text_crc32, law, shard, slot and grown_shard of every document."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    narrow = docs.select("doc_id", "lang", "source", "n_chars", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharded(narrow, ["lang", "source", "size"], ["size", "text_crc32", "doc_id"], shards)
    return placed.withColumn("law", F.lit(LAW)).withColumn("grown_shard", F.lit(None).cast("int"))


def write_shards(docs: DataFrame, plan: DataFrame, path: str) -> None:
    """Write whole documents, a folder for each shard, sorted by slot. ``doc_id`` must be unique."""
    rows = docs.join(plan.select("doc_id", "shard", "slot"), "doc_id")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
