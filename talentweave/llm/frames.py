"""Small helpers of the document operators: reading tables, reserved names, learning folds."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text divides by 5. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def by_batch(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``work`` to each Arrow batch of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return df.mapInArrow(run, schema)


def ordered_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, the first by a hash of ``key``: a sample that doesn't depend on partitions."""
    return df.orderBy(F.xxhash64(key), key).limit(rows)


def kept(key: tuple, build: Callable[[], Any]) -> Any:
    """``build()``, once per worker process. Functions travel by value, so a module's own table would be new in every task."""
    store = sys.__dict__.setdefault("_talentweave_kept", {})
    if key not in store:
        store[key] = build()
    return store[key]
