"""Blocks of rows that each task reads in full, as often as it needs: written once to the checkpoint folder, never shuffled.

``packed`` puts the rows of a table into Arrow blocks of bounded size. ``streamed`` runs tasks that hold something of their own
(some queries, say) and read all blocks pass by pass, one block at a time; a task may end before its last pass. Spark
reads the blocks for the tasks, so they may lie in any store that it can reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

BLOCK_BYTES = 8_000_000
OUT_ROWS = 500_000
Passes = Iterator[tuple[int, Iterator[tuple[str, pa.Table]]]]


def _bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _table(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(payload)).read_all()


def packed(rows: DataFrame, source: str) -> RDD[bytes]:
    """The rows of each partition in blocks of about ``BLOCK_BYTES`` at most, written to the checkpoint folder."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks().replace_schema_metadata({"source": source})
            return pa.RecordBatch.from_pydict({"payload": pa.array([_bytes(table)], pa.binary())})

        for batch in batches:
            step = max(1, int(BLOCK_BYTES * batch.num_rows // max(1, batch.nbytes)))
            for start in range(0, batch.num_rows, step):
                piece = batch.slice(start, step)
                if held and size + piece.nbytes > BLOCK_BYTES:
                    yield block()
                    held, size = [], 0
                held.append(piece)
                size += piece.nbytes
        if held:
            yield block()

    ensure_checkpoint_dir(rows.sparkSession)
    # as opaque bytes: Spark need not look into a block when it is read
    blocks = rows.mapInArrow(pack, "payload binary").rdd.map(lambda row: bytes(row[0]))
    blocks.checkpoint()
    blocks.count()
    return blocks


def streamed(sources: list[RDD[bytes]], tasks: int, passes: int, task: Callable[[int, Passes], Iterator[pa.Table]]) -> RDD[tuple[bytes]]:
    """What ``task(number, passes)`` yields for 0 <= number < ``tasks``, in Arrow blocks.

    Each of the ``passes`` is (number, blocks), blocks being (name of the source, table) of all ``sources`` in no stated order.
    """
    context = sources[0].context
    blocks = (context.union(sources) if len(sources) > 1 else sources[0]).coalesce(1)
    # one step in each batch: all blocks for a task's first step come before any for the second
    steps = context.parallelize([(t, p) for t in range(tasks) for p in range(passes)], tasks * passes).coalesce(tasks)

    def read(pairs: Iterator[tuple[tuple[int, int], bytes]]) -> Iterator[tuple[str, pa.Table]]:
        for _, payload in pairs:
            table = _table(payload)
            yield table.schema.metadata[b"source"].decode(), table

    def run(pairs: Iterator[tuple[tuple[int, int], bytes]]) -> Iterator[tuple[bytes]]:
        met = groupby(pairs, key=lambda pair: pair[0])
        for (number, first), own in met:
            steps_ = chain([(first, own)], ((at, some) for (_, at), some in met))
            for table in task(number, ((at, read(some)) for at, some in steps_)):
                for start in range(0, table.num_rows, OUT_ROWS):
                    yield (_bytes(table.slice(start, OUT_ROWS)),)
            return

    return steps.cartesian(blocks).mapPartitions(run)


def unpacked(spark: SparkSession, blocks: RDD[tuple[bytes]], schema: str) -> DataFrame:
    """The rows of blocks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("payload"):
                yield from _table(payload.as_py()).to_batches()

    return spark.createDataFrame(blocks, "payload binary", verifySchema=False).mapInArrow(rows, schema)
