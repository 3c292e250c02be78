"""Token files: the ids of all documents in ascending order of id, as independently coded blocks, written and read back.

* Documents are put in order by range partitions; each task encodes its texts, appends ``END_ID`` to each, and cuts the
  ids into blocks of ``context_coder.BLOCK``. Blocks of a task are coded side by side, up to ``LANES`` at a time.
* A token file is a Parquet table with one row per block: ``part`` (parts follow one another), ``first`` (ids before the
  block in its part), ``n_ids``, ``payload`` (the coded block with its own head and checksum) and ``docs``: id, place and
  length of each document that has ids in the block, so every block can be decoded by itself. The table is written by
  Spark, so a lost task leaves nothing behind.
* Reading decodes blocks in any order. Checksums of a document that lies in several blocks are put together from the
  checksums of its pieces; its ids never have to meet in one place.

Defined cases: a null or empty text has the end id alone. Rows without doc_id come first; rows that repeat a doc_id follow
one another, ordered by a hash of the text. An empty table gives an empty file. Extra columns are ignored. A damaged block
raises when it is read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from . import context_coder as coder
from .byte_pieces import encoder
from .frames import by_batch

END_ID = 0
_POLYNOMIAL = 0xEDB88320  # fixed value: the reflected polynomial of crc32


def _times(a: int, b: int) -> int:
    """Product of two reflected polynomials modulo that of crc32."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def joined_crc(left: int, right: int, n: int) -> int:
    """crc32 of two byte strings in a row from their own ones; the second is ``n`` bytes long."""
    shift, square = 1 << 31, 1 << 23  # 1 and x**8
    while n:
        if n & 1:
            shift = _times(shift, square)
        square = _times(square, square)
        n >>= 1
    return _times(shift, left) ^ right


class _Blocks:
    """The ids of a task's documents on their way into blocks."""

    def __init__(self, part: int):
        self.part, self.held, self.docs, self.before, self.waiting = part, [], [], 0, 0

    def add(self, doc, ids: bytes) -> None:
        n = len(ids) // 2
        self.held.append(ids)
        self.docs.append((doc, self.before + self.waiting, n))
        self.waiting += n

    def rows(self, all_of_it: bool) -> list[tuple]:
        """Coded blocks of what waits: whole ones, and the rest too if nothing will follow."""
        ids = np.frombuffer(b"".join(self.held), "<u2")
        take = len(ids) if all_of_it else len(ids) // coder.BLOCK * coder.BLOCK
        cuts = range(0, take, coder.BLOCK)
        blocks = [ids[at : min(at + coder.BLOCK, take)] for at in cuts]
        out, docs, k = [], self.docs, 0
        for at, block, payload in zip(cuts, blocks, coder.packed(blocks), strict=True):
            low, high = self.before + at, self.before + at + len(block)
            while docs[k][1] + docs[k][2] <= low:
                k += 1
            inside, j = [], k
            while j < len(docs) and docs[j][1] < high:
                inside.append({"doc_id": docs[j][0], "at": docs[j][1], "n": docs[j][2]})
                j += 1
            out.append((self.part, low, len(block), payload, inside))
        self.before += take
        self.docs = [d for d in docs[k:] if d[1] + d[2] > self.before]
        self.held, self.waiting = [ids[take:].tobytes()], len(ids) - take
        return out


def write_token_file(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Write the ids of ``docs(doc_id, text)`` as a token file to the folder ``path``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    # copies of one row may be dealt to several parts
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("_text"), F.monotonically_increasing_id().alias("_row"))
    ordered = ordered.repartitionByRange("doc_id", "_text", "_row").sortWithinPartitions("doc_id", "_text", "_row")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end, own, schema = encoder(tokenizer, True), np.array([END_ID], "<u2").tobytes(), None, None

        def emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(rows), 256):
                columns = zip(*rows[i : i + 256], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            if own is None:
                doc = pa.struct([("doc_id", batch.column("doc_id").type), ("at", pa.int64()), ("n", pa.int64())])
                schema = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary()), ("docs", pa.list_(doc))])
                own = _Blocks(batch.column("part")[0].as_py())
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own.add(doc_id, known.encode(text or "") + end)
                if own.waiting >= coder.BLOCK * coder.LANES:
                    yield from emit(own.rows(False))
        if own is not None:
            yield from emit(own.rows(True))

    fields = f"part int, first bigint, n_ids bigint, payload binary, docs array<struct<doc_id:{kind},at:bigint,n:bigint>>"
    blocks = ordered.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(work, fields)
    blocks.write.option("compression", "none").parquet(path)


def _pieces(blocks: DataFrame) -> DataFrame:
    """(part, doc_id, at, n, piece, piece_n, crc) of each document's ids in each block."""
    kind = blocks.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        docs = batch.column("docs")
        ends, fields = docs.offsets.to_pylist(), {c: docs.values.field(c) for c in ("doc_id", "at", "n")}
        at, n = fields["at"].to_numpy(), fields["n"].to_numpy()
        first, payload = batch.column("first").to_pylist(), batch.column("payload").to_pylist()
        for low in range(0, batch.num_rows, coder.LANES):
            high = min(low + coder.LANES, batch.num_rows)
            row, start, size, check = [], [], [], []
            for k, ids in zip(range(low, high), coder.unpacked(payload[low:high]), strict=True):
                data = memoryview(ids.astype("<u4").tobytes())
                for j in range(ends[k], ends[k + 1]):
                    a = max(int(at[j]) - first[k], 0)
                    b = min(int(at[j] + n[j]) - first[k], len(ids))
                    row.append(k)
                    start.append(first[k] + a)
                    size.append(b - a)
                    check.append(zlib.crc32(data[4 * a : 4 * b]))
            own = slice(ends[low], ends[high])
            length = own.stop - own.start
            yield pa.RecordBatch.from_arrays(
                [batch.column("part").take(pa.array(row)), *[fields[c].slice(own.start, length) for c in ("doc_id", "at", "n")], *[pa.array(c, pa.int64()) for c in (start, size, check)]],
                ["part", "doc_id", "at", "n", "piece", "piece_n", "crc"],
            )

    return by_batch(blocks.select("part", "first", "payload", "docs"), work, f"part int, doc_id {kind}, at bigint, n bigint, piece bigint, piece_n bigint, crc bigint")


def _joined(found: DataFrame) -> DataFrame:
    """doc_id, start, n and the checksum of all ``pieces`` (array of piece, piece_n, crc in order)."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pieces = batch.column("pieces")
        ends = pieces.offsets.to_numpy()
        size, check = (pieces.values.field(c).to_pylist() for c in ("piece_n", "crc"))
        out = [check[k] for k in ends[:-1].tolist()]
        for i in np.flatnonzero(np.diff(ends) > 1).tolist():
            for k in range(int(ends[i]) + 1, int(ends[i + 1])):
                out[i] = joined_crc(out[i], check[k], 4 * size[k])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(out, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return by_batch(found, work, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens (its end id counted) and ids_crc32 of every document."""
    blocks = spark.read.parquet(path)
    before, offsets = 0, []
    for row in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # one row per part
        offsets.append((row.part, before))
        before += row.n
    offsets = spark.createDataFrame(offsets, "part int, offset bigint")
    # a document's pieces are at most one per block that holds its ids; its place names it
    found = _pieces(blocks).groupBy("part", "at").agg(
        F.first("doc_id").alias("doc_id"), F.first("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("piece", "piece_n", "crc"))).alias("pieces")
    )
    placed = found.join(F.broadcast(offsets), "part").withColumn("start", F.col("offset") + F.col("at"))
    return _joined(placed.select("doc_id", "start", "n_tokens", "pieces"))


def token_file_report(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write ``docs`` as a token file (into a new shared folder unless ``path`` names one) and report what it holds."""
    path = path or shared_folder(docs.sparkSession, "token-file")
    write_token_file(docs, path, tokenizer)
    return read_token_file(docs.sparkSession, path)


def token_ids(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a token file with their ids: part, first, ids (array of ints), docs."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for low in range(0, batch.num_rows, coder.LANES):
            own = batch.slice(low, coder.LANES)
            ids = coder.unpacked(own.column("payload").to_pylist())
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([own.column("part"), own.column("first"), column, own.column("docs")], ["part", "first", "ids", "docs"])

    blocks = spark.read.parquet(path).select("part", "first", "payload", "docs")
    return by_batch(blocks, work, f"part int, first bigint, ids array<int>, docs {blocks.schema['docs'].dataType.simpleString()}")
