"""Repeated passages by relative Lempel-Ziv parsing against every indexed reference block.

A window is ``size`` consecutive words; a word goes if a window over it also starts in a document with a smaller id.

* Every window has an anchor: the word gram of least hash in it (the leftmost on ties). Equal windows have equal anchors
  at the same place, so it is enough to compare the texts around equal anchors.
* Index: the block of an anchor's occurrence is the stretch of words that its windows span. Every distinct block of every
  document is a reference block, owned by the smallest document that has it.
* Parse: a document is taken from anchor to anchor; wherever its block is an earlier document's, the whole block is
  copied from that block's first place. Copied blocks that overlap and go on in the same reference document at the same
  distance are one factor (the greedy step): document, first word, word after the last, reference document and its word. A
  block spans at least a window, so every factor is a duplicate span.
* Factor boundaries: where blocks of one anchor differ, a factor ends inside a block, although some of the block's windows
  may still repeat another block. These windows are compared one by one through their hashes; only the owner of each
  block needs that, because a block's later documents copy it whole. They become factors too.

Blocks and windows are compared through 128 bits (anchor and block, anchor and window). All steps are aggregates with
map-side combining and joins on anchor, window or row; nothing gathers the documents that share a passage. Tables that are
met twice are written compressed. Texts are only shuffled for rows that may have factors: a bitmap of fixed size rules out
most others, and what it lets through by chance does no harm.

Defined cases: null, empty and blank texts have no words and lose none. Rows that repeat a doc_id don't remove words of
one another; a row without doc_id neither loses words nor makes others lose any. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from . import textblocks as tb
from .frames import by_batch

GRAM = 8
FILTER_BITS = 1 << 26


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least value of every run of ``width`` values, by doubling the runs."""
    best, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        span += step
    return best


def _anchors(found: tb.Words, size: int) -> tuple[np.ndarray, ...]:
    """(anchor word, first window, last window, anchor hash, block hash) of each run of windows with one anchor."""
    if len(found.start) < size:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    every = np.arange(len(found.start) - GRAM + 1)
    grams = tb.sequence_hashes(found.hash, every, every + GRAM)
    least = _sliding_least(grams, size - GRAM + 1)
    first = np.arange(len(found.start) - size + 1)
    row_end = np.repeat(found.rows[1:], found.counts)
    inside = first[first + size <= row_end[: len(first)]]
    anchor = least[inside]
    new = np.r_[True, (np.diff(anchor) != 0) | (np.diff(inside) != 1)] if len(inside) else np.zeros(0, bool)
    low = np.flatnonzero(new)
    high = np.r_[low[1:], len(inside)] - 1 if len(low) else low
    lo, hi, at = inside[low], inside[high], anchor[low]
    # the block hash covers the words of all these windows and the anchor's place in them
    block = tb.sequence_hashes(found.hash, lo, hi + size) ^ tb.mixed((at - lo).astype(np.uint64))
    return at, lo, hi, grams[at], block


def anchors(docs: DataFrame, size: int) -> DataFrame:
    """One row per run of windows with one anchor: row, doc_id, lo, hi (first words of its windows), anchor, block."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batch.column("text")):
            found = tb.words(block, "blank")
            at, lo, hi, anchor, about = _anchors(found, size)
            if not len(at):
                continue
            row = np.searchsorted(found.rows, at, side="right") - 1
            base, take = found.rows[row], pa.array(row + block.first)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(take), batch.column("doc_id").take(take), pa.array((lo - base).astype(np.int32)), pa.array((hi - base).astype(np.int32)), pa.array(tb.signed(anchor)), pa.array(tb.signed(about))],
                ["row", "doc_id", "lo", "hi", "anchor", "block"],
            )

    return by_batch(docs, work, f"row bigint, doc_id {kind}, lo int, hi int, anchor bigint, block bigint")


def boundary_windows(docs: DataFrame, size: int) -> DataFrame:
    """The windows (row, doc_id, lo, anchor, window) of the runs in column ``runs`` (array of lo, hi, anchor)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        runs = batch.column("runs")
        at = runs.offsets.to_numpy()
        lo, hi, anchor = (runs.values.field(c).to_numpy().astype(np.int64) for c in ("lo", "hi", "anchor"))
        for block in tb.blocks(batch.column("text")):
            found = tb.words(block, "blank")
            own = slice(at[block.first], at[block.first + block.rows])
            row = np.repeat(np.arange(block.rows), np.diff(at[block.first : block.first + block.rows + 1]))
            n = hi[own] - lo[own] + 1
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            local, which = np.repeat(lo[own], n) + step, np.repeat(row, n)
            start = found.rows[which] + local
            window = tb.sequence_hashes(found.hash, start, start + size)
            take = pa.array(which + block.first)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(take), batch.column("doc_id").take(take), pa.array(local.astype(np.int32)), pa.array(np.repeat(anchor[own], n)), pa.array(tb.signed(window))],
                ["row", "doc_id", "lo", "anchor", "window"],
            )

    return by_batch(docs, work, f"row bigint, doc_id {kind}, lo int, anchor bigint, window bigint")


def without_spans(docs: DataFrame) -> DataFrame:
    """Keep the words outside column ``spans`` (array of first word, word after the last), joined by one space."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        spans = batch.column("spans").to_pylist()
        for block in tb.blocks(batch.column("text")):
            found = tb.words(block, "blank", hashes=False)
            kept, removed, digests = [], [], []
            for i in range(block.rows):
                a, b = int(found.rows[i]), int(found.rows[i + 1])
                stay = np.ones(b - a, bool)
                for span in spans[block.first + i] or ():
                    stay[span["lo"] : span["hi"]] = False
                left = np.flatnonzero(stay) + a
                text = b" ".join([block.data[s:e].tobytes() for s, e in zip(found.start[left].tolist(), found.end[left].tolist(), strict=True)]) if len(left) < b - a else b" ".join(block.text(i).split())
                kept.append(text.decode())
                removed.append(b - a - len(left))
                digests.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(block.first, block.rows), pa.array(found.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(digests, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
            )

    return by_batch(docs, work, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_text string, kept_sha256 string")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def _place(doc_id, row):
    """A row's bit in the filter."""
    return F.xxhash64(doc_id, row).bitwiseAND(FILTER_BITS - 1)


def _row_filter(rows: DataFrame) -> np.ndarray:
    """Bitmap of the rows (doc_id, row) of a table; at most FILTER_BITS / 64 numbers reach the driver."""
    bits = rows.select(_place(F.col("doc_id"), F.col("row")).alias("bit"))
    words = bits.groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask")).toPandas()
    bitmap = np.zeros(FILTER_BITS // 64, np.uint64)
    bitmap[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).view(np.uint64)
    return bitmap


def _passed(docs: DataFrame, bitmap: np.ndarray, inside: bool) -> DataFrame:
    """The rows (row, doc_id, text) whose bit is set, or those where it isn't."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        place = batch.column("place").to_numpy()
        met = (shared.value[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)
        yield batch.drop_columns(["place"]).filter(pa.array(met == inside))

    return by_batch(docs.select("row", "doc_id", "text", _place(F.col("doc_id"), F.col("row")).alias("place")), work, f"row bigint, doc_id {kind}, text string")


def _merged(found: DataFrame) -> DataFrame:
    """Copied blocks and repeated windows of each row (``parts``) as factors (``spans``)."""
    kind = found.schema["doc_id"].dataType.simpleString()
    fields = ("lo", "hi", "reference", "reference_lo")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parts = batch.column("parts")
        ends = parts.offsets.to_pylist()
        columns = [parts.values.field(c).to_pylist() for c in fields]
        offsets, out = [0], []
        for a, b in zip(ends, ends[1:]):  # noqa: B905
            for lo, hi, reference, at in sorted(zip(*(c[a:b] for c in columns), strict=True), key=lambda p: (p[2], p[0] - p[3], p[0])):
                last = out[-1] if len(out) > offsets[-1] else None
                if last and last[2] == reference and last[0] - last[3] == lo - at and lo <= last[1]:
                    last[1] = max(last[1], hi)
                else:
                    out.append([lo, hi, reference, at])
            offsets.append(len(out))
        lists = [pa.array([s[k] for s in out], parts.values.field(c).type) for k, c in enumerate(fields)]
        spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(lists, list(fields)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), spans], ["doc_id", "row", "spans"])

    return by_batch(found, work, f"doc_id {kind}, row bigint, spans array<struct<lo:int,hi:int,reference:{kind},reference_lo:int>>")


def factors(docs: DataFrame, size: int = 50) -> DataFrame:
    """(doc_id, row, spans) of the rows of ``docs(doc_id, text, row)`` that repeat earlier documents.

    A span is a factor: words ``lo`` to ``hi`` are the words from ``reference_lo`` on of the document ``reference``. Spans of
    one row may overlap. ``row`` is a checksum of the text: with the id it names a row by its content, so any task can be run
    again. For the same reason the anchors are not written: hashing the texts twice costs less than storing them.
    """
    known = docs.where("doc_id is not null")
    found = anchors(known, size)
    first = F.min(F.struct("doc_id", "lo"))
    index = found.groupBy("anchor").agg(first.alias("first"), F.max("doc_id").alias("last"), (F.min("block") == F.max("block")).alias("agrees"))
    # an anchor of one document cannot make any of its windows repeat an earlier one
    # written, so that the join below is between two shuffles and a hot anchor's occurrences can be split
    index = _written(index.where("first.doc_id <> last").drop("last"), "anchors")
    met = found.join(index, "anchor").where("not agrees or doc_id > first.doc_id")
    met = _written(met.select("doc_id", "row", "lo", "hi", "anchor", F.when(~F.col("agrees"), F.col("block")).alias("block"), F.when(F.col("agrees"), F.col("first")).alias("first")), "occurrences")
    span = ("doc_id", "row", "lo", (F.col("hi") + size).alias("hi"), F.col("first.doc_id").alias("reference"), F.col("first.lo").alias("reference_lo"))
    copied = met.where("block is null").select(*span)

    # an anchor with several blocks: a block's later documents copy it; what its first document shares with the anchor's
    # other blocks is seen window by window
    several = met.where("block is not null").drop("first")
    owners = _written(several.groupBy("anchor", "block").agg(first.alias("first")), "blocks")
    several = several.join(owners, ["anchor", "block"])
    runs = several.where("doc_id = first.doc_id").groupBy("doc_id", "row").agg(F.collect_list(F.struct("lo", "hi", "anchor")).alias("runs"))
    runs = _written(runs, "runs")
    texts = _passed(known, _row_filter(runs), inside=True)
    edge = _written(boundary_windows(texts.join(runs, ["doc_id", "row"]).select("row", "doc_id", "text", "runs"), size), "windows")
    earliest = edge.groupBy("anchor", "window").agg(first.alias("first"), F.max("doc_id").alias("last")).where("first.doc_id <> last").drop("last")
    repeated = edge.join(earliest, ["anchor", "window"]).where("doc_id > first.doc_id").select(*span[:3], (F.col("lo") + size).alias("hi"), *span[4:])
    spans = copied.union(several.where("doc_id > first.doc_id").select(*span)).union(repeated)
    return _merged(spans.groupBy("doc_id", "row").agg(F.collect_list(F.struct("lo", "hi", "reference", "reference_lo")).alias("parts")))


def without_repeats(docs: DataFrame, size: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and kept_sha256 of every row."""
    keyed = docs.select("doc_id", "text").withColumn("row", F.crc32(F.col("text").cast("binary")))
    spans = _written(factors(keyed, size), "factors")
    bitmap = _row_filter(spans)
    touched = _passed(keyed, bitmap, inside=True).join(spans, ["doc_id", "row"], "left").select("doc_id", "text", "spans")
    others = _passed(keyed, bitmap, inside=False).select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return without_spans(touched).unionByName(without_spans(others))
