"""Benchmark decontamination as a prefix-filtered set join.

An item window of ``size`` words (the whole item where it is shorter) is a set of overlapping word shingles. A text holds
the window only if it holds every shingle, so for containment of 1 the prefix to be joined is one shingle, the rarest by
its count in the corpus. A candidate must pass the length bound (the run of known shingles is as long as the window) and
the positional bound (the window, laid so that the shingles meet, stays within the run) and is then compared word by word.

Texts are read once. A fixed-size bitmap of item shingle hashes (``FILTER_BITS``, 4 MiB whatever the benchmark's size)
marks known shingles; only runs of consecutive known shingles leave the scan, with their words, because no window can
lie outside such a run. The rest are joins and aggregates on these runs.

Defined cases: a null or empty text has no words and no hits; a null or wordless item has no window; repeated rows and
repeated ids each get their own result row; items with equal texts are all reported; items without an id are reported
as "null"; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import textblocks as tb
from .frames import by_batch

FILTER_BITS = 1 << 25
WINDOW_SCHEMA = "item_id string, words array<string>, n int, shingles array<bigint>"
RUN_SCHEMA = "doc_id {}, row bigint, n_words bigint, runs array<struct<start:bigint, k:int, words:array<string>, shingles:array<bigint>>>"


def _word_list(data: np.ndarray, found: tb.Words, a: int, b: int) -> list[str]:
    raw = data[found.start[a] : found.end[b - 1]].tobytes()
    base = int(found.start[a])
    return [raw[s - base : e - base].decode() for s, e in zip(found.start[a:b].tolist(), found.end[a:b].tolist(), strict=True)]


def item_windows(items: DataFrame, size: int, shingle: int) -> DataFrame:
    """One row per distinct window of an item: its words and the hashes of its shingles in order."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("item_id").to_pylist()
        for block in tb.blocks(batch.column("text")):
            found = tb.words(block, "alnum", lower=True)
            data, rows = tb.LOWER[block.data], []
            for i in range(block.rows):
                a, b = int(found.rows[i]), int(found.rows[i + 1])
                n = min(size, b - a)
                k = min(shingle, n)
                for at in range(a, b - n + 1) if n else ():
                    first = np.arange(at, at + n - k + 1)
                    hashes = tb.signed(tb.sequence_hashes(found.hash, first, first + k))
                    rows.append((ids[block.first + i] or "null", _word_list(data, found, at, at + n), n, hashes.tolist()))
            if rows:
                kinds = (pa.string(), pa.list_(pa.string()), pa.int32(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["item_id", "words", "n", "shingles"])

    return by_batch(items.select(F.col("item_id").cast("string"), F.col("text")), work, WINDOW_SCHEMA).distinct()


def shingle_filter(windows: DataFrame) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Bitmap of the window shingles' hashes, and the (shingle words, least window words) met.

    At most FILTER_BITS / 64 rows reach the driver, whatever the number of items.
    """
    place = F.explode("shingles").alias("h")
    bits = windows.select(place).select((F.col("h").bitwiseAND(FILTER_BITS - 1)).alias("bit"))
    words = bits.groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask")
    ).toPandas()
    bitmap = np.zeros(FILTER_BITS // 64, np.uint64)
    bitmap[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).view(np.uint64)
    k = F.col("n") - F.size("shingles") + 1
    least = [(r[0], r[1]) for r in windows.groupBy(k.alias("k")).agg(F.min("n")).collect()]  # one row per shingle length
    return bitmap, sorted(least)


def known_runs(docs: DataFrame, bitmap: np.ndarray, least: list[tuple[int, int]]) -> DataFrame:
    """Per row: number of words, and the runs of consecutive shingles in the bitmap that are long enough for a window."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for block in tb.blocks(batch.column("text")):
            found = tb.words(block, "alnum", lower=True)
            data = tb.LOWER[block.data]
            runs: list[list[dict]] = [[] for _ in range(block.rows)]
            for k, n in least:
                first, hashes = tb.windows(found, k)
                bit = hashes & np.uint64(FILTER_BITS - 1)
                hit = np.flatnonzero((table[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1))
                if not len(hit):
                    continue
                row = np.searchsorted(found.rows, first[hit], side="right") - 1
                cut = np.flatnonzero((np.diff(first[hit]) != 1) | (np.diff(row) != 0)) + 1
                for a, b in zip(np.r_[0, cut].tolist(), np.r_[cut, len(hit)].tolist(), strict=True):
                    if b - a + k - 1 >= n:
                        at, i = int(first[hit[a]]), int(row[a])
                        runs[i].append({"start": at - int(found.rows[i]), "k": k, "words": _word_list(data, found, at, at + b - a + k - 1), "shingles": tb.signed(hashes[hit[a:b]]).tolist()})
            kind = pa.list_(pa.struct([("start", pa.int64()), ("k", pa.int32()), ("words", pa.list_(pa.string())), ("shingles", pa.list_(pa.int64()))]))
            same = [batch.column(c).slice(block.first, block.rows) for c in ("doc_id", "row")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(found.counts, pa.int64()), pa.array(runs, kind)], ["doc_id", "row", "n_words", "runs"])

    return by_batch(docs, work, RUN_SCHEMA.format(docs.schema["doc_id"].dataType.simpleString()))


def window_hits(docs: DataFrame, items: DataFrame, size: int = 10, shingle: int = 5) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n_words) of all rows, and their exact (row, start, n, item_id) occurrences of item windows."""
    windows = cut_lineage(item_windows(items, size, shingle))
    bitmap, least = shingle_filter(windows)
    # the row number ties a row's parts together where ids repeat or are missing
    keyed = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    scanned = cut_lineage(known_runs(keyed, bitmap, least))
    runs = scanned.where(F.size("runs") > 0).select("row", F.posexplode("runs").alias("run", "r")).select("row", "run", "r.*")
    places = runs.select("row", "run", F.posexplode("shingles").alias("at", "h"))
    counts = places.groupBy("h").agg(F.count("*").alias("seen"))
    # a window whose shingles are not all met cannot occur; of the others' shingles the rarest is the prefix
    spread = windows.select("item_id", "words", "n", F.posexplode("shingles").alias("offset", "h"), F.size("shingles").alias("need"))
    prefix = (
        spread.join(counts, "h").groupBy("item_id", "words", "n", "need")
        .agg(F.count("*").alias("met"), F.min(F.struct("seen", "offset", "h")).alias("p"))
        .where("met = need").select("item_id", F.col("words").alias("window"), "n", "p.h", "p.offset")
    )
    candidates = places.join(prefix, "h").withColumn("begin", F.col("at") - F.col("offset")).where("begin >= 0")
    # positional and length bounds, then the words themselves
    checked = candidates.join(runs.select("row", "run", "start", "words"), ["row", "run"]).where(
        (F.col("begin") + F.col("n") <= F.size("words")) & (F.slice("words", F.col("begin") + 1, F.col("n")) == F.col("window"))
    )
    hits = checked.select("row", (F.col("start") + F.col("begin")).alias("start"), "n", "item_id")
    return scanned.select("row", "doc_id", "n_words"), hits


def contaminated(docs: DataFrame, items: DataFrame, size: int = 10, shingle: int = 5) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items (ids sorted as strings), contaminated."""
    rows, hits = window_hits(docs, items, size, shingle)
    hits = cut_lineage(hits)
    item_ids = hits.select("row", "item_id").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    covered = hits.select("row", "start", "n").distinct().select("row", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("word"))
    n_hit = covered.distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    return rows.join(n_hit.join(item_ids, "row"), "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
