"""Near-duplicate texts: MinHash bands, odd-sketch screening, exact check on full shingle sets, components.

* A text's set is its distinct shingles of ``size`` words (the whole sequence where it has fewer). Texts with equal sets
  form one class; only classes are compared, so a group of copies costs one row however large it is.
* Every class has ``bands * rows`` MinHash samples. Each band of ``rows`` samples is a bucket key; ``bands_for`` gives
  the number of bands at which a pair at the threshold is missed with a chance of at most ``miss``.
* Classes that share a bucket get an odd sketch of ``SAMPLES`` further samples: sample i with value v flips the bit
  hash(i, v). Equal samples cancel in the XOR of two sketches, so its population count estimates the share of differing
  samples, most precisely where the similarity is high. Pairs whose count is over ``sketch_limit`` are dropped before
  any set is fetched.
* Links are confirmed on the full sets. No group's pairs are all emitted: first each bucket member is held against the
  smallest of its bucket; then members that ended in another component than it are held against the bucket's members
  outside their own component. What shares a component by then needs no further check, so no link between components
  is lost.

Defined cases: a text without words (null, empty, blank) has an empty set and is linked with nothing. Rows that share a
doc_id count as one document. A row without doc_id is linked with nothing, has no component and is kept. Extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import textblocks as tb
from .components import components
from .frames import by_batch

ROWS = 8
SAMPLES = 1024
SKETCH_WORDS = 32
SKETCH_BITS = 64 * SKETCH_WORDS


def bands_for(percent: int, rows: int = ROWS, miss: float = 1e-5) -> int:
    """Bands needed so that a pair of the given similarity shares no bucket with a chance of at most ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def sketch_limit(percent: int, samples: int = SAMPLES, sigmas: float = 4.5) -> int:
    """Bits that two sketches at the threshold similarity differ in, plus ``sigmas`` standard deviations."""
    q = 1 - percent / 100
    flips = 2 * samples * q
    share = math.exp(-2 * flips / SKETCH_BITS)
    mean = SKETCH_BITS / 2 * (1 - share)
    # deviation of the number of differing samples, carried through the curve, and of their places in the bitmap
    deviation = math.hypot(2 * math.sqrt(samples * q * (1 - q)) * share, math.sqrt(SKETCH_BITS / 4 * (1 - share * share)))
    return math.ceil(mean + sigmas * deviation)


def _multipliers(n: int) -> np.ndarray:
    return tb.mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)


def shingle_sets(block: tb.Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row starts, hashes) of all shingles of the block; a row of fewer words than ``size`` has its sequence as one."""
    found = tb.words(block, "blank", lower=True)
    counts = found.counts
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(n)])
    first = np.arange(starts[-1]) + np.repeat(found.rows[:-1] - starts[:-1], n)
    return starts, tb.sequence_hashes(found.hash, first, first + np.repeat(np.minimum(counts, size), n))


def least_samples(starts: np.ndarray, hashes: np.ndarray, times: np.ndarray) -> np.ndarray:
    """samples x rows: MinHash samples of the rows with shingles."""
    some = np.flatnonzero(np.diff(starts))
    out = np.empty((len(times), len(some)), np.uint64)
    for k in range(len(times)) if len(some) else ():
        np.minimum.reduceat(hashes * times[k], starts[some], out=out[k])
    return out


def folded(least: np.ndarray) -> np.ndarray:
    """rows x SKETCH_WORDS: the samples as an odd sketch."""
    rows = np.arange(least.shape[1])
    flips = np.zeros((least.shape[1], SKETCH_BITS), np.uint8)
    for k, sample in enumerate(least):
        flips[rows, (tb.mixed(sample + np.uint64(k)) & np.uint64(SKETCH_BITS - 1)).astype(np.int64)] ^= 1
    return np.packbits(flips, axis=1, bitorder="little").view(np.int64)


def _lists(values: np.ndarray, some: np.ndarray) -> pa.ListArray:
    """The rows of ``values`` as lists where ``some`` is true, empty lists elsewhere."""
    at = np.concatenate([[0], np.cumsum(some * values.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.ascontiguousarray(values).reshape(-1).view(np.int64)))


def signatures(docs: DataFrame, bands: int, rows: int = ROWS, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (sums over the set's hashes) and bucket keys of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        times = _multipliers(bands * rows)
        for block in tb.blocks(batch.column("text")):
            starts, hashes = shingle_sets(block, size)
            n = block.rows
            distinct, a, b = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            for i in range(n):
                own = np.unique(hashes[starts[i] : starts[i + 1]])
                distinct[i], a[i], b[i] = len(own), own.sum(dtype=np.uint64), tb.mixed(own).sum(dtype=np.uint64)
            least = least_samples(starts, hashes, times)
            keys = np.zeros((bands, least.shape[1]), np.uint64)
            for k in range(bands * rows):
                keys[k // rows] = tb.mixed(keys[k // rows] + least[k] + np.uint64(k + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(block.first, n), pa.array(distinct), pa.array(tb.signed(a)), pa.array(tb.signed(b)), _lists(keys.T, distinct > 0)],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands"],
            )

    return by_batch(docs.select("doc_id", "text"), work, f"doc_id {kind}, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>")


def full_sets(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, shingles, sketch): the distinct shingle hashes of every row, and their odd sketch."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        times = _multipliers(2 * SAMPLES)[SAMPLES:]  # none of the bands' samples
        for block in tb.blocks(batch.column("text")):
            starts, hashes = shingle_sets(block, size)
            sets = [np.unique(hashes[starts[i] : starts[i + 1]]) for i in range(block.rows)]
            sketch = folded(least_samples(starts, hashes, times))
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(block.first, block.rows), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), _lists(sketch, np.diff(starts) > 0)],
                ["doc_id", "shingles", "sketch"],
            )

    return by_batch(docs.select("doc_id", "text"), work, f"doc_id {kind}, shingles array<bigint>, sketch array<bigint>")


def _differing(x: str, y: str) -> Column:
    """Population count of the XOR of two sketches."""
    return F.expr(" + ".join(f"bit_count({x}[{i}] ^ {y}[{i}])" for i in range(SKETCH_WORDS)))


def _screened(pairs: DataFrame, sketches: DataFrame, limit: int) -> DataFrame:
    """The pairs (a, b) whose sketches differ in at most ``limit`` bits."""
    both = pairs.join(sketches.toDF("a", "sketch_a"), "a").join(sketches.toDF("b", "sketch_b"), "b")
    return both.where(_differing("sketch_a", "sketch_b") <= limit).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")


def near_duplicate_classes(docs: DataFrame, percent: int = 80, size: int = 5, rows: int = ROWS, miss: float = 1e-5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row: kept where doc_id is its component's smallest."""
    bands = bands_for(percent, rows, miss)
    limit = sketch_limit(percent)
    scanned = cut_lineage(signatures(docs, bands, rows, size))
    key = ["n_shingles", "set_a", "set_b"]
    named = scanned.where("n_shingles > 0 and doc_id is not null")
    classes = named.groupBy(*key).agg(F.min("doc_id").alias("c"), F.first("bands").alias("bands"))
    classes = cut_lineage(classes)
    members = classes.select("c", F.posexplode("bands").alias("band", "bucket"))
    # a bucket of one class says nothing; the smallest class of a bucket is its centre
    shared = members.groupBy("bucket").agg(F.min("c").alias("centre"), F.max("c").alias("last")).where("centre <> last").drop("last")
    mates = cut_lineage(members.join(shared, "bucket"))
    first = mates.where("c <> centre").select(F.col("c").alias("a"), F.col("centre").alias("b")).distinct()
    wanted = mates.select(F.col("c").alias("doc_id")).distinct()
    sets = cut_lineage(full_sets(docs.join(wanted, "doc_id", "left_semi"), size))
    sketches = sets.select("doc_id", "sketch")
    first = _screened(first, sketches, limit)
    links = cut_lineage(confirmed(first, sets, percent))
    label = components(links)

    # second pass: classes that did not join their bucket's centre, against the bucket outside their own component
    of = label.select(F.col("node").alias("c"), F.col("component").alias("own"))
    own = mates.join(of, "c", "left").withColumn("own", F.coalesce("own", "c"))
    centre_of = label.select(F.col("node").alias("centre"), F.col("component").alias("theirs"))
    own = cut_lineage(own.join(centre_of, "centre", "left").withColumn("theirs", F.coalesce("theirs", "centre")))
    keys = sketches.join(classes.select(F.col("c").alias("doc_id"), "bands"), "doc_id")
    apart = own.where("own <> theirs").select("bucket", "band", F.col("c").alias("a"), F.col("own").alias("own_a"))
    rest = own.where("c <> centre").select("bucket", F.col("c").alias("b"), F.col("own").alias("own_b"), "theirs")
    rest = rest.join(keys.toDF("b", "sketch_b", "bands_b"), "b")
    apart = apart.join(keys.toDF("a", "sketch_a", "bands_a"), "a")
    # a pair that shares several buckets counts in the first of them
    first_band = F.array_position(F.zip_with("bands_a", "bands_b", lambda x, y: x == y), True) - 1
    new = apart.join(rest, "bucket").where(
        (F.col("own_a") != F.col("own_b")) & ((F.col("own_b") == F.col("theirs")) | (F.col("b") < F.col("a")))
        & (_differing("sketch_a", "sketch_b") <= limit) & (F.col("band") == first_band)
    )
    second = cut_lineage(new.select("a", "b").distinct())
    more = confirmed(second, sets, percent)
    label = components(links.union(more))

    found = classes.select(*key, "c").join(label.withColumnRenamed("node", "c"), "c", "left")
    found = found.select(*key, F.coalesce("component", "c").alias("component_id"))
    out = scanned.select("doc_id", *key).join(found, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
