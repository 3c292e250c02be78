"""Text quality with a byte-level convolutional network, trained and applied in NumPy.

* A text's bytes are read in overlapping chunks of ``CHUNK`` positions, one every ``HOP``, that cover the whole text. Each byte has
  a learned vector; ``FILTERS`` learned filters of ``WIDTH`` bytes run over a chunk at every ``STRIDE``-th byte and are
  max-pooled to one vector a chunk. Over the text's chunks these vectors are pooled by their mean and their maximum and
  combined by a logistic layer into one probability.
* Training (Adam, gradients written out below) uses at most ``rows`` labelled texts of at most ``learn_bytes`` bytes,
  half of each label where both are plentiful, the first by a hash of the id. The probability is the one at the
  sample's shares of the labels.
* Scoring goes block by block; memory is bounded by a block of chunks, however long a text is.

Defined cases: a null or empty text is one chunk of padding and is scored as such (a number from 0 to 1). Without any
labelled row every score is 0.5. Rows are independent; repeated rows get equal results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .frames import by_batch, held_out, ordered_sample

CHUNK, STRIDE, WIDTH, VECTOR, FILTERS = 128, 2, 8, 8, 32
HOP = 96
PAD = 256
BLOCK_CHUNKS = 512
PLACES = (CHUNK - WIDTH) // STRIDE + 1


@dataclass
class Network:
    vectors: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    mean_weights: np.ndarray
    max_weights: np.ndarray
    offset: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.vectors, self.filters, self.bias, self.mean_weights, self.max_weights, self.offset]


def chunked(block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
    """(chunk starts of all rows, first chunk of each row): at least one chunk a row, the last one padded."""
    size = np.diff(block.offsets)
    n = np.maximum(1, -(-np.maximum(size - CHUNK, 0) // HOP) + 1)
    rows = np.concatenate([[0], np.cumsum(n)])
    step = np.arange(rows[-1]) - np.repeat(rows[:-1], n)
    return np.repeat(block.offsets[:-1], n) + step * HOP, rows


def chunk_bytes(block: tb.Block, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """chunks x CHUNK byte values; PAD beyond the row's end."""
    at = starts[:, None] + np.arange(CHUNK)
    inside = at < ends[:, None]
    data = block.data if len(block.data) else np.zeros(1, np.uint8)
    return np.where(inside, data[np.minimum(at, len(data) - 1)], PAD)


def convolved(net: Network, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filter outputs before pooling (chunks x places x filters) and the unfolded inputs."""
    x = net.vectors[data].reshape(len(data), CHUNK * VECTOR)
    seen = np.lib.stride_tricks.sliding_window_view(x, WIDTH * VECTOR, axis=1)[:, :: STRIDE * VECTOR]
    seen = np.ascontiguousarray(seen).reshape(-1, WIDTH * VECTOR)
    return (seen @ net.filters).reshape(len(data), PLACES, FILTERS), seen


def pooled_chunks(net: Network, data: np.ndarray) -> np.ndarray:
    return np.maximum(convolved(net, data)[0].max(axis=1) + net.bias, 0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logits(net: Network, chunks: np.ndarray, rows: np.ndarray) -> np.ndarray:
    sums = np.add.reduceat(chunks, rows[:-1], axis=0) / np.diff(rows)[:, None]
    tops = np.maximum.reduceat(chunks, rows[:-1], axis=0)
    return sums @ net.mean_weights + tops @ net.max_weights + net.offset[0]


def scores(net: Network, block: tb.Block) -> np.ndarray:
    """Probability of every row of the block."""
    starts, rows = chunked(block)
    ends = np.repeat(block.offsets[1:], np.diff(rows))
    parts = [pooled_chunks(net, chunk_bytes(block, starts[i : i + BLOCK_CHUNKS], ends[i : i + BLOCK_CHUNKS])) for i in range(0, len(starts), BLOCK_CHUNKS)]
    return sigmoid(logits(net, np.concatenate(parts), rows).astype(np.float64))


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 9, batch: int = 16, rate: float = 4e-3, seed: int = 1) -> Network:
    """Adam on the logistic loss."""
    rng = np.random.default_rng(seed)
    f4 = np.float32
    net = Network(
        rng.normal(0, 0.5, (PAD + 1, VECTOR)).astype(f4), rng.normal(0, (WIDTH * VECTOR) ** -0.5, (WIDTH * VECTOR, FILTERS)).astype(f4), np.zeros(FILTERS, f4),
        rng.normal(0, 0.1, FILTERS).astype(f4), np.zeros(FILTERS, f4), np.zeros(1, f4),
    )
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        pace = rate * (1 - epoch / epochs) + 1e-4
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            block = tb.Block(0, len(some), np.frombuffer(b"".join(texts[i] for i in some), np.uint8), np.concatenate([[0], np.cumsum([len(texts[i]) for i in some])]))
            starts, rows = chunked(block)
            data = chunk_bytes(block, starts, np.repeat(block.offsets[1:], np.diff(rows)))
            out, seen = convolved(net, data)
            where = out.argmax(axis=1)
            raw = np.take_along_axis(out, where[:, None, :], 1)[:, 0] + net.bias
            chunks = np.maximum(raw, 0)
            n = np.diff(rows)
            means, tops = np.add.reduceat(chunks, rows[:-1], axis=0) / n[:, None], np.maximum.reduceat(chunks, rows[:-1], axis=0)
            error = ((sigmoid(means @ net.mean_weights + tops @ net.max_weights + net.offset[0]) - labels[some]) / len(some)).astype(f4)
            # back through the pooling over chunks, the rectifier and the pooling over places
            back = np.repeat(error / n, n)[:, None] * net.mean_weights
            back = back + (chunks == np.repeat(tops, n, axis=0)) * np.repeat(error, n)[:, None] * net.max_weights
            back = (back * (raw > 0)).astype(f4)
            index = (np.arange(len(data))[:, None] * PLACES + where).reshape(-1)
            reached = seen[index].reshape(len(data), FILTERS, WIDTH * VECTOR)
            to_filters = np.einsum("cfw,cf->wf", reached, back, optimize=True)
            to_seen = back[:, :, None] * net.filters.T[None]
            bytes_at = (where * STRIDE)[:, :, None] + np.arange(WIDTH)
            to_vectors = np.zeros_like(net.vectors)
            np.add.at(to_vectors, np.take_along_axis(data[:, None, :], bytes_at, 2).reshape(-1), to_seen.reshape(-1, VECTOR))
            slopes = [to_vectors, to_filters, back.sum(0), error @ means + 1e-4 * net.mean_weights, error @ tops + 1e-4 * net.max_weights, error.sum(keepdims=True)]
            step += 1
            for p, g, a, b in zip(net.parameters(), slopes, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= (pace * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(f4)
    return net


def learned(docs: DataFrame, labels: DataFrame, rows: int = 1600, learn_bytes: int = 6_000) -> Network | None:
    """Network from a bounded sample: at most ``rows`` texts of at most ``learn_bytes`` bytes are gathered (10 MB)."""
    marked = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality"))
    texts = docs.where(F.octet_length("text") <= learn_bytes).select("doc_id")
    known = marked.join(texts, "doc_id", "left_semi").distinct()
    chosen = [ordered_sample(known.where(F.col("quality") == q), "doc_id", rows // 2) for q in (0, 1)]
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").where(F.octet_length("text") <= learn_bytes)
    sample = sample.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # one row of an id, however often it comes
    found = sorted({(r.doc_id, r.text or "", r.quality) for r in sample.collect()})
    if not found:
        return None
    return train([t.encode() for _, t, _ in found], np.array([q for _, _, q in found], np.float32))


def scored(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, score) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batch.column("text")):
            found = np.full(block.rows, 0.5) if shared.value is None else scores(shared.value, block)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.first, block.rows), pa.array(found)], ["doc_id", "score"])

    return by_batch(docs.select("doc_id", "text"), work, f"doc_id {kind}, score double")
