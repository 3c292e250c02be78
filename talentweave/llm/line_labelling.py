"""Quality rules with line labels: base counts, and a linear-chain conditional random field over a text's lines.

* Base counts over the whole text: words, code points in words, symbols, repeated lines, words in repeated three-word
  windows; a text fails the base rules with under ``MIN_WORDS`` words or with over half of its words in such windows.
* Each line (\\n-split, with at least one word) has a feature vector; the field scores the states boilerplate and content
  by these features and by the step from line to line. Viterbi decoding gives the best state sequence of the whole text;
  a text is kept if content lines hold at least ``share`` of its word characters.
* The field is trained here by its penalised conditional likelihood (forward and backward sums written out below) on a
  bounded sample of labelled texts: at most ``rows`` texts of at most ``lines`` lines, whose lines take the text's own
  quality label.

Defined cases: null, empty and blank texts have zero counts, fail the base rules and have content share 0. Without any
labelled row every line counts as content. Rows are independent; repeated rows get equal results. Extra columns are
ignored.
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

MIN_WORDS = 50
FEATURES = 13


def _table(values: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in values]] = True
    return out


_SYMBOL, _DIGIT, _UPPER, _END = _table("#*$%&|<>"), _table("0123456789"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table(".!?")
_MARK, _LOWER = _table("!?|{}[]=_~^@+/\\"), _table("abcdefghijklmnopqrstuvwxyz")


@dataclass
class Lines:
    """Lines with a word of a block, in order; row i holds lines ``rows[i]`` to ``rows[i + 1]``."""

    rows: np.ndarray
    features: np.ndarray
    chars: np.ndarray


def _counter(flags: np.ndarray):
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return lambda a, b: total[b] - total[a]


def measured(block: tb.Block) -> tuple[dict[str, np.ndarray], Lines]:
    """Base counts of the block's rows, and the features of their lines."""
    data, n = block.data, block.rows
    found = tb.words(block, "blank")
    blank = tb.separators("blank")[data]
    starts_char = (data & 0xC0) != 0x80
    word_char = starts_char & ~blank
    per_row = lambda count: count(block.offsets[:-1], block.offsets[1:])
    chars, symbols = _counter(word_char), _counter(_SYMBOL[data])

    # lines: one more than newlines in every row
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([block.offsets[:-1], breaks + 1]))
    row = np.repeat(np.arange(n), np.searchsorted(breaks, block.offsets[1:]) - np.searchsorted(breaks, block.offsets[:-1]) + 1)
    end = np.concatenate([start[1:], block.offsets[-1:]])
    last = np.concatenate([row[1:] == row[:-1], [False]]) if n else np.zeros(0, bool)
    end = end - last  # the newline itself belongs to no line
    first_word = np.searchsorted(found.start, start)
    n_words = np.searchsorted(found.start, end) - first_word
    some = n_words > 0
    start, end, row, n_words, first_word = start[some], end[some], row[some], n_words[some], first_word[some]
    key = tb.mixed(tb.range_hashes(data, start, end) ^ tb.mixed(row.astype(np.uint64)))
    repeated = np.ones(len(key), bool)
    repeated[np.unique(key, return_index=True)[1]] = False

    first, window = tb.windows(found, 3)
    word_row = np.repeat(np.arange(n), found.counts)
    _, which, times = np.unique(tb.mixed(window ^ tb.mixed(word_row[first].astype(np.uint64))), return_inverse=True, return_counts=True)
    often = first[times[which] > 1]
    covered = np.zeros(len(found.start), bool)
    for k in range(3):
        covered[often + k] = True
    many = _counter(covered)

    counts = {
        "n_words": found.counts.astype(np.int64), "word_chars": per_row(chars), "n_symbols": per_row(symbols),
        "n_dup_lines": np.bincount(row[repeated], minlength=n).astype(np.int64), "n_repeat_words": many(found.rows[:-1], found.rows[1:]),
    }
    size = chars(start, end)
    share = lambda flags: _counter(flags)(start, end) / np.maximum(size, 1)
    tail = data[found.end[first_word + n_words - 1] - 1] if len(start) else np.zeros(0, np.uint8)
    head = data[found.start[first_word]] if len(start) else tail
    features = np.stack([
        np.ones(len(start)), np.minimum(np.log1p(n_words) / 5, 2), np.minimum(symbols(start, end) / np.maximum(size, 1), 1) * 5,
        share(_DIGIT[data]) * 3, share(_UPPER[data]) * 3, share(_MARK[data]) * 5, share(_LOWER[data]), _END[tail].astype(float),
        repeated.astype(float), many(first_word, first_word + n_words) / np.maximum(n_words, 1), np.minimum(size / np.maximum(n_words, 1) / 10, 3),
        (n_words < 4).astype(float), (_UPPER[head] | (head >= 0x80)).astype(float),
    ], axis=1) if len(start) else np.zeros((0, FEATURES))
    return counts, Lines(np.searchsorted(row, np.arange(n + 1)), features, size)


@dataclass
class Field:
    """Weights of the content state's features (boilerplate scores 0), and of steps (before, after)."""

    weights: np.ndarray
    steps: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return np.stack([np.zeros(len(features)), features @ self.weights], axis=1)


def viterbi(field: Field, lines: Lines) -> np.ndarray:
    """Best state of every line: all rows step together, the longest rows last to end."""
    score = field.emissions(lines.features)
    sizes = np.diff(lines.rows)
    order = np.argsort(-sizes, kind="stable")
    state = np.zeros(len(score), np.int8)
    back = np.zeros((len(score), 2), np.int8)
    if not len(score):
        return state
    starts, sizes = lines.rows[:-1][order], sizes[order]
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")  # rows with at least t lines
    best = score[starts[: active[0]]]
    final = np.zeros((len(sizes), 2))
    for t, n in enumerate(active):
        if t:
            final[n : len(best)] = best[n:]
            way = best[:n, :, None] + field.steps
            back[starts[:n] + t] = way.argmax(axis=1)
            best = way.max(axis=1) + score[starts[:n] + t]
    final[: len(best)] = best
    now = final.argmax(axis=1).astype(np.int8)
    for t in range(len(active) - 1, -1, -1):
        at = starts[: active[t]] + t
        state[at] = now[: active[t]]
        if t:
            now[: active[t]] = back[at, now[: active[t]]]
    return state


def train(sequences: list[np.ndarray], labels: np.ndarray, rounds: int = 150, rate: float = 0.1, penalty: float = 2e-3) -> Field:
    """Gradient steps (Adam) on the mean conditional log-likelihood of state sequences that repeat each text's label."""
    n, longest = len(sequences), max(map(len, sequences))
    x = np.zeros((n, longest, FEATURES))
    inside = np.zeros((n, longest), bool)
    for i, s in enumerate(sequences):
        x[i, : len(s)], inside[i, : len(s)] = s, True
    labels = labels.astype(int)
    # every text weighs the same, both labels together the same
    weight = np.array([0.5 / max(1, (labels == y).sum()) for y in labels]) / inside.sum(axis=1)
    params = np.zeros(FEATURES + 4)
    first, second = np.zeros_like(params), np.zeros_like(params)
    pairs = inside[:, 1:]
    for step in range(1, rounds + 1):
        score = np.stack([np.zeros((n, longest)), x @ params[:FEATURES]], axis=2)
        steps = params[FEATURES:].reshape(2, 2)
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = score[:, 0]
        for t in range(1, longest):
            ahead[:, t] = score[:, t] + np.logaddexp(ahead[:, t - 1, :1] + steps[0], ahead[:, t - 1, 1:] + steps[1])
        for t in range(longest - 2, -1, -1):
            on = (score[:, t + 1] + behind[:, t + 1])[:, None, :] + steps
            behind[:, t] = np.where(inside[:, t + 1, None], np.logaddexp(on[:, :, 0], on[:, :, 1]), 0)
        ends = inside.sum(axis=1) - 1
        total = np.logaddexp(*ahead[np.arange(n), ends].T)
        state = np.exp(ahead + behind - total[:, None, None])[:, :, 1] * inside
        wanted = inside * labels[:, None]
        slope = np.zeros_like(params)
        slope[:FEATURES] = np.einsum("nt,ntf,n->f", wanted - state, x, weight, optimize=True)
        joint = np.exp(ahead[:, :-1, :, None] + steps + (score + behind)[:, 1:, None, :] - total[:, None, None, None]) * pairs[:, :, None, None]
        met = np.zeros((n, 2, 2))
        met[np.arange(n), labels, labels] = pairs.sum(axis=1)
        slope[FEATURES:] = np.einsum("nij,n->ij", met - joint.sum(axis=1), weight).reshape(-1)
        slope -= penalty * params
        first += 0.1 * (slope - first)
        second += 0.001 * (slope * slope - second)
        params += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Field(params[:FEATURES], params[FEATURES:].reshape(2, 2))


def learned(docs: DataFrame, labels: DataFrame, rows: int = 1200, lines: int = 48, learn_bytes: int = 20_000) -> Field | None:
    """Field from a bounded sample: at most ``rows`` texts' line features are gathered, half of each label."""
    marked = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality"))
    fit = docs.where((F.octet_length("text") <= learn_bytes) & (F.size(F.split("text", "\n")) <= lines))
    known = marked.join(fit.select("doc_id"), "doc_id", "left_semi").distinct()
    chosen = [ordered_sample(known.where(F.col("quality") == q), "doc_id", rows // 2) for q in (0, 1)]
    sample = fit.select("doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    sample = sample.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("quality", "text")  # one row of an id

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batch.column("text")):
            _, found = measured(block)
            each = [found.features[found.rows[i] : found.rows[i + 1]].reshape(-1).tolist() for i in range(block.rows)]
            yield pa.RecordBatch.from_arrays([batch.column("quality").slice(block.first, block.rows), pa.array(each, pa.list_(pa.float64()))], ["quality", "features"])

    found = sorted((r.features, r.quality) for r in by_batch(sample, work, "quality int, features array<double>").collect() if r.features)
    if not found:
        return None
    return train([np.array(f).reshape(-1, FEATURES) for f, _ in found], np.array([q for _, q in found]))


def judged(docs: DataFrame, field: Field | None, share: float = 0.5) -> DataFrame:
    """doc_id, base counts, base_failed, content_share, n_lines, n_content_lines and kept of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batch.column("text")):
            counts, lines = measured(block)
            content = np.ones(len(lines.chars), np.int8) if shared.value is None else viterbi(shared.value, lines)
            row = np.repeat(np.arange(block.rows), np.diff(lines.rows))
            part = np.bincount(row, content * lines.chars, block.rows) / np.maximum(counts["word_chars"], 1)
            failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(block.first, block.rows), *(pa.array(counts[c], pa.int64()) for c in names), pa.array(failed), pa.array(part),
                 pa.array(np.diff(lines.rows), pa.int64()), pa.array(np.bincount(row, content, block.rows).astype(np.int64)), pa.array(~failed & (part >= share))],
                ["doc_id", *names, "base_failed", "content_share", "n_lines", "n_content_lines", "kept"],
            )

    longs = ", ".join(f"{c} bigint" for c in names)
    return by_batch(docs.select("doc_id", "text"), work, f"doc_id {kind}, {longs}, base_failed boolean, content_share double, n_lines bigint, n_content_lines bigint, kept boolean")
