"""Language identification with a string kernel: presence of blended byte n-grams, Nystrom landmarks, ridge regression.

* Kernel: a text is the set of its byte 1-, 2- and 3-grams (ASCII letters lowered), hashed to ``BUCKETS`` places; the
  kernel of two texts is the number of shared places over the root of the product of their numbers (presence, not
  counts, so repeated text weighs nothing extra).
* Long texts: a row of places fills up with the length of what it covers, and full rows are alike in every language. So
  a text of more than ``CHUNK_BYTES`` bytes is cut into equal chunks of at most that size, no gram is lost between
  them, and the text is the mean of its chunks' normalised rows; its scores are then the mean of the chunks' scores.
* Landmarks: a bounded, documented number of learning texts. With K between landmarks, a text's features are
  K(text, landmarks) K(landmarks, landmarks)**-1/2, and one-versus-rest kernel ridge regression has a closed form.
* Scoring is a product of the presence rows of a block of texts with one small matrix.

Learning takes at most ``per_language`` texts of each language, the first by a hash of the id, of any length;
all texts are learnt from and scored whole.

Defined cases: a null text, or one without a letter, is ``und`` with score 0. Without any learnable row every text is
``und``. Rows are independent; repeated rows get equal results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import top_per_group
from . import textblocks as tb
from .frames import by_batch, held_out

BUCKETS = 1 << 13
GRAMS = (1, 2, 3)
CHUNK_BYTES = 20_000
UNKNOWN = "und"


def presence(block: tb.Block) -> np.ndarray:
    """rows x BUCKETS, 1 where a gram of the row falls into the bucket."""
    out = np.zeros(block.rows * BUCKETS, np.uint8)
    data = tb.LOWER[block.data].astype(np.uint32)
    row = np.repeat(np.arange(block.rows, dtype=np.int64), np.diff(block.offsets))
    gram = np.zeros(len(data), np.uint32)
    for n in GRAMS:
        if len(data) < n:
            break
        gram = gram[: len(data) - n + 1] * np.uint32(256) + data[n - 1 :]
        place = ((gram + np.uint32(n << 24)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)
        first = row[: len(gram)]
        inside = first == row[n - 1 :]
        out[(first * BUCKETS + place)[inside]] = 1
    return out.reshape(block.rows, BUCKETS)


def chunks(block: tb.Block) -> Iterator[tuple[np.ndarray, tb.Block]]:
    """(row of each chunk, the chunks as a block): equal chunks of each row, with the start of the grams that run on."""
    size = np.diff(block.offsets)
    count = np.maximum(1, -(-size // CHUNK_BYTES))
    owner = np.repeat(np.arange(block.rows), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = block.offsets[owner] + size[owner] * nth // count[owner]
    end = np.minimum(block.offsets[owner] + size[owner] * (nth + 1) // count[owner] + max(GRAMS) - 1, block.offsets[owner + 1])
    total = np.concatenate([[0], np.cumsum(end - start)])
    at = 0
    while at < len(owner):
        stop = min(at + 128, max(at + 1, int(np.searchsorted(total, total[at] + tb.BLOCK_BYTES, side="right")) - 1), len(owner))
        data = np.concatenate([block.data[a:b] for a, b in zip(start[at:stop], end[at:stop], strict=True)])
        yield owner[at:stop], tb.Block(0, stop - at, data, total[at : stop + 1] - total[at])
        at = stop


def features(block: tb.Block) -> Iterator[bytes]:
    """Of each row: its presence bits, packed, or if it has several chunks the mean of their normalised rows."""
    mean = np.zeros(BUCKETS, np.float32)
    count, row = 0, 0
    kept = b""
    for owner, piece in chunks(block):
        for own, found in zip(owner, presence(piece), strict=True):
            if own != row:
                yield kept if count == 1 else (mean / count).tobytes()
                mean, count, row = np.zeros(BUCKETS, np.float32), 0, own
            kept = np.packbits(found).tobytes()
            mean += found / np.float32(np.sqrt(max(found.sum(dtype=np.int64), 1)))
            count += 1
    if count:
        yield kept if count == 1 else (mean / count).tobytes()


def unpacked(row: bytes) -> np.ndarray:
    """Normalised row of what ``features`` gives."""
    if len(row) == BUCKETS // 8:
        found = np.unpackbits(np.frombuffer(row, np.uint8)).astype(np.float64)
        return found / np.sqrt(max(found.sum(), 1))
    return np.frombuffer(row, np.float32).astype(np.float64)


@dataclass
class Model:
    """languages in order; ``weights`` maps normalised presence rows to one score per language."""

    languages: list[str]
    weights: np.ndarray

    def scores(self, block: tb.Block) -> np.ndarray:
        """rows x languages: the mean of the scores of each row's chunks."""
        out, count = np.zeros((block.rows, len(self.languages)), np.float32), np.zeros((block.rows, 1), np.float32)
        for owner, piece in chunks(block):
            x = presence(piece).astype(np.float32)
            size = np.sqrt(np.maximum(x.sum(axis=1), 1)).astype(np.float32)
            np.add.at(out, owner, (x @ self.weights) / size[:, None])
            np.add.at(count, owner, 1)
        return out / count


def fit(unit: np.ndarray, languages: list[str], landmarks_each: int = 24, ridge: float = 1e-2) -> Model:
    """Nystrom features on landmarks of every language, then ridge regression of +1 / -1 for each language."""
    names = sorted(set(languages))
    target = np.array([[1.0 if x == n else -1.0 for n in names] for x in languages])
    chosen = [i for n in names for i in [k for k, x in enumerate(languages) if x == n][:landmarks_each]]
    marks = unit[chosen]
    values, vectors = np.linalg.eigh(marks @ marks.T)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = (unit @ marks.T) @ root
    # every language weighs the same, however many texts it has
    share = np.array([1.0 / languages.count(x) for x in languages])[:, None]
    inner = features.T @ (features * share) + ridge * np.eye(features.shape[1]) / len(languages)
    solved = np.linalg.solve(inner, features.T @ (target * share))
    return Model(names, (marks.T @ (root @ solved)).astype(np.float32))


def learning_rows(docs: DataFrame, per_language: int) -> DataFrame:
    """Features and language of the learning sample."""
    known = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike("\\p{L}"))
    first = top_per_group(known.select("doc_id", "lang"), ["lang"], [F.xxhash64("doc_id").asc(), F.asc("doc_id")], per_language, "_n")
    sample = docs.select("doc_id", "text").join(F.broadcast(first.select("doc_id", "lang")), "doc_id")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batch.column("text")):
            bits = list(features(block))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(block.first, block.rows) for c in ("doc_id", "lang")), pa.array(bits, pa.binary())], ["doc_id", "lang", "bits"])

    return by_batch(sample.select(F.col("doc_id").cast("string"), "lang", "text"), work, "doc_id string, lang string, bits binary")


def learned(docs: DataFrame, per_language: int = 200) -> Model | None:
    """Model from a sample of ``docs(doc_id, text, lang)``: at most ``per_language`` rows of 1 or 32 KiB a language are gathered."""
    rows = sorted(learning_rows(docs, per_language).collect(), key=lambda r: (r.lang, r.doc_id, bytes(r.bits)))
    if not rows:
        return None
    return fit(np.stack([unpacked(bytes(r.bits)) for r in rows]), [r.lang for r in rows])


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` with lang_pred and score; all columns stay (own columns of these names are replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "_letter")]

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model = shared.value
        letter = batch.column("_letter").to_numpy(zero_copy_only=False)
        for block in tb.blocks(batch.column("text"), tb.BLOCK_BYTES // 2):
            own = letter[block.first : block.first + block.rows]
            best, score = np.full(block.rows, UNKNOWN, object), np.zeros(block.rows)
            if model is not None and own.any():
                value = model.scores(block)
                best = np.array(model.languages, object)[value.argmax(axis=1)]
                score = np.clip((value.max(axis=1) + 1) / 2, 0, 1).astype(np.float64)
            best[~own], score[~own] = UNKNOWN, 0.0
            kept = [batch.column(c).slice(block.first, block.rows) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(best, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    letters = docs.select(*names).withColumn("_letter", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    return by_batch(letters, work, f"{schema}, lang_pred string, score double")
