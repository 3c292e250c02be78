"""BPE encoding and decoding with word ends, by tree concatenation of long unsplit words.

``Vocabulary`` reads a tokenizer file (its path is a parameter; every executor reads its own installed copy once).

* A text is cut at the strings of special tokens, normalised (NFC, runs of white space to one space, lower case) and cut
  into words by the file's pattern. Ordinary words are merged on the spot and remembered in a bounded table.
* A word of more than ``LEAF`` symbols is halved until its pieces are short; pieces are encoded on their own. Two
  neighbours are joined by encoding again a window of tokens on both sides of the seam. If the window's first and last
  token come out as they were on either side, the joined sequence is exactly the encoding of the whole: an encoding is
  valid if and only if each two tokens next to each other are, and both outer pairs were already next to each other.
  Else the window is doubled, at most to the whole of both sides.
* Words of more than ``SPREAD`` symbols leave their document: their leaves become rows and are encoded in parallel over
  the cluster; the joins are then made where the document is put together again.

Defined cases: a null text counts as empty; an empty or blank text has no tokens and decodes to "". Rows are
independent, so repeated rows get equal results. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import by_batch, kept

LEAF = 256
SPREAD = 1 << 15
REMEMBER = 150_000
BATCH_BYTES = 1 << 22
END = "</w>"

# fixed values: white space of the normaliser's pattern, and the word pattern of the tokenizer file
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"
# letters and numbers below U+0250 once lower-cased; the rest of that range is punctuation, symbols and controls
_LETTERS, _NUMBERS = "a-zªµºß-öø-ɏA-ZÀ-ÖØ-Þ", "0-9²³¹¼½¾"
_QUICK = re.compile(rf"{CONTRACTIONS}|[{_LETTERS}]+|[{_NUMBERS}]|[^{SPACE}{_LETTERS}{_NUMBERS}]+")
_FULL = regex.compile(rf"{CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
_SPACES = re.compile(f"[{SPACE}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself, or the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    own = dict.fromkeys(plain)
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def normalised(text: str) -> str:
    """NFC, one space for each run of white space, and the lower case of each character by itself."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ")  # str.lower() would take the word's end into account
    return _SPACES.sub(" ", text).lower()


def split_words(text: str) -> list[str]:
    """Words of a normalised text."""
    quick = text.isascii() or max(text) < "ɐ"
    return (_QUICK if quick else _FULL).findall(text)


class Merges:
    """Merging of neighbouring ids by rank; ``merge`` maps a pair of ids to (rank, new id)."""

    merge: dict[tuple[int, int], tuple[int, int]]

    def merged(self, ids: list[int]) -> list[int]:
        """Merge the pair of lowest rank, the leftmost of equals, until no pair is left."""
        if len(ids) > 48:
            return self._merged_by_queue(ids)
        ids, get = list(ids), self.merge.get
        none = (1 << 60, 0)
        while len(ids) > 1:
            ranks = [get(p, none) for p in zip(ids, ids[1:])]  # noqa: B905
            best = min(ranks)
            if best is none:
                break
            at = ranks.index(best)
            ids[at : at + 2] = [best[1]]
        return ids

    def _merged_by_queue(self, ids: list[int]) -> list[int]:
        """The same for long sequences: a queue of pairs over a linked list."""
        ids, n = list(ids), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get, queue = self.merge.get, []
        for i in range(n - 1):
            if found := get((ids[i], ids[i + 1])):
                queue.append((found[0], i, found[1]))
        heapq.heapify(queue)
        while queue:
            rank, i, new = heapq.heappop(queue)
            j = after[i] if ids[i] is not None else n
            if j >= n or get((ids[i], ids[j])) != (rank, new):
                continue
            ids[i], ids[j], after[i] = new, None, after[j]
            if after[i] < n:
                before[after[i]] = i
                if found := get((new, ids[after[i]])):
                    heapq.heappush(queue, (found[0], i, found[1]))
            if before[i] >= 0 and (found := get((ids[before[i]], new))):
                heapq.heappush(queue, (found[0], before[i], found[1]))
        return [x for x in ids if x is not None]


class Vocabulary(Merges):
    """Merges, symbols and special tokens of a tokenizer file of this kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        model = found["model"]
        if model.get("end_of_word_suffix") != END or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError(f"not a byte-level BPE with word ends: {path}")
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in found["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.text = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.merge = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge[ids[a], ids[b]] = (rank, ids[a + b])
        symbols = byte_symbols()
        self.inner = [ids[s] for s in symbols]
        self.last = [ids[s + END] for s in symbols]
        self.parts = {i: self._symbols(t, ids) for t, i in ids.items()}
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _symbols(token: str, ids: dict[str, int]) -> tuple[int, ...]:
        body = token[: -len(END)] if token.endswith(END) and len(token) > len(END) else token
        out = [ids[c] for c in body if c in ids]
        if body is not token:
            out[-1] = ids[body[-1] + END]
        return tuple(out)

    def symbols(self, word: str, ends: bool = True) -> list[int]:
        raw = word.encode()
        out = [self.inner[b] for b in raw]
        if ends and out:
            out[-1] = self.last[raw[-1]]
        return out

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring stretches of a word from their own encodings."""
        width = 4
        while left and right:
            a, b = left[-width:], right[:width]
            window = self.merged([s for t in (*a, *b) for s in self.parts[t]])
            whole_left, whole_right = len(a) == len(left), len(b) == len(right)
            if (whole_left or window[0] == a[0]) and (whole_right or window[-1] == b[-1]):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            width *= 2
        return left + right

    def tree(self, pieces: list[list[int]]) -> list[int]:
        """Join encoded neighbours pairwise, level by level."""
        while len(pieces) > 1:
            pieces = [self.joined(*pieces[i : i + 2]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
        return pieces[0] if pieces else []

    def word(self, word: str) -> list[int]:
        """Ids of one word."""
        symbols = self.symbols(word)
        if len(symbols) <= LEAF:
            return self.merged(symbols)
        return self.tree([self.merged(p) for p in leaves(symbols)])

    def remembered(self, words: list[str]) -> bytes:
        """Ids of the words, as little-endian 32-bit numbers."""
        memory = self.memory
        try:
            return b"".join(map(memory.__getitem__, words))
        except KeyError:
            if len(memory) >= REMEMBER:  # words still in use come back from the older table
                self.older, self.memory = memory, {}
                memory = self.memory
            out = []
            for w in words:
                if (ids := memory.get(w)) is None:
                    ids = self.older.get(w) or np.array(self.word(w), "<u4").tobytes()
                    if len(w) <= 40:
                        memory[w] = ids
                out.append(ids)
            return b"".join(out)

    def segments(self, text: str) -> Iterator[tuple[int | None, list[str]]]:
        """(special id, []) or (None, words), in order."""
        for part in self.cut.split(text) if self.cut else (text,):
            if part in self.special:
                yield self.special[part], []
            elif part:
                yield None, split_words(normalised(part))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian 32-bit numbers."""
        return b"".join(self.remembered(words) if special is None else np.array([special], "<u4").tobytes() for special, words in self.segments(text))

    def decode(self, ids: bytes) -> str:
        """Tokens of the ids, special ones too, with a space between each two."""
        return " ".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def leaves(symbols: list[int]) -> list[list[int]]:
    """Halve a sequence until no piece is longer than LEAF; each level halves every piece, so joins meet in pairs."""
    pieces = [symbols]
    while max(map(len, pieces)) > LEAF:
        pieces = [half for p in pieces for half in (p[: len(p) // 2], p[len(p) // 2 :])]
    return pieces


def vocabulary(path: str) -> Vocabulary:
    return kept(("bpe", path), lambda: Vocabulary(path))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded bytes."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _encode_rows(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_le, decoded) of rows whose words are all encoded in place."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known, column = vocabulary(path), batch.column("doc_id")
        schema = pa.schema([("doc_id", column.type), ("n_tokens", pa.int64()), ("ids_le", pa.binary()), ("decoded", pa.string())])

        def rows():
            for doc, text in zip(column, batch.column("text"), strict=True):
                ids = known.encode(text.as_py() or "")
                yield doc.as_py(), len(ids) // 4, ids, known.decode(ids)

        yield from _batches(rows(), schema, lambda r: len(r[2]) + len(r[3]))

    return by_batch(docs.select("doc_id", "text"), work, f"doc_id {kind}, n_tokens bigint, ids_le binary, decoded string")


def _encode_spread(docs: DataFrame, path: str) -> DataFrame:
    """The same for rows with very long words: their leaves are encoded as rows of their own."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("row"))

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known, column = vocabulary(path), batch.column("doc_id")
        schema = pa.schema([("doc_id", column.type), ("row", pa.int64()), ("part", pa.int64()), ("leaf", pa.int64()), ("ids", pa.list_(pa.int32()))])

        def rows():
            for doc, row, text in zip(column, batch.column("row"), batch.column("text"), strict=True):
                part, doc, row = 0, doc.as_py(), row.as_py()
                for special, words in known.segments(text.as_py()):
                    for word in words if special is None else [None]:
                        symbols = known.symbols(word) if word is not None else []
                        if len(symbols) > LEAF:
                            for leaf, piece in enumerate(leaves(symbols)):
                                yield doc, row, part, leaf, piece
                        else:  # leaf -1: already tokens
                            yield doc, row, part, -1, [special] if word is None else known.merged(symbols)
                        part += 1

        yield from _batches(rows(), schema, lambda r: 4 * len(r[4]) + 40)

    def encode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        ids = [x if leaf < 0 else known.merged(x) for leaf, x in zip(batch.column("leaf").to_pylist(), batch.column("ids").to_pylist(), strict=True)]
        yield batch.set_column(4, "ids", pa.array(ids, pa.list_(pa.int32())))

    def put_together(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known, column = vocabulary(path), batch.column("doc_id")
        schema = pa.schema([("doc_id", column.type), ("row", pa.int64()), ("n_tokens", pa.int64()), ("ids_le", pa.binary()), ("decoded", pa.string())])

        def rows():
            for doc, row, parts in zip(column, batch.column("row"), batch.column("parts"), strict=True):
                words: dict[int, list] = {}
                for p in parts.as_py():
                    words.setdefault(p["part"], []).append(p["ids"])
                ids = np.array([t for w in words.values() for t in known.tree(w)], "<u4").tobytes()
                yield doc.as_py(), row.as_py(), len(ids) // 4, ids, known.decode(ids)

        yield from _batches(rows(), schema, lambda r: len(r[3]) + len(r[4]))

    key = f"doc_id {kind}, row bigint"
    pieces = by_batch(keyed, cut, f"{key}, part bigint, leaf bigint, ids array<int>").repartition("doc_id", "row", "part", "leaf")
    encoded = by_batch(pieces, encode, f"{key}, part bigint, leaf bigint, ids array<int>").distinct()
    parts = encoded.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("part", "leaf", "ids"))).alias("parts"))
    done = by_batch(parts, put_together, f"{key}, n_tokens bigint, ids_le binary, decoded string").withColumnsRenamed({"doc_id": "_id", "row": "_row"})
    # once more for each row that repeats an id and a text
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row"))
    return keyed.select("doc_id", "row").join(done, same).select("doc_id", "n_tokens", "ids_le", "decoded")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_le (little-endian 32-bit ids) and decoded text of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", text.alias("text"))
    # an unsplit word that long needs a text that long; few texts get to the second test
    spread = (F.length("text") > SPREAD) & F.col("text").rlike(rf"[^\s]{{{SPREAD + 1}}}")
    return _encode_rows(own.where(~spread), path).unionByName(_encode_spread(own.where(spread), path))
