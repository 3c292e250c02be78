"""Token counts that follow edits: a segment tree of pre-tokens for each document.

* A text is cut into pre-tokens by the tokenizer's pattern; a leaf holds ``LEAF`` of them, as its number of characters and
  of tokens. A binary tree of sums over the leaves is kept beside the text as one array of (characters, tokens) in heap
  order (root first), so a table of trees is an ordinary Parquet table.
* An edit replaces ``removed`` characters at ``at`` by a text. Where a pre-token ends depends on at most ``AHEAD``
  characters after it: the rest of a white-space run and what follows it, or two letters after an apostrophe. So the tree
  leads to the leaf with the character ``AHEAD`` before the edit; all pre-tokens before that leaf stay, and from its start
  the new text is cut again until a boundary beyond the edit falls on the start of a former leaf. The pattern looks at
  nothing before a boundary, so from there on every pre-token is as it was: only the region's leaves and the sums above
  them change. A splitting pattern that looks further ahead, or behind, is not supported.
* The region's pre-tokens go into one leaf. Once they are more than ``HEAVY``, they are dealt to new leaves and the sums
  are built anew, without encoding anything again. A single long pre-token stays one leaf, whatever its length.

Defined cases: a null text counts as empty (no tokens); edits are applied in the order given, each to the text the one
before left; positions beyond the text are its end, negative ones its start, a null removal removes nothing, a null
insertion inserts nothing, a null edit list is no edit. Rows are independent; repeated rows get equal results. Extra
columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_pieces
from .bpe import Merges, byte_symbols
from .frames import by_batch, kept

LEAF = 16
HEAVY = 8 * LEAF
AHEAD = 2
REMEMBER = 300_000
BATCH_BYTES = 1 << 22
EDITS = "array<struct<at:bigint,removed:bigint,inserted:string>>"
TREE = "array<struct<chars:bigint,tokens:bigint>>"


class Counter(Merges):
    """Number of tokens of a pre-token, from a byte-level tokenizer file and its splitting pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids = model["vocab"]
        self.merge = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge[ids[a], ids[b]] = (rank, ids[a + b])
        self.bytes = [ids[s] for s in byte_symbols()]
        self.pattern = regex.compile(pattern)
        self.known_pattern = pattern == byte_pieces.PATTERN
        self.memory: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def narrowness(self, text: str) -> int:
        return byte_pieces.narrowness(text) if self.known_pattern else 2

    def splitter(self, narrowness: int):
        return byte_pieces.splitter(narrowness) if self.known_pattern else self.pattern

    def tokens(self, pieces: list[str]) -> list[int]:
        """Tokens of each pre-token."""
        try:
            return list(map(self.memory.__getitem__, pieces))
        except KeyError:
            if len(self.memory) >= REMEMBER:  # pre-tokens still in use come back from the older table
                self.older, self.memory = self.memory, {}
            out = []
            for piece in pieces:
                found = self.memory.get(piece)
                if found is None:
                    found = self.older.get(piece) or len(self.merged([self.bytes[b] for b in piece.encode()]))
                    if len(piece) <= 40:
                        self.memory[piece] = found
                out.append(found)
            return out

    def leaves(self, text: str) -> np.ndarray:
        """leaves x (characters, tokens)."""
        pieces = self.splitter(self.narrowness(text)).findall(text)
        if not pieces:
            return np.zeros((1, 2), np.int64)
        return leaf_sums(list(map(len, pieces)), self.tokens(pieces))


def leaf_sums(sizes: list[int], counts: list[int]) -> np.ndarray:
    """(characters, tokens) of each ``LEAF`` pre-tokens."""
    return np.add.reduceat(np.array([sizes, counts], np.int64), np.arange(0, len(sizes), LEAF), axis=1).T


def counter(path: str, pattern: str) -> Counter:
    return kept(("edit_counts", path, pattern), lambda: Counter(path, pattern))


def tree_of(leaves: np.ndarray) -> np.ndarray:
    """Heap-ordered sums: node i has the children 2 i + 1 and 2 i + 2; the leaves fill the last level from the left."""
    width = 1 << max(0, (len(leaves) - 1).bit_length())
    levels = [np.concatenate([leaves, np.zeros((width - len(leaves), 2), np.int64)])]
    while len(levels[0]) > 1:
        levels.insert(0, levels[0].reshape(-1, 2, 2).sum(axis=1))
    return np.concatenate(levels)


class Tree:
    """A document's text and sums, changed in place by edits."""

    def __init__(self, text: str, nodes: np.ndarray, counter: Counter):
        self.text, self.nodes, self.counter, self.encoded = text, nodes, counter, 0
        self.width, self.narrowness = (len(nodes) + 1) // 2, counter.narrowness(text)

    @property
    def tokens(self) -> int:
        return int(self.nodes[0, 1])

    def leaf_at(self, place: int) -> tuple[int, int]:
        """(leaf, its first character) that holds the given character."""
        node, start = 0, 0
        while node < self.width - 1:
            node = 2 * node + 1
            if place - start >= self.nodes[node, 0]:
                start += int(self.nodes[node, 0])
                node += 1
        return node - (self.width - 1), start

    def put(self, leaf: int, value: tuple[int, int]) -> None:
        node = leaf + self.width - 1
        change = np.array(value, np.int64) - self.nodes[node]
        while True:
            self.nodes[node] += change
            if node == 0:
                return
            node = (node - 1) // 2

    def edit(self, at: int, removed: int, inserted: str) -> None:
        old, width = self.text, self.width
        at = min(max(at, 0), len(old))
        removed = min(max(removed, 0), len(old) - at)
        new = old[:at] + inserted + old[at + removed :]
        if inserted:
            self.narrowness = max(self.narrowness, self.counter.narrowness(inserted))
        leaf, start = self.leaf_at(max(at - AHEAD, 0)) if old else (0, 0)
        chars = self.nodes[width - 1 :, 0].tolist()
        shift, ends_at = len(inserted) - removed, at + removed
        # starts of the leaves at or after the edit's end, where the former cut may be met again
        last, old_end = leaf, start
        while last < width and old_end < ends_at:
            old_end += chars[last]
            last += 1
        cut, where, goal, done = [], start, -1, False
        for match in self.counter.splitter(self.narrowness).finditer(new, start):
            if where >= goal:
                while last < width and old_end + shift < where:
                    old_end += chars[last]
                    last += 1
                goal = old_end + shift
                if goal == where and last > leaf and old_end >= ends_at and where < len(new):
                    done = True
                    break
            where = match.end()
            cut.append(match.group())
        if not done:
            last = width
        sizes, counts = list(map(len, cut)), self.counter.tokens(cut)
        self.encoded += len(cut)
        self.text = new
        if len(cut) > HEAVY:
            leaves = self.nodes[width - 1 :]
            leaves = np.concatenate([leaves[:leaf], leaf_sums(sizes, counts), leaves[last:]])
            self.nodes = tree_of(leaves[leaves[:, 0] > 0])
            self.width = (len(self.nodes) + 1) // 2
            return
        self.put(leaf, (sum(sizes), sum(counts)))
        for i in range(leaf + 1, last):
            if chars[i]:
                self.put(i, (0, 0))


def _batches(rows: Iterator[tuple], names: list[str], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, text, nodes, numbers ...) of bounded size."""

    def batch():
        docs, texts, trees, *numbers = zip(*held, strict=True)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in trees])]).astype(np.int32)
        nodes = np.concatenate(trees)
        values = pa.StructArray.from_arrays([pa.array(nodes[:, 0].copy()), pa.array(nodes[:, 1].copy())], ["chars", "tokens"])
        columns = [pa.array(docs, kind), pa.array(texts, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), values), *(pa.array(c, pa.int64()) for c in numbers)]
        return pa.RecordBatch.from_arrays(columns, names)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 4 * len(row[1]) + 16 * len(row[2])
        if size > BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def trees(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text, tree, n_tokens): the table to keep."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own, column = counter(path, pattern), batch.column("doc_id")

        def rows():
            for doc, text in zip(column.to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                tree = tree_of(own.leaves(text))
                yield doc, text, tree, int(tree[0, 1])

        yield from _batches(rows(), ["doc_id", "text", "tree", "n_tokens"], column.type)

    return by_batch(docs.select("doc_id", "text"), work, f"doc_id {kind}, text string, tree {TREE}, n_tokens bigint")


def edited(kept: DataFrame, path: str, pattern: str) -> DataFrame:
    """``trees`` with a column ``edits`` (array of at, removed, inserted), brought up to date.

    doc_id, text, tree, n_tokens, n_encoded: the pre-tokens that were cut and encoded again, and n_tokens_given: the
    tokens before the edits.
    """
    kind = kept.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own, column, stored = counter(path, pattern), batch.column("doc_id"), batch.column("tree")
        at = stored.offsets.to_numpy()
        values = np.stack([stored.values.field(c).to_numpy() for c in ("chars", "tokens")], axis=1)

        def rows():
            for i, (doc, text, edits) in enumerate(zip(column.to_pylist(), batch.column("text"), batch.column("edits"), strict=True)):
                tree = Tree(text.as_py(), values[at[i] : at[i + 1]].copy(), own)
                given = tree.tokens
                for e in edits.as_py() or ():
                    if e is not None:
                        tree.edit(e["at"] or 0, e["removed"] or 0, e["inserted"] or "")
                yield doc, tree.text, tree.nodes, tree.tokens, tree.encoded, given

        yield from _batches(rows(), ["doc_id", "text", "tree", "n_tokens", "n_encoded", "n_tokens_given"], column.type)

    return by_batch(kept.select("doc_id", "text", "tree", "edits"), work, f"doc_id {kind}, text string, tree {TREE}, n_tokens bigint, n_encoded bigint, n_tokens_given bigint")


def with_edits(kept: DataFrame, edits: DataFrame) -> DataFrame:
    """Attach a table of edits (doc_id, seq, at, removed, inserted) to the trees of ``kept``, in the order of ``seq``."""
    grouped = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "at", "removed", "inserted"))).alias("_all"))
    plain = F.transform("_all", lambda e: F.struct(e["at"].cast("long").alias("at"), e["removed"].cast("long").alias("removed"), e["inserted"].alias("inserted")))
    return kept.join(grouped, "doc_id", "left").withColumn("edits", plain).drop("_all")
