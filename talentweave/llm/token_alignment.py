"""Which ids of two tokenizers stand for each other: alignment by byte offsets, counted through inverted pair bitmaps.

Both tokenizers cut the bytes of a space and the text. Where tokens of both end at the same byte, the text is cut into
groups; every A token of a group is linked with every B token of it. The score of a pair of ids is the number of documents
that hold it linked.

* Index: documents are taken in blocks of bounded size. For each pair a block has a posting: the bitmap of its documents,
  compressed (document numbers where few, bits where many), and planes of bits that spell how many links each of them has.
  A link takes no room of its own, and long groups are counted through their distinct ids.
* Counts: blocks hold different documents, so the merged bitmap of a pair is its blocks' bitmaps side by side, and its
  population count is the sum of theirs; the planes add up to the links.
* Scores go back the same way: each posting gets the count of its pair, and one block's postings give its documents their
  sums. Only (block, pair) rows are joined on pairs; documents and links never are.

Defined cases: a null or empty text, or one whose tokens of A or B don't spell a space and the text, has no tokens, and its
row has zeros and an empty hash. Every row is a document of its own, also if it repeats a doc_id or a text. Empty tables
give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from .bpe import byte_symbols
from .byte_pieces import encoder
from .frames import by_batch, kept

BLOCK_DOCS, BLOCK_BYTES = 8192, 3 << 20  # a longer text is a block of its own
WIDE = 256  # links of a group from which on its distinct ids are counted instead
_DENSE = 16  # a posting with more than one document in so many is stored as bits


class _Pair:
    """Both tokenizers: ids of texts, and the bytes, lengths and printed forms of tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = encoder(path_a, False)
        from_symbol = {s: b for b, s in enumerate(byte_symbols())}
        found = json_vocabulary(path_a)
        self.bytes_a = {i: bytes(from_symbol[c] for c in t) for t, i in found.items() if all(c in from_symbol for c in t)}
        self.length_a = np.zeros(max(found.values()) + 1, np.int64)
        for i, b in self.bytes_a.items():
            self.length_a[i] = len(b)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        n = self.b.get_piece_size()
        if n > 1 << 16:
            raise ValueError("ids wider than 16 bits")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(n)))]
        self.length_b = np.array(list(map(len, self.bytes_b)), np.int64)
        self.print_a = [f"{i}{end}".encode() for i in range(len(self.length_a)) for end in ",|"]
        self.print_b = [f"{i}{end}".encode() for i in range(n) for end in ",;"]

    def ids(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B for each text; none where they don't spell it."""
        none = np.zeros(0, np.int64)
        known_a, known_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        for text, b in zip(texts, self.b.encode([t or "" for t in texts], num_threads=1), strict=True):
            if not text:
                yield none, none
                continue
            whole = b" " + text.encode()
            a = np.frombuffer(self.a.encode(" " + text), "<u2").astype(np.int64)
            same = b"".join(map(known_b, b)) == whole and b"".join(map(known_a, a.tolist())) == whole
            yield (a, np.array(b, np.int64)) if same else (none, none)


def json_vocabulary(path: str) -> dict[str, int]:
    """Tokens and ids of a tokenizer file."""
    import json

    with open(path, encoding="utf-8") as file:
        return json.load(file)["model"]["vocab"]


def tokenizers(path_a: str, path_b: str) -> _Pair:
    return kept(("token_alignment", path_a, path_b), lambda: _Pair(path_a, path_b))


class Aligned:
    """Groups of many documents at once; ``docs_a`` and ``docs_b`` are where each document's tokens start, and the end."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], length_a: np.ndarray, length_b: np.ndarray):
        none = np.zeros(0, np.int64)
        self.a, self.b = np.concatenate([none, *a]), np.concatenate([none, *b])
        self.docs_a = np.concatenate([[0], np.cumsum([len(x) for x in a], dtype=np.int64)])
        self.docs_b = np.concatenate([[0], np.cumsum([len(x) for x in b], dtype=np.int64)])
        ends_a, ends_b = np.cumsum(length_a[self.a]), np.cumsum(length_b[self.b])
        # both run over the same bytes, so a document's end is an end in both
        self.last_a, self.last_b = _common(ends_a, ends_b), _common(ends_b, ends_a)
        self.group_a = np.cumsum(self.last_a) - self.last_a
        self.group_b = np.cumsum(self.last_b) - self.last_b
        self.groups = int(self.last_a.sum())
        self.size_a, self.size_b = (np.bincount(g, minlength=self.groups) for g in (self.group_a, self.group_b))
        self.start_a, self.start_b = (np.concatenate([[0], np.cumsum(s)]) for s in (self.size_a, self.size_b))
        closed = np.concatenate([[0], np.cumsum(self.last_a)])
        self.docs_groups = closed[self.docs_a]

    def links(self) -> np.ndarray:
        """Links of each document."""
        total = np.concatenate([[0], np.cumsum(self.size_a * self.size_b)])
        return np.diff(total[self.docs_groups])

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted (a << 32 | b << 16 | document) of every pair linked in a document, and its links there."""
        doc_of = np.repeat(np.arange(len(self.docs_groups) - 1), np.diff(self.docs_groups))
        product = self.size_a * self.size_b
        narrow = product <= WIDE
        own = np.where(narrow[self.group_a], self.size_b[self.group_a], 0) if len(self.a) else np.zeros(0, np.int64)
        which = np.repeat(np.arange(len(self.a)), own)
        step = np.arange(len(which)) - np.repeat(np.cumsum(own) - own, own)
        group = self.group_a[which]
        key = self.a[which] << 32 | self.b[self.start_b[group] + step] << 16 | doc_of[group]
        key.sort()
        keys, times = _runs(key)
        wide = []
        for g in np.flatnonzero(~narrow).tolist():
            a, n = np.unique(self.a[self.start_a[g] : self.start_a[g + 1]], return_counts=True)
            b, m = np.unique(self.b[self.start_b[g] : self.start_b[g + 1]], return_counts=True)
            wide.append(((a[:, None] << 32 | b[None, :] << 16 | doc_of[g]).reshape(-1), (n[:, None] * m[None, :]).reshape(-1)))
        if wide:
            keys, times = np.concatenate([keys, *[k for k, _ in wide]]), np.concatenate([times, *[n for _, n in wide]])
            order = np.argsort(keys, kind="stable")
            keys, times = keys[order], times[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            keys, times = keys[first], np.add.reduceat(times, first)
        return keys, times

    def digests(self, pair: _Pair) -> list[str]:
        """SHA-256 of each document's groups, printed as ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        shift = len(pair.print_a)
        codes[np.arange(len(self.a)) + self.start_b[self.group_a]] = self.a * 2 + self.last_a
        codes[np.arange(len(self.b)) + self.start_a[self.group_b + 1]] = self.b * 2 + self.last_b + shift
        printed, ends = (pair.print_a + pair.print_b).__getitem__, (self.docs_a + self.docs_b).tolist()
        out = []
        for low, high in zip(ends, ends[1:]):  # noqa: B905
            out.append(hashlib.sha256(b"".join(map(printed, codes[low:high].tolist()))[:-1]).hexdigest() if high > low else "")
        return out


def _common(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of the offsets are in ``other`` too; both rise."""
    if not len(other):
        return np.zeros(len(own), bool)
    at = np.minimum(np.searchsorted(other, own), len(other) - 1)
    return other[at] == own


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each comes."""
    if not len(ordered):
        return ordered, np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return ordered[first], np.diff(np.r_[first, len(ordered)])


def packed_postings(keys: np.ndarray, times: np.ndarray, docs: int) -> tuple[np.ndarray, ...]:
    """(pair, documents, links, planes, offsets, data) of the postings of a block of ``docs`` documents.

    A posting is its document set (16-bit numbers, or one bit for each document of the block) and, for each plane, one bit
    for each of its documents: bit k of its links less one. Each starts at an even byte.
    """
    pair, n = _runs(keys >> 16)
    first = np.cumsum(n) - n
    if not len(pair):
        return pair, n, n, n, np.zeros(1, np.int64), np.zeros(0, np.uint8)
    links = np.add.reduceat(times, first)
    planes = np.array([int(x).bit_length() for x in (np.maximum.reduceat(times, first) - 1).tolist()], np.int64)
    dense = n * _DENSE > docs
    set_size, plane_size = np.where(dense, (docs + 7) // 8, 2 * n), (n + 7) // 8
    size = set_size + planes * plane_size
    size += size & 1
    offsets = np.concatenate([[0], np.cumsum(size)])
    which = np.repeat(np.arange(len(pair)), n)
    rank, doc = np.arange(len(keys)) - first[which], keys & 0xFFFF
    data = np.zeros(int(offsets[-1]), np.uint8)
    few = ~dense[which]
    data.view("<u2")[(offsets[which[few]] >> 1) + rank[few]] = doc[few]
    many = ~few
    places, bits = [offsets[which[many]] + (doc[many] >> 3)], [doc[many] & 7]
    more, base = np.flatnonzero(times > 1), offsets[:-1] + set_size
    for k in range(int(planes.max())):
        own = more[(times[more] - 1 >> k) & 1 == 1]
        places.append(base[which[own]] + k * plane_size[which[own]] + (rank[own] >> 3))
        bits.append(rank[own] & 7)
    at, bit = np.concatenate(places), np.concatenate(bits)
    if len(at):  # each bit is set once, so a sum is an OR
        data |= np.bincount(at, weights=1 << bit, minlength=len(data)).astype(np.uint8)
    return pair, n, links, planes, offsets, data


def posting_sums(n: np.ndarray, planes: np.ndarray, offsets: np.ndarray, data: np.ndarray, docs: int, values: list[np.ndarray]) -> list[np.ndarray]:
    """For each array of a posting's value: its sum over the links of each document of the block."""
    dense = n * _DENSE > docs
    which = np.repeat(np.arange(len(n)), n)
    rank = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    doc, few = np.zeros(len(which), np.int64), ~dense[which]
    doc[few] = data.view("<u2")[(offsets[which[few]] >> 1) + rank[few]]
    width, first = (docs + 7) // 8, np.cumsum(n) - n
    for p in np.flatnonzero(dense).tolist():
        bits = np.unpackbits(data[offsets[p] : offsets[p] + width], bitorder="little")
        doc[first[p] : first[p] + n[p]] = np.flatnonzero(bits)
    times = np.ones(len(which), np.int64)
    base, plane_size = offsets[:-1] + np.where(dense, width, 2 * n), (n + 7) // 8
    for k in range(int(planes.max(initial=0))):
        own = np.flatnonzero(planes[which] > k)
        at = base[which[own]] + k * plane_size[which[own]] + (rank[own] >> 3)
        times[own] += (data[at].astype(np.int64) >> (rank[own] & 7) & 1) << k
    out = []
    for value in values:
        low, high = value & 0xFFFFFF, value >> 24  # sums of doubles stay exact
        low, high = (np.bincount(doc, weights=v[which] * times, minlength=docs).astype(np.int64) for v in (low, high))
        out.append(low + (high << 24))
    return out


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_INDEX = "block bigint, docs array<struct<doc_id:{kind},n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>>, postings array<struct<a:int,b:int,n:bigint,links:bigint>>, planes array<int>, starts array<bigint>, payload binary"


def write_index(docs: DataFrame, path_a: str, path_b: str, folder: str) -> None:
    """Write the blocks of ``docs(doc_id, text)``: their documents, postings and bitmaps, one row a block."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def block(number: int, ids: pa.Array, texts: list[str | None], pair: _Pair) -> pa.RecordBatch:
        a, b = zip(*pair.ids(texts), strict=True)
        found = Aligned(list(a), list(b), pair.length_a, pair.length_b)
        counts = [np.diff(found.docs_a), np.diff(found.docs_b), np.diff(found.docs_groups), found.links()]
        digests = found.digests(pair)
        keys, n, links, planes, offsets, data = packed_postings(*found.entries(), len(texts))
        rows = pa.StructArray.from_arrays([ids, *map(pa.array, counts), pa.array(digests, pa.string())], ["doc_id", *_COUNTS, "groups_sha256"])
        postings = pa.StructArray.from_arrays([pa.array((keys >> 16).astype(np.int32)), pa.array((keys & 0xFFFF).astype(np.int32)), pa.array(n), pa.array(links)], ["a", "b", "n", "links"])
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        columns = [pa.array([number]), one(rows), one(postings), one(pa.array(planes.astype(np.int32))), one(pa.array(offsets)), pa.array([data.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "docs", "postings", "planes", "starts", "payload"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = tokenizers(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts, low, size = batch.column("doc_id"), batch.column("text").to_pylist(), 0, 0
            for i, text in enumerate(texts):
                if i > low and (i - low == BLOCK_DOCS or size + len(text or "") > BLOCK_BYTES):
                    yield block(number, ids.slice(low, i - low), texts[low:i], pair)
                    number, low, size = number + 1, i, 0
                size += len(text or "")
            if texts:
                yield block(number, ids.slice(low), texts[low:], pair)
                number += 1

    docs.select("doc_id", "text").mapInArrow(work, _INDEX.format(kind=kind)).write.option("compression", "zstd").parquet(folder)


def pair_counts(index: DataFrame) -> DataFrame:
    """a, b, n_docs (documents that hold the pair linked), n_links, best (no pair of this A id has more documents)."""
    found = index.select(F.explode("postings").alias("p")).select("p.*").groupBy("a", "b").agg(F.sum("n").alias("n_docs"), F.sum("links").alias("n_links"))
    highest = found.groupBy(F.col("a").alias("_a")).agg(F.max("n_docs").alias("_highest"))
    return found.join(highest, F.col("a") == F.col("_a")).select("a", "b", "n_docs", "n_links", (F.col("n_docs") == F.col("_highest")).alias("best"))


def scored_documents(index: DataFrame) -> DataFrame:
    """The documents of an index with n_best (links whose pair is best for its A id) and count_sum (n_docs over all links)."""
    kind = index.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()
    scores = pair_counts(index).select(F.col("a").alias("_a"), F.col("b").alias("_b"), "n_docs", "best")
    places = index.select("block", F.posexplode("postings").alias("place", "p")).select("block", "place", "p.a", "p.b")
    back = places.join(scores, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
    # as many values as a block has postings
    values = back.groupBy(F.col("block").alias("_block")).agg(F.array_sort(F.collect_list(F.struct("place", "n_docs", "best"))).alias("scores"))
    own = index.select("block", "docs", F.transform("postings", lambda p: p["n"]).alias("sizes"), "planes", "starts", "payload")
    joined = own.join(values, F.col("block") == F.col("_block"), "left").select("docs", "sizes", "planes", "starts", "payload", F.transform("scores", lambda s: s["n_docs"]).alias("counts"), F.transform("scores", lambda s: s["best"].cast("long")).alias("best"))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        def values(name: str, i: int) -> np.ndarray:
            found = batch.column(name)[i].values
            return found.to_numpy(zero_copy_only=False).astype(np.int64) if found is not None else np.zeros(0, np.int64)

        for i in range(batch.num_rows):
            rows = batch.column("docs")[i].values
            data = np.frombuffer(batch.column("payload")[i].as_py(), np.uint8)
            best, total = posting_sums(values("sizes", i), values("planes", i), values("starts", i), data, len(rows), [values("best", i), values("counts", i)])
            columns = [rows.field("doc_id"), *[rows.field(c) for c in _COUNTS], pa.array(best), pa.array(total), rows.field("groups_sha256")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"])

    return by_batch(joined, work, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in (*_COUNTS, "n_best", "count_sum")) + ", groups_sha256 string")


def alignment_report(docs: DataFrame, path_a: str, path_b: str, folder: str | None = None) -> DataFrame:
    """Index ``docs`` (into a new shared folder unless ``folder`` names one) and score every document through it."""
    folder = folder or shared_folder(docs.sparkSession, "token-alignment")
    write_index(docs, path_a, path_b, folder)
    return scored_documents(docs.sparkSession.read.parquet(folder))
