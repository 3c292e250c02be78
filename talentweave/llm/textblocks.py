"""Words of many texts at once: NumPy over the UTF-8 bytes of an Arrow column, in blocks of bounded size.

A block holds at most ``BLOCK_ROWS`` whole rows of at most ``BLOCK_BYTES`` together, or one longer row; a longer row is hashed in pieces that
end at separators, so the wide arrays of the byte pass stay small whatever the row's length. Hashes are 64 bits wide,
polynomial over bytes (or over word hashes) modulo 2**64, with a final mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
BLOCK_ROWS = 2048
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)


def separators(kind: str) -> np.ndarray:
    """Table over byte values, True where a byte separates words.

    ``blank``: the bytes 0x20 and 0x09 to 0x0D. ``alnum``: every ASCII byte but digits and lower-case letters.
    """
    table = np.zeros(256, bool)
    if kind == "blank":
        table[[0x20, *range(0x09, 0x0E)]] = True
    elif kind == "alnum":
        table[:0x80] = True
        table[0x30:0x3A] = False
        table[0x61:0x7B] = False
    else:
        raise ValueError(f"unknown kind of words: {kind}")
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, extended on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b), dtype=np.uint64)]) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_byte_powers, _word_powers = Powers(_BASE), Powers(_WORD_BASE)


@dataclass
class Block:
    """Rows ``first`` to ``first + rows`` of a batch; ``offsets`` are byte positions in ``data``."""

    first: int
    rows: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


@dataclass
class Words:
    """Word byte ranges of a block, in order; row i holds the words ``rows[i]`` to ``rows[i + 1]``."""

    start: np.ndarray
    end: np.ndarray
    rows: np.ndarray
    hash: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The rows of a string or binary column in blocks; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), first + BLOCK_ROWS, len(column))
        yield Block(first, last - first, values[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def _edges(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~table[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begins[cuts] = inside[cuts]  # a word never runs from one row into the next
    ends[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _byte_powers.get(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range; ranges come in order and don't overlap. Long data is done in pieces between ranges."""
    out, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        base = start[at]
        stop = max(at + 1, int(np.searchsorted(end, base + BLOCK_BYTES, side="right")))
        out[at:stop] = _byte_hashes(data[base : end[stop - 1]], start[at:stop] - base, end[at:stop] - base)
        at = stop
    return out


def words(block: Block, kind: str, lower: bool = False, hashes: bool = True) -> Words:
    """Words of the block's rows, with ASCII letters lowered first where asked."""
    table = separators(kind)
    data = LOWER[block.data] if lower else block.data
    start, end = _edges(data, block.offsets, table) if len(data) else (np.zeros(0, np.int64),) * 2
    rows = np.searchsorted(start, block.offsets)
    return Words(start, end, rows, range_hashes(data, start, end) if hashes else None)


def windows(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each run of ``size`` words within a row."""
    n = len(found.start)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.arange(n - size + 1)
    row_end = np.repeat(found.rows[1:], found.counts)
    first = first[first + size <= row_end[: n - size + 1]]
    return first, sequence_hashes(found.hash, first, first + size)


def sequence_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each range of word hashes; ranges may overlap."""
    up, down = _word_powers.get(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a signed number, Spark's long."""
    return x.view(np.int64)
