"""Ids of whole texts by a byte-level tokenizer file: cut by its pattern, each distinct piece encoded once by the library.

A text of a byte-level BPE is cut into pieces by a pattern, and no merge crosses a piece, so a piece has the same ids in
every text. ``PieceEncoder`` keeps a bounded table of pieces in two generations, so that pieces in use outlast those met once;
what is in neither goes through the model of the tokenizers library. Ids are 16 bits wide here.
"""

from __future__ import annotations

import re

import numpy as np
import regex
from tokenizers import Tokenizer

from .bpe import byte_symbols
from .frames import kept

REMEMBER = 250_000
LONG = 64

# fixed values: the splitting pattern of the tokenizer file, and its letters, numbers and white space below U+0250
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_FULL = regex.compile(PATTERN)
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def narrowness(text: str) -> int:
    """0 for an ASCII text, 1 for one below U+0250, else 2; of two texts together, the greater of theirs."""
    return 0 if text.isascii() else 1 if max(text) < "ɐ" else 2


def splitter(narrowness: int):
    """The quickest of the patterns that cut a text of this narrowness alike."""
    return (_ASCII, _LATIN, _FULL)[narrowness]


def pieces(text: str) -> list[str]:
    """The text's pieces, in order; together they are the text."""
    return splitter(narrowness(text)).findall(text)


class PieceEncoder:
    """Ids as little-endian 16-bit numbers; ``special`` tells whether strings of special tokens stand for their ids."""

    def __init__(self, path: str, special: bool):
        library = Tokenizer.from_file(path)
        if library.get_vocab_size() > 1 << 16:
            raise ValueError("ids wider than 16 bits")
        self.model = library.model
        self.symbols = {i: ord(s) for i, s in enumerate(byte_symbols())}
        self.special = {t.content: np.array([i], "<u2").tobytes() for i, t in library.get_added_tokens_decoder().items()} if special else {}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        found = self.model.tokenize(piece.encode().decode("latin-1").translate(self.symbols))
        return np.array([t.id for t in found], "<u2").tobytes()

    def _plain(self, text: str) -> bytes:
        found, memory = pieces(text), self.memory
        try:
            return b"".join(map(memory.__getitem__, found))
        except KeyError:
            if len(memory) > REMEMBER:
                self.older, self.memory = memory, {}
                memory = self.memory
            out = []
            for piece in found:
                if (ids := memory.get(piece)) is None:
                    ids = self.older.get(piece) or self.piece(piece)
                    if len(piece) <= LONG:
                        memory[piece] = ids
                out.append(ids)
            return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self.cut is None:
            return self._plain(text) if text else b""
        return b"".join(self.special.get(part) or self._plain(part) for part in self.cut.split(text) if part)


def encoder(path: str, special: bool) -> PieceEncoder:
    return kept(("byte_pieces", path, special), lambda: PieceEncoder(path, special))
