"""Blocks of token ids as arithmetic codes, driven by predictions of order 0 to 2 that are learnt while coding.

Every block is coded by itself: its model starts empty, and its head holds the number of ids and their checksum. Many
blocks are coded side by side, one lane of the NumPy arrays each; a lane's code doesn't depend on the other lanes.

* Order 2 and order 1 predict one id each: the last one that followed the same two ids (the same id) in this block, with a
  count of how often that was right. Order 0 predicts by counts of the ids' groups of 256, refreshed as the block goes on.
* Mixing: how often order 2, order 1 and neither were right is counted for each pair of their confidences (and whether
  they agree). These counts share the coding range among both predicted ids and order 0.
* Coding: one interval for "as order 2 says", "as order 1 says" or the id's group, the latter split evenly into 256 ids.
  A range coder of 64 bits puts out 32 bits at a time; a carry is added to the words already put out.

Layout of a block, little-endian: mark (2 bytes), number of ids (4), crc32 of the ids as 32-bit numbers (4), code words
(4 each). Ids are below 65536. An empty block has no code words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MARK = b"\xc7\x02"
HEAD, HEAD_SIZE = "<2sII", 10
BLOCK = 4096
LANES = 2048

_ONE_BITS, _TWO_BITS = 11, 12  # slots of a lane in the tables of order 1 and 2
_TOTAL = 16  # bits of a share; the coder works with eight more, for the place in a group
_GROUPS = 256
_SCALE = 12  # bits of the order-0 table
_LEAST = 1 << _SCALE  # what order 0 always keeps of the range
_REFRESH = 128
_STATES = 32
_U = np.uint64
_SURE = 1 << 16  # a table entry is confidence * _SURE + id, confidence at most 3


class _Model:
    """The lanes' predictions; lanes are in order of falling length, so the ones still at work come first."""

    def __init__(self, lanes: int, inverse: bool):
        place = np.arange(lanes, dtype=np.int64)
        self.base_one, self.base_two = place << _ONE_BITS, place << _TWO_BITS
        self.base_state, self.base_group, self.base_edge, self.base_scale = (place * n for n in (_STATES, _GROUPS, _GROUPS + 1, _LEAST))
        self.one, self.two = np.zeros(lanes << _ONE_BITS, np.int64), np.zeros(lanes << _TWO_BITS, np.int64)
        self.votes = np.tile(np.array([1, 1, 2], np.int64), lanes * _STATES)
        self.counts = np.ones(lanes * _GROUPS, np.int64)
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.step, self.inverse = 0, inverse
        self._refresh(lanes)

    def _refresh(self, n: int) -> None:
        """Shares of each state and edges of order 0 from the counts of the first ``n`` lanes so far."""
        votes = self.votes[: n * _STATES * 3].reshape(-1, 3)
        full = votes[:, 0] + votes[:, 1] + votes[:, 2] > 4000
        votes[full] = (votes[full] >> 1) + 1
        span = (1 << _TOTAL) - _LEAST - 2
        total = votes.sum(axis=1)
        self.share_two_of = 1 + votes[:, 0] * span // total
        self.share_one_of = 1 + votes[:, 1] * span // total
        total = np.cumsum(self.counts[: n * _GROUPS].reshape(n, _GROUPS), axis=1)
        edges = np.zeros((n, _GROUPS + 1), np.int64)
        edges[:, 1:] = total * (_LEAST - _GROUPS) // total[:, -1:] + np.arange(1, _GROUPS + 1)
        self.edges = edges.reshape(-1)
        if self.inverse:
            self.group_of = np.repeat(np.tile(np.arange(_GROUPS, dtype=np.uint8), n), np.diff(edges, axis=1).reshape(-1))

    def predict(self, n: int) -> None:
        """Set the predicted ids and the shares of the range for the first ``n`` lanes."""
        if self.step and (self.step % _REFRESH == 0 or self.step in (16, 32, 64)):
            self._refresh(n)
        last = self.last[:n]
        spread = last * 0x9E3779B1
        self.at_one = self.base_one[:n] + (spread >> 21 & (1 << _ONE_BITS) - 1)
        self.at_two = self.base_two[:n] + ((spread + self.before[:n] * 0x85EBCA77) >> 20 & (1 << _TWO_BITS) - 1)
        self.of_one, self.of_two = self.one[self.at_one], self.two[self.at_two]
        self.id_one, self.id_two = self.of_one & 0xFFFF, self.of_two & 0xFFFF
        state = (self.of_two >> 16 << 2) + (self.of_one >> 16) + ((self.id_one == self.id_two).view(np.int8) << np.int8(4))
        self.at_state = state + self.base_state[:n]
        self.share_two = self.share_two_of[self.at_state]
        self.share_one = self.share_one_of[self.at_state]
        self.start_zero = self.share_two + self.share_one
        self.share_zero = (1 << _TOTAL) - self.start_zero

    def group(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, share) of the groups' intervals."""
        at = self.base_edge[: len(group)] + group
        low = self.edges[at] * self.share_zero >> _SCALE
        return low + self.start_zero, (self.edges[at + 1] * self.share_zero >> _SCALE) - low

    def group_at(self, at: np.ndarray) -> np.ndarray:
        """The group whose interval holds a place of order 0; any group for other places."""
        y = np.maximum(((at - self.start_zero + 1) << _SCALE) - 1, 0) // self.share_zero
        return self.group_of[self.base_scale[: len(at)] + y].astype(np.int64)

    def learn(self, n: int, ids: np.ndarray, hit_two: np.ndarray, hit_one: np.ndarray) -> None:
        """Take in the ids that came."""
        sure = ids + 3 * _SURE
        self.two[self.at_two] = np.where(hit_two, np.minimum(self.of_two + _SURE, sure), ids)
        self.one[self.at_one] = np.where(self.id_one == ids, np.minimum(self.of_one + _SURE, sure), ids)
        # which of the three was right: 0, 1 or 2
        miss_two = ~hit_two
        self.votes[self.at_state * 3 + miss_two + (miss_two & ~hit_one)] += 24
        self.counts[self.base_group[:n] + (ids >> 8)] += 32
        self.before[:n] = self.last[:n]
        self.last[:n] = ids
        self.step += 1


class _Writer:
    """Range coders of the lanes; all intervals are parts of 2**24."""

    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, np.iinfo(np.uint64).max, _U)
        self.width = steps * 3 // 4 + 4  # a step narrows the range by at most 24 bits
        self.out, self.at = np.zeros(lanes * self.width, _U), np.arange(lanes) * self.width

    def put(self, n: int, start: np.ndarray, share: np.ndarray) -> None:
        part = self.range[:n] >> _U(24)
        added = part * start.view(_U)
        low = self.low[:n]
        low += added
        carry = np.flatnonzero(low < added)
        if len(carry):
            self.out[self.at[carry] - 1] += _U(1)
        span = np.multiply(part, share.view(_U), out=self.range[:n])
        full = np.flatnonzero(span < _U(1 << 32))
        at, ready = self.at[full], low[full]
        self.out[at] = ready >> _U(32)
        self.at[full] = at + 1
        low[full] = ready << _U(32)
        span[full] <<= _U(32)

    def finish(self) -> list[bytes]:
        self.out[self.at] = self.low >> _U(32)
        self.out[self.at + 1] = self.low & _U((1 << 32) - 1)
        out = self.out.reshape(-1, self.width)
        for i in range(out.shape[1] - 1, 0, -1):
            out[:, i - 1] += out[:, i] >> _U(32)
        ends = self.at + 2 - np.arange(len(out)) * self.width
        return [row[:n].astype("<u4").tobytes() for row, n in zip(out, ends.tolist(), strict=True)]


class _Reader:
    def __init__(self, codes: list[bytes]):
        width = max((len(c) // 4 for c in codes), default=0) + 3
        words = np.zeros((len(codes), width), "<u4")
        for row, code in zip(words, codes, strict=True):
            row[: len(code) // 4] = np.frombuffer(code[: len(code) // 4 * 4], "<u4")
        self.value = words[:, 0].astype(_U) << _U(32) | words[:, 1]
        self.words, self.at, self.end = words.reshape(-1), np.arange(len(codes)) * width + 2, words.size - 1
        self.range = np.full(len(codes), np.iinfo(np.uint64).max, _U)

    def get(self, n: int) -> np.ndarray:
        """Where in 2**24 the lanes' codes are."""
        self.part = self.range[:n] >> _U(24)
        return np.minimum(self.value[:n] // self.part, _U((1 << 24) - 1)).view(np.int64)

    def take(self, n: int, start: np.ndarray, share: np.ndarray) -> None:
        value = self.value[:n]
        value -= self.part * start.view(_U)
        span = np.multiply(self.part, share.view(_U), out=self.range[:n])
        full = np.flatnonzero(span < _U(1 << 32))
        at = self.at[full]
        value[full] = value[full] << _U(32) | self.words[np.minimum(at, self.end)]  # a damaged code may ask for more
        self.at[full] = at + 1
        span[full] <<= _U(32)


def _by_length(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(lanes from long to short, lanes at work at each step)."""
    order = np.argsort(-np.array(lengths, np.int64), kind="stable")
    sizes = np.array(lengths, np.int64)[order]
    return order, len(sizes) - np.searchsorted(sizes[::-1], np.arange(int(sizes.max(initial=0))), side="right")


def packed(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of ids as bytes, head included."""
    blocks = [np.asarray(b, "<u2") for b in blocks]
    codes: list[bytes] = [b""] * len(blocks)
    order, active = _by_length([len(b) for b in blocks])
    if len(active):
        ids = np.zeros((len(active), len(blocks)), np.uint16)
        for lane, k in enumerate(order):
            ids[: len(blocks[k]), lane] = blocks[k]
        model, coder = _Model(len(blocks), inverse=False), _Writer(len(blocks), len(active))
        for row, n in zip(ids, active.tolist(), strict=True):
            got = row[:n].astype(np.int64)
            model.predict(n)
            hit_two, hit_one = model.id_two == got, model.id_one == got
            low, share = model.group(got >> 8)
            start = (low << 8) + (got & 0xFF) * share
            start = np.where(hit_two, 0, np.where(hit_one, model.share_two << 8, start))
            share = np.where(hit_two, model.share_two << 8, np.where(hit_one, model.share_one << 8, share))
            coder.put(n, start, share)
            model.learn(n, got, hit_two, hit_one)
        for lane, code in enumerate(coder.finish()):
            if len(blocks[order[lane]]):
                codes[order[lane]] = code
    return [struct.pack(HEAD, MARK, len(b), zlib.crc32(b.astype("<u4").tobytes())) + c for b, c in zip(blocks, codes, strict=True)]


def unpacked(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; a block that is damaged raises."""
    heads = [struct.unpack_from(HEAD, b) if len(b) >= HEAD_SIZE else (b"", 0, 0) for b in blocks]
    if any(mark != MARK for mark, _, _ in heads):
        raise ValueError("not a block of token ids")
    if any(n > 1 << 24 for _, n, _ in heads):
        raise ValueError("a block of token ids names too many ids")
    order, active = _by_length([n for _, n, _ in heads])
    ids = np.zeros((len(blocks), len(active)), np.uint16)
    if len(active):
        model, coder = _Model(len(blocks), inverse=True), _Reader([blocks[k][HEAD_SIZE :] for k in order])
        for t, n in enumerate(active.tolist()):
            model.predict(n)
            place = coder.get(n)
            at = place >> 8
            hit_two = at < model.share_two
            hit_one = ~hit_two & (at < model.start_zero)
            group = model.group_at(at)
            low, share = model.group(group)
            rest = (place - (low << 8)) // share
            start = (low << 8) + rest * share
            start = np.where(hit_two, 0, np.where(hit_one, model.share_two << 8, start))
            coder.take(n, start, np.where(hit_two, model.share_two << 8, np.where(hit_one, model.share_one << 8, share)))
            got = np.where(hit_two, model.id_two, np.where(hit_one, model.id_one, (group << 8) + (rest & 0xFF)))
            model.learn(n, got, hit_two, hit_one)
            ids[:n, t] = got
    out: list[np.ndarray] = [np.zeros(0, "<u2")] * len(blocks)
    for lane, k in enumerate(order):
        _, n, check = heads[k]
        out[k] = ids[lane, :n].astype("<u2")
        if zlib.crc32(out[k].astype("<u4").tobytes()) != check:
            raise ValueError("checksum of a block of token ids doesn't match")
    return out
