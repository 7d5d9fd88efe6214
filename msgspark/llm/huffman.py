"""Canonical length-limited Huffman codes, and blocks of ids that decode on their own."""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"IDH1"
STEP = 64  # ids between two checkpoints
HEADER = struct.Struct("<4sIIQ")


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Bits of each symbol, at most ``limit``, with the least total (package-merge); 0 for a count of 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64) if counts.max() > 1 << 50 else counts[order].astype(np.int64)
    level, is_symbol = weight, [np.ones(len(order), bool)]
    for _ in range(limit - 1):
        pairs = len(level) // 2
        packages = level[0: 2 * pairs: 2] + level[1: 2 * pairs: 2]
        both = np.concatenate([weight, packages])
        sort = np.argsort(both, kind="stable")
        level = both[sort]
        is_symbol.append(sort < len(order))
    take, bits = 2 * len(order) - 2, np.zeros(len(order), np.int64)
    for flags in reversed(is_symbol):
        symbols = int(flags[:take].sum())
        bits[:symbols] += 1
        take = 2 * (take - symbols)
    lengths[order] = bits
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol), so the lengths alone restore them."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    n = lengths[order].astype(np.int64)
    if len(order):
        top = int(n[-1])
        room = np.left_shift(np.uint64(1), (top - n).astype(np.uint64))  # leaves below a code at the lowest level
        codes[order] = (np.cumsum(room) - room) >> (top - n).astype(np.uint64)
    return codes


class Decoder:
    """One table look-up for each id: the next ``bits`` bits give symbol and length."""

    def __init__(self, lengths: np.ndarray):
        self.bits = max(1, int(lengths.max(initial=1)))
        order = np.flatnonzero(lengths)
        order = order[np.lexsort((order, lengths[order]))]
        share = np.left_shift(1, self.bits - lengths[order].astype(np.int64))
        self.symbol, self.length = np.zeros(1 << self.bits, np.uint32), np.ones(1 << self.bits, np.int64)
        self.symbol[: share.sum()] = np.repeat(order, share)
        self.length[: share.sum()] = np.repeat(lengths[order], share)

    def ids(self, block: bytes) -> np.ndarray:
        magic, step, n, size = HEADER.unpack_from(block)
        if magic != MAGIC:
            raise ValueError("not a block of ids")
        lanes = -(-n // step)
        at = np.frombuffer(block, "<u4", lanes, HEADER.size).astype(np.int64) if lanes else np.zeros(0, np.int64)
        stream = np.frombuffer(block, np.uint8, size, HEADER.size + 4 * lanes)
        padded = np.concatenate([stream, np.zeros(8, np.uint8)])
        words = np.zeros(size + 1, np.uint64)  # the 4 bytes from each byte on
        for k in range(4):
            words = (words << np.uint64(8)) | padded[k: k + size + 1]
        out = np.zeros((step, lanes), np.uint32)
        live, mask = lanes, (1 << self.bits) - 1
        for k in range(step):
            if k and lanes and k == n - step * (lanes - 1):  # the last lane may be short
                live, at = lanes - 1, at[: lanes - 1]
            peek = (words[at >> 3].astype(np.int64) >> (32 - self.bits - (at & 7))) & mask
            out[k, :live] = self.symbol[peek]
            at = at + self.length[peek]
        return out.T.reshape(-1)[:n]


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """Header, bit offsets of every STEP-th id, then the bits; longest code 24 bits."""
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    starts = ends - bits
    total = int(ends[-1]) if len(ids) else 0
    n_words = total // 32 + 2
    at = starts >> 5
    shifted = codes[ids] << (np.uint64(64) - (starts & 31).astype(np.uint64) - bits.astype(np.uint64))
    words = np.zeros(n_words, np.uint64)
    if len(ids):
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        merged = np.bitwise_or.reduceat(shifted, first)
        words[at[first]] |= merged >> np.uint64(32)
        words[at[first] + 1] |= merged & np.uint64(0xFFFFFFFF)
    stream = words.astype(">u4").tobytes()[: -(-total // 8)]
    if total >> 32:
        raise ValueError("block too long for 32-bit checkpoints")
    return HEADER.pack(MAGIC, STEP, len(ids), len(stream)) + starts[::STEP].astype("<u4").tobytes() + stream
