"""Canonical length-limited Huffman codes over non-negative ids."""

from __future__ import annotations

import numpy as np

MAX_BITS = 18  # of a code, or one more than it takes to number the used ids, up to WIDEST
WIDEST = 25  # the decoder reads codes from windows of 32 bits that begin on a byte
EVERY = 64  # ids between two checkpoints


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths (package-merge) of at most ``max_bits``, more if the ids are too many for that; 0 for ids that do not occur."""
    counts = np.asarray(counts, np.int64)
    lengths = np.zeros(len(counts), np.uint8)
    used = np.nonzero(counts)[0]
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    max_bits = max(max_bits, min(WIDEST, len(used).bit_length() + 1))
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids need codes longer than {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    single = counts[order]
    levels, packages = [], np.empty(0, np.int64)
    for _ in range(max_bits):
        merged = np.concatenate([single, packages])
        ranked = np.argsort(merged, kind="stable")
        levels.append(np.cumsum(ranked < len(single)))  # singles among the first items of the level
        packages = merged[ranked]
        packages = packages[: len(packages) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(used) - 2
    for singles in reversed(levels):
        if not take:
            break
        n = int(singles[take - 1])
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.nonzero(lengths)[0]
    order = used[np.lexsort((used, lengths[used]))]
    code, bits = 0, 0
    for symbol, length in zip(order.tolist(), lengths[order].tolist()):
        code <<= length - bits
        bits = length
        codes[symbol] = code
        code += 1
    return codes


def encode(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> list[tuple[bytes, np.ndarray]]:
    """Of every document (``sizes`` ids each, none empty): its bits, filled up to a byte, and the bit offsets of every ``EVERY``-th id."""
    if not len(ids):
        return []
    bits = lengths[ids].astype(np.int64)
    end = np.cumsum(bits)
    last = np.cumsum(sizes)
    first = last - sizes
    total = np.diff(end[last - 1], prepend=0)
    room = (total + 7) // 8
    at = np.cumsum(room) - room  # first byte of each document
    begin = end - bits - np.repeat(end[first] - bits[first], sizes)  # bits before, in the own document
    place = begin + np.repeat(8 * at, sizes)
    words = int(at[-1] + room[-1]) // 4 + 3
    shifted = codes[ids] << (64 - (place & 31) - bits).astype(np.uint64)
    word = place >> 5
    # Bits of different ids never overlap, so sums of 32-bit halves are exact in a double.
    high = np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), words)
    low = np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    data = (high + low).astype(np.uint64).astype(">u4").tobytes()
    return [
        (data[b:b + n], begin[f:l:EVERY]) for b, n, f, l in zip(at.tolist(), room.tolist(), first.tolist(), last.tolist())]


class Decoder:
    """Table-driven decoding: the next ``width`` bits index the id and the length of its code."""

    def __init__(self, lengths: np.ndarray):
        self.width = max(1, int(lengths.max(initial=1)))
        used = np.nonzero(lengths)[0]
        order = used[np.lexsort((used, lengths[used]))]
        spans = 1 << (self.width - lengths[order].astype(np.int64))
        filled = np.repeat(order, spans)  # canonical codes cover the table from its start without gaps
        self.table = np.zeros(1 << self.width, np.uint32)
        self.table[: len(filled)] = (filled.astype(np.uint32) << 5) | lengths[filled]

    def decode(self, payload: bytes, checkpoints: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """All ids; ``counts`` ids (at most ``EVERY``) follow each checkpoint. All checkpoints are walked side by side."""
        data = np.frombuffer(payload + b"\0\0\0\0", np.uint8).astype(np.uint32)
        windows = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        order = np.argsort(-counts, kind="stable")
        at, left = checkpoints[order].astype(np.int64), counts[order]
        found = np.zeros((EVERY, len(order)), np.uint32)
        drop = np.uint32(32 - self.width)
        for step in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -step, side="left"))
            pos = at[:live]
            entry = self.table[(windows[pos >> 3] << (pos & 7).astype(np.uint32)) >> drop]
            found[step, :live] = entry >> np.uint32(5)
            pos += entry & np.uint32(31)
        rows = np.empty((len(order), EVERY), np.uint32)
        rows[order] = found.T
        return rows[np.arange(EVERY) < counts[:, None]]
