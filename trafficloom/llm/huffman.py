"""Canonical length-limited Huffman codes over arrays of ids."""

from __future__ import annotations

import numpy as np

# Codes are at most this long; longer only if so many ids need it.
LENGTH_LIMIT = 18
# Ids between two checkpoints of a document's bits.
STEP = 256


def length_limit(symbols: int) -> int:
    return max(LENGTH_LIMIT, int(symbols - 1).bit_length() + 1 if symbols > 1 else 1)


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = len(level) // 2
        packages = level[: 2 * pairs].reshape(pairs, 2).sum(1)
        both = np.concatenate((leaves, packages))
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        is_leaf.append(rank < n)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for flags in reversed(is_leaf):
        chosen = int(flags[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical_codes(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id), each the next number of its length."""
    order = np.lexsort((ids, lengths))
    codes = np.zeros(len(ids), np.uint64)
    code, last = 0, 0
    for i in order.tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


class Encoder:
    def __init__(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        size = int(ids.max()) + 1 if len(ids) else 0
        self.codes, self.lengths = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.codes[ids], self.lengths[ids] = canonical_codes(ids, lengths), lengths

    def encode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits of each text's ids from a byte of its own on: bytes, bounds of each
        text's bytes, and the bit at which each id begins within its text."""
        lengths = self.lengths[ids]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        text_bits = ends[bounds[1:]] - ends[bounds[:-1]]
        byte_bounds = np.concatenate(([0], np.cumsum((text_bits + 7) // 8)))
        within = ends[:-1] - np.repeat(ends[bounds[:-1]], np.diff(bounds))
        place = within + np.repeat(byte_bounds[:-1] * 8, np.diff(bounds))
        words = np.zeros(byte_bounds[-1] // 8 + 2, np.uint64)
        if len(ids):
            codes = self.codes[ids]
            word = place >> 6
            room = 64 - (place & 63) - lengths
            # A code that does not fit ends in the next word.
            over = np.maximum(-room, 0).astype(np.uint64)
            high = (codes >> over) << np.maximum(room, 0).astype(np.uint64)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            words[word[first]] = np.add.reduceat(high, first)
            split = np.flatnonzero(room < 0)
            words[word[split] + 1] += codes[split] << (np.uint64(64) - over[split])
        return words.astype(">u8").view(np.uint8)[: byte_bounds[-1]], byte_bounds, within


class Decoder:
    """Table-driven: the next bits, as many as the longest code has, are the place of the id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.width = int(lengths.max()) if len(lengths) else 1
        self.ids = np.zeros(1 << self.width, np.uint32)
        self.lengths = np.zeros(1 << self.width, np.int64)
        order = np.lexsort((ids, lengths))
        spans = np.int64(1) << (self.width - lengths[order])
        filled = int(spans.sum())
        self.ids[:filled] = np.repeat(ids[order].astype(np.uint32), spans)
        self.lengths[:filled] = np.repeat(lengths[order], spans)

    def decode(self, data: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of many runs of bits side by side, one after another in the result."""
        out = np.empty(int(counts.sum()), np.uint32)
        places = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        place, bit, left = places[order], starts[order].astype(np.int64), counts[order]
        padded = np.concatenate((data, np.zeros(4, np.uint8))).astype(np.uint32)
        window = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
        shift = np.uint32(32 - self.width)
        for step in range(int(left[0]) if len(left) else 0):
            active = int(np.searchsorted(-left, -step, "left"))
            at = bit[:active]
            slot = (window[at >> 3] << (at & 7).astype(np.uint32)) >> shift
            out[place[:active] + step] = self.ids[slot]
            bit[:active] = at + self.lengths[slot]
        return out
