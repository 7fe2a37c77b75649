"""Words of many texts at once, as 64-bit hashes over Arrow buffers.

A word is a run of bytes that are not separators. Texts are worked on in
slices of about a megabyte, so memory does not grow with a partition; a text
longer than that is a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
# Space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
# Everything in ASCII but letters and digits.
NOT_ALPHANUMERIC = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (a bijection)."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def _byte_values(fold_case: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    if fold_case:
        values[65:91] = values[97:123]
    return values


_VALUES = {True: _byte_values(True), False: _byte_values(False)}


def byte_values(fold_case: bool) -> np.ndarray:
    """The value each byte adds to the hash of its word."""
    return _VALUES[fold_case]


_powers: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.uint64))


def power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < size:
        tables = []
        for base in (_BASE, _INVERSE):
            steps = np.full(max(size, SLICE_BYTES + 1), base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers = (tables[0], tables[1])
    return _powers


@dataclass
class Words:
    """Words of a slice of texts; text ``i`` has words ``bounds[i]:bounds[i + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an array of texts; a null text has no bytes."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def release_unused() -> None:
    """Gives memory that arrays no longer use back to the system. Workers outlive their tasks, and
    an idle one would keep what its largest slice needed."""
    pa.default_memory_pool().release_unused()
    # Of glibc; other C libraries have no such function.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one text."""
    _, bounds = buffers(texts)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, last
        first = last
    release_unused()


def _hash_piece(data: np.ndarray, starts: np.ndarray, spaces: np.ndarray, fold_case: bool) -> np.ndarray:
    powers, inverses = power_tables(len(data))
    values = _VALUES[fold_case][data]
    values[spaces] = 0
    values *= powers[: len(data)]
    return mix(np.add.reduceat(values, starts) * inverses[starts])


def hash_pieces(data: np.ndarray, starts: np.ndarray, spaces: np.ndarray, fold_case: bool) -> np.ndarray:
    """Hashes of the pieces from each start to the next, bytes in ``spaces`` aside."""
    if not len(starts):
        return np.empty(0, np.uint64)
    if len(data) <= 4 * SLICE_BYTES:
        return _hash_piece(data, starts, spaces, fold_case)
    # A very long text: hash it in pieces that begin with a start.
    hashes = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(int(np.searchsorted(starts, starts[first] + SLICE_BYTES)), first + 1)
        begin = starts[first]
        end = starts[last] if last < len(starts) else len(data)
        hashes[first:last] = _hash_piece(data[begin:end], starts[first:last] - begin, spaces[begin:end], fold_case)
        first = last
    return hashes


def split_words(texts: pa.Array, separators: np.ndarray = WHITE, fold_case: bool = True) -> Words:
    """Words of a slice. With ``fold_case`` the letters A-Z hash like a-z."""
    data, bounds = buffers(texts)
    if not len(data):
        none = np.empty(0, np.int64)
        return Words(data, none, none, none.astype(np.uint64), np.zeros(len(texts) + 1, np.int64))
    spaces = separators[data]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = spaces[:-1]
    before[inner] = True
    starts = np.flatnonzero(before & ~spaces)
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = spaces[1:]
    after[inner - 1] = True
    ends = np.flatnonzero(after & ~spaces) + 1
    hashes = hash_pieces(data, starts, spaces, fold_case)
    return Words(data, starts, ends, hashes, np.searchsorted(starts, bounds))


def windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words and the bounds of each text's runs.

    A text with fewer words, but at least one, has its whole sequence as its only run.
    """
    counts = words.counts
    n_runs = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    run_bounds = np.concatenate(([0], np.cumsum(n_runs)))
    total = int(run_bounds[-1])
    if not total:
        return np.empty(0, np.uint64), run_bounds
    factors = [np.uint64(pow(_BASE, i + 1, 1 << 64)) for i in range(width)]
    first = np.arange(total) - np.repeat(run_bounds[:-1], n_runs) + np.repeat(words.bounds[:-1], n_runs)
    padded = np.concatenate((words.hashes, np.zeros(width, np.uint64)))
    runs = np.zeros(total, np.uint64)
    short = np.repeat(counts < width, n_runs)
    length = np.repeat(np.minimum(counts, width), n_runs)
    for i in range(width):
        part = padded[first + i] * factors[i]
        if short.any():
            part[length <= i] = 0
        runs += part
    return mix(runs + length.astype(np.uint64)), run_bounds
