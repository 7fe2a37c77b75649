"""Token ids of whole texts, encoded unit by unit.

The vocabulary used drops white space and never merges across it, and its own
pattern splits letters from signs. So a text's ids are the ids of its units in
a row, where a unit is a run of letters, a run of plain ASCII signs, or, where
a word holds anything else, the whole word. A unit is encoded once per worker
rather than once per place.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from trafficloom.llm.words import SLICE_BYTES, WHITE, buffers, byte_values, mix, power_tables

# Units kept per worker: ids and hashes, about 40 bytes each.
CACHED_UNITS = 600_000
_CHUNK = 2_000
_SPACE, _LETTER, _SIGN, _OTHER = 0, 1, 2, 3


def _classes() -> np.ndarray:
    table = np.full(256, _OTHER, np.uint8)
    table[WHITE] = _SPACE
    for b in range(128):
        c = chr(b)
        if c.isalpha():
            table[b] = _LETTER
        elif c.isprintable() and not c.isalnum() and c not in " '<":
            table[b] = _SIGN
    # Two-byte characters from U+00C0 to U+027F: all letters but two.
    table[0xC3:0xCA] = _LETTER
    table[0x80:0xC0] = _LETTER
    return table


_CLASS = _classes()


# Hashes in order, first places and numbers of ids.
_NO_UNITS = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))


@dataclass
class UnitEncoder:
    """Encodes with the tokenizer file at ``path``; ids are unsigned 32-bit numbers."""

    path: str
    main: tuple[np.ndarray, ...] = _NO_UNITS
    recent: tuple[np.ndarray, ...] = _NO_UNITS
    flat: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint32))

    def __post_init__(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(self.path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, number in vocabulary.items():
            self.ends_word[number] = token.endswith("</w>")

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units in a row and the number of each unit's ids."""
        all_ids, all_sizes = [], []
        for at in range(0, len(units), _CHUNK):
            chunk = units[at : at + _CHUNK]
            whole = self.tokenizer.encode_batch_fast([" ".join(chunk)], add_special_tokens=False)[0]
            ids = np.array(whole.ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(chunk) or (len(ends) and ends[-1] != len(ids)):
                # Some unit is several words of the tokenizer: go by the places of the ids.
                whole = self.tokenizer.encode(" ".join(chunk), add_special_tokens=False)
                ids = np.array(whole.ids, np.uint32)
                starts = np.array([o[0] for o in whole.offsets], np.int64)
                places = np.cumsum([len(u) + 1 for u in chunk])
                ends = np.searchsorted(starts, places)
            all_ids.append(ids)
            all_sizes.append(np.diff(ends, prepend=0))
        return np.concatenate(all_ids), np.concatenate(all_sizes)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice of texts in a row, and the bounds of each text's ids."""
        data, bounds = buffers(texts)
        if len(data) > 4 * SLICE_BYTES:
            return self._encode_long(data, bounds)
        classes = _CLASS[data]
        signs = np.flatnonzero(data == 0xC3)
        signs = signs[np.isin(data[signs + 1], (0x97, 0xB7))]
        classes[signs] = _OTHER
        inner = bounds[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        spaces = classes == _SPACE
        first = np.empty(len(data), bool)
        first[:1] = True
        first[1:] = spaces[:-1]
        first[inner] = True
        odd = np.flatnonzero(classes == _OTHER)
        values = byte_values(True)[data]
        whole_words = np.zeros(len(data), bool)
        if len(odd):
            # Words with anything else are units as they stand, case and all.
            words = np.flatnonzero(first & ~spaces)
            ends = np.append(words[1:], len(data))
            hit = np.unique(np.searchsorted(words, odd, "right") - 1)
            mask = np.zeros(len(data) + 1, np.int8)
            mask[words[hit]] += 1
            mask[ends[hit]] -= 1
            inside = np.cumsum(mask[:-1]).astype(bool) & ~spaces
            classes[inside] = _LETTER
            whole_words = inside
            values[inside] = byte_values(False)[data[inside]] ^ np.uint64(0x5555555555555555)
        first[1:] |= classes[1:] != classes[:-1]
        starts = np.flatnonzero(first & ~spaces)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        powers, inverses = power_tables(len(data))
        values[spaces] = 0
        values *= powers[: len(data)]
        hashes = mix(np.add.reduceat(values, starts) * inverses[starts])
        distinct, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = starts[index]
        begins, sizes, flat = self._find(distinct, data, at, spaces | first, whole_words[at])
        lengths = sizes[inverse]
        ends = np.cumsum(lengths)
        ids = flat[np.arange(ends[-1]) + np.repeat(begins[inverse] - (ends - lengths), lengths)]
        return ids, np.concatenate(([0], ends))[np.searchsorted(starts, bounds)]

    def _find(self, distinct, data, starts, breaks, odd):
        """Where the ids of distinct units are in a flat array of ids."""
        begins, sizes = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        missing = np.ones(len(distinct), bool)
        for cache in (self.main, self.recent):
            if len(cache[0]):
                at = np.minimum(np.searchsorted(cache[0], distinct), len(cache[0]) - 1)
                hit = cache[0][at] == distinct
                begins[hit], sizes[hit] = cache[1][at[hit]], cache[2][at[hit]]
                missing &= ~hit
        if not missing.any():
            return begins, sizes, self.flat
        stops = np.append(np.flatnonzero(breaks), len(data))
        stops = stops[np.searchsorted(stops, starts, "right")]
        raw = data.tobytes()
        flat = self.flat
        for kind in (missing & ~odd, missing & odd):
            if kind.any():
                units = [raw[s:e].decode() for s, e in zip(starts[kind].tolist(), stops[kind].tolist())]
                ids, fresh = self._encode_units(units)
                begins[kind] = len(flat) + np.cumsum(fresh) - fresh
                sizes[kind] = fresh
                flat = np.concatenate((flat, ids))
        if len(self.main[0]) + len(self.recent[0]) < CACHED_UNITS:
            self.flat = flat
            self.recent = self._merged(self.recent, (distinct[missing], begins[missing], sizes[missing]))
            if len(self.recent[0]) > 50_000 + len(self.main[0]) // 8:
                self.main, self.recent = self._merged(self.main, self.recent), _NO_UNITS
        return begins, sizes, flat

    @staticmethod
    def _merged(a, b):
        order = np.argsort(np.concatenate((a[0], b[0])), kind="stable")
        return tuple(np.concatenate((x, y))[order] for x, y in zip(a, b))

    def _encode_long(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A slice above a few megabytes: texts are cut after white space and encoded in pieces."""
        parts, counts = [], []
        for begin, end in zip(bounds[:-1], bounds[1:]):
            total = 0
            while begin < end:
                stop = min(begin + SLICE_BYTES, end)
                while stop < end and not WHITE[data[stop - 1]]:
                    stop += 1
                piece = pa.array([data[begin:stop].tobytes()], pa.binary()).cast(pa.string())
                if stop - begin > 4 * SLICE_BYTES:
                    # One word of megabytes: nothing to share, encoded as it is.
                    ids = np.array(self.tokenizer.encode(piece[0].as_py(), add_special_tokens=False).ids, np.uint32)
                else:
                    ids, _ = self.encode(piece)
                parts.append(ids)
                total += len(ids)
                begin = stop
            counts.append(total)
        ids = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        return ids, np.concatenate(([0], np.cumsum(counts))).astype(np.int64)


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """The worker's encoder for this file; it lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]
