"""Language-model scores from a log-frequency Bloom filter.

The filter holds quantised counts of words and word pairs: an n-gram of
level q is entered q times, once for each level up to its own, so its level is
found by probing until a probe fails, and no n-gram is stored. The filter is
cut into segments by hash, so each is built by the task that has summed its
n-grams, and their number grows with the n-grams. A segment has as many bits as
what is to be entered asks for, so every n-gram is held. As long as all
segments together have no more than a fixed number of bits they are broadcast;
beyond that the distinct n-grams of a block of texts are sent to the segments.
The same bits are probed either way, so the scores are the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficloom.llm.tables import written
from trafficloom.llm.words import Words, mix, slices, split_words

# The largest filter that is broadcast: 8 MB on the driver and in each worker.
FILTER_BITS = 1 << 26
PROBES = 4
# Counts are quantised to powers of this.
LOG_BASE = 1.5
MAX_LEVEL = 64
# Words looked up in memory, the most frequent ones; the rest are joined by shuffle.
HEAD_WORDS = 1_000_000
# Weight of the word's own probability against the counts of pairs; high, as most pairs of text seen once say little.
PRIOR = 1000.0
# Words gathered in a task before their n-grams are summed and passed on.
FLUSH_WORDS = 2_000_000
ENTRIES_PER_SEGMENT = 1 << 21
# Bits of a segment for each probe that entering sets one for, at least; up to twice as many.
BITS_PER_ENTRY = 2
FINGERPRINT_BITS = 48
# Where no filter is broadcast: bytes of the texts whose n-grams are looked up together, and of a token, about.
BLOCK_BYTES = 8 << 20
TOKEN_BYTES = 6

END = np.uint64(0x9AE16A3B2F90404F)
START = np.uint64(0xC3A5C85C97CB3127)
_PAIR = np.uint64(0x9DDFEA08EB382D69)
_ONE = np.uint64(0x8F14E45FCEEA167A)


def token_runs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a slice (words and one end per text), the token before each (a start first), and bounds."""
    counts = words.counts + 1
    bounds = np.concatenate(([0], np.cumsum(counts)))
    tokens = np.full(int(bounds[-1]), END, np.uint64)
    is_word = np.ones(len(tokens), bool)
    is_word[bounds[1:] - 1] = False
    tokens[is_word] = words.hashes
    before = np.empty(len(tokens), np.uint64)
    before[1:] = tokens[:-1]
    before[bounds[:-1]] = START
    return tokens, before, bounds


def pair_hash(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(before * _PAIR + tokens)


def word_hash(tokens: np.ndarray) -> np.ndarray:
    return mix(tokens ^ _ONE)


def summed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)
    return values[first], (np.add.reduceat(counts, first) if len(first) else counts)


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values, ascending. Sorting whole numbers takes a small part of the time of np.unique's hashing."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): the counts of all tokens, end included. Words are 64-bit hashes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def flush() -> pa.RecordBatch:
            words, counts = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "n"])

        for batch in batches:
            for first, last in slices(batch["text"]):
                tokens, _, _ = token_runs(split_words(batch["text"].slice(first, last - first)))
                waiting.append(tokens)
                size += len(tokens)
                if size >= FLUSH_WORDS:
                    yield flush()
                    waiting, size = [], 0
        if waiting:
            yield flush()

    return docs.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(1 + np.floor(np.log(counts) / math.log(LOG_BASE) + 1e-9), MAX_LEVEL).astype(np.int64)


def level_values() -> np.ndarray:
    """The count a level stands for: the mean of the whole numbers it covers."""
    values = np.zeros(MAX_LEVEL + 1)
    for q in range(1, MAX_LEVEL + 1):
        low, high = math.ceil(LOG_BASE ** (q - 1) - 1e-9), math.ceil(LOG_BASE**q - 1e-9) - 1
        values[q] = (low + max(high, low)) / 2
    return values


def _places(entries: np.ndarray, level: np.ndarray | int, words: np.ndarray | np.uint64) -> tuple[np.ndarray, list[np.ndarray]]:
    """The 64-bit word of a segment that an entry of a level uses, ``words`` being their number (a power of two),
    and the bits in it. All are in one word, so that a probe reads memory once."""
    seed = mix(entries + np.asarray(level, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    word = (seed >> np.uint64(32)) & (words - np.uint64(1))
    return word, [(seed >> np.uint64(6 * i)) & np.uint64(63) for i in range(PROBES)]


def probed(data: np.ndarray, first: np.ndarray | np.uint64, words: np.ndarray | np.uint64, entries: np.ndarray) -> np.ndarray:
    """The level of each entry, 0 if it is not held: its segment begins at the word ``first`` of ``data`` and has
    ``words`` of them, and is probed level by level until one fails."""
    found = np.zeros(len(entries), np.int64)
    alive, own = np.arange(len(entries)), entries
    first, words = (np.broadcast_to(x, len(entries)) if np.ndim(x) == 0 else x for x in (first, words))
    for level in range(1, MAX_LEVEL + 1):
        word, bits = _places(own, level, words)
        wanted = np.zeros(len(own), np.uint64)
        for bit in bits:
            wanted |= np.uint64(1) << bit
        held = data[(first + word).astype(np.int64)] & wanted == wanted
        alive, own, first, words = alive[held], own[held], first[held], words[held]
        if not len(alive):
            break
        found[alive] = level
    return found


@dataclass(frozen=True)
class Filter:
    bounds: np.ndarray  # first word of each segment, and the end of the last; their number is a power of two
    data: np.ndarray  # words of 64 bits, segment after segment

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """The level of each n-gram, 0 if it is not held."""
        segment = segment_of(hashes, len(self.bounds) - 1).astype(np.int64)
        words = np.diff(self.bounds)[segment]
        return probed(self.data, self.bounds[segment], words, hashes >> np.uint64(64 - FINGERPRINT_BITS))


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    bits = segments.bit_length() - 1
    return hashes >> np.uint64(64 - bits) if bits else np.zeros_like(hashes)


def _packed(entries: np.ndarray) -> bytes:
    """Ascending entries as differences, of 32 bits where they fit."""
    steps = np.diff(entries, prepend=np.uint64(0))
    rest = steps[1:]
    kind = np.uint32 if not len(rest) or rest.max() < 1 << 32 else np.uint64
    return steps[:1].tobytes() + rest.astype(kind).tobytes()


def _unpacked(data: bytes, size: int) -> np.ndarray:
    kind = np.uint32 if len(data) == 8 + 4 * (size - 1) else np.uint64
    steps = np.concatenate((np.frombuffer(data[:8], np.uint64), np.frombuffer(data[8:], kind).astype(np.uint64)))
    return np.cumsum(steps, dtype=np.uint64)


def segments_for(tokens: int) -> int:
    return max(1, 1 << (max(1, 2 * tokens // ENTRIES_PER_SEGMENT) - 1).bit_length())


def _by_segment(entries: np.ndarray, segments: int) -> tuple[np.ndarray, list[slice]]:
    """The segments that ascending entries fall into, and the span of each."""
    hashes = entries << np.uint64(64 - FINGERPRINT_BITS)
    cuts = np.searchsorted(segment_of(hashes, segments), np.arange(segments + 1, dtype=np.uint64))
    used = np.flatnonzero(np.diff(cuts))
    return used, [slice(cuts[i], cuts[i + 1]) for i in used]


def _ngrams(now: np.ndarray, before: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    return [pair_hash(before, now), word_hash(now), word_hash(before[bounds[:-1]])]


def _shares(docs: DataFrame, segments: int) -> DataFrame:
    """Summed n-grams of some texts at a time, a segment's share as one packed value."""

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def flush() -> pa.RecordBatch:
            hashes, counts = np.unique(np.concatenate(waiting), return_counts=True)
            entries = hashes >> np.uint64(64 - FINGERPRINT_BITS)
            used, spans = _by_segment(entries, segments)
            arrays = [
                pa.array(used, pa.int32()),
                pa.array([s.stop - s.start for s in spans], pa.int32()),
                pa.array([_packed(entries[s]) for s in spans], pa.binary()),
                pa.array([counts[s].astype(np.uint32).tobytes() for s in spans], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(arrays, ["segment", "size", "entries", "counts"])

        for batch in batches:
            for first, last in slices(batch["text"]):
                now, before, bounds = token_runs(split_words(batch["text"].slice(first, last - first)))
                waiting += _ngrams(now, before, bounds)
                size += 2 * len(now)
                if size >= 2 * FLUSH_WORDS:
                    yield flush()
                    waiting, size = [], 0
        if waiting:
            yield flush()

    return docs.select("text").mapInArrow(share, "segment int, size int, entries binary, counts binary")


def _summed_shares(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Entries of a segment and their levels."""
    sizes = table["size"].to_pylist()
    entries = [_unpacked(e.as_py(), n) for e, n in zip(table["entries"], sizes)]
    counts = [np.frombuffer(c.as_py(), np.uint32).astype(np.int64) for c in table["counts"]]
    entries, counts = summed(np.concatenate(entries), np.concatenate(counts))
    return entries, levels_of(counts)


def _bits_of(entries: np.ndarray, levels: np.ndarray, entry_bits: int) -> np.ndarray:
    """The bytes of a segment that holds the entries, with as many bits as they need."""
    wanted = entry_bits * PROBES * int(levels.sum())
    bits = max(64, 1 << (wanted - 1).bit_length())
    flags = np.zeros(bits, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        word, places = _places(entries[levels >= level], level, np.uint64(bits // 64))
        for place in places:
            flags[((word << np.uint64(6)) + place).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little")


def build_segments(docs: DataFrame, segments: int, entry_bits: int = BITS_PER_ENTRY) -> DataFrame:
    """(segment, bits) of the filter of all words and word pairs of ``docs``; segments without n-grams have no row.

    Each task sums the n-grams of some texts at a time and sends a segment's
    share as one packed value; a segment's task adds those up. A level is
    never above its count, so a segment's bits are bounded by its share of
    the tokens.
    """

    def enter(table: pa.Table) -> pa.Table:
        data = _bits_of(*_summed_shares(table), entry_bits).tobytes()
        return pa.table({"segment": table["segment"][:1], "bits": pa.array([data], pa.binary())})

    return _shares(docs, segments).groupBy("segment").applyInArrow(enter, "segment int, bits binary")


def gathered(built: DataFrame, segments: int, filter_bits: int = FILTER_BITS) -> Filter | None:
    """The filter of all segments, if they have no more than ``filter_bits`` together."""
    if 8 * (built.agg(F.sum(F.octet_length("bits"))).first()[0] or 0) > filter_bits:
        return None
    # Segments without n-grams are a word of zeros.
    parts = [np.zeros(1, np.uint64)] * segments
    for row in built.toLocalIterator():
        parts[row["segment"]] = np.frombuffer(row["bits"], np.uint64)
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.uint64)
    return Filter(bounds, np.concatenate(parts))


@dataclass(frozen=True)
class LookedUp:
    """Levels of the n-grams of a block of texts, as their segments gave them."""

    entries: np.ndarray  # ascending
    found: np.ndarray

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        # In order, as searches near each other read the same memory.
        order = np.argsort(hashes)
        levels = np.empty(len(hashes), np.int64)
        levels[order] = self.found[np.searchsorted(self.entries, hashes[order] >> np.uint64(64 - FINGERPRINT_BITS))]
        return levels


def _block_entries(texts: pa.Array) -> np.ndarray:
    """The distinct n-grams of a block, ascending."""
    held = []
    for first, last in slices(texts):
        now, before, bounds = token_runs(split_words(texts.slice(first, last - first)))
        held.append(distinct(np.concatenate(_ngrams(now, before, bounds)) >> np.uint64(64 - FINGERPRINT_BITS)))
    return distinct(np.concatenate(held))


def _in_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(block, packed), a block having about ``block_bytes`` of text or one longer text, its rows compressed."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def block() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(pa.Table.from_batches(held).combine_chunks())
            packed = sink.getvalue().to_pybytes()
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([packed], pa.binary())], ["block", "packed"])

        for batch in batches:
            for first, last in slices(batch["text"]):
                part = batch.slice(first, last - first)
                held.append(part)
                size += (pc.sum(pc.binary_length(part["text"])).as_py() or 0) + 64 * part.num_rows
                if size >= block_bytes:
                    yield block()
                    number, held, size = number + 1, [], 0
        if held:
            yield block()

    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return numbered.mapInArrow(gather, "block bigint, packed binary")


def _rows_of(packed: pa.Scalar) -> pa.RecordBatch:
    """The documents (doc_id, text) of a block."""
    return pa.ipc.open_stream(packed.as_buffer()).read_all().combine_chunks().to_batches()[0]


def head_of(counts: DataFrame, size: int = HEAD_WORDS) -> tuple[int, np.ndarray, np.ndarray]:
    """The least count such that the words that have it are no more than ``size``, and those words and counts."""
    by_power = counts.groupBy(F.floor(F.log2("n")).alias("p")).count().collect()
    least, held = 1 << 62, 0
    for row in sorted(by_power, key=lambda r: -r["p"]):
        held += row["count"]
        if held > size:
            break
        least = 1 << row["p"]
    words = counts.where(F.col("n") >= F.lit(least)).toArrow() if held else None
    if words is None or not words.num_rows:
        return least, np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes = words["word"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return least, hashes[order], words["n"].to_numpy()[order]


@dataclass(frozen=True)
class Model:
    tokens: int
    words: int
    filter: Filter | LookedUp | None
    head: np.ndarray
    head_counts: np.ndarray

    @property
    def denominator(self) -> float:
        return self.tokens + 0.5 * (self.words + 1)

    def scores(self, now: np.ndarray, before: np.ndarray, prior: float = PRIOR) -> np.ndarray:
        """log10 of the probability of each token after the one before it."""
        values = level_values()
        distinct, inverse = np.unique(np.concatenate((now, before)), return_inverse=True)
        counts = values[self.filter.levels(word_hash(distinct))][inverse]
        own, previous = counts[: len(now)], counts[len(now) :]
        pairs = np.zeros(len(now))
        both = np.flatnonzero((own > 0) & (previous > 0))
        pairs[both] = values[self.filter.levels(pair_hash(before[both], now[both]))]
        # A pair cannot be more frequent than its words.
        pairs = np.minimum(pairs, np.minimum(own, previous))
        single = (own + 0.5) / self.denominator
        return np.log10((pairs + prior * single) / (previous + prior))


_SCORES = (
    "doc_id bigint, n_tokens bigint, known bigint, base double, score double, t1 bigint, t2 bigint, "
    "words array<bigint>, times array<bigint>"
)


def _scored(batch: pa.RecordBatch, model: Model, prior: float) -> Iterator[pa.RecordBatch]:
    logs = np.log10((model.head_counts + 0.5) / model.denominator)
    for first, last in slices(batch["text"]):
        rows = last - first
        now, before, bounds = token_runs(split_words(batch["text"].slice(first, rows)))
        scores = np.add.reduceat(model.scores(now, before, prior), bounds[:-1])
        # Each distinct token of a text once, with how often it occurs.
        text = np.repeat(np.arange(rows), np.diff(bounds))
        order = np.lexsort((now, text))
        now, text = now[order], text[order]
        fresh = np.flatnonzero(np.concatenate(([True], (now[1:] != now[:-1]) | (text[1:] != text[:-1]))))
        times = np.diff(np.append(fresh, len(now)))
        now, text = now[fresh], text[fresh]
        # Equal texts have the same tokens: two sums over them stand for what is looked up.
        prints = [np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)]
        for salt, out in zip((0x51, 0xA7), prints):
            np.add.at(out, text, mix(now ^ np.uint64(salt)) * times.astype(np.uint64))
        if len(model.head):
            place = np.minimum(np.searchsorted(model.head, now), len(model.head) - 1)
            in_head = model.head[place] == now
        else:
            place, in_head = np.zeros(len(now), np.int64), np.zeros(len(now), bool)
        known = np.bincount(text[in_head], weights=times[in_head], minlength=rows)
        base = np.bincount(text[in_head], weights=times[in_head] * logs[place[in_head]], minlength=rows)
        rest = ~in_head
        offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(text[rest], minlength=rows)))), pa.int32())
        arrays = [
            batch["doc_id"].slice(first, rows),
            pa.array(np.diff(bounds)),
            pa.array(known.astype(np.int64)),
            pa.array(base.astype(np.float64)),
            pa.array(scores),
            pa.array(prints[0].view(np.int64)),
            pa.array(prints[1].view(np.int64)),
            pa.ListArray.from_arrays(offsets, pa.array(now[rest].view(np.int64))),
            pa.ListArray.from_arrays(offsets, pa.array(times[rest])),
        ]
        names = ["doc_id", "n_tokens", "known", "base", "score", "t1", "t2", "words", "times"]
        yield pa.RecordBatch.from_arrays(arrays, names)


def _score_pass(docs: DataFrame, shared: Broadcast, prior: float) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _scored(batch, shared.value, prior)

    return docs.select("doc_id", "text").mapInArrow(score, _SCORES)


def _score_by_shuffle(
    docs: DataFrame, built: DataFrame, segments: int, shared: Broadcast, prior: float, block_bytes: int
) -> DataFrame:
    """Like ``_score_pass`` for segments of any number, of which a task holds one: the distinct n-grams of a
    block of texts go to their segments, are probed there, and their levels come back to the block."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch["block"].to_pylist(), batch["packed"]):
                entries = _block_entries(_rows_of(packed)["text"])
                used, spans = _by_segment(entries, segments)
                arrays = [
                    pa.array(used, pa.int32()),
                    pa.array([block] * len(used), pa.int64()),
                    pa.array([s.stop - s.start for s in spans], pa.int32()),
                    pa.array([_packed(entries[s]) for s in spans], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["segment", "block", "size", "entries"])

    def answer(held: pa.Table, asked: pa.Table) -> pa.Table:
        data = np.frombuffer(held["bits"][0].as_py() if held.num_rows else bytes(8), np.uint64)
        found = []
        for packed, size in zip(asked["entries"], asked["size"].to_pylist()):
            entries = _unpacked(packed.as_py(), size)
            found.append(probed(data, np.uint64(0), np.uint64(len(data)), entries).astype(np.uint8).tobytes())
        return pa.table({"block": asked["block"], "segment": asked["segment"], "levels": pa.array(found, pa.binary())})

    def score(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        texts = _rows_of(blocks["packed"][0])
        levels = b"".join(x.as_py() for x in answers.sort_by("segment")["levels"])
        looked_up = LookedUp(_block_entries(texts["text"]), np.frombuffer(levels, np.uint8).astype(np.int64))
        return pa.Table.from_batches(list(_scored(texts, replace(shared.value, filter=looked_up), prior)))

    blocks = written(_in_blocks(docs, block_bytes), "blocks")
    asked = blocks.mapInArrow(ask, "segment int, block bigint, size int, entries binary")
    answers = built.groupBy("segment").cogroup(asked.groupBy("segment")).applyInArrow(
        answer, "block bigint, segment int, levels binary"
    )
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, _SCORES)


def score_documents(
    docs: DataFrame,
    learn: Column,
    prior: float = PRIOR,
    filter_bits: int = FILTER_BITS,
    entry_bits: int = BITS_PER_ENTRY,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    The model learns from the rows for which ``learn`` is true. Tokens are the
    words of the whole text, A-Z as a-z, and one end; a null text is empty.
    ``base_score`` sums log10((c + 0.5) / (N + 0.5 (V + 1))) with exact counts:
    frequent words from memory, the others by a join. ``score`` is the filter's:
    (pair + prior * word) / (before + prior) for each token, counts by probing.
    All n-grams are held, and the same bits are probed whether the filter has
    at most ``filter_bits`` and is broadcast or its segments are asked by shuffle.
    Nothing to learn from gives counts of 0. Repeated rows are scored alike
    (and learned from as often as they occur); other columns are ignored.
    """
    spark = docs.sparkSession
    training = docs.where(learn)
    counts = written(count_words(training), "word-counts")
    totals = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, words = totals["n"] or 0, totals["v"]
    least, head, head_counts = head_of(counts)
    model = Model(tokens, words, None, head, head_counts)
    # A segment may be asked for n-grams of all texts, so these count as well.
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = segments_for(max(tokens, size // TOKEN_BYTES))
    built = written(build_segments(training, segments, entry_bits), "bloom-segments")
    held = gathered(built, segments, filter_bits)
    shared = spark.sparkContext.broadcast(replace(model, filter=held))
    if held is not None:
        scored = _score_pass(docs, shared, prior)
    else:
        scored = _score_by_shuffle(docs, built, segments, shared, prior, block_bytes)
    scored = written(scored, "scores")
    shared.destroy()
    # Words outside memory: once per distinct text, joined to their counts.
    outside = scored.where(F.size("words") > 0).select("t1", "t2", "words", "times").dropDuplicates(["t1", "t2"])
    outside = outside.select("t1", "t2", F.explode(F.arrays_zip("words", "times")).alias("w"))
    outside = outside.select("t1", "t2", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    rare = counts.where(F.col("n") < F.lit(least))
    found = outside.join(rare, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    log = F.log10((F.col("n") + 0.5) / F.lit(model.denominator))
    sums = found.groupBy("t1", "t2").agg(
        F.sum(F.col("times") * log).alias("rare_base"), F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("rare_known")
    )
    return scored.drop("words", "times").join(sums, ["t1", "t2"], "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        "score",
    )
