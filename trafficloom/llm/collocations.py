"""Phrases whose words stand together more often than apart, language by language.

Phrases are counted in a HAT-trie: a shallow trie over word ids whose leaves
are hash containers; a container that grows too large bursts into a node with
containers of its own, keyed by the next word. When a task holds too many
entries, it spills whole subtrees as sorted runs, one for every prefix
partition (language and first two words) the subtree has entries of. Spark
brings the runs of a partition together, where they are merged.

A phrase of three words that is frequent enough consists of pairs that are, so
pairs are counted first and a Bloom filter of the frequent ones keeps most
other triples out of the tries. The filter has a bounded size; where it fills
up it lets more triples through, and the counts remain the same.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficloom.functions.skew import broadcast_if_small
from trafficloom.llm.tables import written
from trafficloom.llm.words import buffers, mix, slices, split_words

MIN_COUNT = 10
TOP_PHRASES = 2000
NESTED_PERCENT = 50
SCALE = 1_000_000
# Entries of a task's tries before subtrees are spilled, and of a container before it bursts.
TRIE_ENTRIES = 1_200_000
CONTAINER_ENTRIES = 1 << 15
# Words of the corpus for each prefix partition, about.
PARTITION_WORDS = 1_000_000
# The filter of frequent pairs: bits for each, probes, and bits at most.
FILTER_BITS_EACH = 16
FILTER_PROBES = 4
MAX_FILTER_BITS = 1 << 27

_BREAKS = np.zeros(256, bool)
_BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
_BETWEEN = _BREAKS.copy()
_BETWEEN[[9, 32]] = True
# The first r bytes of eight, the first in the lowest bits.
_FIRST = np.array([(1 << (8 * r)) - 1 for r in range(9)], np.uint64)
_FANOUT = 16
# Word ids of a task are numbers of so many bits; three of them fill a key.
_ID_BITS = 21
_ID_MASK = (1 << _ID_BITS) - 1

RUNS = "part bigint, lang string, size int, run binary"
GRAMS = "lang string, w1 bigint, w2 bigint, w3 bigint, f bigint"
WORDS = "lang string, word string, id bigint, f bigint"


# ----- words and phrases of a slice --------------------------------------------


def slice_words(texts: pa.Array, seed: int = 0) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], pa.Array]]:
    """Ids of the words of some texts, the piece each stands in, and a way to their spelling.

    Ids are hashes of 64 bits. ``seed`` changes which words share one: the
    length and the first eight bytes are mixed in another way.
    """
    words = split_words(texts, _BETWEEN)
    ids = words.hashes
    if seed and len(ids):
        padded = np.concatenate((words.data, np.zeros(8, np.uint8)))
        padded[(padded >= 65) & (padded <= 90)] += 32
        sizes = words.ends - words.starts
        heads = np.lib.stride_tricks.sliding_window_view(padded, 8)[words.starts].view("<u8").ravel().astype(np.uint64)
        heads &= _FIRST[np.minimum(sizes, 8)]
        ids = mix(ids ^ mix(heads * np.uint64(2 * seed + 1) + sizes.astype(np.uint64)))
    # Pieces are numbered through; the first of each text is a new one.
    breaks = np.flatnonzero(_BREAKS[words.data]) if len(words.data) else np.empty(0, np.int64)
    pieces = np.searchsorted(breaks, words.starts) + words.text_of_word()

    def spelling(at: np.ndarray) -> pa.Array:
        sizes = words.ends[at] - words.starts[at]
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        taken = words.data[np.repeat(words.starts[at] - offsets[:-1], sizes) + np.arange(offsets[-1])]
        capital = (taken >= 65) & (taken <= 90)
        taken[capital] += 32
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(taken)).cast(pa.string())

    return ids, pieces, spelling


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """Slices of the texts of each language of a batch."""
    langs = batch["lang"].dictionary_encode()
    codes = langs.indices.to_numpy()
    for code, lang in enumerate(langs.dictionary.to_pylist()):
        texts = batch["text"].take(pa.array(np.flatnonzero(codes == code)))
        for first, last in slices(texts):
            yield lang, texts.slice(first, last - first)


# ----- the trie ------------------------------------------------------------------


class WordNumbers:
    """Small numbers for the word ids a task meets, in order of their first meeting."""

    def __init__(self) -> None:
        self.number: dict[int, int] = {}

    def of(self, ids: np.ndarray) -> np.ndarray:
        distinct, inverse = np.unique(ids, return_inverse=True)
        number = self.number
        found = np.fromiter((number.setdefault(x, len(number)) for x in distinct.tolist()), np.int64, len(distinct))
        return found[inverse]

    def room_for(self, words: int) -> bool:
        return len(self.number) + words <= _ID_MASK

    def ids(self) -> np.ndarray:
        return np.fromiter(self.number, np.uint64, len(self.number))


class Node:
    """A container of (key, count), or, once burst, a node over ``_FANOUT`` of them.

    A key holds the numbers of a phrase's words, the first in the highest
    bits. A node at depth d tells its children apart by word d of the phrase.
    """

    def __init__(self, size: int, depth: int = 0) -> None:
        self.size, self.depth = size, depth
        self.counts: Counter | None = Counter()
        self.children: list[Node] = []

    def add(self, keys: np.ndarray, counts: list[int] | None = None) -> None:
        if self.counts is None:
            branch = (keys >> (_ID_BITS * (self.size - 1 - self.depth))) & (_FANOUT - 1)
            order = np.argsort(branch.astype(np.uint8), kind="stable")
            cuts = np.searchsorted(branch[order], np.arange(_FANOUT + 1))
            for child, low, high in zip(self.children, cuts[:-1], cuts[1:], strict=True):
                if low < high:
                    picked = order[low:high]
                    child.add(keys[picked], None if counts is None else [counts[i] for i in picked.tolist()])
            return
        if counts is None:
            self.counts.update(keys.tolist())
        else:
            for key, n in zip(keys.tolist(), counts, strict=True):
                self.counts[key] += n
        if len(self.counts) > CONTAINER_ENTRIES and self.depth < self.size - 1:
            self.burst()

    def burst(self) -> None:
        held, self.counts = self.counts, None
        self.children = [Node(self.size, self.depth + 1) for _ in range(_FANOUT)]
        self.add(np.fromiter(held.keys(), np.int64, len(held)), list(held.values()))

    def __len__(self) -> int:
        return len(self.counts) if self.counts is not None else sum(len(c) for c in self.children)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        if self.counts is not None:
            n = len(self.counts)
            return np.fromiter(self.counts.keys(), np.int64, n), np.fromiter(self.counts.values(), np.int64, n)
        parts = [c.entries() for c in self.children]
        return np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])

    def take(self, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Takes out whole subtrees under the root, the largest first, until ``least`` entries are gone."""
        if self.counts is not None:
            if self.counts:
                yield self.entries()
                self.counts = Counter()
            return
        gone = 0
        for k in sorted(range(len(self.children)), key=lambda k: -len(self.children[k])):
            size = len(self.children[k])
            if gone >= least or not size:
                return
            yield self.children[k].entries()
            self.children[k] = Node(self.size, self.depth + 1)
            gone += size


def pack(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """A sorted run: columns of ids, equal ones of the first told by lengths, and counts."""
    first = columns[0]
    opens = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
    head = np.array([len(first), len(opens)], np.int64)
    lengths = np.diff(np.append(opens, len(first)))
    parts = [head, first[opens], lengths.astype(np.uint32), *columns[1:], counts]
    return zlib.compress(b"".join(p.tobytes() for p in parts), 1)


def unpack(run: bytes, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    raw = zlib.decompress(run)
    n, k = np.frombuffer(raw, np.int64, 2).tolist()
    first = np.repeat(np.frombuffer(raw, np.uint64, k, 16), np.frombuffer(raw, np.uint32, k, 16 + 8 * k))
    at = 16 + 12 * k
    columns = [first]
    for _ in range(size - 1):
        columns.append(np.frombuffer(raw, np.uint64, n, at))
        at += 8 * n
    return columns, np.frombuffer(raw, np.int64, n, at)


class Tries:
    """The tries of a task, one for each language, and the runs they spill."""

    def __init__(self, size: int, partitions: int, limit: int = TRIE_ENTRIES) -> None:
        self.size, self.partitions, self.limit = size, partitions, limit
        self.words = WordNumbers()
        self.roots: dict[str, Node] = {}

    def add(self, lang: str, ids: np.ndarray, phrases: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counts the phrases that begin at the given places of ``ids``."""
        if not self.words.room_for(len(ids)):
            yield from self.spill(0)
        # A text of more words than there are numbers is counted piece by piece.
        step = _ID_MASK - self.size
        for low in range(0, len(ids), step):
            piece = ids[low : low + step + self.size - 1]
            numbers = self.words.of(piece)
            at = phrases[(phrases >= low) & (phrases < low + step)] - low
            key = numbers[at]
            for k in range(1, self.size):
                key = (key << _ID_BITS) | numbers[at + k]
            self.roots.setdefault(lang, Node(self.size)).add(key)
            if low + step < len(ids):
                yield from self.spill(0)
        if sum(map(len, self.roots.values())) > self.limit:
            yield from self.spill(self.limit // 2)

    def spill(self, leave: int) -> Iterator[pa.RecordBatch]:
        """Spills subtrees until at most ``leave`` entries are left; with 0, words get new numbers."""
        ids = self.words.ids()
        while (held := sum(map(len, self.roots.values()))) > leave:
            lang = max(self.roots, key=lambda x: len(self.roots[x]))
            for keys, counts in self.roots[lang].take(held - leave):
                yield self._runs(lang, ids, keys, counts)
        if not leave:
            self.words, self.roots = WordNumbers(), {}

    def _runs(self, lang: str, ids: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        shifts = [_ID_BITS * (self.size - 1 - k) for k in range(self.size)]
        columns = [ids[(keys >> s) & _ID_MASK] for s in shifts]
        part = prefix_partition(lang, columns[0], columns[1], self.partitions)
        order = np.lexsort((*reversed(columns), part))
        columns, counts, part = [c[order] for c in columns], counts[order], part[order]
        cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        ends = np.append(cuts[1:], len(part))
        runs = [pack([c[a:b] for c in columns], counts[a:b]) for a, b in zip(cuts, ends, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(part[cuts]), pa.array([lang] * len(runs), pa.string()), pa.array([self.size] * len(runs), pa.int32()), pa.array(runs, pa.binary())],
            names=["part", "lang", "size", "run"],
        )


def _language_salt(lang: str) -> np.uint64:
    return np.uint64(zlib.crc32(lang.encode())) << np.uint64(20)


def pair_hash(lang: str, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
    return mix(mix(w1 + _language_salt(lang)) ^ w2)


def prefix_partition(lang: str, w1: np.ndarray, w2: np.ndarray, partitions: int) -> np.ndarray:
    return (pair_hash(lang, w1, w2) % np.uint64(partitions)).astype(np.int64)


# ----- tasks -----------------------------------------------------------------------


def count_words(seed: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in _by_language(batch):
                ids, _, spelling = slice_words(texts, seed)
                distinct, at, n = np.unique(ids, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(distinct), pa.string()), spelling(at), pa.array(distinct.view(np.int64)), pa.array(n)],
                    names=["lang", "word", "id", "f"],
                )

    return task


def count_phrases(size: int, partitions: int, seed: int, frequent=None) -> Callable:
    """A task that counts phrases of ``size`` words; with a filter, only those whose pairs it has."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if frequent is None else np.frombuffer(frequent.value, np.uint64)
        tries = Tries(size, partitions)
        for batch in batches:
            for lang, texts in _by_language(batch):
                ids, pieces, _ = slice_words(texts, seed)
                if len(ids) < size:
                    continue
                whole = pieces[size - 1 :] == pieces[: len(pieces) - size + 1]
                if bits is not None:
                    pairs = in_filter(bits, pair_hash(lang, ids[:-1], ids[1:]))
                    for k in range(size - 1):
                        whole &= pairs[k : len(pairs) - size + 2 + k]
                yield from tries.add(lang, ids, np.flatnonzero(whole))
        yield from tries.spill(0)

    return task


def merge_runs(least: int) -> Callable:
    """Merges the runs of a prefix partition; phrases below ``least`` are left out."""

    def task(runs: pa.Table) -> pa.Table:
        out = []
        keys = runs.select(["lang", "size"]).group_by(["lang", "size"]).aggregate([]).to_pylist()
        langs, sizes = runs["lang"].to_pylist(), runs["size"].to_pylist()
        for key in keys:
            lang, size = key["lang"], key["size"]
            found = [unpack(r.as_py(), size) for r, x, s in zip(runs["run"], langs, sizes, strict=True) if (x, s) == (lang, size)]
            columns = [np.concatenate([c[k] for c, _ in found]) for k in range(size)]
            counts = np.concatenate([n for _, n in found])
            order = np.lexsort(tuple(reversed(columns)))
            columns = [c[order] for c in columns]
            opens = np.ones(len(counts), bool)
            opens[1:] = False
            for c in columns:
                opens[1:] |= c[1:] != c[:-1]
            at = np.flatnonzero(opens)
            sums = np.add.reduceat(counts[order], at)
            at, sums = at[sums >= least], sums[sums >= least]
            ids = [pa.array(c[at].view(np.int64)) for c in columns] + [pa.nulls(len(at), pa.int64())] * (3 - size)
            out.append(pa.table([pa.array([lang] * len(at), pa.string()), *ids, pa.array(sums)], names=["lang", "w1", "w2", "w3", "f"]))
        return pa.concat_tables(out)

    return task


# ----- the filter of frequent pairs -----------------------------------------------


def _probes(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    for k in range(FILTER_PROBES):
        yield (hashes + np.uint64(k) * step) & np.uint64(bits - 1)


def in_filter(filled: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for bit in _probes(hashes, 64 * len(filled)):
        found &= ((filled[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)
    return found


def pair_filter(pairs: DataFrame) -> bytes:
    """The bits of a Bloom filter over (lang, w1, w2), at most MAX_FILTER_BITS of them.

    Tasks set their bits, Spark joins equal words of 64 bits, and the driver
    gets the words that are not zero: 16 bytes for each, 32 MB at most.
    """
    bits = 1 << 16
    wanted = min(pairs.count() * FILTER_BITS_EACH, MAX_FILTER_BITS)
    while bits < wanted:
        bits *= 2

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch["lang"].dictionary_encode()
            codes = langs.indices.to_numpy()
            w1, w2 = (batch[c].to_numpy().view(np.uint64) for c in ("w1", "w2"))
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                own = codes == code
                bit = np.sort(np.concatenate(list(_probes(pair_hash(lang, w1[own], w2[own]), bits))))
                place = bit >> np.uint64(6)
                at = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.empty(0, np.int64)
                value = np.bitwise_or.reduceat(np.uint64(1) << (bit & np.uint64(63)), at) if len(at) else np.empty(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(place[at].view(np.int64)), pa.array(value.view(np.int64))], names=["place", "bits"])

    found = pairs.select("lang", "w1", "w2").mapInArrow(task, "place bigint, bits bigint")
    table = found.groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    filled = np.zeros(bits // 64, np.uint64)
    filled[table["place"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return filled.tobytes()


# ----- the whole -----------------------------------------------------------------


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """Words (lang, word, id, f) of any count, and phrases (lang, w1, w2, w3, f) of at least ``min_count``.

    ``w3`` is null in a pair. Should two words of a language share an id, ids
    are made anew with another seed.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text")).where("text is not null")
    seed = 0
    while True:
        words = rows.mapInArrow(count_words(seed), WORDS).groupBy("lang", "word", "id").agg(F.sum("f").alias("f"))
        words = written(words, "phrase-words")
        if not words.groupBy("lang", "id").count().where("count > 1").limit(1).count():
            break
        seed += 1
    total = words.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PARTITION_WORDS)

    def counted(size: int, frequent=None) -> DataFrame:
        runs = rows.mapInArrow(count_phrases(size, partitions, seed, frequent), RUNS)
        merged = runs.repartition(partitions, "part").groupBy("part").applyInArrow(merge_runs(min_count), GRAMS)
        return written(merged, f"phrases-{size}")

    pairs = counted(2)
    filled = spark.sparkContext.broadcast(pair_filter(pairs))
    try:
        triples = counted(3, filled)
    finally:
        filled.destroy()
    return words, pairs.unionByName(triples)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (left * right)), exact: products have up to 38 digits."""

    def long(c: Column) -> Column:
        return c.cast("decimal(16,0)")

    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * (long(a) * long(a)).cast("decimal(31,0)"), long(left) * long(right))


def _leading(found: DataFrame, top: int) -> DataFrame:
    """The phrases of each language from the best down to the score and count that its ``top``-th has.

    Phrases of equal score and count are counted first: every such group has
    one at least, so the first ``top`` groups of a language are enough to find
    the last one needed, and no task sees more of a language than these.
    """
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    groups = found.groupBy("lang", "score", "a").agg(F.count(F.lit(1)).alias("size"))
    groups = groups.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top)
    before = F.coalesce(F.sum("size").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    needed = groups.withColumn("before", before).where(F.col("before") < top)
    last = written(needed.groupBy("lang").agg(F.min(F.struct("score", "a")).alias("last")), "last-places")
    return found.join(broadcast_if_small(last), "lang").where(F.struct("score", "a") >= F.col("last")).drop("last")


def mine_phrases(
    docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP_PHRASES, nested_percent: int = NESTED_PERCENT
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two or three words of each language.

    A null text is empty and a null lang is ``und``. A phrase counts wherever
    its words follow each other within a piece, overlaps included, in whole
    texts. It is left out where a longer candidate that contains it has at
    least ``nested_percent`` percent of its count. Ties go by count, then by
    the bytes of the phrase; repeated rows count again; a language without
    candidates has no rows. Other columns are ignored; an empty table gives no rows.
    """
    words, grams = phrase_counts(docs, min_count)
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    often = words.where(F.col("f") >= min_count)
    pairs, triples = grams.where("w3 is null"), grams.where("w3 is not null")

    def single(which: str, count: str) -> DataFrame:
        return often.select("lang", F.col("id").alias(which), F.col("f").alias(count))

    def pair(first: str, second: str, count: str) -> DataFrame:
        return pairs.select("lang", F.col("w1").alias(first), F.col("w2").alias(second), F.col("f").alias(count))

    inside = triples.select("lang", F.col("f").alias("longer"), F.explode(F.array(
        F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"))
    )).alias("part"))
    inside = inside.groupBy("lang", F.col("part.w1").alias("w1"), F.col("part.w2").alias("w2")).agg(F.max("longer").alias("longer"))
    alone = pairs.join(inside, ["lang", "w1", "w2"], "left")
    alone = alone.where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("f") * nested_percent)).drop("longer")
    two = alone.join(single("w1", "l"), ["lang", "w1"]).join(single("w2", "r"), ["lang", "w2"])
    two = two.select("lang", "w1", "w2", "w3", F.col("f").alias("a"), "l", "r", _score(F.col("f"), F.col("l"), F.col("r")).alias("score"))
    three = triples.join(pair("w1", "w2", "f12"), ["lang", "w1", "w2"]).join(pair("w2", "w3", "f23"), ["lang", "w2", "w3"])
    three = three.join(single("w1", "f1"), ["lang", "w1"]).join(single("w3", "f3"), ["lang", "w3"])
    early, late = _score(F.col("f"), F.col("f1"), F.col("f23")), _score(F.col("f"), F.col("f12"), F.col("f3"))
    three = three.select(
        "lang", "w1", "w2", "w3", F.col("f").alias("a"),
        F.when(early <= late, F.col("f1")).otherwise(F.col("f12")).alias("l"),
        F.when(early <= late, F.col("f23")).otherwise(F.col("f3")).alias("r"),
        F.least(early, late).alias("score"),
    )
    # Those that may be among the first, ties and all; only they need their spelling.
    found = written(two.unionByName(three), "scored-phrases")
    found = written(_leading(found, top), "best-phrases")
    for k in (1, 2, 3):
        spelt = often.select("lang", F.col("id").alias(f"w{k}"), F.col("word").alias(f"s{k}"))
        found = found.join(spelt, ["lang", f"w{k}"], "left")
    found = found.withColumn("phrase", F.concat_ws(" ", "s1", "s2", "s3"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    found = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return found.join(broadcast_if_small(sizes), "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
