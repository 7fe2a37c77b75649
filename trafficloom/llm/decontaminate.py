"""Benchmark decontamination: every training passage queries a BM25 index of the test
items; what it retrieves is verified by the overlap of question and answer."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from trafficloom.llm import bm25
from trafficloom.llm.tables import written
from trafficloom.llm.words import NOT_ALPHANUMERIC, Words, mix, slices, split_words

# Share of an item's weight that a passage must hold to be looked at.
THRESHOLD = 0.6
# Share of the shingles of the question, and of the answer, that must be in the passage.
OVERLAP = 0.6
# Words of a shingle; a part with fewer words is one shingle.
WIDTH = 5
# Items of one index, which is broadcast; more items are more indexes, one after another, with one set of statistics.
ITEMS_PER_INDEX = 50_000
_SENTENCE_END = re.compile(r"(?<=[.?!])\s+")


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item: the last sentence is the answer, or, where there
    is only one, its last third of words."""
    sentences = _SENTENCE_END.split(text.strip())
    if len(sentences) > 1:
        cut = text.strip().rindex(sentences[-1])
        return text.strip()[:cut], sentences[-1]
    words = text.split()
    cut = len(words) - max(len(words) // 3, 1)
    return " ".join(words[:cut]), " ".join(words[cut:])


def _words(texts: pa.Array) -> Words:
    return split_words(texts, NOT_ALPHANUMERIC)


def shingles(words: np.ndarray) -> np.ndarray:
    """Distinct hashes of runs of WIDTH words, or of all of them where there are fewer."""
    width = min(WIDTH, len(words))
    if not width:
        return words
    runs = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        runs = mix(runs + words[i : len(words) - width + 1 + i])
    return np.unique(runs)


@dataclass(frozen=True)
class Items:
    ids: list[int | None]
    index: bm25.Index
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    span: int  # words of the longest item

    def holds(self, item: int, passage: np.ndarray) -> bool:
        """Whether enough of question and answer is in the passage."""
        for part in (self.questions[item], self.answers[item]):
            width = min(WIDTH, part[1])
            if not width:
                continue
            runs = passage.get(width)
            if np.isin(part[0], runs).sum() < OVERLAP * len(part[0]):
                return False
        return True


class _Passage:
    """Shingles of a passage by width, made when asked for."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.runs = words, {}

    def get(self, width: int) -> np.ndarray:
        if width not in self.runs:
            n = len(self.words) - width + 1
            runs = np.zeros(max(n, 0), np.uint64)
            for i in range(width):
                runs = mix(runs + self.words[i : n + i]) if n > 0 else runs
            self.runs[width] = runs
        return self.runs[width]


def item_terms(rows: DataFrame) -> DataFrame:
    """(shard, term, n) of items (shard, text): each distinct word with n = 1, and a null term with the number of words.
    Items without words give no rows."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch["text"]):
                words = _words(batch["text"].slice(first, last - first))
                text = np.repeat(np.arange(last - first), words.counts)
                order = np.lexsort((words.hashes, text))
                hashes, text = words.hashes[order], text[order]
                fresh = np.ones(len(hashes), bool)
                fresh[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
                hashes, text = hashes[fresh], text[fresh]
                filled = np.flatnonzero(words.counts)
                arrays = [
                    batch["shard"].slice(first, last - first).take(pa.array(np.concatenate((text, filled)))),
                    pa.concat_arrays([pa.array(hashes.view(np.int64)), pa.nulls(len(filled), pa.int64())]),
                    pa.array(np.concatenate((np.ones(len(hashes), np.int64), words.counts[filled].astype(np.int64)))),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["shard", "term", "n"])

    return rows.select("shard", "text").mapInArrow(terms, "shard bigint, term bigint, n bigint")


def _statistics(sums: Row, terms: DataFrame) -> bm25.Statistics:
    """Statistics of all items, with those terms (term, df) that an index needs."""
    found = terms.select("term", "df").toArrow()
    hashes, df = found["term"].to_numpy().view(np.uint64), found["df"].to_numpy()
    order = np.argsort(hashes)
    return bm25.Statistics(sums["items"], (sums["words"] or 0) / max(sums["items"], 1), hashes[order], df[order])


def build_items(rows: list[tuple[int | None, str | None]], statistics: bm25.Statistics, span: int) -> Items:
    """Items that have words; a null or empty item matches nothing. ``span`` is the length of the longest of all items."""
    ids, words, questions, answers = [], [], [], []
    for item_id, text in sorted(((i, t) for i, t in rows if t), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        parts = [_words(pa.array([t])).hashes for t in (text, *split_item(text))]
        if len(parts[0]):
            ids.append(item_id)
            words.append(parts[0])
            questions.append((shingles(parts[1]), len(parts[1])))
            answers.append((shingles(parts[2]), len(parts[2])))
    return Items(ids, bm25.build(words, statistics), questions, answers, span)


def _windows(counts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Passages of each text: runs of twice the longest item, one item's length apart,
    so that every place where an item can stand is inside one. (text, first word)."""
    n = np.where(counts > 0, np.maximum(1, -(-(counts - span) // max(span, 1))), 0)
    text = np.repeat(np.arange(len(counts)), n)
    step = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return text, step * span


def find_in_slice(texts: pa.Array, items: Items, threshold: float) -> list[tuple[int, int, float]]:
    """(text, item, score) of verified items, the best score of each pair."""
    index, words = items.index, _words(texts)
    if not len(words.hashes) or not len(index.terms):
        return []
    place = np.minimum(np.searchsorted(index.terms, words.hashes), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[place] == words.hashes)
    term = place[known]
    text, first = _windows(words.counts, items.span)
    begin = words.bounds[text] + first
    stop = np.minimum(begin + 2 * items.span, words.bounds[text + 1])
    low, high = np.searchsorted(known, begin), np.searchsorted(known, stop)
    size = high - low
    at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    passage = np.repeat(np.arange(len(text)), size)
    found: dict[tuple[int, int], float] = {}
    for w in bm25.live(index, passage, term[at], len(text), threshold).tolist():
        terms = np.unique(term[low[w] : high[w]])
        hits = bm25.search(index, terms, threshold)
        if hits:
            passage = _Passage(words.hashes[begin[w] : stop[w]])
            for item, score in hits:
                if items.holds(item, passage):
                    pair = (int(text[w]), item)
                    found[pair] = max(found.get(pair, 0.0), score)
    return [(t, i, s) for (t, i), s in found.items()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score) for every document and test item it holds.

    Whole texts are looked at, in passages that overlap by the longest item.
    Words are runs of letters and digits, A-Z as a-z. A passage is looked at
    where its BM25 score for an item is at least ``threshold`` of the item's
    own; it is a leak where it holds most of the shingles of the question and
    of the answer. Null and empty texts and items hold nothing; a document
    gives one row per item, repeated rows repeat theirs, and equal items are
    all reported. Other columns are ignored; no items give no rows.
    """
    spark = docs.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    shards = max(1, math.ceil(rows.count() / ITEMS_PER_INDEX))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    # Word statistics and the longest item are those of all items, so scores do not depend on the number of indexes.
    per_shard = written(item_terms(rows).groupBy("shard", "term").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("items"), F.max("n").alias("longest")
    ), "item-terms")
    sums = per_shard.where("term is null").agg(
        F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.sum("n").alias("words"), F.max("longest").alias("longest")
    ).first()
    totals = per_shard.where("term is not null").groupBy("term").agg(F.sum("n").alias("df"))
    terms = written(per_shard.where("term is not null").select("shard", "term").join(totals, "term"), "item-counts")
    schema = "doc_id bigint, item_id bigint, score double"
    found = None
    for shard in range(shards):
        # About ITEMS_PER_INDEX items and their terms: the driver and the workers never hold more than one index.
        part = [tuple(r) for r in rows.where(F.col("shard") == shard).select("item_id", "text").collect()]
        items = build_items(part, _statistics(sums, terms.where(F.col("shard") == shard)), sums["longest"] or 0)
        shared = spark.sparkContext.broadcast(items)

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                for first, last in slices(batch["text"]):
                    hits = find_in_slice(batch["text"].slice(first, last - first), items, threshold)
                    doc_ids = batch["doc_id"].slice(first, last - first)
                    yield pa.RecordBatch.from_arrays(
                        [
                            doc_ids.take(pa.array([t for t, _, _ in hits], pa.int64())),
                            pa.array([items.ids[i] for _, i, _ in hits], pa.int64()),
                            pa.array([s for _, _, s in hits], pa.float64()),
                        ],
                        ["doc_id", "item_id", "score"],
                    )

        leaks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(look, schema)
        found = leaks if found is None else found.unionAll(leaks)
    return found
