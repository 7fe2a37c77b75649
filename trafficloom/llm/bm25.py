"""A BM25 inverted index of short items, queried with block-max WAND.

Scores are divided by the score an item has when all its words are in the
query, so one threshold holds for all items: 0.6 means that the query holds
words that make up 60 % of the item's weight.

Many passages are asked at once. A first step bounds them all together by
blocks of items, with rare terms' block maxima and, for each block, the most
that common terms can add; passages in which no block can reach the threshold
need no search. The others are searched one by one with block-max WAND.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

K1, B = 1.2, 0.75
BLOCK = 8
# Terms are common, the most frequent first, as long as they make up no more of any item than this.
COMMON_SHARE = 0.36


@dataclass(frozen=True)
class Index:
    """Postings by term: items in order, their normalised scores, and the best score of each block of them."""

    terms: np.ndarray  # hashes in order
    bounds: np.ndarray
    items: np.ndarray
    scores: np.ndarray
    block_bounds: np.ndarray  # first block of each term
    block_max: np.ndarray
    block_last: np.ndarray  # last item of each block
    term_max: np.ndarray
    # Bounds for many passages at once: by rare term, the aligned blocks of items and their best scores.
    rare_bounds: np.ndarray
    rare_block: np.ndarray
    rare_max: np.ndarray
    common_max: np.ndarray  # by block: the most that common terms add to an item of it


@dataclass(frozen=True)
class Statistics:
    """What scores depend on besides the item: counted over all items, whichever index holds them."""

    items: int
    mean_length: float
    terms: np.ndarray  # hashes in order
    df: np.ndarray  # items that hold the term


def build(words: Sequence[np.ndarray], statistics: Statistics | None = None) -> Index:
    """The index of items given as arrays of word hashes; item i is words[i]. Without statistics, these are all items."""
    lengths = np.array([len(w) for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    flat = np.concatenate(words) if len(words) else np.empty(0, np.uint64)
    order = np.lexsort((owner, flat))
    flat, owner = flat[order], owner[order]
    fresh = np.ones(len(flat), bool)
    fresh[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    tf = np.diff(np.append(first, len(flat)))
    term_of, item_of = flat[first], owner[first]
    terms, starts = np.unique(term_of, return_index=True)
    bounds = np.append(starts, len(term_of))
    df = np.diff(bounds)
    if statistics is None:
        statistics = Statistics(len(words), lengths.mean() if len(words) else 1.0, terms, df)
    all_df = statistics.df[np.searchsorted(statistics.terms, terms)]
    idf = np.log(1 + (statistics.items - all_df + 0.5) / (all_df + 0.5))
    mean = max(statistics.mean_length, 1)
    scores = np.repeat(idf, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item_of] / mean))
    own = np.bincount(item_of, weights=scores, minlength=len(words))
    scores = scores / np.maximum(own, 1e-9)[item_of]
    blocks = -(-df // BLOCK)
    block_bounds = np.concatenate(([0], np.cumsum(blocks)))
    step = np.arange(block_bounds[-1]) - np.repeat(block_bounds[:-1], blocks)
    begins = np.repeat(bounds[:-1], blocks) + step * BLOCK
    ends = np.minimum(begins + BLOCK, np.repeat(bounds[1:], blocks))
    block_max = np.maximum.reduceat(scores, begins) if len(scores) else scores
    term_max = np.maximum.reduceat(scores, bounds[:-1]) if len(scores) else scores
    last = item_of[ends - 1] if len(ends) else ends
    return Index(terms, bounds, item_of, scores, block_bounds, block_max, last, term_max, *_bounds(len(words), bounds, item_of, scores))


def _bounds(n_items: int, bounds: np.ndarray, items: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, ...]:
    """Splits terms into common and rare ones, for ``live``."""
    df = np.diff(bounds)
    common = np.zeros(len(df), bool)
    held = np.zeros(n_items)
    for t in np.argsort(-df, kind="stable").tolist():
        span = slice(bounds[t], bounds[t + 1])
        if (held[items[span]] + scores[span]).max() <= COMMON_SHARE:
            held[items[span]] += scores[span]
            common[t] = True
    blocks = -(-n_items // BLOCK)
    common_max = np.zeros(blocks)
    np.maximum.at(common_max, np.arange(n_items) // BLOCK, held)
    term = np.repeat(np.arange(len(df)), df)
    rare = ~common[term]
    key = term[rare] * max(blocks, 1) + items[rare] // BLOCK
    places, first = np.unique(key, return_index=True)
    best = np.maximum.reduceat(scores[rare], first) if len(first) else np.empty(0)
    rare_bounds = np.searchsorted(places // max(blocks, 1), np.arange(len(df) + 1))
    return rare_bounds, places % max(blocks, 1), best, common_max


def live(index: Index, passage: np.ndarray, term: np.ndarray, passages: int, threshold: float) -> np.ndarray:
    """The passages in which some block of items may reach the threshold.

    Takes the (passage, term) occurrences of all passages, repeats allowed.
    """
    alive = np.zeros(passages, bool)
    if COMMON_SHARE >= threshold:
        alive[passage] = True
        return np.flatnonzero(alive)
    n_blocks, n_terms = max(len(index.common_max), 1), len(index.terms)
    rare = index.rare_bounds[term + 1] > index.rare_bounds[term]
    pairs = np.unique(passage[rare] * n_terms + term[rare])
    owner, term = pairs // n_terms, pairs % n_terms
    first, count = index.rare_bounds[term], index.rare_bounds[term + 1] - index.rare_bounds[term]
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    key = np.repeat(owner, count) * n_blocks + index.rare_block[at]
    places, inverse = np.unique(key, return_inverse=True)
    bound = np.bincount(inverse, weights=index.rare_max[at]) if len(places) else np.empty(0)
    reach = bound + index.common_max[places % n_blocks] >= threshold
    alive[places[reach] // n_blocks] = True
    return np.flatnonzero(alive)


def search(index: Index, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """All items that score ``threshold`` or more for a query of distinct terms (places in the index).

    Cursors are kept in the order of their item. The pivot is the first one at
    which the terms' best scores reach the threshold; then the best scores of
    the blocks that may hold the pivot decide whether it is scored or its
    block is skipped.
    """
    at = index.bounds[terms].tolist()
    end = index.bounds[terms + 1].tolist()
    best = index.term_max[terms].tolist()
    term = terms.tolist()
    items, scores = index.items, index.scores
    cursors = sorted((int(items[at[i]]), i) for i in range(len(term)))
    found = []

    def advance(i: int, target: int) -> tuple[int, int] | None:
        # First posting at or after the target, over whole blocks first.
        low, high = at[i], end[i]
        low += int(np.searchsorted(items[low:high], target))
        at[i] = low
        return (int(items[low]), i) if low < high else None

    while cursors:
        total, pivot = 0.0, -1
        for place, (_, i) in enumerate(cursors):
            total += best[i]
            if total >= threshold:
                pivot = place
                break
        if pivot < 0:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        # The blocks that would hold the item, and where the nearest of them ends.
        bound, skip = 0.0, None
        for _, i in cursors[: pivot + 1]:
            first, last = index.block_bounds[term[i]], index.block_bounds[term[i] + 1]
            block = first + int(np.searchsorted(index.block_last[first:last], item))
            if block < last:
                bound += float(index.block_max[block])
                reach = int(index.block_last[block])
                skip = reach if skip is None else min(skip, reach)
        if bound >= threshold:
            if cursors[0][0] == item:
                score = 0.0
                for doc, i in cursors:
                    if doc != item:
                        break
                    score += float(scores[at[i]])
                if score >= threshold:
                    found.append((item, score))
                target = item + 1
            else:
                target = item
        else:
            target = item + 1 if skip is None else skip + 1
            if pivot + 1 < len(cursors):
                target = min(target, cursors[pivot + 1][0])
            target = max(target, item + 1 if cursors[0][0] == item else item)
        moved = [advance(i, target) for doc, i in cursors[: pivot + 1] if doc < target]
        kept = [c for c in cursors[: pivot + 1] if c[0] >= target]
        cursors = sorted(kept + [m for m in moved if m is not None] + cursors[pivot + 1 :])
    return found
