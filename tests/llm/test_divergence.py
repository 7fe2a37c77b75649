import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from trafficloom.llm import divergence
from trafficloom.llm.divergence import audit_sources, sort_pointers, term_counts, term_pointers

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return TERM.findall((text or "").translate(LOWER))


def _audit(docs, min_docs, top=10):
    """The whole audit, term by term."""
    counts, in_docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        counts[lang, source].update(_terms(text))
        in_docs[lang].update(set(_terms(text)))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in in_docs[lang].items() if n >= min_docs]
        sources = sorted(s for x, s in groups if x == lang)
        v = len(kept)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * v) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


def _found(frame):
    return sorted(map(tuple, frame.select("lang", "source", "part", "item", "value", "rank").collect()))


@pytest.fixture(scope="module")
def texts():
    dice = random.Random(5)
    words = ["a", "ab", "abcdefgh", "abcdefghi", "abcdefghij", "Abcdefghijklmnop", "abcdefghijklmnopq", "é", "naïve", "ZZ", "zz", "你好", "x" * 40, "x" * 41]
    rows = []
    for k in range(150):
        text = " ".join(dice.choices(words[: 3 + k % len(words)], k=dice.randrange(12)))
        rows.append((dice.choice(["en", "de", None, "en"]), dice.choice(["web", "", None, "books", "news"]), dice.choice([text, text + " 1-2_3 it's", None, ""])))
    return rows


def test_pointers_sort_like_the_words_they_point_at(texts):
    joined = [t or "" for _, _, t in texts]
    data = divergence._LOWER[np.frombuffer("".join(joined).encode(), np.uint8)]
    bounds = np.concatenate(([0], np.cumsum([len(t.encode()) for t in joined])))
    starts, ends = term_pointers(data, bounds)
    words = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert words == [w for t in joined for w in _terms(t)]
    order, opens = sort_pointers(data, starts, ends)
    ordered = [words[i] for i in order]
    runs = [w for w, first in zip(ordered, opens) if first]
    # Equal words stand together and in the order given.
    assert sorted(ordered) == sorted(words) and len(runs) == len(set(words)) == len(set(runs))
    for a, b, x, y in zip(ordered, ordered[1:], order, order[1:]):
        assert a != b or x < y


def test_audit_equals_brute_force(llm_spark, texts):
    docs = llm_spark.createDataFrame([(*t, 1, "z") for t in texts], "lang string, source string, text string, term int, p string")
    for min_docs in (1, 4, 10, 10_000):
        assert _found(audit_sources(docs.repartition(5), min_docs)) == _audit(texts, min_docs)


def test_tiles_of_sources_and_blocks_of_terms(llm_spark, texts, monkeypatch):
    """With more sources than a tile holds, sums of tiles that lack a term are made up for."""
    many = [(lang, f"{source}{k % 7}", text) for k, (lang, source, text) in enumerate(texts)]
    small = divergence.compare_block

    def in_small_tiles(key, terms, sources):
        kept = divergence.TILE, divergence._CELLS
        divergence.TILE, divergence._CELLS = 3, 20
        try:
            return small(key, terms, sources)
        finally:
            # Workers are used again.
            divergence.TILE, divergence._CELLS = kept

    monkeypatch.setattr(divergence, "TILE", 3)
    monkeypatch.setattr(divergence, "BLOCK_ROWS", 10)
    monkeypatch.setattr(divergence, "compare_block", in_small_tiles)
    docs = llm_spark.createDataFrame(many, "lang string, source string, text string")
    assert _found(audit_sources(docs, 2)) == _audit(many, 2)


def test_long_texts_are_counted_piece_by_piece(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE_BYTES", 50)
    long = "The cat, the " + "é" * 60 + " and THE end. " * 30
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "en"], "source": ["a", "a"], "text": [long, "the end"]})
    rows = [r for b in divergence.count_terms(iter([batch])) for r in b.to_pylist() if r["term"] is not None]
    n, docs = Counter(), Counter()
    for r in rows:
        n[r["term"]] += r["n"]
        docs[r["term"]] += r["docs"]
    assert n == Counter(_terms(long) + _terms("the end"))
    assert docs == Counter([*set(_terms(long)), *set(_terms("the end"))])


def test_odd_rows_and_empty_tables(odd_docs, no_docs):
    docs = [(r.lang, r.source, r.text) for r in odd_docs.collect()]
    assert _found(audit_sources(odd_docs, 2)) == _audit(docs, 2)
    assert audit_sources(no_docs).count() == 0
    assert term_counts(no_docs).count() == 0
