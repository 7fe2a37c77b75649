import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from trafficloom.llm import collocations
from trafficloom.llm.collocations import Tries, in_filter, merge_runs, mine_phrases, pack, slice_words, unpack

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _pieces(text):
    for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
        yield re.findall("[^\x20\x09]+", piece)


def _phrases(docs, least, top=2000, nested=50):
    """All phrases by plain counting."""
    counts = defaultdict(Counter)
    for lang, text in docs:
        for words in _pieces(text):
            for size in (1, 2, 3):
                counts[lang or "und"].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        found = []
        for g, a in f.items():
            if len(g) == 1 or a < least:
                continue
            cuts = [(10**6 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            inside = any(len(h) == 3 and len(g) == 2 and g in (h[:2], h[1:]) and c >= least and 100 * c >= nested * a for h, c in f.items())
            if not inside:
                found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top]):
            out.append((lang, rank + 1, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def _found(frame):
    return sorted(map(tuple, frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.fixture(scope="module")
def docs():
    dice = random.Random(3)
    words = ["New", "york", "city", "the", "of", "a", "é", "naïve", "x" * 30, "A"]
    rows = []
    for _ in range(120):
        text = "".join(dice.choice(words) + dice.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(dice.randrange(40)))
        rows.append((dice.choice(["en", "en", "de", None, "und"]), dice.choice([text, text, "new york city hall", None, ""])))
    return rows


def test_phrases_equal_brute_force(llm_spark, docs):
    frame = llm_spark.createDataFrame([(*d, 1, "k") for d in docs], "lang string, text string, w1 int, word string")
    for least, top in ((2, 2000), (10, 2000), (3, 7)):
        assert _found(mine_phrases(frame.repartition(6), least, top)) == _phrases(docs, least, top)


def test_odd_rows_and_empty_tables(odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    assert _found(mine_phrases(odd_docs, 2)) == _phrases(rows, 2)
    assert mine_phrases(no_docs).count() == 0


def test_another_seed_gives_other_ids_and_the_same_words():
    texts = pa.array(["New york, new York\nnew", None, "a"])
    first, pieces, spelling = slice_words(texts)
    second, _, _ = slice_words(texts, 1)
    assert spelling(np.arange(6)).to_pylist() == ["new", "york", "new", "york", "new", "a"]
    assert len(set(first.tolist())) == len(set(second.tolist())) == 3 and set(first.tolist()).isdisjoint(second.tolist())
    assert first[0] == first[2] == first[4] and second[0] == second[2] == second[4]
    assert pieces[0] == pieces[1] and len(set(pieces.tolist())) == 4


def test_tries_burst_spill_and_merge(monkeypatch):
    """Runs of small tries, merged, are the counts of all phrases."""
    monkeypatch.setattr(collocations, "CONTAINER_ENTRIES", 20)
    rng = np.random.default_rng(1)
    tries, batches, expected = Tries(3, 5, limit=300), [], Counter()
    for lang in ("en", "de", "en", "fr"):
        ids = rng.integers(1, 12, 900).astype(np.uint64) * np.uint64(2**55 + 17)
        at = np.flatnonzero(rng.random(898) < 0.9)
        batches += tries.add(lang, ids, at)
        expected.update((lang, *ids[i : i + 3].tolist()) for i in at)
    assert any(root.children for root in tries.roots.values()) and batches
    batches += tries.spill(0)
    assert not tries.roots
    runs = pa.Table.from_batches(batches)
    found, places = Counter(), defaultdict(set)
    for part in set(runs["part"].to_pylist()):
        own = runs.filter(pa.compute.equal(runs["part"], part))
        for r in merge_runs(1)(own).to_pylist():
            key = (r["lang"], *[r[w] % 2**64 for w in ("w1", "w2", "w3")])
            found[key] += r["f"]
            places[key].add(part)
    assert found == expected
    # Each phrase is merged in one place, and so is all that begins with the same two words.
    heads = defaultdict(set)
    for (lang, a, b, _), at in places.items():
        heads[lang, a, b] |= at
    assert {len(p) for p in heads.values()} == {1}


def test_runs_round_trip():
    columns = [np.array(c, np.uint64) for c in ([1, 1, 5], [7, 2**64 - 1, 0], [3, 3, 3])]
    back, counts = unpack(pack(columns, np.array([4, 5, 6])), 3)
    assert [c.tolist() for c in back] == [c.tolist() for c in columns] and counts.tolist() == [4, 5, 6]


def test_filter_has_all_frequent_pairs_and_few_others(llm_spark):
    rows = [("en", k, k * 31 - 2**62, None, 10) for k in range(500)]
    pairs = llm_spark.createDataFrame(rows, "lang string, w1 bigint, w2 bigint, w3 bigint, f bigint")
    bits = np.frombuffer(collocations.pair_filter(pairs), np.uint64)
    ids = np.array([r[1:3] for r in rows]).T.astype(np.int64).view(np.uint64)
    assert in_filter(bits, collocations.pair_hash("en", *ids)).all()
    assert in_filter(bits, collocations.pair_hash("de", *ids)).mean() < 0.1
