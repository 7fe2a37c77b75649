import ctypes
import re
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.brute import words as plain_words
from trafficloom.llm import bm25, huffman, set_join
from trafficloom.llm.words import WHITE, slices, split_words, windows

texts = st.lists(st.one_of(st.none(), st.text(alphabet="abAB \n\té🙂.", max_size=30)), min_size=1, max_size=6)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_words_are_those_of_the_pattern(values):
    found = split_words(pa.array(values, pa.string()), WHITE)
    assert found.counts.tolist() == [len(plain_words(v)) for v in values]
    plain = [w for v in values for w in plain_words(v)]
    by_hash = {}
    for w, h in zip(plain, found.hashes.tolist()):
        assert by_hash.setdefault(w, h) == h
    assert len(set(by_hash.values())) == len(by_hash)


def test_windows_and_slices():
    found = split_words(pa.array(["a b c d e f", "a b", None, "b a", "b c d e f"]))
    runs, bounds = windows(found, 5)
    assert np.diff(bounds).tolist() == [2, 1, 0, 1, 1]
    assert runs[1] == runs[4] and runs[2] != runs[3]
    assert list(slices(pa.array(["x" * 10] * 5), 25)) == [(0, 2), (2, 4), (4, 5)]
    assert list(slices(pa.array(["x" * 100, "y"]), 25)) == [(0, 1), (1, 2)]


def test_a_long_text_has_the_words_of_its_pieces(monkeypatch):
    import trafficloom.llm.words as module

    value = " ".join(f"w{i % 97}" for i in range(400))
    whole = split_words(pa.array([value])).hashes
    monkeypatch.setattr(module, "SLICE_BYTES", 50)
    assert (split_words(pa.array([value])).hashes == whole).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=300), min_size=1, max_size=4))
def test_huffman_round_trip(docs):
    flat = np.array([i for d in docs for i in d], np.int64)
    if not len(flat):
        return
    ids, counts = np.unique(flat, return_counts=True)
    lengths = huffman.code_lengths(counts, huffman.length_limit(len(ids)))
    bounds = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    data, byte_bounds, within = huffman.Encoder(ids, lengths).encode(flat, bounds)
    starts = [byte_bounds[i] * 8 for i, d in enumerate(docs) if d]
    counts = [len(d) for d in docs if d]
    out = huffman.Decoder(ids, lengths).decode(data, np.array(starts), np.array(counts))
    assert out.tolist() == flat.tolist()
    # Every id can be read from the bit it begins at.
    for d, b in zip(range(len(docs)), bounds[:-1]):
        for k in range(len(docs[d])):
            one = huffman.Decoder(ids, lengths).decode(data, np.array([byte_bounds[d] * 8 + within[b + k]]), np.array([1]))
            assert one[0] == docs[d][k]
            break


def test_code_lengths_keep_the_limit_and_fill_the_tree():
    lengths = huffman.code_lengths(2 ** np.arange(40, dtype=np.int64), 12)
    assert lengths.max() == 12 and sum(2.0**-lengths) == 1
    assert huffman.code_lengths(np.array([5]), 18).tolist() == [1]
    # Without need of a limit the cost is that of Huffman's tree.
    assert sorted(huffman.code_lengths(np.array([1, 1, 2, 3, 5]), 18).tolist()) == [1, 2, 3, 4, 4]


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8])
def test_block_max_search_finds_all_items_above_the_threshold(threshold):
    random = np.random.default_rng(7)
    items = [random.zipf(1.3, random.integers(3, 30)).astype(np.uint64) % np.uint64(200) for _ in range(150)]
    index = bm25.build(items)
    for _ in range(60):
        terms = np.unique(random.integers(0, len(index.terms), 40))
        scores = np.zeros(len(items))
        for t in terms:
            span = slice(index.bounds[t], index.bounds[t + 1])
            scores[index.items[span]] += index.scores[span]
        wanted = np.flatnonzero(scores >= threshold)
        found = bm25.search(index, terms, threshold)
        assert sorted(i for i, _ in found) == wanted.tolist()
        live = bm25.live(index, np.zeros(len(terms), np.int64), terms, 1, threshold)
        assert len(live) or not len(wanted)


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="only glibc gives memory back when asked")
def test_a_batch_leaves_no_memory_behind():
    def mine():
        return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) >> 10

    texts = pa.array(["a text"])
    list(slices(texts))
    before = mine()
    arrays = [np.ones(12_000) for _ in range(600)]
    pins = [np.ones(500) for _ in range(50)]
    filled = mine()
    del arrays
    list(slices(texts))
    assert filled > before + 40 and mine() < filled - 40
    assert len(pins) == 50


def test_the_driver_holds_one_sketch():
    sketch = np.random.default_rng(1).integers(0, 1_000_000, 1 << set_join.SKETCH_BITS).astype(np.uint64)
    tracemalloc.start()
    levels = set_join.sketch_levels(sketch)
    set_join.light_boundary(sketch, 80)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 << 20
    some = slice(0, len(sketch), 9_973)
    assert levels[some].tolist() == np.minimum(np.floor(8 * np.log2(1 + sketch[some].astype(float))), 255).astype(int).tolist()
