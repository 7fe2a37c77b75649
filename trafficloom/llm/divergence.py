"""How the sources of a language differ in their words, term by term and source by source.

Terms are counted by sorting pointers: every start of a word in a slice of an
Arrow buffer is a pointer, and a multikey quicksort orders the pointers by the
words they point at. Equal runs are the terms; as the texts of a slice are laid
out by source, a run falls into stretches of one source, whose length is the
count and whose changes of text are the document frequency. Spark adds up the
slices. Sources of a language are then compared over all kept terms in blocks
of terms, each a dense matrix of exact integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficloom.llm.tables import written
from trafficloom.llm.words import buffers, slices

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
PRIOR = 2
# Bytes of text whose pointers are sorted together.
SLICE_BYTES = 8 << 20
# Sources that are compared as one block, and rows of terms in one block, about.
TILE = 512
BLOCK_ROWS = 200_000
# Cells of one dense piece of a block.
_CELLS = 1 << 20

_IS_TERM = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
# The first r bytes of a symbol of eight.
_FIRST = np.array([0] + [(1 << 64) - (1 << (64 - 8 * r)) for r in range(1, 9)], np.uint64)
COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def term_pointers(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms of texts laid end to end; no term spans two texts."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    own = _IS_TERM[data]
    edge = bounds[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    opens = own.copy()
    opens[1:] &= ~own[:-1]
    opens[edge] = own[edge]
    closes = own.copy()
    closes[:-1] &= ~own[1:]
    closes[edge - 1] = own[edge - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def sort_pointers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of pointers by what they point at, and where in it each run of equal terms begins.

    A multikey quicksort whose symbols are eight bytes: a level sorts the
    pointers of every run by their next symbol, and only runs of an equal full
    symbol go a level deeper. Equal terms stay in the order given. No term has
    a zero byte, so a symbol that ends in one is a term's last.
    """
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(8, np.uint8))), 8)

    def symbols(pointers: np.ndarray, depth: int) -> np.ndarray:
        left = np.clip(ends[pointers] - starts[pointers] - depth, 0, 8)
        at = np.minimum(starts[pointers] + depth, len(data))
        return windows[at].view(">u8").ravel().astype(np.uint64) & _FIRST[left]

    n = len(starts)
    first = symbols(np.arange(n), 0)
    order = np.argsort(first, kind="stable")
    level = first[order]
    opens = np.ones(n, bool)
    opens[1:] = level[1:] != level[:-1]
    # Places, in the order, whose runs may still fall apart.
    open_places = np.flatnonzero((level & np.uint64(255)) != 0)
    depth = 8
    while len(open_places):
        run = np.cumsum(opens)[open_places]
        alone = np.ones(len(run), bool)
        alone[1:] &= run[1:] != run[:-1]
        alone[:-1] &= run[:-1] != run[1:]
        open_places, run = open_places[~alone], run[~alone]
        if not len(open_places):
            break
        pointers = order[open_places]
        level = symbols(pointers, depth)
        by = np.lexsort((level, run))
        order[open_places] = pointers[by]
        level, run = level[by], run[by]
        opens[open_places[1:]] |= (level[1:] != level[:-1]) | (run[1:] != run[:-1])
        open_places = open_places[(level & np.uint64(255)) != 0]
        depth += 8
    return order, opens


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    sizes = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    taken = data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(taken)).cast(pa.string())


def _count_slice(texts: pa.Array, groups: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of texts that lie in order of their groups."""
    data, bounds = buffers(texts)
    data = _LOWER[data]
    starts, ends = term_pointers(data, bounds)
    text = np.searchsorted(bounds, starts, "right") - 1
    order, opens = sort_pointers(data, starts, ends)
    text = text[order]
    group = groups[text]
    row = opens
    row[1:] |= group[1:] != group[:-1]
    doc = row.copy()
    doc[1:] |= text[1:] != text[:-1]
    at = np.flatnonzero(row)
    n = np.diff(np.append(at, len(order)))
    docs = np.add.reduceat(doc.astype(np.int64), at) if len(at) else n
    return group[at], _strings(data, starts[order[at]], ends[order[at]]), n, docs


def _pieces(text: str) -> list[str]:
    """A long text in pieces that end between terms (a term as long as a piece stays whole)."""
    raw, out, first = text.encode(), [], 0
    while first < len(raw):
        last = first + SLICE_BYTES
        while last < len(raw) and _IS_TERM[raw[last]]:
            last += 1
        out.append(raw[first:last].decode())
        first = last
    return out


def _count_long(text: str) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """One text too long for a slice: its pieces added up, one document for each term."""
    tables = []
    for piece in _pieces(text):
        _, terms, n, _ = _count_slice(pa.array([piece]), np.zeros(1, np.int64))
        tables.append(pa.table({"term": terms, "n": n}))
    summed = pa.concat_tables(tables).group_by("term").aggregate([("n", "sum")]).combine_chunks()
    terms = summed["term"].combine_chunks()
    return np.zeros(len(terms), np.int64), terms, summed["n_sum"].to_numpy(), np.ones(len(terms), np.int64)


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of terms per slice, and per batch a row without a term for every (lang, source)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        pairs = pa.table({"lang": batch["lang"], "source": batch["source"], "at": np.arange(batch.num_rows)})
        keys = pairs.group_by(["lang", "source"]).aggregate([("at", "count")]).select(["lang", "source"])
        keys = keys.append_column("code", pa.array(np.arange(keys.num_rows)))
        coded = pairs.join(keys, ["lang", "source"]).sort_by([("code", "ascending"), ("at", "ascending")])
        langs, sources = keys["lang"].combine_chunks(), keys["source"].combine_chunks()
        groups = coded["code"].to_numpy()
        texts = batch["text"].cast(pa.large_string()).take(coded["at"].combine_chunks())
        zeros = pa.array(np.zeros(keys.num_rows, np.int64))
        yield pa.RecordBatch.from_arrays(
            [langs, sources, pa.nulls(keys.num_rows, pa.string()), zeros, zeros], names=["lang", "source", "term", "n", "docs"]
        )
        for first, last in slices(texts, SLICE_BYTES):
            part = texts.slice(first, last - first)
            if last == first + 1 and len(part[0].as_buffer()) > SLICE_BYTES:
                group, terms, n, docs = _count_long(part[0].as_py())
            else:
                group, terms, n, docs = _count_slice(part, groups[first:last] - groups[first])
            code = pa.array(group + groups[first])
            yield pa.RecordBatch.from_arrays(
                [langs.take(code), sources.take(code), terms, pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"]
            )


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs); each (lang, source) also has a row without a term."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = rows.mapInArrow(count_terms, COUNTS)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)), exact for any counts."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(20,0)")
    below = (total + PRIOR * terms).cast("decimal(20,0)")
    return F.call_function("div", above, below) + 1


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def compare_block(key: tuple, terms: pa.Table, sources: pa.Table) -> pa.Table:
    """Sums over a block's terms, for every two sources of its tiles: (lang, a, b, f, terms).

    ``terms`` has a row (term, i, p) for every source that has the term, and
    ``sources`` (source, none) the share of an absent term for each source of the two tiles.
    """
    lang, tile_a, tile_b = (k.as_py() for k in key[:3])
    none = np.zeros(0, np.int64)
    if sources.num_rows:
        index = sources["source"].to_numpy()
        by = np.argsort(index)
        index, none = index[by], sources["none"].to_numpy()[by]
    if not terms.num_rows or not len(none):
        return pa.table({"lang": [], "a": [], "b": [], "f": [], "terms": []}, schema=_BLOCK)
    code = terms["term"].combine_chunks().dictionary_encode().indices.to_numpy()
    at, p = np.searchsorted(index, terms["i"].to_numpy()), terms["p"].to_numpy()
    by = np.argsort(code, kind="stable")
    code, at, p = code[by], at[by], p[by]
    n_terms = int(code[-1]) + 1
    left, right = np.flatnonzero(index // TILE == tile_a), np.flatnonzero(index // TILE == tile_b)
    sums = np.zeros((len(left), len(right)), np.int64)
    step = max(1, _CELLS // len(index))
    for low in range(0, n_terms, step):
        high = min(low + step, n_terms)
        first, last = np.searchsorted(code, [low, high])
        shares = np.repeat(none[:, None], high - low, axis=1)
        shares[at[first:last], code[first:last] - low] = p[first:last]
        others = shares[right]
        for k, a in enumerate(left):
            gap = others - shares[a]
            sums[k] += (gap * gap // (others + shares[a])).sum(axis=1)
    rows = len(left) * len(right)
    return pa.table(
        {
            "lang": pa.array([lang] * rows, pa.string()),
            "a": np.repeat(index[left], len(right)),
            "b": np.tile(index[right], len(left)),
            "f": sums.ravel(),
            "terms": np.full(rows, n_terms, np.int64),
        },
        schema=_BLOCK,
    )


_BLOCK = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("f", pa.int64()), ("terms", pa.int64())])


def _compared(shares: DataFrame, groups: DataFrame, n_rows: int) -> DataFrame:
    """(lang, a, b, f, terms): sums over the terms that either tile of the two sources has."""
    blocks = max(1, math.ceil(n_rows / BLOCK_ROWS))
    tiled = groups.withColumn("tile", F.expr(f"i div {TILE}"))
    tiled = tiled.withColumn("last", F.max("tile").over(Window.partitionBy("lang")))
    # A source takes part in the pairs of its tile with every tile of the language.
    with_tiles = tiled.select("lang", "i", "none", "tile", F.explode(F.expr("sequence(0L, last)")).alias("other"))
    both_ways = F.array_distinct(F.array(
        F.struct(F.col("tile").alias("ta"), F.col("other").alias("tb")), F.struct(F.col("other").alias("ta"), F.col("tile").alias("tb"))
    ))
    pairs = with_tiles.select("lang", "i", "none", F.explode(both_ways).alias("t")).select("lang", "i", "none", "t.ta", "t.tb")
    rows = shares.select("lang", "i", "term", "p", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"))
    rows = rows.join(pairs.select("lang", "i", "ta", "tb"), ["lang", "i"])
    heads = pairs.withColumn("block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
    keys = ("lang", "ta", "tb", "block")
    heads = heads.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("i").alias("source"), "none")
    found = rows.groupBy(*keys).cogroup(heads.groupBy(*[f"{k}_" for k in keys])).applyInArrow(
        compare_block, "lang string, a bigint, b bigint, f bigint, terms bigint"
    )
    return found.groupBy("lang", "a", "b").agg(F.sum("f").alias("f"), F.sum("terms").alias("terms"))


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs.

    Part ``pair`` has the distance to every other source of the language, part
    ``term`` the ``top_terms`` terms that a source has more of than its
    language. A null lang, source or text is an empty one; a language without a
    term in ``min_docs`` documents has distances of 0 and no terms; a source
    without terms is compared like any other; repeated rows count as
    documents of their own; ties are ordered by the item's bytes. Other
    columns are ignored; an empty table gives no rows.
    """
    counts = written(term_counts(docs), "term-counts")
    same = Window.partitionBy("lang", "term")
    kept = counts.where("term is not null").select(
        "lang", "source", "term", "n",
        F.sum("n").over(same).alias("n_lang"),
        F.sum("docs").over(same).alias("docs"),
        (F.row_number().over(same.orderBy("source")) == 1).alias("first"),
    )
    kept = written(kept.where(F.col("docs") >= min_docs).drop("docs"), "kept-terms")
    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("v"))
    groups = counts.where("term is null").select("lang", "source").join(by_source, ["lang", "source"], "left")
    groups = groups.join(by_lang, "lang", "left").na.fill(0, ["total", "lang_total", "v"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    none = F.when(F.col("v") > 0, _share(F.lit(0), F.col("total"), F.col("v"))).otherwise(F.lit(0))
    groups = written(groups.select("*", number.alias("i"), none.alias("none")), "source-totals")
    rows = kept.join(groups, ["lang", "source"])
    shares = rows.select("lang", "source", "i", "term", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
                         _share(F.col("n_lang"), F.col("lang_total"), F.col("v")).alias("q"))
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                         _apart(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)
    sums = _compared(shares, groups, kept.count())
    one = groups.select("lang", "source", F.col("i").alias("a"), F.col("none").alias("none_a"), "v")
    two = groups.select("lang", F.col("source").alias("item"), F.col("i").alias("b"), F.col("none").alias("none_b"))
    # One row per pair of sources, which the result has too.
    pairs = one.join(two, "lang").where("a != b").join(sums, ["lang", "a", "b"], "left").na.fill(0, ["f", "terms"])
    left_out = F.when(F.col("v") > F.col("terms"), (F.col("v") - F.col("terms")) * _apart(F.col("none_a"), F.col("none_b")))
    value = F.col("f") + F.coalesce(left_out, F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(terms)
