"""N-gram Jaccard join: a size-aware join of light and heavy sets.

The set of a text is its distinct 5-word shingles. Two sets link when their
Jaccard similarity is at least 0.8; then each holds at least ceil(0.8 n) of
the other's elements, so under any one order of all elements the first
n - ceil(0.8 n) + k of each have k in common. Light sets (few elements)
enumerate the pairs (k = 2) of their first elements as keys; heavy sets put
their first elements into inverted lists, which are scanned, and must meet in
as many lists as the k of the smaller one (a twentieth of its size). The
boundary is where enumerating begins to cost more than scanning. Rare elements
come first in the order, by a frequency sketch of fixed size over the whole
corpus: the order decides how many candidates there are, never which links.

Equal sets are one class, and one document stands for it. The lists are worked
in two rounds. First every member of a list is compared with one leader, the
most common in content; that connects groups of near copies by as many
comparisons as members. Members compared with the same class are a family, whose
links come from what each has other than that class (``families``). Then pairs of
a list are compared that are still in different components and in different
families, those that meet most often first, so no link between components is lost
and dense groups are not compared pair by pair.

A pair of sets with n and m elements links from a = ceil((n + m) * 0.8 / 1.8)
common ones, so its first k common elements lie among the first n - a + k of the
one and m - a + k of the other, and before them stand at most n - a and m - a
elements that the sets do not share. An element whose list has one member is
shared with none that links. Members meet only where both hold: variants of one
text that differ too much all share its common elements, but have too many
of their own before them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficloom.llm.components import connected
from trafficloom.llm.families import families, family_links, members
from trafficloom.llm.tables import WRITING, settings, written
from trafficloom.llm.words import mix, release_unused, slices, split_words, windows

WIDTH = 5
# Bytes of text worked on at once: the arrays made of them take about a hundred times as much.
TEXT_BYTES = 1 << 18
# Slots of the frequency sketch: 16 MB in a task, whatever the corpus.
SKETCH_BITS = 22
SKETCH_PART = 16_384
# Bits of the bitmap of documents whose sets are asked for: 2 MB, whatever their number.
# It only saves work: a bit shared by two documents sends one set too many.
WANTED_BITS = 24
PAIR = ["a", "a_s1", "b", "b_s1"]
# Rounds in which one pair of each two components is compared, before all that are left are.
BEST_ROUNDS = 2
# No set above this is light.
MAX_LIGHT = 64
# A key of a list has 48 bits beside the place in the set; later places count as the last one.
# Keys that share their bits and late places only add candidates.
PLACE_BITS = 16
LAST_PLACE = (1 << PLACE_BITS) - 1


def need(n: np.ndarray | int, percent: int = 80) -> np.ndarray | int:
    """Elements that a set of ``n`` must share with any set it links to."""
    return -(-n * percent // 100)


def meetings(n: np.ndarray | int) -> np.ndarray | int:
    """Lists in which a heavy set of ``n`` meets any set it links to that is no smaller."""
    return 1 + n // 20


def _slot(elements: np.ndarray) -> np.ndarray:
    return (elements >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def ordered_sets(texts: pa.Array, levels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text of a slice and their bounds, in the global order:
    by level of the sketch (common ones last) and value. Without levels, by value."""
    elements, bounds = windows(split_words(texts), WIDTH)
    text = np.repeat(np.arange(len(texts), dtype=np.uint32), np.diff(bounds))
    order = np.argsort(elements, kind="stable")
    if levels is not None:
        order = order[np.argsort(levels[_slot(elements[order])], kind="stable")]
    order = order[np.argsort(text[order].astype(np.uint16) if len(texts) < 65_536 else text[order], kind="stable")]
    elements, text = elements[order], text[order]
    fresh = np.ones(len(elements), bool)
    fresh[1:] = (elements[1:] != elements[:-1]) | (text[1:] != text[:-1])
    elements = elements[fresh]
    counts = np.bincount(text[fresh], minlength=len(texts))
    return elements, np.concatenate(([0], np.cumsum(counts)))


def signatures(elements: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set: together they stand for the set."""
    out = []
    for salt in (0x1234567, 0xABCDEF987):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(elements ^ np.uint64(salt)))))
        out.append(mix(sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def describe(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, n, s1, s2) and, with doc_id null and n = -1, parts of the sketch (slot, counts)."""

    def one_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        names = ["doc_id", "n", "s1", "s2", "slot", "counts"]
        for batch in batches:
            for first, last in slices(batch["text"], TEXT_BYTES):
                elements, bounds = ordered_sets(batch["text"].slice(first, last - first))
                np.add.at(sketch, _slot(elements), np.uint32(1))
                s1, s2 = signatures(elements, bounds)
                rows = last - first
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(first, rows),
                        pa.array(np.diff(bounds)),
                        pa.array(s1),
                        pa.array(s2),
                        pa.nulls(rows, pa.int32()),
                        pa.nulls(rows, pa.binary()),
                    ],
                    names,
                )
        parts = sketch.reshape(-1, SKETCH_PART)
        used = np.flatnonzero(parts.any(1))
        if len(used):
            size = len(used)
            counts = pa.array([zlib.compress(parts[i].tobytes(), 1) for i in used], pa.binary())
            nulls = [pa.nulls(size, pa.int64()), pa.array(np.full(size, -1)), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64())]
            yield pa.RecordBatch.from_arrays([*nulls, pa.array(used, pa.int32()), counts], names)

    schema = "doc_id bigint, n bigint, s1 bigint, s2 bigint, slot int, counts binary"
    return docs.select("doc_id", "text").mapInArrow(one_pass, schema)


def merged_sketch(parts: DataFrame) -> np.ndarray:
    """The sketch of the corpus: sums per part, which come to the driver compressed, and there make 32 MB."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH_PART, np.uint64)
        for counts in table["counts"]:
            total += np.frombuffer(zlib.decompress(counts.as_py()), np.uint32)
        return pa.table({"slot": table["slot"][:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    sketch = np.zeros(1 << SKETCH_BITS, np.uint64)
    with settings(parts.sparkSession, WRITING):
        sums = parts.groupBy("slot").applyInArrow(add, "slot int, counts binary").collect()
    for row in sums:
        sketch[row["slot"] * SKETCH_PART :][:SKETCH_PART] = np.frombuffer(zlib.decompress(row["counts"]), np.uint64)
    return sketch


def sketch_levels(sketch: np.ndarray) -> np.ndarray:
    """Eight levels for each doubling of a slot's count, so that an element little above the noise is late already."""
    levels = np.empty(len(sketch), np.uint8)
    # Part by part: the driver holds the sketch, but no more numbers as wide as it.
    for at in range(0, len(sketch), SKETCH_PART):
        part = sketch[at : at + SKETCH_PART].astype(np.float64)
        levels[at : at + SKETCH_PART] = np.minimum(np.floor(8 * np.log2(1 + part)), 255)
    return levels


def light_boundary(sketch: np.ndarray, percent: int) -> int:
    """The largest n up to which enumerating pairs costs no more than scanning lists.

    A set of n makes C(p + 1, 2) keys of pairs, or p keys whose lists are as
    long as an element's list is on average (by the sketch, less its noise).
    """
    total = float(sketch.sum())
    squares = sum(float((sketch[at : at + SKETCH_PART].astype(np.float64) ** 2).sum()) for at in range(0, len(sketch), SKETCH_PART))
    length = max(0.0, squares / total - total / len(sketch)) if total else 0.0
    best = 0
    for n in range(2, MAX_LIGHT + 1):
        p = n - need(n, percent) + 1
        if math.comb(p + 1, 2) <= p * (1 + length):
            best = n
        else:
            break
    return best


def _keys(
    elements: np.ndarray, bounds: np.ndarray, light: int, percent: int, places: bool = False
) -> tuple[np.ndarray, ...]:
    """Keys of each set of a slice and the number of the set each belongs to; with ``places``
    also the place of the key's last element in the set, from 0."""
    sizes = np.diff(bounds)
    first = sizes - need(sizes, percent) + meetings(sizes)
    heavy = (sizes > light * percent // 100) & (sizes > 1)
    counts = np.where(heavy, first, 0)
    owner = np.repeat(np.arange(len(sizes)), counts)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    # The last bit tells keys of lists from keys of pairs.
    keys, owners, at = [mix(elements[bounds[owner] + step] ^ np.uint64(1)) | np.uint64(1)], [owner], [step]
    small = np.flatnonzero((sizes <= light) & (sizes > 1))
    for n in np.unique(sizes[small]):
        sets = small[sizes[small] == n]
        take = min(int(n - need(n, percent) + 2), int(n))
        i, j = np.triu_indices(take, 1)
        block = elements[bounds[sets][:, None] + np.arange(take)[None, :]]
        both = mix(mix(block[:, i] ^ np.uint64(2)) + mix(block[:, j] ^ np.uint64(2)))
        keys.append((both & ~np.uint64(1)).ravel())
        owners.append(np.repeat(sets, len(i)))
        at.append(np.tile(j, len(sets)))
    found = np.concatenate(keys), np.concatenate(owners)
    return (*found, np.concatenate(at)) if places else found


_LIST_FIELDS = "key bigint, lead_id bigint, lead_s1 bigint, lead_n bigint, doc_id bigint, s1 bigint, n bigint, place bigint"


def inverted_lists(docs: DataFrame, sketch: np.ndarray, percent: int) -> DataFrame:
    """Members of every list that holds two classes or more, each with the list's leader.

    A class is written once per task by one of its documents, and once per
    list after the shuffle. The rows of a list arrive in order and are passed
    on as they come: no list is held in memory.
    """
    levels, light = sketch_levels(sketch), light_boundary(sketch, percent)
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        order = shared.value
        for batch in batches:
            for first, last in slices(batch["text"], TEXT_BYTES):
                rows = last - first
                elements, bounds = ordered_sets(batch["text"].slice(first, rows), order)
                s1, _ = signatures(elements, bounds)
                sizes = np.diff(bounds)
                fresh = np.zeros(rows, bool)
                for i, s in enumerate(s1.tolist()):
                    if s not in seen:
                        seen.add(s)
                        fresh[i] = True
                # How common the set's elements are: leaders are the most common.
                level = np.concatenate(([0], np.cumsum(order[_slot(elements)], dtype=np.int64)))
                common = (level[bounds[1:]] - level[bounds[:-1]]) * 1000 // np.maximum(sizes, 1)
                keys, owner, place = _keys(elements, bounds, light, percent, places=True)
                chosen = fresh[owner]
                keys, owner, place = keys[chosen], owner[chosen], place[chosen]
                doc_ids = batch["doc_id"].slice(first, rows).to_numpy()
                # Few wide numbers: what a set has in all of its rows is one, what is the row's own another.
                kind = keys & np.uint64(1)
                keys = (keys >> np.uint64(PLACE_BITS + 1) << np.uint64(1)) | kind
                at = (keys << np.uint64(PLACE_BITS)) | np.minimum(place, LAST_PLACE).astype(np.uint64)
                shape = (-common << 32) | sizes
                arrays = [at.view(np.int64), shape[owner], s1[owner], doc_ids[owner]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["at", "shape", "s1", "doc_id"])

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The leader of the list that the last batch ended in, and whether it has been passed on.
        leader: tuple | None = None
        last_s1, shown = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            at, shape, s1, doc = (batch[c].to_numpy() for c in ("at", "shape", "s1", "doc_id"))
            key, place, n = at >> PLACE_BITS, at & LAST_PLACE, shape & ((1 << 32) - 1)
            new = np.empty(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            new[0] = leader is None or leader[0] != key[0]
            other = np.ones(len(key), bool)
            other[1:] = new[1:] | (s1[1:] != s1[:-1])
            other[0] = new[0] or last_s1 != s1[0]
            group = np.cumsum(new) - 1 + (0 if new[0] else 1)
            heads = np.flatnonzero(new)
            leads = doc[heads], s1[heads], n[heads], place[heads]
            if not new[0]:
                leads = tuple(np.concatenate(([x], y)) for x, y in zip(leader[1:], leads))
            lead_doc, lead_s1, lead_n, lead_place = leads
            members = other & ~new
            several = np.zeros(len(lead_doc), bool)
            several[group[members]] = True
            # A leader is passed on with its first other member, perhaps batches later.
            own = np.flatnonzero(several)
            if len(own) and not new[0] and own[0] == 0 and shown:
                own = own[1:]
            first_key = np.concatenate(([key[0]], key[heads])) if not new[0] else key[heads]
            at = np.flatnonzero(members)
            g = np.concatenate((own, group[at]))
            ids = (
                first_key[g], lead_doc[g], lead_s1[g], lead_n[g],
                np.concatenate((lead_doc[own], doc[at])), np.concatenate((lead_s1[own], s1[at])), np.concatenate((lead_n[own], n[at])),
                np.concatenate((lead_place[own], place[at])),
            )
            if len(g):
                names = ["key", "lead_id", "lead_s1", "lead_n", "doc_id", "s1", "n", "place"]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in ids], names)
            end = len(lead_doc) - 1
            was_open = end == 0 and not new[0]
            shown = bool(several[end]) or (was_open and shown)
            leader, last_s1 = (key[-1], lead_doc[end], lead_s1[end], lead_n[end], lead_place[end]), s1[-1]

    rows = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(
        emit, "at bigint, shape bigint, s1 bigint, doc_id bigint"
    )
    key = F.shiftright("at", PLACE_BITS)
    rows = rows.repartition(key).sortWithinPartitions(key, "shape", "s1", "doc_id")
    return rows.mapInArrow(lead, _LIST_FIELDS)


def own_elements(lists: DataFrame, percent: int) -> DataFrame:
    """The lists with ``own``: how many elements before this one, in the member's order,
    are in a list by themselves. Keys of pairs do not tell; theirs is 0. A member that is in
    fewer lists than the smallest set it may link to asks for links by none of them: those rows
    are left out. The rows are dealt by doc_id and s1, as a join by those asks."""
    all_of = Window.partitionBy("doc_id", "s1", F.col("key").bitwiseAND(F.lit(1)))
    own = F.col("place") + 1 - F.row_number().over(all_of.orderBy("place"))
    in_list = F.col("key").bitwiseAND(F.lit(1)) == 1
    lists = lists.repartition("doc_id", "s1").withColumn("own", F.when(in_list, own).otherwise(0))
    lists = lists.withColumn("lists", F.count(F.lit(1)).over(all_of))
    return lists.where(~in_list | F.expr(f"lists >= 1 + ({percent} * n + 99) div 100 div 20")).drop("lists")


def meetings_apart(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of a list (key, doc_id, s1, n, part, fam, fam_size, place, own; the other's with
    a 2) that are in different components and families and may be of the first ``meetings`` (of keys of pairs: 2) common elements
    of sets that link. Every such pair that links has all of those here."""
    ends = [f(c).alias(f"{c}_{f.__name__}") for c in ("part", "fam") for f in (F.min, F.max)]
    open_lists = placed.groupBy("key").agg(*ends, F.max(F.struct("fam_size", "fam"))["fam"].alias("main"))
    open_lists = open_lists.where("part_min != part_max and fam_min != fam_max").select("key", "main")
    left = placed.join(open_lists, "key")
    right = left.toDF(*[c if c == "key" else f"{c}2" for c in left.columns])
    more = "if((key & 1) = 1, floor(least(n, n2) / 20), 1)"
    together = f"{percent} * (n + n2) <= {100 + percent}"
    near = [f"{together} * ({n} - {own}) and {together} * ({n} + {more} - {place})" for n, own, place in (("n", "own", "place"), ("n2", "own2", "place2"))]
    fits = f"100 * least(n, n2) >= {percent} * greatest(n, n2)"
    # Of two families of a list one is not its main one: only members outside that meet all others.
    apart = "part != part2 and fam != fam2 and (fam2 = main2 or part < part2)"
    return left.where("fam != main").join(right, "key").where(f"{apart} and {fits} and {near[0]} and {near[1]}")


def both_sets(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, a_s1, b, b_s1) with the sets of both as bytes, x and y."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << WANTED_BITS))
    ends = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).select(place.alias("place"))
    # bitmap_construct_agg makes one bitmap of 32,768 bits for each bucket of places.
    bitmaps = ends.groupBy(F.shiftright("place", 15).alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit(32_767))).alias("bits")
    )
    wanted = np.zeros((1 << WANTED_BITS) // 8, np.uint8)
    for row in bitmaps.collect():
        wanted[row["bucket"] * 4_096 :][:4_096] = np.frombuffer(row["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        bitmap = shared.value
        for whole in batches:
            places = whole["place"].to_numpy()
            asked = (bitmap[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
            batch = whole.filter(pa.array(asked))
            for first, last in slices(batch["text"], TEXT_BYTES):
                rows = last - first
                elements, bounds = ordered_sets(batch["text"].slice(first, rows))
                s1, _ = signatures(elements, bounds)
                doc_ids = batch["doc_id"].slice(first, rows)
                fresh = []
                for i, pair in enumerate(zip(doc_ids.to_pylist(), s1.tolist())):
                    if pair not in seen:
                        seen.add(pair)
                        fresh.append(i)
                raw = elements.tobytes()
                values = [raw[8 * bounds[i] : 8 * bounds[i + 1]] for i in fresh]
                arrays = [doc_ids.take(pa.array(fresh, pa.int64())), pa.array(s1[fresh]), pa.array(values, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "s1", "elements"])

    # Repeated rows are sent once per task; links found twice do no harm.
    texts = docs.where("doc_id is not null").select("doc_id", "text", place.alias("place"))
    sets = texts.mapInArrow(to_sets, "doc_id bigint, s1 bigint, elements binary")
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s1").alias("a_s1"), F.col("elements").alias("x")), ["a", "a_s1"])
    both = both.join(sets.select(F.col("doc_id").alias("b"), F.col("s1").alias("b_s1"), F.col("elements").alias("y")), ["b", "b_s1"])
    return both.select("a", "a_s1", "b", "b_s1", "x", "y")


def compared(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, a_s1, b, b_s1) with the number of elements they share, those only one of
    them has, and whether they link."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, links, only = [], [], ([], [])
            for x, y in zip(batch["x"], batch["y"]):
                x, y = (np.frombuffer(v.as_buffer(), np.int64) for v in (x, y))
                only[0].append(np.setdiff1d(x, y, assume_unique=True))
                only[1].append(np.setdiff1d(y, x, assume_unique=True))
                shared.append(len(x) - len(only[0][-1]))
                links.append(100 * shared[-1] >= percent * (len(y) + len(only[0][-1])))
            lists = []
            for own in only:
                bounds = np.cumsum([0, *map(len, own)])
                values = np.concatenate(own) if own else np.empty(0, np.int64)
                lists.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int64())))
            ends = [batch[c] for c in PAIR]
            arrays = [*ends, pa.array(shared, pa.int64()), *lists, pa.array(links, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, [*PAIR, "shared", "only_a", "only_b", "links"])

    schema = ", ".join(f"{c} bigint" for c in (*PAIR, "shared")) + ", only_a array<bigint>, only_b array<bigint>, links boolean"
    return both_sets(docs, pairs).mapInArrow(compare, schema)


def verified(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, a_s1, b, b_s1) whose sets link, by comparing the sets themselves."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"]):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate((x, y))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "a_s1", "b", "b_s1"])

    return both_sets(docs, pairs).mapInArrow(compare, "a bigint, a_s1 bigint, b bigint, b_s1 bigint")


def jaccard_components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Letters A-Z count as a-z. A null text, or one without words, has an empty
    set, links with nothing and is its own component. ``component_id`` is the
    smallest doc_id reached by links and by equal sets. Rows sharing a doc_id
    are one node. A row with a null doc_id is in the component of the
    documents with an equal set, null if there is none. An empty table gives
    no rows; other columns are ignored.
    """
    found = written(describe(docs), "sets")
    sketch = merged_sketch(found.where("n = -1").select("slot", "counts"))
    rows = found.where("n >= 0").select("doc_id", "n", "s1", "s2")
    classes = rows.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("node"))
    nodes = written(
        rows.join(classes, ["s1", "s2", "n"], "left").select("doc_id", "n", "s1", F.coalesce("node", "doc_id").alias("node")),
        "nodes",
    )
    lists = written(inverted_lists(docs, sketch, percent), "lists")
    # The driver plans the rest, and has no use for the sketch any more.
    del sketch
    release_unused()

    def candidates(rows: DataFrame, x: tuple[str, ...], y: tuple[str, ...], share: int) -> DataFrame:
        """Pairs of classes of fitting size that meet often enough; x and y name (doc_id, s1, n, part)."""
        fits = f"100 * least({x[2]}, {y[2]}) >= {percent} * greatest({x[2]}, {y[2]})"
        swap = F.col(x[1]) > F.col(y[1])
        ends = [F.when(swap, F.col(q)).otherwise(F.col(p)).alias(f"a{i}") for i, (p, q) in enumerate(zip(x, y))]
        ends += [F.when(swap, F.col(p)).otherwise(F.col(q)).alias(f"b{i}") for i, (p, q) in enumerate(zip(x, y))]
        in_list = F.col("key").bitwiseAND(F.lit(1))
        met = rows.where(f"{x[1]} != {y[1]} and {fits}").select(*ends, in_list.alias("in_list"))
        met = met.groupBy("a1", "b1").agg(
            F.min("a0").alias("a"),
            F.min("b0").alias("b"),
            F.min(F.least("a2", "b2")).alias("n"),
            F.min("a3").alias("a_part"),
            F.min("b3").alias("b_part"),
            F.sum("in_list").alias("lists"),
            F.count(F.lit(1)).alias("times"),
        )
        often = (F.col("times") > F.col("lists")) | (F.col("lists") * share >= 1 + F.floor(F.col("n") / 20))
        return met.where(often).select("a", F.col("a1").alias("a_s1"), "b", F.col("b1").alias("b_s1"), "a_part", "b_part", "times")

    # Half the meetings will do here: what a leader is not compared with comes in the second round.
    starred = candidates(lists, ("lead_id", "lead_s1", "lead_n", "lead_id"), ("doc_id", "s1", "n", "doc_id"), 2)
    starred = written(starred.select(*PAIR), "star-pairs")
    leaders = written(compared(docs, starred, percent), "star-links")
    links = leaders.where("links").select(*PAIR)
    fams = written(families(leaders), "families")

    by_node = nodes.where("doc_id is not null").select("doc_id", "s1", "node").distinct()

    def between_nodes(links: DataFrame) -> DataFrame:
        for x in "ab":
            end = by_node.select(F.col("doc_id").alias(x), F.col("s1").alias(f"{x}_s1"), F.col("node").alias(f"{x}_node"))
            links = links.join(end, [x, f"{x}_s1"])
        return links.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))

    # Rows of one doc_id with different texts are one node.
    several = by_node.groupBy("doc_id").agg(F.count_distinct("node").alias("k")).where("k > 1").select("doc_id")
    same_id = by_node.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    parts = written(connected(between_nodes(links).unionAll(same_id)), "star-parts")

    # Members of lists with the component they are in so far; without links, by themselves.
    known = by_node.join(parts, "node", "left").join(fams, "s1", "left").where("component is not null or fam is not null")
    known = written(known.select("doc_id", "s1", F.coalesce("component", "node").alias("part"), "fam", "fam_size"), "known")
    near = family_links(members(leaders, known, percent), percent)
    member = own_elements(lists.select("key", "doc_id", "s1", "n", "place"), percent).join(known, ["doc_id", "s1"], "left")
    fill = {"part": F.coalesce("part", "doc_id"), "fam": F.coalesce("fam", "s1"), "fam_size": F.coalesce("fam_size", F.lit(1))}
    placed = written(member.withColumns(fill), "placed")
    apart = meetings_apart(placed, percent)
    rest = candidates(apart, ("doc_id", "s1", "n", "part"), ("doc_id2", "s12", "n2", "part2"), 1)
    rest = written(rest.join(starred, ["a_s1", "b_s1"], "left_anti"), "rest-pairs")
    links = parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(written(between_nodes(near), "family-links"))
    # One link joins two components: the pair of each two that meets most often is compared first.
    for _ in range(BEST_ROUNDS):
        ends = F.struct("times", *PAIR)
        between = [F.least("a_part", "b_part").alias("p"), F.greatest("a_part", "b_part").alias("q")]
        best = rest.groupBy(*between).agg(F.max(ends).alias("pair")).select(*[F.col(f"pair.{c}").alias(c) for c in PAIR])
        best = written(best, "best-pairs")
        links = written(links.unionAll(between_nodes(verified(docs, best, percent))), "best-links")
        parts = written(connected(links), "best-parts")
        rest = rest.join(best, ["a_s1", "b_s1"], "left_anti")
        for x in "ab":
            moved = by_node.join(parts, "node").select(
                F.col("doc_id").alias(x), F.col("s1").alias(f"{x}_s1"), F.col("component").alias(f"{x}_now")
            )
            rest = rest.join(moved, [x, f"{x}_s1"], "left").withColumn(f"{x}_part", F.coalesce(f"{x}_now", f"{x}_part")).drop(f"{x}_now")
        rest = written(rest.where("a_part != b_part"), "rest-pairs")
    more = between_nodes(verified(docs, rest.select(*PAIR), percent))
    final = written(connected(links.unionAll(more)), "components")
    # Rows whose own class node is not theirs (a shared doc_id) follow the smallest.
    return nodes.join(final, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id")
    )
