"""Line dedup by a rolling hash over line hashes.

``dedup_runs`` hashes every two neighbouring lines; blank lines do not count, so
a heading and a blank line are no run. A run of two filled lines or more
is repeated just when each of its pairs is, so the pairs that stand at several
places cover every repeated run, whatever its length and wherever it begins;
they are removed but for their first place, after their bytes have been
compared.

``dedup_lines`` compares content-defined chunks instead: the rolling hash
chooses where a chunk ends, so a long passage is cut alike wherever it stands,
but what lies outside its whole chunks is not found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficloom.llm.tables import written
from trafficloom.llm.words import WHITE, buffers, hash_pieces, mix, slices

# Lines that the rolling hash looks at, and lines per chunk on average.
WINDOW = 2
MEAN_LINES = 4
# Shorter chunks are left alone: single lines repeat for good reasons.
MIN_LINES = 2
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def line_hash(line: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(line, digest_size=8).digest(), "little")


def chunk_bounds(lines: list[bytes]) -> list[int]:
    """Places at which chunks of the lines end; blank lines belong to the chunk before them."""
    hashes = np.array([line_hash(x.strip()) for x in lines], np.uint64)
    rolled = np.zeros(len(lines), np.uint64)
    for i in range(WINDOW):
        rolled[i:] += hashes[: len(lines) - i] * np.uint64(pow(int(_FACTOR), i + 1, 1 << 64))
    ends = np.flatnonzero(mix(rolled) % np.uint64(MEAN_LINES) == 0) + 1
    return [*(int(e) for e in ends if e < len(lines)), len(lines)]


def chunks(text: str) -> list[tuple[int, int, bytes]]:
    """(first line, lines, bytes) of each chunk."""
    lines = text.encode().split(b"\n")
    out, first = [], 0
    for last in chunk_bounds(lines):
        out.append((first, last - first, b"\n".join(lines[first:last])))
        first = last
    return out


def _hash_pair(data: bytes) -> tuple[int, int]:
    digest = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for first, last in slices(batch["text"]):
        yield batch.slice(first, last - first)


_PLACE = ["doc_id", "k1", "k2", "first"]
_NAMES = ["h1", "h2", *_PLACE, "lines"]
_SCHEMA = "h1 bigint, h2 bigint, doc_id bigint, k1 bigint, k2 bigint, first int, lines int"
# Bits of the bitmap of repeated chunks: 2 MB, whatever their number. It only
# saves work: a bit shared by chance sends one chunk too many.
BITMAP_BITS = 24
# The bitmap of repeated pairs has about 16 bits for each, from 2 MB up to 64 MB.
MAX_PAIR_BITS = 29


def _chunk_rows(docs: DataFrame, bitmap=None) -> DataFrame:
    """One row per chunk that may be removed; with a bitmap only those in it, and their bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else bitmap.value
        for part in (p for batch in batches for p in _slices(batch)):
            found: list[tuple] = []
            for doc_id, k1, k2, text in zip(*(part[c].to_pylist() for c in ("doc_id", "k1", "k2", "text"))):
                for first, lines, data in chunks(text):
                    if lines < MIN_LINES or not data.strip():
                        continue
                    h1, h2 = _hash_pair(data)
                    if bits is not None:
                        place = h1 & ((1 << BITMAP_BITS) - 1)
                        if not bits[place >> 3] >> (place & 7) & 1:
                            continue
                    found.append((h1, h2, doc_id, k1, k2, first, lines, data if bits is not None else None))
            yield as_batch(found)

    def as_batch(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) if found else [()] * 8
        kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + ([pa.binary()] if bitmap is not None else [])
        names = _NAMES + (["bytes"] if bitmap is not None else [])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    schema = _SCHEMA + (", bytes binary" if bitmap is not None else "")
    return docs.where("text is not null").select("doc_id", "k1", "k2", "text").mapInArrow(rows, schema)


def _bitmap(hashes: DataFrame, width: int) -> np.ndarray:
    """Bytes of a bitmap of 2**width bits, with the low bits of each ``h`` set."""
    bit = F.col("h").bitwiseAND(F.lit((1 << width) - 1))
    bitmaps = hashes.select(bit.alias("bit")).groupBy(F.shiftright("bit", 15).alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32_767))).alias("bits")
    )
    bits = np.zeros((1 << width) // 8, np.uint8)
    for row in bitmaps.toLocalIterator():
        bits[row["bucket"] * 4_096 :][:4_096] = np.frombuffer(row["bits"], np.uint8)
    return bits


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """Every place (doc_id, k1, k2, first, lines) at which a chunk stands that stood at another place before."""
    spark = docs.sparkSession
    place = F.struct(*_PLACE)
    rows = written(_chunk_rows(docs), "chunks")
    repeated = rows.groupBy("h1", "h2").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a != b")
    bits = _bitmap(repeated.select(F.col("h1").alias("h")), BITMAP_BITS)
    # The bytes of repeated chunks only; grouping by them is the comparison.
    held = _chunk_rows(docs, spark.sparkContext.broadcast(bits))
    kept = held.groupBy("h1", "h2", "bytes").agg(F.min(place).alias("keep"), F.max(place).alias("last"))
    kept = kept.where("keep != last").select("h1", "h2", "keep")
    # One row per repeated chunk on this side; a chunk in very many places is split by adaptive execution.
    return rows.join(kept, ["h1", "h2"]).where(place != F.col("keep")).select(*_PLACE, "lines")


def line_pairs(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Every two filled lines of a slice of texts with at most blank ones between them: hash, text, first line,
    lines, and the places where they begin and end in the returned bytes. A blank line is no line of a pair."""
    # Each text ends with a line feed, so that each line has a byte.
    nothing, feed = (pa.scalar(x, pa.large_string()) for x in ("", "\n"))
    ended = pc.binary_join_element_wise(texts.fill_null("").cast(pa.large_string()), nothing, feed)
    data, bounds = buffers(ended)
    feeds = data == 10
    ends = np.flatnonzero(feeds)
    starts = np.concatenate((np.zeros(1, np.int64), ends[:-1] + 1))
    hashes = hash_pieces(data, starts, feeds, False)
    filled = np.logical_or.reduceat(~WHITE[data], starts)
    text = np.searchsorted(bounds, starts, "right") - 1
    line = np.arange(len(starts)) - np.searchsorted(starts, bounds[:-1])[text]
    own = np.flatnonzero(filled)
    same = np.flatnonzero(text[own[1:]] == text[own[:-1]])
    at, next_at = own[same], own[same + 1]
    rolled = mix(hashes[at] * _FACTOR + mix(hashes[next_at] + _FACTOR + (next_at - at).astype(np.uint64)))
    return rolled.view(np.int64), text[at], line[at], next_at - at + 1, starts[at], ends[next_at], data


def _pair_counts(docs: DataFrame) -> DataFrame:
    """(h, n): hashes of pairs of lines and how often they occur."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in _slices(batch)):
            hashes, counts = np.unique(line_pairs(part["text"])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(counts)], ["h", "n"])

    found = docs.where("text is not null").select("text").mapInArrow(count, "h bigint, n bigint")
    return found.groupBy("h").agg(F.sum("n").alias("n"))


def _pair_rows(docs: DataFrame, bitmap, width: int) -> DataFrame:
    """One row per place of a pair of lines that is in the bitmap, with its bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for part in (p for batch in batches for p in _slices(batch)):
            hashes, text, line, lines, starts, ends, data = line_pairs(part["text"])
            place = hashes & ((1 << width) - 1)
            held = np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            whole = data.tobytes()
            pieces = [whole[a:b] for a, b in zip(starts[held].tolist(), ends[held].tolist())]
            keys = [part[c].take(pa.array(text[held])) for c in ("doc_id", "k1", "k2")]
            spans = [pa.array(x[held].astype(np.int32)) for x in (line, lines)]
            arrays = [pa.array(hashes[held]), *keys, *spans, pa.array(pieces, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["h", *_PLACE, "lines", "bytes"])

    schema = "h bigint, doc_id bigint, k1 bigint, k2 bigint, first int, lines int, bytes binary"
    return docs.where("text is not null").select("doc_id", "k1", "k2", "text").mapInArrow(rows, schema)


def repeated_pairs(docs: DataFrame) -> DataFrame:
    """Every place (doc_id, k1, k2, first, lines) at which a pair of lines stands that stood at another place before."""
    place = F.struct(*_PLACE)
    repeated = written(_pair_counts(docs).where("n > 1").select("h"), "repeated-pairs")
    width = min(max(BITMAP_BITS, (16 * repeated.count()).bit_length()), MAX_PAIR_BITS)
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(repeated, width))
    rows = _pair_rows(docs, bits, width).withColumn("h2", F.xxhash64("bytes"))
    rows = written(rows, "pairs")
    # Grouping by the bytes is the comparison; one row per repeated pair is joined back.
    kept = rows.groupBy("h", "h2", "bytes").agg(F.min(place).alias("keep"), F.max(place).alias("last"))
    kept = kept.where("keep != last").select("h", "h2", "keep")
    return rows.drop("bytes").join(kept, ["h", "h2"]).where(place != F.col("keep")).select(*_PLACE, "lines")


def dedup_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) of every row, the text without repeated runs of lines.

    Of any run of two filled lines or more that stands at several places, the
    place of the smallest doc_id (null first) and line keeps it, and every other
    place loses it with the blank lines inside it; a line whose neighbours differ stays; where a line is in a run kept and in one removed, it goes,
    as it stands at an earlier place. So the first place of every line stays.
    Rows equal in doc_id and text are one document, and each is cut alike. A
    null text stays null and has 0 lines; an empty one has 1. Other columns are ignored; an empty table gives no rows.
    """
    keyed = _keyed(docs)
    return _without(keyed, repeated_pairs(keyed))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) of every row, the text without repeated chunks.

    Of a chunk of two lines or more that stands at several places, the place
    of the smallest doc_id (null first) and line keeps it. Rows equal in
    doc_id and text are one document, and each is cut alike. A null text stays
    null and has 0 lines; an empty one has 1. Chunks of blank lines stay.
    Other columns are ignored; an empty table gives no rows.
    """
    keyed = _keyed(docs)
    return _without(keyed, repeated_chunks(keyed))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("doc_id", "text").alias("k1"),
        F.xxhash64("text", "doc_id", F.lit(1)).alias("k2"),
        "text",
    )


def _without(keyed: DataFrame, places: DataFrame) -> DataFrame:
    """The texts without the lines at ``places``."""
    removed = places.distinct().groupBy("k1", "k2").agg(
        F.sort_array(F.collect_list(F.struct("first", "lines"))).alias("cuts")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for whole in batches for p in _slices(whole)):
            counts, gone, texts = [], [], []
            for text, cuts in zip(batch["text"].to_pylist(), batch["cuts"].to_pylist()):
                lines = [] if text is None else text.split("\n")
                counts.append(len(lines))
                out: set[int] = set()
                for c in cuts or ():
                    out.update(range(c["first"], c["first"] + c["lines"]))
                gone.append(len(out))
                if cuts:
                    text = "\n".join(line for i, line in enumerate(lines) if i not in out)
                texts.append(text)
            arrays = [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_lines", "n_removed", "text"])

    joined = keyed.join(removed, ["k1", "k2"], "left").select("doc_id", "text", "cuts")
    return joined.mapInArrow(cut, "doc_id bigint, n_lines bigint, n_removed bigint, text string")
