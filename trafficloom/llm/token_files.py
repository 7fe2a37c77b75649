"""Token ids as files of canonical Huffman codes.

A token file is a folder of two Parquet tables. ``codes`` has the length of
each id's code, from the counts of all ids; the codes follow from it.
``blocks`` has runs of whole documents in ascending doc_id order, written part
by part in range order: the documents' ids, numbers of tokens and of bytes, their
bits (each document begins at a byte), and for each document the bit at which every
256th token begins. Any block, and any 256 tokens in it, can be read alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trafficloom.llm.huffman import STEP, Decoder, Encoder, code_lengths, length_limit
from trafficloom.llm.tables import written
from trafficloom.llm.tokenize_words import encoder
from trafficloom.llm.words import slices
from trafficloom.session import scratch_dir

# Bytes of text encoded at once: the arrays made of them take about a hundred times as much.
TEXT_BYTES = 1 << 19
BLOCK_TOKENS = 65_536
PART_TOKENS = 4_000_000
# Codes are kept in memory: vocabularies may have as many ids as this.
MAX_IDS = 1 << 22


def _binary(data: np.ndarray, byte_bounds: np.ndarray) -> pa.Array:
    """Pieces of ``data`` as an array of binary values, without copying each."""
    offsets = pa.py_buffer(byte_bounds.astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(byte_bounds) - 1, [None, offsets, pa.py_buffer(data.tobytes())])


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, ids): ids of each whole text and ``end_id``, as little-endian bytes
    of 16 bits where the vocabulary allows, else 32. A null text is empty."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(tokenizer)
        kind = np.uint16 if len(one.ends_word) <= 1 << 16 and end_id < 1 << 16 else np.uint32
        for batch in batches:
            for first, last in slices(batch["text"], TEXT_BYTES):
                ids, bounds = one.encode(batch["text"].slice(first, last - first))
                # One more place per text, for the end.
                counts = np.diff(bounds) + 1
                ends = np.cumsum(counts)
                row = np.empty(int(ends[-1]), kind)
                is_end = np.zeros(len(row), bool)
                is_end[ends - 1] = True
                row[~is_end], row[is_end] = ids, end_id
                width = row.itemsize
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(first, last - first),
                        pa.array(counts, pa.int64()),
                        pa.array(np.full(last - first, width, np.int32)),
                        _binary(row.view(np.uint8), np.concatenate(([0], ends)) * width),
                    ],
                    ["doc_id", "n_tokens", "width", "ids"],
                )

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id bigint, n_tokens bigint, width int, ids binary")


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    """All ids of a batch of ``tokenized`` in a row."""
    column = batch["ids"]
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(np.uint16 if batch["width"][0].as_py() == 2 else np.uint32)


def _parts(batch: pa.RecordBatch, tokens: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    counts = np.cumsum(batch["n_tokens"].to_numpy())
    first = 0
    while first < batch.num_rows:
        before = counts[first - 1] if first else 0
        last = max(int(np.searchsorted(counts, before + tokens, "right")), first + 1)
        yield batch.slice(first, last - first)
        first = last


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, n) over all documents, summed within a task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                found = np.bincount(_ids(batch))
                if len(found) > len(total):
                    found, total = total, found
                total[: len(found)] += found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids])], ["id", "n"])

    return tokens.select("width", "ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encodes every whole text of (doc_id, text) and writes the token file at ``path``.

    Documents are in ascending order of doc_id, null first, and those that
    share one in the order of their number of tokens and bits. A null or empty
    text is only its end; an empty table gives a file without blocks. Other
    columns are ignored.
    """
    tokens = written(tokenized(docs, tokenizer, end_id), "token-ids")
    counts = id_counts(tokens).orderBy("id").limit(MAX_IDS + 1).collect()
    if len(counts) > MAX_IDS:
        raise ValueError(f"more than {MAX_IDS} distinct ids")
    ids = np.array([r["id"] for r in counts], np.int64)
    numbers = np.array([r["n"] for r in counts], np.int64)
    lengths = code_lengths(numbers, length_limit(len(ids)))
    spark = docs.sparkSession
    rows = [(int(i), int(n)) for i, n in zip(ids, lengths)]
    spark.createDataFrame(rows, "id bigint, length int").coalesce(1).write.parquet(f"{path}/codes")
    shared = spark.sparkContext.broadcast((ids, lengths))

    def to_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Encoder(*shared.value)
        for whole in batches:
            for batch in _parts(whole):
                sizes = batch["n_tokens"].to_numpy()
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                data, byte_bounds, within = code.encode(_ids(batch), bounds)
                n_marks = (sizes + STEP - 1) // STEP
                mark_bounds = np.concatenate(([0], np.cumsum(n_marks)))
                step = np.arange(mark_bounds[-1]) - np.repeat(mark_bounds[:-1], n_marks)
                marks = within[np.repeat(bounds[:-1], n_marks) + step * STEP].astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], batch["n_tokens"], _binary(data, byte_bounds), _binary(marks.view(np.uint8), mark_bounds * 4)],
                    ["doc_id", "n_tokens", "bits", "marks"],
                )

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        doc_ids, sizes, bits, marks = [], [], [], []
        block = done = waiting = 0

        def flush() -> pa.RecordBatch:
            fields = [
                pa.array([part], pa.int32()),
                pa.array([block], pa.int64()),
                pa.array([done], pa.int64()),
                pa.array([waiting], pa.int64()),
                pa.array([doc_ids], pa.list_(pa.int64())),
                pa.array([sizes], pa.list_(pa.int64())),
                pa.array([[len(b) for b in bits]], pa.list_(pa.int64())),
                pa.array([b"".join(bits)], pa.binary()),
                pa.array([b"".join(marks)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(fields, ["part", "block", "before", "tokens", "doc_ids", "sizes", "bytes", "bits", "marks"])

        for batch in batches:
            for doc_id, size, data, mark in zip(*(batch[i].to_pylist() for i in range(4))):
                doc_ids.append(doc_id)
                sizes.append(size)
                bits.append(data)
                marks.append(mark)
                waiting += size
                if waiting >= BLOCK_TOKENS:
                    yield flush()
                    block, done, waiting = block + 1, done + waiting, 0
                    doc_ids, sizes, bits, marks = [], [], [], []
        if doc_ids:
            yield flush()

    encoded = tokens.mapInArrow(to_bits, "doc_id bigint, n_tokens bigint, bits binary, marks binary")
    parts = max(1, math.ceil(int(numbers.sum()) / PART_TOKENS))
    ordered = encoded.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.crc32("bits"))
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.crc32("bits"), "n_tokens", "bits")
    blocks = ordered.mapInArrow(
        to_blocks,
        "part int, block bigint, before bigint, tokens bigint, doc_ids array<bigint>, sizes array<bigint>, bytes array<bigint>, bits binary, marks binary",
    )
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a token file.

    ``start`` counts the ids of all documents before it in the file's order;
    ``ids_crc32`` is over the decoded ids as little-endian 32-bit numbers.
    """
    codes = spark.read.parquet(f"{path}/codes").orderBy("id").limit(MAX_IDS).collect()
    ids = np.array([r["id"] for r in codes], np.int64)
    lengths = np.array([r["length"] for r in codes], np.int64)
    shared = spark.sparkContext.broadcast((ids, lengths))
    blocks = spark.read.parquet(f"{path}/blocks")
    # One row per written part: their number is set by PART_TOKENS.
    parts = blocks.groupBy("part").agg(F.sum("tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Decoder(*shared.value)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                doc_ids, sizes, lengths = row["doc_ids"].flatten(), row["sizes"].flatten().to_numpy(), row["bytes"].flatten().to_numpy()
                data = np.frombuffer(row["bits"][0].as_py(), np.uint8)
                marks = np.frombuffer(row["marks"][0].as_py(), np.uint32)
                n_marks = (sizes + STEP - 1) // STEP
                counts = np.full(len(marks), STEP)
                last = np.cumsum(n_marks) - 1
                counts[last] = sizes - (n_marks - 1) * STEP
                starts = marks + np.repeat((np.cumsum(lengths) - lengths) * 8, n_marks)
                tokens = table.decode(data, starts, counts)
                ends = np.cumsum(sizes)
                raw = memoryview(tokens.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                begin = row["offset"][0].as_py() + row["before"][0].as_py()
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array(begin + ends - sizes), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return blocks.join(F.broadcast(offsets), "part").mapInArrow(
        decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes ``docs`` as a token file in the shared folder and returns what reading it gives."""
    path = scratch_dir(docs.sparkSession, "token-file")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path)
