import zlib

import pytest
from pyspark.sql import functions as F

from trafficloom.llm.queries import QUERIES
from trafficloom.llm.sharding import shard_documents, text_crc32, write_shards


def _expected(rows, shards):
    """(doc_id, size, crc) in order, each with its shard and slot, by plain sums."""
    ordered = sorted(
        ((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows),
        key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]),
    )
    total, before, slots, out = sum(r[1] for r in ordered), 0, {}, []
    for d, size, crc in ordered:
        shard = shards * (2 * before + size) // (2 * total)
        out.append((d, size, crc, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    return out


def _found(frame):
    rows = frame.select("doc_id", "size", text_crc32(F.col("text")).alias("crc"), "shard", "slot").collect()
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("shards", [1, 3, 8, 50])
def test_odd_rows_follow_plain_sums(odd_docs, shards):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert _found(shard_documents(odd_docs, shards)) == sorted(_expected(rows, shards), key=repr)


def test_many_partitions_and_hot_copies(llm_spark):
    """A third of the rows are one document; every shard is near its share, whatever the partitions."""
    docs = llm_spark.range(3_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("the same text")).otherwise(F.repeat(F.lit("ab "), (F.col("id") % 97).cast("int"))).alias("text"),
    )
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = _found(shard_documents(docs.repartition(13)))
    assert found == sorted(_expected(rows, 8), key=repr)
    sums = {}
    for r in found:
        sums[r[3]] = sums.get(r[3], 0) + r[1]
    assert max(sums.values()) - min(sums.values()) <= 2 * max(r[1] for r in found)


def test_other_columns_are_kept_and_clashes_replaced(llm_spark, no_docs):
    docs = llm_spark.createDataFrame(
        [(1, "a b", "x", 5, "p"), (2, None, None, 6, "q")], "doc_id bigint, text string, Shard string, place int, part string"
    )
    out = shard_documents(docs, 2)
    assert out.columns == ["doc_id", "text", "place", "part", "size", "shard", "slot"]
    assert sorted((r.doc_id, r.place, r.part, r.size, r.shard) for r in out.collect()) == [(1, 5, "p", 4, 0), (2, 6, "q", 1, 1)]
    assert shard_documents(no_docs).count() == 0
    with pytest.raises(ValueError):
        shard_documents(docs, 0)


def test_shard_files_hold_their_rows_in_order(llm_spark, odd_docs, tmp_path):
    placed = shard_documents(odd_docs, 3)
    path = str(tmp_path / "shards")
    write_shards(placed, path)
    back = llm_spark.read.parquet(path)
    assert sorted(map(repr, back.select("doc_id", "text", "shard", "slot").collect())) == sorted(
        map(repr, placed.select("doc_id", "text", "shard", "slot").collect())
    )
    for folder in (tmp_path / "shards").glob("shard=*"):
        for file in folder.glob("*.parquet"):
            slots = [r.slot for r in llm_spark.read.parquet(str(file)).coalesce(1).collect()]
            assert slots == sorted(slots)


def test_query(llm_spark, sample):
    rows = QUERIES["op11_shards"](llm_spark, sample).collect()
    docs = llm_spark.read.parquet(f"{sample}/documents.parquet").select("doc_id", "text").collect()
    assert sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in rows) == sorted(_expected([tuple(d) for d in docs], 8))
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
