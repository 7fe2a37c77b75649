"""Contiguous shards of nearly equal bytes. Column expressions only.

The documents are range-sorted once and stored in that order; every stored
partition then has a total of bytes and of rows, and the running sums of these
totals (one row per partition) tell where each partition begins in the whole.
Equal targets cut the whole into shards. Only the few partitions in which a
target falls need running sums of their rows; every other one lies inside one
shard. A row's shard and slot follow from its place by a join with these
segments, so the texts are shuffled once, by the sort, and never grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficloom.llm.tables import written

SHARDS = 8
RESULT = ("size", "shard", "slot")
# monotonically_increasing_id has the partition above this bit and counts rows below.
_PLACE_BITS = 33


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text plus one; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def in_order(docs: DataFrame) -> DataFrame:
    """The documents stored in the order of their shards: (row, size, part, place).

    The order is doc_id (nulls first), size, checksum. Rows alike in all three
    are told apart by where they were read, so that a hot group of copies is
    dealt over as many tasks as it needs.
    """
    kept = [c for c in docs.columns if c.lower() not in RESULT]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        text_bytes(F.col("text")).alias("size"),
        text_crc32(F.col("text")).alias("crc"),
        F.monotonically_increasing_id().alias("read"),
    )
    ordered = rows.orderBy(F.col("row.doc_id").asc_nulls_first(), "size", "crc", "read")
    place = F.monotonically_increasing_id()
    stored = written(ordered.select("row", "size", place.alias("place")), "shard-order")
    return stored.withColumn("part", F.shiftright("place", _PLACE_BITS))


def segments(sizes: DataFrame, shards: int) -> DataFrame:
    """Runs of rows of one partition in one shard: (part, cuts), where cuts are structs
    (place of the first row, shard, slot of the first row), in order.

    ``sizes`` is (part, place, size). A row is in the shard in which the middle
    of its bytes falls: each cut is then at most half a document off its target.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per stored partition.
    totals = sizes.groupBy("part").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("place").alias("place")
    )
    totals = totals.select(
        "*",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )

    def shard_at(twice: str) -> Column:
        """The shard of a position, given as twice the bytes before it."""
        return F.expr(f"cast({shards} as decimal(10,0)) * cast({twice} as decimal(20,0)) div cast(2 * total as decimal(20,0))").cast("int")

    totals = totals.select("*", shard_at("2 * start").alias("lo"), shard_at("2 * (start + bytes) - 1").alias("hi"))
    totals = written(totals, "shard-totals")
    whole = totals.where("lo = hi").select("part", "place", F.col("lo").alias("shard"), "rows")
    # As many partitions as there are cuts, at most.
    mixed = F.broadcast(totals.where("lo < hi").select("part", "start", "total"))
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    running = sizes.join(mixed, "part").withColumn("ahead", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    cut = running.select("part", "place", shard_at("2 * ahead + size").alias("shard"))
    cut = cut.groupBy("part", "shard").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("rows"))
    runs = whole.unionByName(cut)
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("slot", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    return runs.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("place", "shard", "slot"))).alias("cuts"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with size, shard (0 to ``shards`` - 1) and slot (from 0, without gaps, in its shard).

    Shards are contiguous in the order of doc_id, and their bytes differ from
    equal shares by less than the largest document. A null text has no bytes
    and size 1, like an empty one; null doc_ids come first; repeated doc_ids
    and repeated rows are rows of their own; a document longer than a share
    leaves shards empty. Columns of the input that are named like the added
    ones are replaced; all others are kept. An empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("there must be at least one shard")
    stored = in_order(docs)
    # At most one row per stored partition, with as many cuts in all as partitions and shards.
    found = F.broadcast(segments(stored.select("part", "place", "size"), shards))
    own = F.element_at(F.filter("cuts", lambda c: c["place"] <= F.col("place")), -1)
    rows = stored.join(found, "part").select("row", "size", "place", own.alias("own"))
    return rows.select(
        "row.*", "size", F.col("own.shard").alias("shard"), (F.col("own.slot") + F.col("place") - F.col("own.place")).alias("slot")
    )


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard under ``path``; files hold their rows in the order of slots."""
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
