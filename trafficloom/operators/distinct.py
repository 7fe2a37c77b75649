"""Exact distinct counts that can be merged: values as numbers, sets of numbers as bitmaps.

A dictionary gives every value a number without gaps. A set of numbers is a
bitmap for each chunk of 32,768 of them; sets of disjoint times are joined by
``or``, so a distinct count over a long range reads one small row per hour
instead of all the values seen in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Parts in which new values are numbered.
PARTS = 64


def number_new(values: DataFrame, known: DataFrame, taken: dict[str, int]) -> DataFrame:
    """(kind, value, id) of the values (kind, value) that ``known`` does not have.

    Ids of a kind go on after the ``taken`` ones, without gaps: rows are counted
    in parts by hash, and each part begins where those before it end.
    """
    new = values.where("value is not null").distinct().join(known.select("kind", "value"), ["kind", "value"], "left_anti")
    new = new.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(PARTS)))
    # One row per kind and part.
    sizes = new.groupBy("kind", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = F.lit(0).cast("long")
    for kind, n in taken.items():
        base = F.when(F.col("kind") == kind, F.lit(n)).otherwise(base)
    starts = sizes.select("kind", "part", (base + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("start"))
    place = F.row_number().over(Window.partitionBy("kind", "part").orderBy("value"))
    numbered = new.withColumn("place", place).join(F.broadcast(starts), ["kind", "part"])
    return numbered.select("kind", "value", (F.col("start") + F.col("place") - 1).alias("id"))


def id_sets(rows: DataFrame, *keys: str) -> DataFrame:
    """The sets of the ``id`` of rows, per key: (keys, chunk, ids)."""
    chunk = F.bitmap_bucket_number("id").alias("chunk")
    return rows.groupBy(*keys, chunk).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("ids"))


def merge_sets(sets: DataFrame, *keys: str) -> DataFrame:
    return sets.groupBy(*keys, "chunk").agg(F.bitmap_or_agg("ids").alias("ids"))


def count_sets(sets: DataFrame, *keys: str) -> DataFrame:
    """How many ids the sets of each key have together."""
    return merge_sets(sets, *keys).groupBy(*keys).agg(F.sum(F.bitmap_count("ids")).alias("n"))
