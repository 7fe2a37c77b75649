"""Joins that hold up when one key carries a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A dimension is broadcast only when it is proven to have at most this many rows.
BROADCAST_ROWS = 200_000
# Keys that are handled by broadcast in the hot-key split. A key outside the
# top 1,024 has less than 1/1024 of the rows.
HOT_KEYS = 1_024
# Number of made-up keys over which hot rows are spread.
SPREAD_KEYS = 65_521


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Runs a bounded count: never looks at more than ``rows + 1`` rows."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(dim: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint when its size is proven; else as it is, for
    a shuffle join whose skewed partitions adaptive execution splits."""
    return F.broadcast(dim) if has_at_most(dim, rows) else dim


def lookup_join(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    spread_by: list[Column],
    hot_keys: int = HOT_KEYS,
    key_counts: DataFrame | None = None,
) -> DataFrame:
    """Left-join a large dimension with a unique, non-NULL text ``key`` onto skewed facts.

    The ``hot_keys`` most frequent keys of the facts are looked up by broadcast
    (the side has at most ``hot_keys`` rows by construction). All other keys
    meet in a shuffle join. Hot and NULL rows take part in that shuffle under
    made-up keys that spread them over all tasks and match nothing (real keys
    carry another first letter).
    The result is exact and ``fact`` is read once for the join; ``key_counts``
    (key, n) saves the counting pass when the caller has the counts already.
    """
    values = [c for c in dim.columns if c != key]
    if key_counts is None:
        key_counts = fact.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot = key_counts.orderBy(F.col("n").desc(), F.col(key)).limit(hot_keys).select(key)
    found = dim.join(F.broadcast(hot), key)
    hot_dim = hot.join(F.broadcast(found), key, "left").select(
        F.col(key).alias("__hot_key"), *[F.col(v).alias(f"__hot_{v}") for v in values]
    )
    tagged = fact.join(F.broadcast(hot_dim), F.col(key) == F.col("__hot_key"), "left")
    off_path = F.col("__hot_key").isNotNull() | F.col(key).isNull()
    spread = F.concat(F.lit("s"), F.pmod(F.xxhash64(*spread_by), F.lit(SPREAD_KEYS)))
    tagged = tagged.withColumn("__key", F.when(off_path, spread).otherwise(F.concat(F.lit("k"), F.col(key))))
    cold_dim = dim.select(
        F.concat(F.lit("k"), F.col(key)).alias("__key"), *[F.col(v).alias(f"__cold_{v}") for v in values]
    )
    joined = tagged.join(cold_dim, "__key", "left")
    return joined.select(
        *fact.columns,
        *[
            F.when(F.col("__hot_key").isNotNull(), F.col(f"__hot_{v}")).otherwise(F.col(f"__cold_{v}")).alias(v)
            for v in values
        ],
    )


def dimension_join(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    spread_by: list[Column],
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left-join a dimension: by broadcast when its size is proven, else by hot-key split."""
    if has_at_most(dim, broadcast_rows):
        return fact.join(F.broadcast(dim), key, "left").select(*fact.columns, *[c for c in dim.columns if c != key])
    return lookup_join(fact, dim, key, spread_by)
