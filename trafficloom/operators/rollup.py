"""Additive roll-ups of events. Every one is a map-side combined group-by.

``all_rollups`` makes all stored ones from a single scan: events are first
summed at the finest grain that any of them needs, then grouping sets sum those
rows for every table at once.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficloom.functions.timeparts import hour_of, minute_of
from trafficloom.operators.categorize import CategoryRules, categorize
from trafficloom.schema import (
    CLIENT_CATEGORY_MINUTE,
    CLIENT_DOMAIN_SEEN,
    CLIENT_HOURLY,
    CLIENT_MINUTE,
    DOMAIN_MINUTE,
    DOMAIN_SEEN,
    FLUSHED_ROLLUPS,
    MINUTE_TOTALS,
    RollupSpec,
)

# Folders over which first visits are spread by domain.
SEEN_BUCKETS = 16


def cache_class(action: Column) -> Column:
    """'hit', 'miss' or NULL; a tag with both texts is a hit."""
    tag = F.upper(action)
    return F.when(tag.contains("HIT"), "hit").when(tag.contains("MISS"), "miss")


def _requests() -> Column:
    return F.count(F.lit(1))


def _blocked() -> Column:
    return F.count_if(F.col("blocked"))


def minute_totals(events: DataFrame) -> DataFrame:
    rows = events.select(
        minute_of(F.col("timestamp")).alias("bucket_ts"),
        "branch",
        "blocked",
        "bytes",
        cache_class(F.col("action")).alias("cache"),
    )
    return rows.groupBy("bucket_ts", "branch").agg(
        _requests().alias("total_requests"),
        _blocked().alias("blocked_requests"),
        F.count_if(~F.col("blocked")).alias("allowed_requests"),
        F.sum("bytes").alias("total_bytes"),
        F.count_if(F.col("cache") == "hit").alias("hit_requests"),
        F.count_if(F.col("cache") == "miss").alias("miss_requests"),
    )


def domain_minute(events: DataFrame) -> DataFrame:
    rows = events.where(F.col("domain").isNotNull() & (F.col("domain") != ""))
    return rows.groupBy(minute_of(F.col("timestamp")).alias("bucket_ts"), "domain", "branch").agg(
        _requests().alias("request_count"), _blocked().alias("blocked_count"), F.sum("bytes").alias("total_bytes")
    )


def client_minute(events: DataFrame) -> DataFrame:
    return events.groupBy(minute_of(F.col("timestamp")).alias("bucket_ts"), "client_ip", "branch", "user").agg(
        _requests().alias("request_count"), _blocked().alias("blocked_count"), F.sum("bytes").alias("total_bytes")
    )


def client_category_minute(events: DataFrame, rules: CategoryRules) -> DataFrame:
    """Events are summed per domain first, so the category look-up sees far fewer rows."""
    per_domain = (
        events.where(F.col("domain").isNotNull() & (F.col("domain") != ""))
        .groupBy(minute_of(F.col("timestamp")).alias("bucket_ts"), "client_ip", "branch", "domain")
        .agg(_requests().alias("request_count"), F.sum("bytes").alias("total_bytes"))
    )
    labelled = categorize(per_domain, rules, spread_by=["bucket_ts", "client_ip"])
    return labelled.groupBy("bucket_ts", "client_ip", "category", "branch").agg(
        F.sum("request_count").alias("request_count"), F.sum("total_bytes").alias("total_bytes")
    )


def client_hourly(client_minutes: DataFrame) -> DataFrame:
    """Minute rows re-bucketed to hours."""
    keys = [hour_of(F.col("bucket_ts")).alias("bucket_ts"), *CLIENT_HOURLY.keys[1:]]
    return client_minutes.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in CLIENT_MINUTE.measures])


def client_domain_seen(events: DataFrame) -> DataFrame:
    """First visit of every client to every domain."""
    named = events.where(F.col("domain").isNotNull() & (F.col("domain") != ""))
    return named.groupBy("client_ip", "branch", "domain").agg(F.min("timestamp").alias("first_seen"))


def domain_seen(events: DataFrame) -> DataFrame:
    """First visit of anyone in a branch to every domain."""
    named = events.where(F.col("domain").isNotNull() & (F.col("domain") != ""))
    return named.groupBy("branch", "domain").agg(F.min("timestamp").alias("first_seen"))


def seen_bucket(domain: Column) -> Column:
    """The folder of a domain's first visits; a checksum, so that Python can name it too."""
    return (F.crc32(domain.cast("binary")) % SEEN_BUCKETS).cast("int")


def seen_bucket_of(domain: str) -> int:
    return zlib.crc32(domain.encode()) % SEEN_BUCKETS


def finest_sums(events: DataFrame) -> DataFrame:
    """Sums by minute, branch, client, user and domain: every stored roll-up can be made from them."""
    cache = cache_class(F.col("action"))
    return events.groupBy(
        minute_of(F.col("timestamp")).alias("bucket_ts"), "branch", "client_ip", "user", "domain"
    ).agg(
        _requests().alias("requests"),
        _blocked().alias("blocked"),
        F.sum("bytes").alias("bytes"),
        F.count_if(cache == "hit").alias("hits"),
        F.count_if(cache == "miss").alias("misses"),
        F.min("timestamp").alias("first_seen"),
    )


# The columns that some roll-up is keyed by, in the order of the grouping id's bits.
_SET_KEYS = ("bucket_ts", "branch", "client_ip", "user", "domain", "category")


def _set_id(spec: RollupSpec) -> int:
    """The grouping id of a roll-up's rows: a bit is set for every column that is not a key."""
    return sum(1 << (len(_SET_KEYS) - 1 - k) for k, name in enumerate(_SET_KEYS) if name not in spec.keys)


def all_rollups(events: DataFrame, rules: CategoryRules) -> DataFrame:
    """The rows of all flushed roll-ups in one frame, told apart by ``grain``.

    Two shuffles: one to the finest grain, one for all grouping sets. Measures
    that a roll-up does not have are null. ``bucket`` deals first visits over
    folders and is 0 elsewhere.
    """
    finest = finest_sums(events)
    named = F.col("domain").isNotNull() & (F.col("domain") != "")
    labelled = categorize(finest, rules, spread_by=["bucket_ts", "client_ip"])
    labelled = labelled.withColumn("category", F.when(named, F.col("category")))
    sets = [[F.col(k) for k in spec.keys] for spec in FLUSHED_ROLLUPS]
    sums = labelled.groupingSets(sets, *[F.col(k) for k in _SET_KEYS]).agg(
        F.grouping_id(*_SET_KEYS).cast("int").alias("set"),
        F.sum("requests").alias("requests"),
        F.sum("blocked").alias("blocked"),
        F.sum("bytes").alias("bytes"),
        F.sum("hits").alias("hits"),
        F.sum("misses").alias("misses"),
        F.min("first_seen").alias("first"),
    )
    ids = {spec.name: _set_id(spec) for spec in FLUSHED_ROLLUPS}
    of = {name: F.col("set") == number for name, number in ids.items()}
    totals = of[MINUTE_TOTALS.name]
    first = of[CLIENT_DOMAIN_SEEN.name] | of[DOMAIN_SEEN.name]
    per_domain = of[DOMAIN_MINUTE.name] | first
    rows = sums.where(named | ~per_domain).where(F.col("category").isNotNull() | ~of[CLIENT_CATEGORY_MINUTE.name])
    grain = F.coalesce(*[F.when(test, F.lit(name)) for name, test in of.items()])
    measures = {
        "total_requests": (totals, F.col("requests")),
        "blocked_requests": (totals, F.col("blocked")),
        "allowed_requests": (totals, F.col("requests") - F.col("blocked")),
        "hit_requests": (totals, F.col("hits")),
        "miss_requests": (totals, F.col("misses")),
        "request_count": (~totals & ~first, F.col("requests")),
        "blocked_count": (~totals & ~first & ~of[CLIENT_CATEGORY_MINUTE.name], F.col("blocked")),
        "total_bytes": (~first, F.col("bytes")),
        "first_seen": (first, F.col("first")),
    }
    return rows.select(
        grain.alias("grain"),
        F.when(first, seen_bucket(F.col("domain"))).otherwise(F.lit(0)).alias("bucket"),
        *_SET_KEYS,
        *[F.when(test, value).alias(name) for name, (test, value) in measures.items()],
    )


def rollup_of(wide: DataFrame, spec: RollupSpec) -> DataFrame:
    """One roll-up out of the rows of ``all_rollups``."""
    return wide.where(F.col("grain") == spec.name).select(*spec.keys, *spec.measures)


def merge_partials(partials: DataFrame, spec: RollupSpec, *more_keys: str) -> DataFrame:
    """Merge rows that share the key; NULL keys form one group."""
    return partials.groupBy(*spec.keys, *more_keys).agg(*spec.merged())
