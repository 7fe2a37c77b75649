"""Totals, cache efficiency, time series and period comparison."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficloom.functions.timeparts import TimeRange, hour_of, ntz
from trafficloom.operators.filters import buckets_in_range, in_branch

COUNTS = ("total_requests", "blocked_requests", "allowed_requests")
ACTIVE = ("active_client_count", "active_user_count")


def _sum_or_zero(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0).cast("long"))


def active_counts(client_rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Exact distinct clients and named users.

    Rows collapse to distinct (client, user) pairs map-side first, so the two
    distinct counts expand only those pairs.
    """
    pairs = client_rows.select(*by, "client_ip", "user").distinct()
    return pairs.groupBy(*by).agg(
        F.count_distinct("client_ip").alias("active_client_count"),
        F.count_distinct("user").alias("active_user_count"),
    )


def summary(
    minutes: DataFrame,
    client_rows: DataFrame,
    since: dt.datetime,
    until: dt.datetime,
    branch: str | None = None,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Request totals and active clients/users; one row, or one per ``by`` group.

    ``client_rows`` comes from ``clients.client_bucket_rows`` for the same range.
    """
    totals = buckets_in_range(minutes, since, until, branch).groupBy(*by).agg(*[_sum_or_zero(c).alias(c) for c in COUNTS])
    active = active_counts(client_rows, by)
    zero = F.lit(0).cast("long")
    stacked = totals.select(*by, *COUNTS, *[zero.alias(c) for c in ACTIVE]).unionByName(
        active.select(*by, *[zero.alias(c) for c in COUNTS], *ACTIVE)
    )
    return stacked.groupBy(*by).agg(*[F.sum(c).alias(c) for c in (*COUNTS, *ACTIVE)])


def cache_efficiency(
    minutes: DataFrame, since: dt.datetime, until: dt.datetime, branch: str | None = None
) -> DataFrame:
    """Hits, misses and hit ratio; the ratio is NULL when nothing was cacheable."""
    sums = buckets_in_range(minutes, since, until, branch).agg(
        _sum_or_zero("hit_requests").alias("hit_requests"), _sum_or_zero("miss_requests").alias("miss_requests")
    )
    cacheable = F.nullif(F.col("hit_requests") + F.col("miss_requests"), F.lit(0))
    return sums.withColumn("hit_ratio", F.try_divide(F.col("hit_requests"), cacheable))


def timeseries(
    minutes: DataFrame,
    since: dt.datetime,
    until: dt.datetime,
    granularity: str = "minute",
    branch: str | None = None,
) -> DataFrame:
    """Totals per minute or hour over all selected branches, gaps left out."""
    if granularity not in ("minute", "hour"):
        raise ValueError(f"unknown granularity {granularity!r}")
    bucket = F.col("bucket_ts") if granularity == "minute" else hour_of(F.col("bucket_ts"))
    rows = buckets_in_range(minutes, since, until, branch)
    return rows.groupBy(bucket.alias("bucket_ts")).agg(*[F.sum(c).alias(c) for c in COUNTS]).orderBy("bucket_ts")


def percent_change(current: Column, previous: Column) -> Column:
    """NULL when the previous value is missing or 0."""
    return (current - previous) / F.nullif(previous, F.lit(0)).cast("double") * 100


def period_comparison(minutes: DataFrame, current: TimeRange, branch: str | None = None) -> DataFrame:
    """Totals of a period, of the equally long one before it, and percent changes.

    Both periods are summed in one pass. As ranges include both ends, a bucket
    exactly on the border counts in both.
    """
    before = current.previous()
    rows = in_branch(minutes, branch).where(F.col("bucket_ts").between(ntz(before.since), ntz(current.until)))
    if "event_date" in minutes.columns:
        rows = rows.where(F.col("event_date").between(F.lit(before.since.date()), F.lit(current.until.date())))
    now = F.col("bucket_ts") >= ntz(current.since)
    then = F.col("bucket_ts") <= ntz(before.until)
    sums = rows.agg(
        *[F.coalesce(F.sum(F.when(now, F.col(c))), F.lit(0).cast("long")).alias(f"current_{c}") for c in COUNTS],
        *[F.coalesce(F.sum(F.when(then, F.col(c))), F.lit(0).cast("long")).alias(f"previous_{c}") for c in COUNTS],
    )
    return sums.select(
        "*",
        *[percent_change(F.col(f"current_{c}"), F.col(f"previous_{c}")).alias(f"change_{c}") for c in COUNTS],
    )
