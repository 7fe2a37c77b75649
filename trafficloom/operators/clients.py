"""Per-client listing, summary and activity."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficloom.functions.text import is_blank
from trafficloom.operators.events import newest_first
from trafficloom.operators.filters import (
    buckets_in_range,
    hours_overlapping,
    ordered,
    page,
    search_any,
    select_events,
    total_of,
)

ROW = ("client_ip", "user", "branch", "request_count", "blocked_count", "total_bytes", "bucket_ts")
CLIENT = ("client_ip", "user", "branch")
SORTABLE = (*CLIENT, "total_requests", "blocked_requests", "total_bytes", "last_activity")


def client_bucket_rows(
    minutes: DataFrame,
    hours: DataFrame | None,
    since: dt.datetime,
    until: dt.datetime,
    client_ip: str | None = None,
    search: str | None = None,
    branch: str | None = None,
) -> DataFrame:
    """Minute rows and hour rows of a range. The two must not cover the same time twice."""
    arms = [buckets_in_range(minutes, since, until, branch)]
    if hours is not None:
        arms.append(hours_overlapping(hours, since, until, branch))

    def narrowed(rows: DataFrame) -> DataFrame:
        if client_ip is not None:
            rows = rows.where(F.col("client_ip") == client_ip)
        if not is_blank(search):
            rows = rows.where(search_any(["client_ip", "user"], search))
        return rows.select(*ROW)

    merged = narrowed(arms[0])
    for arm in arms[1:]:
        merged = merged.unionByName(narrowed(arm))
    return merged


def client_totals(rows: DataFrame) -> DataFrame:
    """Sums and last activity per (client, user, branch)."""
    return rows.groupBy(*CLIENT).agg(
        F.sum("request_count").alias("total_requests"),
        F.sum("blocked_count").alias("blocked_requests"),
        F.sum("total_bytes").alias("total_bytes"),
        F.max("bucket_ts").alias("last_activity"),
    )


def list_clients(
    rows: DataFrame,
    sort_by: str = "total_requests",
    descending: bool = True,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """A page of clients; an IP seen in two branches is listed once per branch."""
    return page(ordered(client_totals(rows), sort_by, SORTABLE, "total_requests", descending, list(CLIENT)), limit, offset)


def count_clients(rows: DataFrame) -> DataFrame:
    """The total that goes with ``list_clients``."""
    return total_of(rows.select(*CLIENT).distinct())


def client_summary(rows: DataFrame) -> DataFrame:
    """One row per IP over all its users, with the user and branch seen last.

    Minute rows are reduced to (client, user, branch) by a hash aggregate
    before the last-seen pick, whose ties go to the greater user and branch.
    """
    per_user = client_totals(rows)
    seen = F.struct("last_activity", "user", "branch")
    return (
        per_user.groupBy("client_ip")
        .agg(
            F.sum("total_requests").alias("total_requests"),
            F.sum("blocked_requests").alias("blocked_requests"),
            F.sum("total_bytes").alias("total_bytes"),
            F.max(seen).alias("seen"),
        )
        .select(
            "client_ip",
            F.col("seen.user").alias("user"),
            F.col("seen.branch").alias("branch"),
            "total_requests",
            "blocked_requests",
            "total_bytes",
            F.col("seen.last_activity").alias("last_activity"),
        )
    )


def client_activity(
    events: DataFrame,
    client_ip: str,
    since: dt.datetime,
    until: dt.datetime,
    limit: int = 50,
    offset: int = 0,
    **conditions,
) -> DataFrame:
    """A page of one client's events, newest first."""
    return page(newest_first(select_events(events, since, until, client_ip=client_ip, **conditions)), limit, offset)
