"""Event listings and the views built on them."""

from __future__ import annotations

import datetime as dt

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficloom.functions.skew import has_at_most, lookup_join
from trafficloom.functions.timeparts import minute_of, ntz
from trafficloom.operators.categorize import CategoryRules, categorize
from trafficloom.operators.filters import in_branch, in_time_range, page, select_events, total_of

DETAIL = (
    "id",
    "timestamp",
    "client_ip",
    "branch",
    "user",
    "method",
    "url",
    "domain",
    "action",
    "status_code",
    "bytes",
    "blocked",
    "duration_ms",
    "hierarchy",
    "peer",
    "content_type",
)


def event_detail(events: DataFrame) -> DataFrame:
    """The 16 columns of a listing, without storage columns."""
    return events.select(*DETAIL)


def newest_first(events: DataFrame) -> DataFrame:
    return event_detail(events).orderBy(F.col("timestamp").desc(), F.col("id").desc())


def minute_counts(events: DataFrame) -> DataFrame:
    """(bucket_ts, n): events per minute."""
    return events.groupBy(minute_of(F.col("timestamp")).alias("bucket_ts")).agg(F.count(F.lit(1)).alias("n"))


def newest(events: DataFrame, n: int, counts: DataFrame | None = None) -> DataFrame:
    """The ``n`` newest events, in no order; of equal times those with the highest ids.

    Counts per minute (of exactly these events, made here if not given) tell in
    which minute the n-th newest event is. Later minutes are whole and are only
    filtered; no task sorts more than the events of that one minute.
    """
    later = Window.orderBy(F.col("bucket_ts").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = (minute_counts(events) if counts is None else counts).groupBy("bucket_ts").agg(F.sum("n").alias("n"))
    # One row per minute.
    sums = sums.withColumn("later", F.coalesce(F.sum("n").over(later), F.lit(0)))
    edge = sums.where((F.col("later") < n) & (F.col("later") + F.col("n") >= n)).select("bucket_ts", "later").first()
    if edge is None:
        return events
    end = edge["bucket_ts"] + dt.timedelta(minutes=1)
    recent = events.where(F.col("timestamp") >= ntz(edge["bucket_ts"]))
    if "event_date" in events.columns:
        recent = recent.where(F.col("event_date") >= F.lit(edge["bucket_ts"].date()))
    last = recent.where(F.col("timestamp") < ntz(end)).orderBy(F.col("timestamp").desc(), F.col("id").desc())
    return recent.where(F.col("timestamp") >= ntz(end)).unionByName(last.limit(n - edge["later"]))


@dataclass(frozen=True)
class Position:
    """A place in the events from newest to oldest: right after the event with this time and id."""

    timestamp: dt.datetime
    id: int


def events_after(events: DataFrame, position: Position | None, limit: int = 50) -> DataFrame:
    """The page that follows a position; events that arrive meanwhile do not move it.

    On a stored table only dates up to the position's are read.
    """
    rows = events
    if position is not None:
        at = ntz(position.timestamp)
        rows = rows.where((F.col("timestamp") < at) | ((F.col("timestamp") == at) & (F.col("id") < position.id)))
        if "event_date" in events.columns:
            rows = rows.where(F.col("event_date") <= F.lit(position.timestamp.date()))
    return page(newest_first(rows), limit)


def next_position(rows: DataFrame) -> Position | None:
    """Where the page after these rows begins; None after an empty page."""
    oldest = rows.select("timestamp", "id").orderBy("timestamp", "id").first()
    return None if oldest is None else Position(oldest["timestamp"], oldest["id"])


# Up to so many rows a page is best kept as a heap in every task.
HEAP_ROWS = 10_000


def list_events(
    events: DataFrame, since: dt.datetime, until: dt.datetime, limit: int = 50, offset: int = 0, **conditions
) -> DataFrame:
    rows = select_events(events, since, until, **conditions)
    if offset + limit > HEAP_ROWS:
        rows = newest(rows, offset + limit)
    return page(newest_first(rows), limit, offset)


def count_events(events: DataFrame, since: dt.datetime, until: dt.datetime, **conditions) -> DataFrame:
    return total_of(select_events(events, since, until, **conditions))


def recent_events(
    events: DataFrame,
    limit: int = 50,
    blocked_only: bool = False,
    client_ip: str | None = None,
    branch: str | None = None,
    newest_date: dt.date | None = None,
) -> DataFrame:
    """The newest events. ``newest_date`` lets a stored table scan only late partitions."""
    rows = in_branch(events, branch)
    if newest_date is not None and "event_date" in events.columns:
        rows = rows.where(F.col("event_date") >= F.lit(newest_date))
    if blocked_only:
        rows = rows.where("blocked")
    if client_ip:
        rows = rows.where(F.col("client_ip") == client_ip)
    return newest_first(rows).limit(limit)


def distinct_domains(
    events: DataFrame, since: dt.datetime, until: dt.datetime, branch: str | None = None
) -> DataFrame:
    rows = in_branch(in_time_range(events, since, until), branch)
    return rows.where(F.col("domain").isNotNull() & (F.col("domain") != "")).select("domain").distinct()


def events_in_domains(events: DataFrame, domains: DataFrame) -> DataFrame:
    """Events whose domain is in a set; an empty set gives no rows."""
    wanted = domains.select("domain").where(F.col("domain").isNotNull()).distinct()
    if has_at_most(wanted, 200_000):
        return events.join(F.broadcast(wanted), "domain", "left_semi").select(*events.columns)
    marked = lookup_join(events, wanted.withColumn("wanted", F.lit(True)), "domain", [F.col("id")])
    return marked.where("wanted").drop("wanted")


def events_in_category(events: DataFrame, rules: CategoryRules, category: str) -> DataFrame:
    """Events whose domain has a category, labelled in place: no domain set is built or sent."""
    named = events.where(F.col("domain").isNotNull())
    return categorize(named, rules, spread_by=["id"]).where(F.col("category") == category).drop("category")


def list_branches(events: DataFrame) -> DataFrame:
    """Branch slugs with a display label."""
    slugs = events.select("branch").distinct()
    return slugs.select(
        F.col("branch").alias("slug"), F.initcap(F.translate("branch", "_-", "  ")).alias("label")
    ).orderBy("slug")
