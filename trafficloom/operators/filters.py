"""Predicates, ordering and paging shared by the listings."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficloom.fixed_values import NON_WORK_EXEMPT
from trafficloom.functions.text import contains_ci, is_blank
from trafficloom.functions.timeparts import ntz

MAX_PAGE = 1_000


def in_time_range(df: DataFrame, since: dt.datetime, until: dt.datetime, column: str = "timestamp") -> DataFrame:
    """Both ends inclusive. On stored tables the date bounds prune partitions."""
    rows = df.where(F.col(column).between(ntz(since), ntz(until)))
    if "event_date" in df.columns:
        rows = rows.where(F.col("event_date").between(F.lit(since.date()), F.lit(until.date())))
    return rows


def in_branch(df: DataFrame, branch: str | None) -> DataFrame:
    return df if branch is None else df.where(F.col("branch") == branch)


def buckets_in_range(df: DataFrame, since: dt.datetime, until: dt.datetime, branch: str | None = None) -> DataFrame:
    """Minute rows whose bucket start is in the range."""
    return in_branch(in_time_range(df, since, until, "bucket_ts"), branch)


def hours_overlapping(df: DataFrame, since: dt.datetime, until: dt.datetime, branch: str | None = None) -> DataFrame:
    """Hour rows any part of which is in the range."""
    earliest = since - dt.timedelta(hours=1)
    rows = df.where((F.col("bucket_ts") <= ntz(until)) & (F.col("bucket_ts") > ntz(earliest)))
    if "event_date" in df.columns:
        rows = rows.where(F.col("event_date").between(F.lit(earliest.date()), F.lit(until.date())))
    return in_branch(rows, branch)


def search_any(columns: list[str], needle: str) -> Column:
    return reduce(lambda a, b: a | b, [contains_ci(F.col(c), needle) for c in columns])


def _equals(column: str) -> Callable[[str], Column]:
    return lambda value: F.col(column) == value


def _contains(*columns: str) -> Callable[[str], Column]:
    return lambda value: search_any(list(columns), value)


CONDITIONS: dict[str, Callable[..., Column]] = {
    "branch": _equals("branch"),
    "client_ip": _equals("client_ip"),
    "method": _equals("method"),
    "domain": _contains("domain"),
    "user": _contains("user"),
    "search": _contains("client_ip", "domain", "url", "user"),
    "blocked_only": lambda _: F.col("blocked"),
}


def select_events(
    events: DataFrame,
    since: dt.datetime,
    until: dt.datetime,
    **conditions: str | bool | None,
) -> DataFrame:
    """Events of a range that meet all conditions, named as in ``CONDITIONS``.

    A condition that is None, False or blank does not restrict anything.
    """
    unknown = conditions.keys() - CONDITIONS.keys()
    if unknown:
        raise TypeError(f"unknown conditions: {', '.join(sorted(unknown))}")
    tests = [CONDITIONS[name](value) for name, value in conditions.items() if value and not is_blank(str(value))]
    rows = in_time_range(events, since, until)
    return rows.where(reduce(lambda a, b: a & b, tests)) if tests else rows


def non_work(category: Column) -> Column:
    return ~category.isin(*NON_WORK_EXEMPT)


def ordered(df: DataFrame, sort_by: str, allowed: tuple[str, ...], default: str, descending: bool, ties: list[str]):
    """Sort by a named column (unknown names fall back), ties broken by key."""
    name = sort_by if sort_by in allowed else default
    lead = F.col(name).desc() if descending else F.col(name).asc()
    return df.orderBy(lead, *[F.col(t).asc() for t in ties if t != name])


def page(df: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of an ordered frame."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be 1 to {MAX_PAGE}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    return (df.offset(offset) if offset else df).limit(limit)


def total_of(df: DataFrame) -> DataFrame:
    """The page total as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias("total"))
