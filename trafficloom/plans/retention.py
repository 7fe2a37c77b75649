"""Retention of events and roll-ups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficloom.fixed_values import HOURLY_AFTER_HOURS, RAW_RETENTION_DAYS, ROLLUP_RETENTION_DAYS
from trafficloom.functions.timeparts import ntz
from trafficloom.plans.store import CLIENT_SETS, MONITOR_ANOMALIES, LogStore
from trafficloom.schema import ALL_ROLLUPS, ANOMALIES, CLIENT_DOMAIN_SEEN, CLIENT_MINUTE, DOMAIN_SEEN, RAW_EVENTS


def unarchived_branches(branches: DataFrame, archive_runs: DataFrame, cutoff: dt.datetime) -> DataFrame:
    """Branches whose archive does not reach up to the purge cutoff."""
    joined = branches.select("branch").join(archive_runs, "branch", "left")
    return joined.where(F.col("archived_until").isNull() | (F.col("archived_until") < ntz(cutoff))).select("branch")


def kept(rows: DataFrame, cutoff: dt.datetime, column: str) -> DataFrame:
    return rows.where(F.col(column) >= ntz(cutoff))


def _purge(store: LogStore, name: str, cutoff: dt.datetime, column: str) -> list[dt.date]:
    """Drop whole dates, then rewrite the one date the cutoff falls into."""
    dropped = store.drop_dates(name, cutoff.date())
    if cutoff.time() != dt.time() and cutoff.date() in store.dates(name):
        store.fold(name, [cutoff.date()], lambda rows: kept(rows, cutoff, column))
    return dropped


def run_retention(
    store: LogStore,
    branches: DataFrame,
    archive_runs: DataFrame,
    now: dt.datetime,
    raw_days: int = RAW_RETENTION_DAYS,
    rollup_days: int = ROLLUP_RETENTION_DAYS,
    hourly_after_hours: int = HOURLY_AFTER_HOURS,
) -> DataFrame:
    """Roll client minutes up, purge old data, return the branches purged without an archive.

    Safe to repeat: every step leaves nothing to do for the next run at the
    same ``now``.
    """
    store.roll_up_hours(now - dt.timedelta(hours=hourly_after_hours))
    raw_cutoff = now - dt.timedelta(days=raw_days)
    warning = unarchived_branches(branches, archive_runs, raw_cutoff)
    _purge(store, RAW_EVENTS, raw_cutoff, "timestamp")
    rollup_cutoff = now - dt.timedelta(days=rollup_days)
    for spec in ALL_ROLLUPS:
        if spec is CLIENT_MINUTE:
            # Minutes this old are hours already.
            store.drop_dates(spec.name, rollup_cutoff.date())
        elif spec is CLIENT_DOMAIN_SEEN:
            # Visits are remembered as long as the events themselves.
            store.drop_dates(spec.name, raw_cutoff.date())
        elif spec is DOMAIN_SEEN:
            store.drop_dates(spec.name, rollup_cutoff.date())
        else:
            _purge(store, spec.name, rollup_cutoff, "bucket_ts")
    for name in (ANOMALIES, MONITOR_ANOMALIES):
        store.drop_batches(name, "generated_at", rollup_cutoff)
    store.drop_dates(CLIENT_SETS, rollup_cutoff.date())
    # Rejected lines have no time of their own; the numbers of lines are running totals and stay.
    store.drop_batches("rejects", "received", raw_cutoff)
    return warning
