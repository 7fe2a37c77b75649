"""Weekly gzip archives of events per branch, and their watermarks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficloom.fixed_values import ARCHIVE_DAYS
from trafficloom.functions.skew import broadcast_if_small
from trafficloom.functions.timeparts import ntz
from trafficloom.plans.export import csv_frame
from trafficloom.plans.files import delete, partitions
from trafficloom.plans.store import LogStore


def archive_windows(branches: DataFrame, archive_runs: DataFrame, now: dt.datetime) -> DataFrame:
    """(branch, since, until): a week, or longer when the last archive is older."""
    week = ntz(now - dt.timedelta(days=ARCHIVE_DAYS))
    joined = branches.select("branch").join(archive_runs, "branch", "left")
    return joined.select("branch", F.least(week, F.col("archived_until")).alias("since"), ntz(now).alias("until"))


def archive_rows(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Events to archive. ``windows`` has one row per configured branch."""
    if "event_date" in events.columns:
        # One row: the earliest date any branch needs, so that older partitions are not read.
        span = windows.agg(F.min("since").alias("since"), F.max("until").alias("until")).first()
        if span["since"] is not None:
            events = events.where(F.col("event_date").between(F.lit(span["since"].date()), F.lit(span["until"].date())))
    rows = events.join(broadcast_if_small(windows.select("branch", "since", "until")), "branch")
    return rows.where(F.col("timestamp").between(F.col("since"), F.col("until"))).select(*events.columns)


def advance(branches: DataFrame, archive_runs: DataFrame, now: dt.datetime) -> DataFrame:
    """Watermarks after a run: configured branches at ``now``, others as they were."""
    done = branches.select("branch", ntz(now).alias("archived_until"))
    return archive_runs.join(branches, "branch", "left_anti").select("branch", "archived_until").unionByName(done)


def is_due(
    branches: DataFrame, archive_runs: DataFrame, now: dt.datetime, every: dt.timedelta = dt.timedelta(days=ARCHIVE_DAYS)
) -> DataFrame:
    """One row: is any branch without a run, or its last run too old?"""
    joined = branches.select("branch").join(archive_runs, "branch", "left")
    old = F.col("archived_until").isNull() | (F.col("archived_until") <= ntz(now - every))
    return joined.agg(F.coalesce(F.bool_or(old), F.lit(False)).alias("due"))


def run_archive(
    events: DataFrame, branches: DataFrame, archive_runs: DataFrame, now: dt.datetime, out: str
) -> DataFrame:
    """Write ``<out>/run_date=<day>/archive_branch=<b>/*.csv.gz``; returns the new watermarks.

    Rows go straight from scan tasks to files, so a large branch is written by
    many tasks. The folder of a day is replaced when a run is repeated, and the
    caller stores the watermarks only after this returns.
    """
    rows = archive_rows(events, archive_windows(branches, archive_runs, now))
    files = csv_frame(rows).select("*", F.lit(now.date()).alias("run_date"), F.col("branch").alias("archive_branch"))
    (
        files.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_date", "archive_branch")
        .option("header", True)
        .option("escape", '"')
        .option("compression", "gzip")
        .csv(out)
    )
    return advance(branches, archive_runs, now)


RUNS = "branch string, archived_until timestamp_ntz"


def archive_store(store: LogStore, branches: DataFrame, now: dt.datetime, out: str) -> bool:
    """Archive a store when any branch is due; the watermarks move only after the files are written."""
    runs = store.state("archive_runs", RUNS)
    if not is_due(branches, runs, now).first()["due"]:
        return False
    store.save_state("archive_runs", run_archive(store.events(), branches, runs, now, out))
    return True


def prune_archives(spark: SparkSession, out: str, keep_days: int, now: dt.datetime) -> list[str]:
    """Delete run folders older than ``keep_days``; returns their dates."""
    oldest = (now - dt.timedelta(days=keep_days)).date()
    dropped = []
    for p in partitions(spark, out, "run_date"):
        if dt.date.fromisoformat(p["run_date"]) < oldest:
            delete(spark, p["path"])
            dropped.append(p["run_date"])
    return sorted(dropped)


def merge_watermarks(archive_runs: DataFrame, source: str, target: str) -> DataFrame:
    """Fold one branch's watermark into another's, keeping the earlier one."""
    renamed = F.when(F.col("branch") == source, F.lit(target)).otherwise(F.col("branch"))
    return archive_runs.groupBy(renamed.alias("branch")).agg(F.min("archived_until").alias("archived_until"))
