"""Relabelling a branch in stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficloom.plans.archive import RUNS, merge_watermarks
from trafficloom.plans.store import CARRIED, CLIENT_SETS, LogStore
from trafficloom.schema import ALL_ROLLUPS, CLIENT_HOURLY, CLIENT_MINUTE, RAW_EVENTS


def relabelled(rows: DataFrame, source: str, target: str) -> DataFrame:
    return rows.withColumn("branch", F.when(F.col("branch") == source, F.lit(target)).otherwise(F.col("branch")))


def relabel_conflicts(rows: DataFrame, keys: list[str], source: str, target: str) -> DataFrame:
    """Rows of ``source`` whose key already exists under ``target``. NULL keys compare equal.

    Both branches are folded into one group-by on the remaining key, so no join
    on a large branch is needed.
    """
    rest = [k for k in keys if k != "branch"]
    both = rows.where(F.col("branch").isin(source, target))
    return (
        both.groupBy(*rest)
        .agg(
            F.count_if(F.col("branch") == source).alias("source_rows"),
            F.count_if(F.col("branch") == target).alias("target_rows"),
        )
        .where("source_rows > 0 and target_rows > 0")
    )


def relabel_plan(rows: DataFrame, name: str, keys: list[str] | None, source: str, target: str) -> DataFrame:
    """One row: how many rows would move and how many of them conflict."""
    moving = rows.where(F.col("branch") == source).agg(F.count(F.lit(1)).alias("moving"))
    zero = F.lit(0).cast("long")
    counts = moving.select("moving", zero.alias("conflicts"))
    if keys is not None:
        clashes = relabel_conflicts(rows, keys, source, target).agg(
            F.coalesce(F.sum("source_rows"), zero).alias("conflicts")
        )
        counts = counts.unionByName(clashes.select(zero.alias("moving"), "conflicts"))
    return counts.agg(F.sum("moving").alias("moving"), F.sum("conflicts").alias("conflicts")).select(
        F.lit(name).alias("table_name"), "moving", "conflicts"
    )


def _settings_moved(rows: DataFrame, source: str, target: str) -> DataFrame:
    """Settings of the source branch go to the target, unless that has its own."""
    kept = rows.where(F.col("branch") == target)
    moved = relabelled(rows, source, target)
    own = kept.select("branch").distinct()
    return moved.where(F.col("branch") != target).unionByName(kept).unionByName(
        moved.where(F.col("branch") == target).join(own, "branch", "left_anti")
    )


SETTINGS = (
    "branch string, sensitive_categories array<string>, non_work_minutes int, byte_quota bigint, uncategorized_threshold int"
)
STATES = (("archive_runs", RUNS, merge_watermarks), ("alert_settings", SETTINGS, _settings_moved))


def relabel_branch(store: LogStore, source: str, target: str, dry_run: bool = True) -> DataFrame:
    """Rename a branch in every stored table, in stored settings, watermarks and anomalies; a
    table with key conflicts is left as it is. Stored events and roll-ups are not written again.

    Returns (table_name, moving, conflicts) per table, also for a dry run.
    """
    if source == target:
        raise ValueError("the two branches must differ")
    plans = [relabel_plan(store.events(), RAW_EVENTS, None, source, target)]
    plans += [relabel_plan(store.rollup(s), s.name, list(s.keys), source, target) for s in ALL_ROLLUPS]
    report = plans[0]
    for plan in plans[1:]:
        report = report.unionByName(plan)
    found = report.collect()  # One row per table.
    if not dry_run:
        free = [row.table_name for row in found if row.moving and not row.conflicts]
        if free:
            sets = [CLIENT_SETS] if {CLIENT_MINUTE.name, CLIENT_HOURLY.name}.intersection(free) else []
            store.rename_branch([*free, *CARRIED, *sets], source, target)
        store.relabel_anomalies(source, target)
        for name, columns, merge in STATES:
            rows = store.state(name, columns)
            if rows.where(F.col("branch") == source).limit(1).count():
                store.save_state(name, merge(rows, source, target))
    return store.spark.createDataFrame(found, report.schema)
