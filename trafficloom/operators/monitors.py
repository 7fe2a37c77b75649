"""Periodic checks over the last 24 hours of roll-ups, against branch thresholds."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficloom.fixed_values import (
    DEFAULT_NON_WORK_MINUTES,
    MONITOR_LOOKBACK_HOURS,
    QUOTA_CRITICAL_MULTIPLE,
    TITLES,
    UNCATEGORIZED,
    UNCATEGORIZED_CANDIDATES,
    UNCATEGORIZED_COOLDOWN_DAYS,
)
from trafficloom.functions.skew import broadcast_if_small
from trafficloom.functions.timeparts import ntz
from trafficloom.operators.anomalies import as_anomalies
from trafficloom.operators.categorize import CategoryRules
from trafficloom.operators.domains import top_domains_per_branch
from trafficloom.operators.filters import non_work


def _since(rows: DataFrame, since: dt.datetime) -> DataFrame:
    kept = rows.where(F.col("bucket_ts") >= ntz(since))
    return kept.where(F.col("event_date") >= F.lit(since.date())) if "event_date" in rows.columns else kept


def not_flagged_since(rows: DataFrame, anomalies: DataFrame, kind: str, keys: list[str], since: dt.datetime) -> DataFrame:
    """Rows without an anomaly of the same title and key since a time."""
    flagged = anomalies.where((F.col("title") == TITLES[kind]) & (F.col("generated_at") >= ntz(since)))
    return rows.join(flagged.select(*keys).distinct(), keys, "left_anti")


def active_minutes(category_minutes: DataFrame, since: dt.datetime) -> DataFrame:
    """Distinct minutes per (branch, client) with traffic in any non-exempt category."""
    rows = _since(category_minutes, since).where(non_work(F.col("category")))
    return rows.groupBy("branch", "client_ip").agg(F.count_distinct("bucket_ts").alias("minutes"))


def non_work_time(
    category_minutes: DataFrame, settings: DataFrame, anomalies: DataFrame, now: dt.datetime
) -> DataFrame:
    since = now - dt.timedelta(hours=MONITOR_LOOKBACK_HOURS)
    limits = settings.select("branch", "non_work_minutes")
    over = (
        active_minutes(category_minutes, since)
        .join(broadcast_if_small(limits), "branch", "left")
        .withColumn("threshold", F.coalesce("non_work_minutes", F.lit(DEFAULT_NON_WORK_MINUTES)))
        .where((F.col("threshold") > 0) & (F.col("minutes") >= F.col("threshold")))
    )
    fresh = not_flagged_since(over, anomalies, "non_work_time", ["branch", "client_ip"], since)
    text = F.format_string("%s: %d non-work minutes in 24 h, threshold %d", "client_ip", "minutes", "threshold")
    params = {"clientIp": F.col("client_ip"), "minutes": F.col("minutes"), "threshold": F.col("threshold")}
    return as_anomalies(fresh.withColumn("generated_at", ntz(now)), "non_work_time", "medium", text, params)


def byte_quota(client_minutes: DataFrame, settings: DataFrame, anomalies: DataFrame, now: dt.datetime) -> DataFrame:
    since = now - dt.timedelta(hours=MONITOR_LOOKBACK_HOURS)
    used = _since(client_minutes, since).groupBy("branch", "client_ip").agg(F.sum("total_bytes").alias("used"))
    over = used.join(broadcast_if_small(settings.select("branch", "byte_quota")), "branch").where(
        (F.col("byte_quota") != 0) & (F.col("used") >= F.col("byte_quota"))
    )
    fresh = not_flagged_since(over, anomalies, "byte_quota", ["branch", "client_ip"], since)
    severity = F.when(F.col("used") >= F.col("byte_quota") * QUOTA_CRITICAL_MULTIPLE, "critical").otherwise("high")
    text = F.format_string("%s: %d bytes in 24 h, quota %d", "client_ip", "used", "byte_quota")
    params = {"clientIp": F.col("client_ip"), "bytes": F.col("used"), "quota": F.col("byte_quota")}
    return as_anomalies(fresh.withColumn("generated_at", ntz(now)), "byte_quota", severity, text, params)


def uncategorized_domains(
    domain_minutes: DataFrame,
    settings: DataFrame,
    anomalies: DataFrame,
    rules: CategoryRules,
    now: dt.datetime,
    candidates: int | None = UNCATEGORIZED_CANDIDATES,
) -> DataFrame:
    """Uncategorised domains above their branch's threshold.

    Only the ``candidates`` most requested ones of a branch are looked at, before
    threshold and cool-down; with None all are.
    """
    since = now - dt.timedelta(hours=MONITOR_LOOKBACK_HOURS)
    limits = settings.where("uncategorized_threshold > 0").select("branch", "uncategorized_threshold")
    top = top_domains_per_branch(
        domain_minutes, since, now, rules, candidates, category=UNCATEGORIZED
    )
    over = top.join(broadcast_if_small(limits), "branch").where(F.col("request_count") >= F.col("uncategorized_threshold"))
    cooldown = now - dt.timedelta(days=UNCATEGORIZED_COOLDOWN_DAYS)
    fresh = not_flagged_since(over, anomalies, "uncategorized_domain", ["branch", "domain"], cooldown)
    text = F.format_string(
        "%s: %d requests in 24 h without a category, threshold %d", "domain", "request_count", "uncategorized_threshold"
    )
    params = {
        "domain": F.col("domain"),
        "requests": F.col("request_count"),
        "threshold": F.col("uncategorized_threshold"),
    }
    return as_anomalies(fresh.withColumn("generated_at", ntz(now)), "uncategorized_domain", "low", text, params)
