"""Time spent per client and domain, from gaps between requests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficloom.fixed_values import SESSION_GAP_MINUTES
from trafficloom.functions.timeparts import epoch_micros
from trafficloom.operators.categorize import CategoryRules, categorize
from trafficloom.operators.filters import in_branch, in_time_range


def time_spent(
    events: DataFrame,
    since: dt.datetime,
    until: dt.datetime,
    client_ip: str | None = None,
    branch: str | None = None,
    gap_minutes: int = SESSION_GAP_MINUTES,
) -> DataFrame:
    """Whole seconds and session count per (client, domain).

    A session ends where the gap to the next request is longer than
    ``gap_minutes``. Time is cut into slots as long as the gap: requests inside
    one slot always belong together, so a slot is fully described by its first
    and last request. The map-side combined minimum and maximum per slot
    therefore replaces sorting the requests, and the window below sees at most
    one row per slot however often a client called a domain.
    """
    gap = max(gap_minutes * 60_000_000, 1)
    rows = in_branch(in_time_range(events, since, until), branch).where(F.col("domain").isNotNull())
    if client_ip is not None:
        rows = rows.where(F.col("client_ip") == client_ip)
    micros = rows.select("client_ip", "domain", epoch_micros(F.col("timestamp")).alias("at"))
    slots = micros.groupBy("client_ip", "domain", F.floor(F.col("at") / gap).alias("slot")).agg(
        F.min("at").alias("first"), F.max("at").alias("last")
    )
    order = Window.partitionBy("client_ip", "domain").orderBy("slot")
    pause = F.col("first") - F.lag("last").over(order)
    return (
        slots.withColumn("pause", pause)
        .groupBy("client_ip", "domain")
        .agg(
            F.sum(
                F.col("last") - F.col("first") + F.when(F.col("pause") <= gap, F.col("pause")).otherwise(F.lit(0))
            ).alias("micros"),
            F.count_if(F.col("pause").isNull() | (F.col("pause") > gap)).alias("session_count"),
        )
        .select(
            "client_ip", "domain", F.expr("micros div 1000000").alias("total_seconds"), "session_count"
        )
    )


def time_spent_by_category(spent: DataFrame, rules: CategoryRules) -> DataFrame:
    """Domain times of ``time_spent`` added up per (client, category)."""
    return (
        categorize(spent, rules, spread_by=["client_ip"])
        .groupBy("client_ip", "category")
        .agg(F.sum("total_seconds").alias("total_seconds"), F.sum("session_count").alias("session_count"))
    )


def longest_first(spent: DataFrame) -> DataFrame:
    name = "domain" if "domain" in spent.columns else "category"
    return spent.orderBy(F.col("total_seconds").desc(), "client_ip", name)
