"""Anomaly detectors over one window of events and its history.

A window is the set of events of one flush. History never includes the window:
only rows before the window's start count as known.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficloom import schema
from trafficloom.fixed_values import (
    BLOCKED_MIN_REQUESTS,
    BLOCKED_RATIO,
    DEFAULT_BRANCH,
    MAX_WINDOW_SPREAD_SECONDS,
    SEVERITIES,
    SPIKE_BASELINE_MINUTES,
    SPIKE_MIN_MINUTES,
    SPIKE_MULTIPLIER,
    TITLES,
)
from trafficloom.functions.skew import BROADCAST_ROWS, broadcast_if_small, has_at_most
from trafficloom.functions.timeparts import shift
from trafficloom.operators.categorize import CategoryRules, categorize
from trafficloom.operators.filters import in_branch, page


# Carried minutes answer for windows that begin up to this long before the newest minute, less one minute.
CARRIED_SECONDS = MAX_WINDOW_SPREAD_SECONDS + 120


def as_anomalies(
    rows: DataFrame, kind: str, severity: str | Column, description: Column, params: dict[str, Column]
) -> DataFrame:
    """Rows in the common anomaly schema. Needs ``generated_at`` and ``branch``."""

    def optional(name: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(None).cast("string")

    pairs = [c for name, value in params.items() for c in (F.lit(name), value.cast("string"))]
    return rows.select(
        "generated_at",
        F.lit(kind).alias("kind"),
        F.lit(TITLES[kind]).alias("title"),
        description.alias("description"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        optional("client_ip").alias("client_ip"),
        optional("domain").alias("domain"),
        F.coalesce(F.col("branch"), F.lit(DEFAULT_BRANCH)).alias("branch"),
        F.create_map(*pairs).alias("params"),
    )


def window_bounds(window: DataFrame) -> DataFrame:
    """Per branch: newest time, start (at most one hour before it) and request count."""
    return (
        window.groupBy("branch")
        .agg(
            F.min("timestamp").alias("oldest"),
            F.max("timestamp").alias("generated_at"),
            F.count(F.lit(1)).alias("current"),
        )
        .select(
            "branch",
            "generated_at",
            F.greatest("oldest", shift(F.col("generated_at"), -MAX_WINDOW_SPREAD_SECONDS)).alias("window_start"),
            "current",
        )
    )


def carried_minutes(minutes: DataFrame) -> DataFrame:
    """What of (branch, bucket_ts, total_requests) rows later windows may need: per branch the
    minutes near its newest one, where windows may begin, and the last complete ones before those."""
    newest = Window.partitionBy("branch")
    latest = Window.partitionBy("branch").orderBy(F.col("near").asc(), F.col("bucket_ts").desc())
    sums = minutes.groupBy("branch", "bucket_ts").agg(F.sum("total_requests").alias("total_requests"))
    near = F.col("bucket_ts") >= shift(F.max("bucket_ts").over(newest), -CARRIED_SECONDS)
    aged = sums.withColumn("near", near).withColumn("age", F.row_number().over(latest))
    return aged.where(F.col("near") | (F.col("age") <= SPIKE_BASELINE_MINUTES)).drop("near", "age")


def outside_carried(window: DataFrame, minutes: DataFrame) -> DataFrame:
    """Branches whose window begins before what ``carried_minutes`` answers for."""
    newest = minutes.groupBy("branch").agg(F.max("bucket_ts").alias("newest"))
    late = F.col("window_start") < shift(F.col("newest"), 60 - CARRIED_SECONDS)
    return window_bounds(window).join(newest, "branch").where(late).select("branch")


def traffic_spike(window: DataFrame, minutes: DataFrame) -> DataFrame:
    """Window count above three times the mean of the last complete minutes before it."""
    bounds = window_bounds(window)
    newest = Window.partitionBy("branch").orderBy(F.col("bucket_ts").desc())
    baseline = (
        minutes.join(bounds, "branch")
        .where(shift(F.col("bucket_ts"), 60) <= F.col("window_start"))
        .withColumn("age", F.row_number().over(newest))
        .where(F.col("age") <= SPIKE_BASELINE_MINUTES)
        .groupBy("branch")
        .agg(
            F.sum("total_requests").alias("requests"),
            F.count(F.lit(1)).alias("windows"),
            F.first("current").alias("current"),
            F.first("generated_at").alias("generated_at"),
        )
        .withColumn("baseline", F.col("requests") / F.col("windows"))
        .where(
            (F.col("windows") >= SPIKE_MIN_MINUTES)
            & (F.col("baseline") > 0)
            & (F.col("current") > F.col("baseline") * SPIKE_MULTIPLIER)
        )
        .withColumn("rounded", F.bround("baseline").cast("long"))
    )
    text = F.format_string("%d requests, about %d per minute before", "current", "rounded")
    params = {"current": F.col("current"), "baseline": F.col("rounded"), "windows": F.col("windows")}
    return as_anomalies(baseline, "traffic_spike", "high", text, params)


def first_seen(history: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Earliest time per key: a map-side combined minimum, unique keys on output."""
    return history.groupBy(*keys).agg(F.min(time).alias("first_seen"))


def unseen(candidates: DataFrame, history: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Candidates (unique keys, with ``window_start``) that history does not hold before the window.

    A window has few candidates: when that is proven, they are broadcast to the
    history scan, so that history is read narrowly and not shuffled.
    """
    if has_at_most(candidates, BROADCAST_ROWS):
        history = history.join(F.broadcast(candidates.select(*keys)), keys, "left_semi")
    known = first_seen(history, keys, time).select(*[F.col(k).alias(f"__{k}") for k in keys], "first_seen")
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    return candidates.join(known, [*same, F.col("first_seen") < F.col("window_start")], "left_anti")


# Rows, or a way to get those that may concern some candidates.
History = DataFrame | Callable[[DataFrame], DataFrame]


# Candidates of a window up to this many are worked out once and kept as plain rows.
SETTLED_ROWS = 10_000


def _settled(candidates: DataFrame) -> DataFrame:
    """The same rows, as a local relation when there are few: several later steps look at them."""
    rows = candidates.limit(SETTLED_ROWS + 1).toArrow()
    return candidates if rows.num_rows > SETTLED_ROWS else candidates.sparkSession.createDataFrame(rows, candidates.schema)


def _about(history: History, candidates: DataFrame) -> DataFrame:
    rows = history if isinstance(history, DataFrame) else history(candidates)
    return rows.where(F.col("domain").isNotNull())


def new_blocked_domains(window: DataFrame, history: History, time: str = "timestamp") -> DataFrame:
    """Domains blocked in the window that the branch never visited before, blocked or not.

    ``history`` has ``branch``, ``domain`` and a time column (events, domain minutes or first visits).
    """
    blocked = window.where(F.col("blocked") & F.col("domain").isNotNull() & (F.col("domain") != ""))
    candidates = _settled(blocked.select("branch", "domain").distinct().join(window_bounds(window), "branch"))
    fresh = unseen(candidates, _about(history, candidates), ["branch", "domain"], time)
    text = F.format_string("%s was blocked and had not been visited before", "domain")
    return as_anomalies(fresh, "new_blocked_domain", "medium", text, {"domain": F.col("domain")})


def client_blocked_ratio(window: DataFrame, period: str | None = None) -> DataFrame:
    """Clients with enough requests of which at least half were blocked.

    ``period`` names a column that cuts ``window`` into several windows, so a
    long history can be checked in one pass.
    """
    cut = ["branch"] if period is None else ["branch", period]
    per_client = window.groupBy(*cut, "client_ip").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("blocked").alias("blocked"), F.max("timestamp").alias("newest")
    )
    bounds = per_client.groupBy(*cut).agg(F.max("newest").alias("generated_at"))
    flagged = (
        per_client.where(F.col("total") >= BLOCKED_MIN_REQUESTS)
        .withColumn("ratio", F.col("blocked") / F.col("total"))
        .where(F.col("ratio") >= BLOCKED_RATIO)
        .join(bounds, cut)
        .withColumn("percent", F.bround(F.col("ratio") * 100).cast("long"))
    )
    text = F.format_string("%s: %d of %d requests blocked (%d%%)", "client_ip", "blocked", "total", "percent")
    params = {
        "clientIp": F.col("client_ip"),
        "blocked": F.col("blocked"),
        "total": F.col("total"),
        "ratio": F.col("percent"),
    }
    return as_anomalies(flagged, "client_blocked_ratio", "high", text, params)


def sensitive_visits(
    window: DataFrame, history: History, settings: DataFrame, rules: CategoryRules, time: str = "timestamp"
) -> DataFrame:
    """First visit of a client to a domain in one of its branch's sensitive categories."""
    pairs = window.where(F.col("domain").isNotNull() & (F.col("domain") != "")).select("branch", "client_ip", "domain").distinct()
    sensitive = settings.where(F.size("sensitive_categories") > 0).select("branch", "sensitive_categories")
    candidates = _settled(
        categorize(pairs.join(broadcast_if_small(sensitive), "branch"), rules, spread_by=["branch", "client_ip"])
        .where(F.array_contains("sensitive_categories", F.col("category")))
        .join(window_bounds(window), "branch")
    )
    keys = ["branch", "client_ip", "domain"]
    fresh = unseen(candidates, _about(history, candidates), keys, time)
    text = F.format_string("%s opened %s (%s) and had not done so before", "client_ip", "domain", "category")
    params = {"clientIp": F.col("client_ip"), "domain": F.col("domain"), "category": F.col("category")}
    return as_anomalies(fresh, "sensitive_category_visit", "medium", text, params)


@dataclass(frozen=True)
class DetectionInput:
    """What a detector set may look at. History frames exclude the current batch.

    ``minutes`` holds at least the minutes that may count for the window.
    ``domain_history`` has the first visits of branches to domains,
    ``visit_history`` those of clients.
    """

    window: DataFrame
    minutes: DataFrame
    domain_history: History
    visit_history: History
    settings: DataFrame
    rules: CategoryRules


def detect_none(data: DetectionInput) -> DataFrame:
    return data.window.sparkSession.createDataFrame([], schema.ANOMALY)


def detect_statistical(data: DetectionInput) -> DataFrame:
    found = [
        traffic_spike(data.window, data.minutes),
        new_blocked_domains(data.window, data.domain_history, "first_seen"),
        client_blocked_ratio(data.window),
        sensitive_visits(data.window, data.visit_history, data.settings, data.rules, "first_seen"),
    ]
    merged = found[0]
    for rows in found[1:]:
        merged = merged.unionByName(rows)
    return merged


DETECTORS: dict[str, Callable[[DetectionInput], DataFrame]] = {
    "noop": detect_none,
    "statistical": detect_statistical,
}


def detector(name: str = "noop") -> Callable[[DetectionInput], DataFrame]:
    if name not in DETECTORS:
        raise ValueError(f"unknown detector {name!r}, expected one of {', '.join(DETECTORS)}")
    return DETECTORS[name]


def severity_rank(severity: Column) -> Column:
    """Position in the severity scale, from 0."""
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity) - 1


def select_alerts(anomalies: DataFrame, minimum: str = "high") -> DataFrame:
    """Anomalies severe enough to alert on."""
    return anomalies.where(severity_rank(F.col("severity")) >= SEVERITIES.index(minimum))


def recent_anomalies(anomalies: DataFrame, limit: int = 50, offset: int = 0, branch: str | None = None) -> DataFrame:
    """A page of anomalies, newest first."""
    ties = ["branch", "title", "client_ip", "domain"]
    return page(in_branch(anomalies, branch).orderBy(F.col("generated_at").desc(), *ties), limit, offset)
