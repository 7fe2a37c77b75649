"""Periodic traffic reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficloom.fixed_values import REPORT_ANOMALIES, REPORT_TOP_DOMAINS
from trafficloom.operators.anomalies import recent_anomalies
from trafficloom.operators.categorize import CategoryRules
from trafficloom.operators.clients import client_bucket_rows
from trafficloom.operators.domains import BY_BLOCKS, top_domains, top_domains_per_branch, usage_by_category
from trafficloom.operators.traffic import summary

SCHEDULES = {"daily": dt.timedelta(days=1), "weekly": dt.timedelta(days=7)}


def report_window(schedule: str, now: dt.datetime, last_sent: dt.datetime | None = None) -> tuple[dt.datetime, dt.datetime] | None:
    """(since, until) of a due report: from the last one, or one interval back. None when not due."""
    if schedule not in SCHEDULES:
        return None
    interval = SCHEDULES[schedule]
    if last_sent is not None and now - last_sent < interval:
        return None
    return (last_sent or now - interval, now)


def period_report(
    minutes: DataFrame,
    domain_minutes: DataFrame,
    client_minutes: DataFrame,
    client_hours: DataFrame | None,
    anomalies: DataFrame,
    rules: CategoryRules,
    since: dt.datetime,
    until: dt.datetime,
    branch: str | None = None,
) -> dict[str, DataFrame]:
    clients = client_bucket_rows(client_minutes, client_hours, since, until, branch=branch)
    return {
        "summary": summary(minutes, clients, since, until, branch),
        "top_domains": top_domains(domain_minutes, since, until, rules, limit=REPORT_TOP_DOMAINS, branch=branch),
        "top_blocked": top_domains(
            domain_minutes, since, until, rules, BY_BLOCKS, REPORT_TOP_DOMAINS, branch=branch
        ),
        "by_category": usage_by_category(domain_minutes, since, until, rules, branch),
        "anomalies": recent_anomalies(anomalies, REPORT_ANOMALIES, branch=branch),
    }


def branch_reports(
    minutes: DataFrame,
    domain_minutes: DataFrame,
    client_minutes: DataFrame,
    client_hours: DataFrame | None,
    anomalies: DataFrame,
    rules: CategoryRules,
    since: dt.datetime,
    until: dt.datetime,
) -> dict[str, DataFrame]:
    """The same five sections for every branch at once, each in one pass over its table."""
    clients = client_bucket_rows(client_minutes, client_hours, since, until)
    newest = Window.partitionBy("branch").orderBy(F.col("generated_at").desc(), "title", "client_ip", "domain")
    return {
        "summary": summary(minutes, clients, since, until, by=("branch",)),
        "top_domains": top_domains_per_branch(domain_minutes, since, until, rules, REPORT_TOP_DOMAINS),
        "top_blocked": top_domains_per_branch(
            domain_minutes, since, until, rules, REPORT_TOP_DOMAINS, BY_BLOCKS
        ),
        "by_category": usage_by_category(domain_minutes, since, until, rules, by=("branch",)),
        "anomalies": anomalies.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= REPORT_ANOMALIES),
    }
