"""Domain rankings, category usage and the single-domain drill-down."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficloom.functions.text import contains_ci, is_blank
from trafficloom.operators.categorize import CategoryRules, categorize
from trafficloom.operators.filters import buckets_in_range, in_branch, in_time_range, ordered, page, total_of

MEASURES = ("request_count", "blocked_count", "total_bytes")


@dataclass(frozen=True)
class Ranking:
    """What domains are ranked by, and which of them take part."""

    measure: str
    having: str | None = None

    def of(self, totals: DataFrame) -> DataFrame:
        return totals if self.having is None else totals.where(self.having)

    @property
    def order(self) -> tuple[Column, ...]:
        return F.col(self.measure).desc(), F.col("domain").asc()


BY_REQUESTS = Ranking("request_count")
BY_BLOCKS = Ranking("blocked_count", having="blocked_count > 0")
BY_BYTES = Ranking("total_bytes")
CLIENT_SORTABLE = ("client_ip", "visit_count", "blocked_count", "total_bytes", "last_visit")


def domain_totals(domain_minutes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return domain_minutes.groupBy(*by, "domain").agg(*[F.sum(m).alias(m) for m in MEASURES])


def top_domains(
    domain_minutes: DataFrame,
    since: dt.datetime,
    until: dt.datetime,
    rules: CategoryRules,
    ranking: Ranking = BY_REQUESTS,
    limit: int = 10,
    search: str | None = None,
    branch: str | None = None,
    category: str | None = None,
) -> DataFrame:
    """The first ``limit`` domains of a ranking, with category.

    Without a category filter only the winners are labelled; with one, labels
    go onto the per-domain sums, so no set of domains is collected.
    """
    rows = buckets_in_range(domain_minutes, since, until, branch)
    if not is_blank(search):
        rows = rows.where(contains_ci(F.col("domain"), search))
    totals = ranking.of(domain_totals(rows))
    if category is not None:
        labelled = categorize(totals, rules).where(F.col("category") == category)
        return labelled.orderBy(*ranking.order).limit(limit)
    return categorize(totals.orderBy(*ranking.order).limit(limit), rules).orderBy(*ranking.order)


def top_domains_per_branch(
    domain_minutes: DataFrame,
    since: dt.datetime,
    until: dt.datetime,
    rules: CategoryRules,
    limit: int | None,
    ranking: Ranking = BY_REQUESTS,
    category: str | None = None,
) -> DataFrame:
    """Top-k of every branch in one pass; the rank filter prunes before the shuffle. Without a limit, all."""
    totals = ranking.of(domain_totals(buckets_in_range(domain_minutes, since, until), by=("branch",)))
    if category is not None:
        totals = categorize(totals, rules, spread_by=["branch"]).where(F.col("category") == category)
    if limit is None:
        return totals if category is not None else categorize(totals, rules, spread_by=["branch"])
    order = Window.partitionBy("branch").orderBy(*ranking.order)
    top = totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return top if category is not None else categorize(top, rules, spread_by=["branch"])


def usage_by_category(
    domain_minutes: DataFrame,
    since: dt.datetime,
    until: dt.datetime,
    rules: CategoryRules,
    branch: str | None = None,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Requests, blocks and bytes per category, most bytes first."""
    totals = domain_totals(buckets_in_range(domain_minutes, since, until, branch), by)
    labelled = categorize(totals, rules, spread_by=list(by) or None)
    return (
        labelled.groupBy(*by, "category")
        .agg(*[F.sum(m).alias(m) for m in MEASURES])
        .orderBy(*by, F.col("total_bytes").desc(), F.col("category").asc())
    )


def domain_summary(
    events: DataFrame,
    since: dt.datetime,
    until: dt.datetime,
    rules: CategoryRules,
    domain: str | None = None,
    branch: str | None = None,
) -> DataFrame:
    """Totals, distinct clients and category of one domain, or of every domain.

    Events first collapse to (domain, client), which splits a hot domain over
    its clients; the second aggregate counts those rows.
    """
    rows = in_branch(in_time_range(events, since, until), branch)
    rows = rows.where(F.col("domain").isNotNull()) if domain is None else rows.where(F.col("domain") == domain)
    per_client = rows.groupBy("domain", "client_ip").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("blocked").alias("blocked"), F.sum("bytes").alias("bytes")
    )
    measures = [
        F.coalesce(F.sum("requests"), F.lit(0).cast("long")).alias("total_requests"),
        F.coalesce(F.sum("blocked"), F.lit(0).cast("long")).alias("blocked_requests"),
        F.coalesce(F.sum("bytes"), F.lit(0).cast("long")).alias("total_bytes"),
        F.count(F.lit(1)).alias("distinct_client_count"),
    ]
    if domain is None:
        totals = per_client.groupBy("domain").agg(*measures)
    else:
        # A global aggregate: a domain without traffic still gives its row of zeros.
        totals = per_client.agg(*measures).select(F.lit(domain).alias("domain"), "*")
    return categorize(totals, rules)


def domain_clients(
    events: DataFrame,
    since: dt.datetime,
    until: dt.datetime,
    domain: str | None = None,
    branch: str | None = None,
) -> DataFrame:
    """Visits per (domain, client), with the alphabetically last user name.

    Summed per user first, so the text maximum (a sort aggregate) sees few rows.
    """
    rows = in_branch(in_time_range(events, since, until), branch)
    rows = rows.where(F.col("domain").isNotNull()) if domain is None else rows.where(F.col("domain") == domain)
    per_user = rows.groupBy("domain", "client_ip", "user").agg(
        F.count(F.lit(1)).alias("visit_count"),
        F.count_if("blocked").alias("blocked_count"),
        F.sum("bytes").alias("total_bytes"),
        F.max("timestamp").alias("last_visit"),
    )
    return per_user.groupBy("domain", "client_ip").agg(
        F.max("user").alias("user"),
        F.sum("visit_count").alias("visit_count"),
        F.sum("blocked_count").alias("blocked_count"),
        F.sum("total_bytes").alias("total_bytes"),
        F.max("last_visit").alias("last_visit"),
    )


def list_domain_clients(
    clients: DataFrame, sort_by: str = "visit_count", descending: bool = True, limit: int = 50, offset: int = 0
) -> DataFrame:
    """A page of ``domain_clients``."""
    return page(ordered(clients, sort_by, CLIENT_SORTABLE, "visit_count", descending, ["domain", "client_ip"]), limit, offset)


def count_domain_clients(clients: DataFrame) -> DataFrame:
    return total_of(clients)


def domain_traffic(events: DataFrame, since: dt.datetime, branch: str | None = None) -> DataFrame:
    """Requests per domain since a time, most first; scans three columns."""
    rows = in_branch(events, branch).where(F.col("domain").isNotNull() & (F.col("timestamp") >= F.lit(since).cast("timestamp_ntz")))
    if "event_date" in events.columns:
        rows = rows.where(F.col("event_date") >= F.lit(since.date()))
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.col("cnt").desc(), "domain")
