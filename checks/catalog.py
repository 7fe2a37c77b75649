"""Every registered query with the SQL that gives the same result."""

from __future__ import annotations

import dataclasses
import datetime as dt
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import EARLY, EARLY_END, LAST_HOUR, NOON, SINCE, UNTIL, Data, with_sql
from trafficloom import fixed_values as fv
from trafficloom.functions.timeparts import TimeRange, ntz, resolve_range
from trafficloom.operators import (
    anomalies,
    categorize,
    clients,
    domains,
    events,
    filters,
    markers,
    monitors,
    parse,
    rollup,
    sessions,
    traffic,
)
from trafficloom.plans import archive, branches, export, report, retention
from trafficloom.plans.files import delete, read_or_empty
from trafficloom.plans.store import LogStore
from trafficloom.schema import CLIENT_DOMAIN_SEEN, CLIENT_HOURLY, CLIENT_MINUTE, DOMAIN_MINUTE, MINUTE_TOTALS
from trafficloom.session import scratch_dir
from trafficloom.sources import dimensions
from trafficloom.sources.access_log import read_lines, stream_lines
from trafficloom.streaming import feed, progress
from trafficloom.streaming.ingest import Ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Build = Callable[[Data], DataFrame]


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        QUERIES[name] = lambda spark, sf_dir: build(Data(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


DAY = "BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-02'"
DETAIL_SQL = (
    'id, "timestamp", client_ip, branch, "user", method, url, domain, action, status_code, bytes, blocked, '
    "duration_ms, hierarchy, peer, content_type"
)
EXPORT_SQL = 'id, "timestamp", client_ip, branch, "user", method, url, domain, action, status_code, bytes, blocked'
# Expected parse results: times lose their sub-millisecond part, URL hosts are lower-cased.
PARSED_SQL = """date_trunc('millisecond', "timestamp") AS "timestamp", duration_ms, client_ip, branch, action, status_code,
  bytes, method, url, CASE WHEN method = 'CONNECT' THEN domain ELSE lower(domain) END AS domain, "user",
  hierarchy, peer, content_type, blocked"""


# ----- parsing -------------------------------------------------------------


@query("parse_events", with_sql(f"SELECT {PARSED_SQL} FROM access_events"))
def _(d: Data) -> DataFrame:
    good, _rejects = parse.parse_access_log(d.lines())
    return good.drop("id")


@query(
    "parse_rejects",
    with_sql(
        f"""SELECT branch, CASE id % {len(fx.DAMAGE)} WHEN 0 THEN 'field_count' WHEN 1 THEN 'timestamp' WHEN 2 THEN 'client_ip'
            WHEN 3 THEN 'field_count' ELSE 'client_ip' END AS reject_reason, value AS line
        FROM damaged WHERE id % {len(fx.DAMAGE)} IN (0, 1, 2, 3, 7)""",
        fx.damaged_lines_sql(),
    ),
)
def _(d: Data) -> DataFrame:
    _good, rejects = parse.parse_access_log(d.lines(damaged=True))
    return rejects


@query(
    "parse_address_forms",
    with_sql(
        f"""SELECT branch, CASE id % {len(fx.DAMAGE)} WHEN 5 THEN '2001:db8::' || CAST(id % 9999 AS VARCHAR)
            WHEN 6 THEN '::ffff:' || client_ip ELSE client_ip END AS client_ip, count(*) AS n,
            CAST(sum(bytes) AS BIGINT) AS total_bytes, CAST(sum(duration_ms) AS BIGINT) AS total_ms
        FROM access_events WHERE id % {len(fx.DAMAGE)} IN (5, 6, 8, 9, 10) GROUP BY 1, 2"""
    ),
)
def _(d: Data) -> DataFrame:
    good, _rejects = parse.parse_access_log(d.lines(damaged=True))
    return good.groupBy("branch", "client_ip").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("total_bytes"), F.sum("duration_ms").alias("total_ms")
    )


@query(
    "parse_quality",
    with_sql(
        f"""SELECT *, round(1 - lines_parsed / lines_seen, 3) AS failure_rate,
            round(1 - lines_parsed / lines_seen, 3) >= 0.5 AS alarm FROM (
          SELECT branch, count(*) AS lines_seen, count(*) FILTER (id % {len(fx.DAMAGE)} IN (5, 6, 8, 9, 10)) AS lines_parsed
          FROM access_events WHERE id % {len(fx.DAMAGE)} <> 4 GROUP BY branch) q"""
    ),
)
def _(d: Data) -> DataFrame:
    return parse.parse_quality(d.lines(damaged=True))


@query("page_hosts", f"WITH {fx.HOST_SQL} SELECT page_id, domain FROM page_hosts")
def _(d: Data) -> DataFrame:
    return d.page_hosts.select("page_id", "domain")


# ----- roll-ups ------------------------------------------------------------


@query("minute_totals", with_sql("SELECT * FROM minute_totals"))
def _(d: Data) -> DataFrame:
    return d.minutes


@query("domain_minute", with_sql("SELECT * FROM domain_minute"))
def _(d: Data) -> DataFrame:
    return d.domain_minutes


@query("client_minute", with_sql("SELECT * FROM client_minute"))
def _(d: Data) -> DataFrame:
    return d.client_minutes


@query(
    "client_category_minute",
    with_sql(
        """SELECT date_trunc('minute', "timestamp") AS bucket_ts, client_ip, category, branch,
          count(*) AS request_count, CAST(sum(bytes) AS BIGINT) AS total_bytes
        FROM access_events JOIN categories USING (domain) GROUP BY 1, 2, 3, 4""",
        fx.CATEGORIES_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    return rollup.client_category_minute(d.events, d.rules)


def _grain_sql(name: str, source: str, **columns: str) -> str:
    """Rows of one roll-up in the columns that all of them share; sums that it does not have are 0."""
    texts = ("branch", "client_ip", "user", "domain", "category")
    sums = ("total_requests", "blocked_requests", "allowed_requests", "hit_requests", "miss_requests", "request_count", "blocked_count", "total_bytes")
    every = ("bucket_ts", *texts, *sums, "first_seen")
    kinds = dict.fromkeys(texts, "VARCHAR") | dict.fromkeys(sums, "BIGINT") | dict.fromkeys(("bucket_ts", "first_seen"), "TIMESTAMP")
    parts = [
        f'{columns[c]} AS "{c}"' if c in columns else f'CAST({0 if c in sums else "NULL"} AS {kinds[c]}) AS "{c}"' for c in every
    ]
    return f"SELECT '{name}' AS grain, {', '.join(parts)} FROM {source}"


def _same(*names: str) -> dict[str, str]:
    return {n: f'"{n}"' for n in names}


ROLLUP_TABLES_SQL = " UNION ALL ".join(
    [
        _grain_sql("minute_totals", "minute_totals", **_same("bucket_ts", "branch", "total_requests", "blocked_requests",
                   "allowed_requests", "hit_requests", "miss_requests", "total_bytes")),
        _grain_sql("domain_minute", "domain_minute", **_same("bucket_ts", "branch", "domain", "request_count", "blocked_count", "total_bytes")),
        _grain_sql("client_minute", "client_minute", **_same("bucket_ts", "branch", "client_ip", "user", "request_count", "blocked_count", "total_bytes")),
        _grain_sql("client_category_minute", """(SELECT date_trunc('minute', "timestamp") AS bucket_ts, client_ip, category, branch,
              count(*) AS request_count, CAST(sum(bytes) AS BIGINT) AS total_bytes
            FROM access_events JOIN categories USING (domain) GROUP BY 1, 2, 3, 4)""",
                   **_same("bucket_ts", "branch", "client_ip", "category", "request_count", "total_bytes")),
        _grain_sql("client_domain_seen", """(SELECT branch, client_ip, domain, min("timestamp") AS first_seen FROM access_events
            WHERE domain IS NOT NULL GROUP BY 1, 2, 3)""", **_same("branch", "client_ip", "domain", "first_seen")),
        _grain_sql("domain_seen", """(SELECT branch, domain, min("timestamp") AS first_seen FROM access_events
            WHERE domain IS NOT NULL GROUP BY 1, 2)""", **_same("branch", "domain", "first_seen")),
    ]
)


@query("rollup_tables", with_sql(ROLLUP_TABLES_SQL, fx.CATEGORIES_SQL))
def _(d: Data) -> DataFrame:
    """Every stored roll-up from one scan of the events."""
    return rollup.all_rollups(d.events, d.rules).drop("bucket").na.fill(0)


HOURLY_SQL = """client_hours AS (
  SELECT date_trunc('hour', bucket_ts) AS bucket_ts, client_ip, branch, "user",
    CAST(sum(request_count) AS BIGINT) AS request_count, CAST(sum(blocked_count) AS BIGINT) AS blocked_count,
    CAST(sum(total_bytes) AS BIGINT) AS total_bytes FROM client_minute GROUP BY 1, 2, 3, 4)"""


@query("hourly_rollup", with_sql("SELECT * FROM client_hours", HOURLY_SQL))
def _(d: Data) -> DataFrame:
    return rollup.client_hourly(d.client_minutes)


@query(
    "cache_class",
    with_sql(
        """SELECT action, CASE WHEN action LIKE '%HIT%' THEN 'hit' WHEN action LIKE '%MISS%' THEN 'miss' END AS cache,
          count(*) AS n FROM access_events GROUP BY 1, 2"""
    ),
)
def _(d: Data) -> DataFrame:
    return d.events.groupBy("action", rollup.cache_class(F.col("action")).alias("cache")).agg(F.count(F.lit(1)).alias("n"))


# ----- totals --------------------------------------------------------------

TWO_GRAINS_SQL = f"""client_rows AS (
  SELECT client_ip, "user", branch, request_count, blocked_count, total_bytes, bucket_ts FROM client_minute
    WHERE bucket_ts >= TIMESTAMP '2024-01-01 12:00:00'
  UNION ALL
  SELECT client_ip, "user", branch, CAST(sum(request_count) AS BIGINT), CAST(sum(blocked_count) AS BIGINT),
    CAST(sum(total_bytes) AS BIGINT), date_trunc('hour', bucket_ts) FROM client_minute
    WHERE bucket_ts < TIMESTAMP '2024-01-01 12:00:00' GROUP BY 1, 2, 3, 7)"""


@query(
    "summary",
    with_sql(
        """SELECT CAST(sum(total_requests) AS BIGINT) AS total_requests, CAST(sum(blocked_requests) AS BIGINT) AS blocked_requests,
          CAST(sum(allowed_requests) AS BIGINT) AS allowed_requests,
          (SELECT count(DISTINCT client_ip) FROM access_events) AS active_client_count,
          (SELECT count(DISTINCT "user") FROM access_events) AS active_user_count FROM minute_totals"""
    ),
)
def _(d: Data) -> DataFrame:
    recent, old = d.two_grains()
    return traffic.summary(d.minutes, clients.client_bucket_rows(recent, old, SINCE, UNTIL), SINCE, UNTIL)


@query(
    "active_clients",
    with_sql(
        """SELECT branch, count(DISTINCT client_ip) AS active_client_count, count(DISTINCT "user") AS active_user_count
        FROM client_minute GROUP BY branch"""
    ),
)
def _(d: Data) -> DataFrame:
    return traffic.active_counts(clients.client_bucket_rows(d.client_minutes, None, SINCE, UNTIL), ("branch",))


@query(
    "cache_efficiency",
    with_sql(
        """SELECT hit_requests, miss_requests, hit_requests / nullif(hit_requests + miss_requests, 0) AS hit_ratio FROM (
          SELECT CAST(sum(hit_requests) AS BIGINT) AS hit_requests, CAST(sum(miss_requests) AS BIGINT) AS miss_requests
          FROM minute_totals) t"""
    ),
)
def _(d: Data) -> DataFrame:
    return traffic.cache_efficiency(d.minutes, SINCE, UNTIL)


def _series_sql(unit: str) -> str:
    return with_sql(
        f"""SELECT date_trunc('{unit}', bucket_ts) AS bucket_ts, CAST(sum(total_requests) AS BIGINT) AS total_requests,
          CAST(sum(blocked_requests) AS BIGINT) AS blocked_requests, CAST(sum(allowed_requests) AS BIGINT) AS allowed_requests
        FROM minute_totals WHERE bucket_ts {DAY} GROUP BY 1"""
    )


@query("timeseries_minute", _series_sql("minute"))
def _(d: Data) -> DataFrame:
    return traffic.timeseries(d.minutes, SINCE, UNTIL)


@query("timeseries_hour", _series_sql("hour"))
def _(d: Data) -> DataFrame:
    return traffic.timeseries(d.minutes, SINCE, UNTIL, "hour")


COUNTS = ("total_requests", "blocked_requests", "allowed_requests")
_NOW_SUMS = ", ".join(f"CAST(coalesce(sum({c}) FILTER (bucket_ts BETWEEN TIMESTAMP '2024-01-01 12:00:00' AND TIMESTAMP '2024-01-02'), 0) AS BIGINT) AS current_{c}" for c in COUNTS)
_THEN_SUMS = ", ".join(f"CAST(coalesce(sum({c}) FILTER (bucket_ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-01 12:00:00'), 0) AS BIGINT) AS previous_{c}" for c in COUNTS)
_CHANGES = ", ".join(f"(current_{c} - previous_{c}) / CAST(nullif(previous_{c}, 0) AS DOUBLE) * 100 AS change_{c}" for c in COUNTS)


@query("period_comparison", with_sql(f"SELECT *, {_CHANGES} FROM (SELECT {_NOW_SUMS}, {_THEN_SUMS} FROM minute_totals) t"))
def _(d: Data) -> DataFrame:
    return traffic.period_comparison(d.minutes, TimeRange(NOON, UNTIL))


# ----- domains -------------------------------------------------------------

DOMAIN_SUMS_SQL = """SELECT domain, CAST(sum(request_count) AS BIGINT) AS request_count,
  CAST(sum(blocked_count) AS BIGINT) AS blocked_count, CAST(sum(total_bytes) AS BIGINT) AS total_bytes FROM domain_minute"""


def _top_sql(order: str, limit: int, where: str = "", having: str = "", category: str = "") -> str:
    return with_sql(
        f"""SELECT t.*, category FROM ({DOMAIN_SUMS_SQL} {where} GROUP BY domain {having}) t JOIN categories USING (domain)
        {category} ORDER BY {order} DESC, domain LIMIT {limit}""",
        fx.CATEGORIES_SQL,
    )


@query("top_domains", _top_sql("request_count", 10))
def _(d: Data) -> DataFrame:
    return domains.top_domains(d.domain_minutes, SINCE, UNTIL, d.rules)


@query("top_blocked", _top_sql("blocked_count", 10, having="HAVING sum(blocked_count) > 0"))
def _(d: Data) -> DataFrame:
    return domains.top_domains(d.domain_minutes, SINCE, UNTIL, d.rules, domains.BY_BLOCKS)


@query("top_data_usage", _top_sql("total_bytes", 10))
def _(d: Data) -> DataFrame:
    return domains.top_domains(d.domain_minutes, SINCE, UNTIL, d.rules, domains.BY_BYTES)


@query("domain_search", _top_sql("request_count", 20, where="WHERE domain ILIKE '%ama_on%'"))
def _(d: Data) -> DataFrame:
    return domains.top_domains(d.domain_minutes, SINCE, UNTIL, d.rules, limit=20, search=" AMA_on ")


@query("top_domains_in_category", _top_sql("request_count", 10, category="WHERE category = 'gambling'"))
def _(d: Data) -> DataFrame:
    return domains.top_domains(d.domain_minutes, SINCE, UNTIL, d.rules, category="gambling")


@query(
    "top_domains_one_branch",
    with_sql(
        f"""SELECT t.*, category FROM ({DOMAIN_SUMS_SQL} WHERE branch = 'branch-b'
          AND bucket_ts BETWEEN TIMESTAMP '2024-01-01 06:30:30' AND TIMESTAMP '2024-01-01 18:00:00' GROUP BY domain) t
        JOIN categories USING (domain) ORDER BY request_count DESC, domain LIMIT 5""",
        fx.CATEGORIES_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    since, until = dt.datetime(2024, 1, 1, 6, 30, 30), dt.datetime(2024, 1, 1, 18)
    return domains.top_domains(d.domain_minutes, since, until, d.rules, limit=5, branch="branch-b")


@query(
    "usage_by_category",
    with_sql(
        """SELECT category, CAST(sum(request_count) AS BIGINT) AS request_count, CAST(sum(blocked_count) AS BIGINT) AS blocked_count,
          CAST(sum(total_bytes) AS BIGINT) AS total_bytes FROM domain_minute JOIN categories USING (domain) GROUP BY category""",
        fx.CATEGORIES_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    return domains.usage_by_category(d.domain_minutes, SINCE, UNTIL, d.rules)


@query(
    "domain_summary",
    with_sql(
        """SELECT domain, total_requests, blocked_requests, total_bytes, distinct_client_count, category FROM (
          SELECT domain, count(*) AS total_requests, count(*) FILTER (blocked) AS blocked_requests,
            CAST(sum(bytes) AS BIGINT) AS total_bytes, count(DISTINCT client_ip) AS distinct_client_count
          FROM access_events WHERE domain IS NOT NULL GROUP BY domain) t JOIN categories USING (domain)""",
        fx.CATEGORIES_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    return domains.domain_summary(d.events, SINCE, UNTIL, d.rules)


DOMAIN_CLIENTS_SQL = """domain_clients AS (
  SELECT domain, client_ip, max("user") AS "user", count(*) AS visit_count, count(*) FILTER (blocked) AS blocked_count,
    CAST(sum(bytes) AS BIGINT) AS total_bytes, max("timestamp") AS last_visit
  FROM access_events WHERE domain IS NOT NULL GROUP BY 1, 2)"""


@query("domain_clients", with_sql("SELECT * FROM domain_clients", DOMAIN_CLIENTS_SQL))
def _(d: Data) -> DataFrame:
    return domains.domain_clients(d.events, SINCE, UNTIL)


@query(
    "domain_clients_page",
    with_sql(
        "SELECT * FROM domain_clients ORDER BY total_bytes DESC, domain, client_ip LIMIT 25 OFFSET 25", DOMAIN_CLIENTS_SQL
    ),
)
def _(d: Data) -> DataFrame:
    rows = domains.domain_clients(d.events, SINCE, UNTIL)
    return domains.list_domain_clients(rows, "total_bytes", limit=25, offset=25)


@query("domain_clients_total", with_sql("SELECT count(*) AS total FROM domain_clients", DOMAIN_CLIENTS_SQL))
def _(d: Data) -> DataFrame:
    return domains.count_domain_clients(domains.domain_clients(d.events, SINCE, UNTIL))


@query("domain_traffic", with_sql("SELECT domain, count(*) AS cnt FROM access_events WHERE domain IS NOT NULL GROUP BY 1"))
def _(d: Data) -> DataFrame:
    return domains.domain_traffic(d.events, SINCE)


@query("distinct_domains", with_sql("SELECT DISTINCT domain FROM access_events WHERE domain IS NOT NULL"))
def _(d: Data) -> DataFrame:
    return events.distinct_domains(d.events, SINCE, UNTIL)


# ----- categories ----------------------------------------------------------


@query("domain_categories", with_sql("SELECT * FROM categories", fx.CATEGORIES_SQL))
def _(d: Data) -> DataFrame:
    return categorize.categorize(events.distinct_domains(d.events, SINCE, UNTIL), d.rules)


def _repeated_rules(d: Data) -> categorize.CategoryRules:
    """The rules with every host and override twice, one of them under a category late in the alphabet and in capitals."""
    hosts = [(h.upper(), "zzz") for h, _ in fv.STARTER_HOSTNAMES] + list(fv.STARTER_HOSTNAMES)
    overrides = d.overrides.unionByName(d.overrides.withColumn("category", F.lit("zzz")))
    return categorize.CategoryRules(hostnames=d.spark.createDataFrame(hosts, "hostname string, category string"), overrides=overrides)


@query("domain_categories_repeated_rules", with_sql("SELECT * FROM categories", fx.CATEGORIES_SQL))
def _(d: Data) -> DataFrame:
    """Rules listed more than once, hosts matched from memory: no domain twice."""
    return categorize.categorize(events.distinct_domains(d.events, SINCE, UNTIL), _repeated_rules(d))


@query("domain_categories_joined_hosts", with_sql("SELECT * FROM categories", fx.CATEGORIES_SQL))
def _(d: Data) -> DataFrame:
    """The same with the host list matched by joins, as lists beyond memory are."""
    rules = _repeated_rules(d)
    domains_ = events.distinct_domains(d.events, SINCE, UNTIL)
    return categorize.categorize(domains_, dataclasses.replace(rules, memory_hosts=0))


@query("domains_in_category", with_sql("SELECT domain FROM categories WHERE category = 'uncategorized'", fx.CATEGORIES_SQL))
def _(d: Data) -> DataFrame:
    return categorize.domains_in_category(d.events, d.rules, "uncategorized")


PAGE_CATEGORIES_SQL = fx.category_sql(
    "page_categories", "SELECT DISTINCT domain FROM page_hosts", fx.PAGE_OVERRIDES_SQL, fx.PAGE_BLOCKLIST_SQL
)


@query(
    "page_categories",
    f"WITH {fx.HOST_SQL}, {PAGE_CATEGORIES_SQL} SELECT page_id, domain, category FROM page_hosts JOIN page_categories USING (domain)",
)
def _(d: Data) -> DataFrame:
    return categorize.categorize(d.page_hosts.select("page_id", "domain"), d.page_rules, spread_by=["page_id"])


@query(
    "blocklist_hits",
    f"""WITH {fx.HOST_SQL} SELECT h.domain, arg_min(b.label, b.priority) AS label
    FROM (SELECT DISTINCT domain FROM page_hosts) h JOIN ({fx.PAGE_BLOCKLIST_SQL}) b
      ON h.domain = b.domain OR ends_with(h.domain, '.' || b.domain) GROUP BY h.domain""",
)
def _(d: Data) -> DataFrame:
    return categorize.blocklist_hits(d.page_hosts.select("domain").distinct(), d.page_rules.blocklist)


# Import rows derived from the events: every domain and method, numbered by first event, some faulty.
_IMPORT_SQL = """import_rows AS (SELECT min(id) + 1 AS row_number, ' ' || upper(domain) AS domain,
  CASE method WHEN 'GET' THEN 'news ' WHEN 'POST' THEN 'other' ELSE 'newz' END AS category
  FROM access_events GROUP BY domain, method)"""


def _import_rows(d: Data) -> tuple[DataFrame, DataFrame]:
    label = F.when(F.col("method") == "GET", "news ").when(F.col("method") == "POST", "other").otherwise("newz")
    first = d.events.groupBy("domain", "method").agg((F.min("id") + 1).alias("row_number"))
    rows = first.select("row_number", F.concat(F.lit(" "), F.upper("domain")).alias("domain"), label.alias("category"))
    return dimensions.validate_overrides(rows)


@query(
    "override_import",
    with_sql(
        """SELECT lower(trim(domain)) AS domain, trim(arg_max(category, row_number)) AS category FROM import_rows
        WHERE domain IS NOT NULL AND category <> 'newz' GROUP BY 1""",
        _IMPORT_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    return _import_rows(d)[0]


@query(
    "override_import_errors",
    with_sql(
        """SELECT row_number, lower(trim(domain)) AS domain, trim(category) AS category,
          CASE WHEN domain IS NULL THEN 'missing_domain' ELSE 'unknown_category' END AS reason
        FROM import_rows WHERE domain IS NULL OR category = 'newz'""",
        _IMPORT_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    return _import_rows(d)[1]


_FILES_SQL = """import_files AS (SELECT id % 3 AS file, row_number() OVER (PARTITION BY id % 3 ORDER BY id) AS row_number,
  CASE WHEN id % 11 = 0 THEN NULL ELSE upper(domain) END AS domain,
  CASE method WHEN 'GET' THEN 'news' WHEN 'POST' THEN 'other' ELSE 'newz' END AS category FROM access_events)"""


def _import_files(d: Data) -> tuple[DataFrame, DataFrame]:
    """Three override files written from the events, in the order of their ids, and loaded as one folder."""
    label = F.when(F.col("method") == "GET", "news").when(F.col("method") == "POST", "other").otherwise("newz")
    rows = d.events.select(
        (F.col("id") % 3).alias("file"), "id", F.when(F.col("id") % 11 != 0, F.upper("domain")).alias("domain"), label.alias("category")
    )
    root = scratch_dir(d.spark, "override-files")
    for file in range(3):
        part = rows.where(F.col("file") == file).repartition(1).sortWithinPartitions("id").select("domain", "category")
        part.write.option("header", True).csv(f"{root}/{file}")
    return dimensions.load_overrides(d.spark, f"{root}/*")


@query(
    "override_files",
    with_sql(
        """SELECT lower(domain) AS domain, arg_max(category, file * 1000000000 + row_number) AS category FROM import_files
        WHERE domain IS NOT NULL AND category <> 'newz' GROUP BY 1""",
        _FILES_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    return _import_files(d)[0]


@query(
    "override_files_errors",
    with_sql(
        """SELECT CAST(file AS INTEGER) AS file, row_number, lower(domain) AS domain, category,
          CASE WHEN domain IS NULL THEN 'missing_domain' ELSE 'unknown_category' END AS reason
        FROM import_files WHERE domain IS NULL OR category = 'newz'""",
        _FILES_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    errors = _import_files(d)[1]
    return errors.withColumn("file", F.element_at(F.split("file", "/"), -2).cast("int"))


# ----- clients -------------------------------------------------------------

CLIENT_TOTALS_SQL = """client_totals AS (
  SELECT client_ip, "user", branch, CAST(sum(request_count) AS BIGINT) AS total_requests,
    CAST(sum(blocked_count) AS BIGINT) AS blocked_requests, CAST(sum(total_bytes) AS BIGINT) AS total_bytes,
    max(bucket_ts) AS last_activity FROM client_rows GROUP BY 1, 2, 3)"""


def _client_rows(d: Data, **conditions) -> DataFrame:
    recent, old = d.two_grains()
    return clients.client_bucket_rows(recent, old, SINCE, UNTIL, **conditions)


@query("client_rows_two_grains", with_sql("SELECT * FROM client_rows", TWO_GRAINS_SQL))
def _(d: Data) -> DataFrame:
    return _client_rows(d)


@query(
    "client_rows_partial_hour",
    with_sql(
        """SELECT * FROM client_rows WHERE bucket_ts <= TIMESTAMP '2024-01-01 15:00:00' AND (
          bucket_ts >= TIMESTAMP '2024-01-01 12:00:00' OR bucket_ts > TIMESTAMP '2024-01-01 08:20:00')""",
        TWO_GRAINS_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    recent, old = d.two_grains()
    return clients.client_bucket_rows(recent, old, dt.datetime(2024, 1, 1, 9, 20), dt.datetime(2024, 1, 1, 15))


@query(
    "client_list",
    with_sql(
        """SELECT * FROM client_totals ORDER BY total_requests DESC, client_ip, "user" NULLS FIRST, branch LIMIT 50""",
        TWO_GRAINS_SQL,
        CLIENT_TOTALS_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    return clients.list_clients(_client_rows(d))


@query(
    "client_search",
    with_sql(
        """SELECT * FROM client_totals WHERE client_ip ILIKE '%user1%' OR "user" ILIKE '%user1%'
        ORDER BY total_bytes, client_ip, "user" NULLS FIRST, branch LIMIT 30 OFFSET 5""",
        TWO_GRAINS_SQL,
        CLIENT_TOTALS_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    return clients.list_clients(_client_rows(d, search="USER1"), "total_bytes", descending=False, limit=30, offset=5)


@query("client_total", with_sql("SELECT count(*) AS total FROM client_totals", TWO_GRAINS_SQL, CLIENT_TOTALS_SQL))
def _(d: Data) -> DataFrame:
    return clients.count_clients(_client_rows(d))


@query(
    "client_summary",
    with_sql(
        """SELECT s.client_ip, l."user", l.branch, s.total_requests, s.blocked_requests, s.total_bytes, s.last_activity FROM (
          SELECT client_ip, CAST(sum(request_count) AS BIGINT) AS total_requests, CAST(sum(blocked_count) AS BIGINT) AS blocked_requests,
            CAST(sum(total_bytes) AS BIGINT) AS total_bytes, max(bucket_ts) AS last_activity FROM client_rows GROUP BY 1) s
        JOIN (SELECT client_ip, "user", branch, row_number() OVER (PARTITION BY client_ip
          ORDER BY bucket_ts DESC, "user" DESC NULLS LAST, branch DESC) AS rn FROM client_rows) l
        ON s.client_ip = l.client_ip AND rn = 1""",
        TWO_GRAINS_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    return clients.client_summary(_client_rows(d))


@query(
    "client_activity",
    with_sql(
        f"""SELECT {DETAIL_SQL} FROM access_events WHERE client_ip = '10.17.0.6' AND domain ILIKE '%a%'
        ORDER BY "timestamp" DESC, id DESC LIMIT 40"""
    ),
)
def _(d: Data) -> DataFrame:
    return clients.client_activity(d.events, "10.17.0.6", SINCE, UNTIL, limit=40, domain="A")


# ----- events --------------------------------------------------------------


@query(
    "event_search",
    with_sql(
        f"""SELECT {DETAIL_SQL} FROM access_events WHERE blocked AND method = 'GET' AND domain ILIKE '%o%' AND "user" ILIKE '%user%'
        AND branch = 'branch-a' AND (client_ip ILIKE '%10.%1%' OR domain ILIKE '%10.%1%' OR url ILIKE '%10.%1%' OR "user" ILIKE '%10.%1%')
        AND "timestamp" BETWEEN TIMESTAMP '2024-01-01 01:00:00' AND TIMESTAMP '2024-01-01 23:00:00'"""
    ),
)
def _(d: Data) -> DataFrame:
    rows = filters.select_events(
        d.events, dt.datetime(2024, 1, 1, 1), LAST_HOUR, blocked_only=True, domain="o", method="GET", user="USER",
        search="10.%1", branch="branch-a",
    )
    return events.event_detail(rows)


@query(
    "event_page",
    with_sql(f"""SELECT {DETAIL_SQL} FROM access_events ORDER BY "timestamp" DESC, id DESC LIMIT 100 OFFSET 150"""),
)
def _(d: Data) -> DataFrame:
    return events.list_events(d.events, SINCE, UNTIL, limit=100, offset=150)


@query("event_total", with_sql("SELECT count(*) AS total FROM access_events WHERE blocked"))
def _(d: Data) -> DataFrame:
    return events.count_events(d.events, SINCE, UNTIL, blocked_only=True)


@query("blocked_events", with_sql(f"SELECT {DETAIL_SQL} FROM access_events WHERE blocked"))
def _(d: Data) -> DataFrame:
    return events.event_detail(filters.select_events(d.events, SINCE, UNTIL, blocked_only=True))


@query(
    "free_text_search",
    with_sql(
        f"""SELECT {DETAIL_SQL} FROM access_events WHERE client_ip ILIKE '%slack%' OR domain ILIKE '%slack%'
        OR url ILIKE '%slack%' OR "user" ILIKE '%slack%'"""
    ),
)
def _(d: Data) -> DataFrame:
    return events.event_detail(filters.select_events(d.events, SINCE, UNTIL, search="slack"))


@query(
    "recent_events",
    with_sql(
        f"""SELECT {DETAIL_SQL} FROM access_events WHERE branch = 'default' AND blocked ORDER BY "timestamp" DESC, id DESC LIMIT 50"""
    ),
)
def _(d: Data) -> DataFrame:
    return events.recent_events(d.events, 50, blocked_only=True, branch="default")


@query(
    "events_in_category",
    with_sql(
        f"SELECT {DETAIL_SQL} FROM access_events JOIN categories USING (domain) WHERE category = 'work_tools'", fx.CATEGORIES_SQL
    ),
)
def _(d: Data) -> DataFrame:
    return events.event_detail(events.events_in_category(d.events, d.rules, "work_tools"))


@query(
    "events_in_domains",
    with_sql(
        f"SELECT {DETAIL_SQL} FROM access_events WHERE domain IN (SELECT domain FROM categories WHERE category = 'adult_content')",
        fx.CATEGORIES_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    wanted = categorize.domains_in_category(d.events, d.rules, "adult_content")
    return events.event_detail(events.events_in_domains(d.events, wanted))


@query(
    "branch_list",
    with_sql(
        """SELECT DISTINCT branch AS slug, CASE branch WHEN 'branch-a' THEN 'Branch A' WHEN 'branch-b' THEN 'Branch B'
          ELSE 'Default' END AS label FROM access_events"""
    ),
)
def _(d: Data) -> DataFrame:
    return events.list_branches(d.events)


# ----- sessions ------------------------------------------------------------

SPENT_SQL = """spent AS (
  SELECT client_ip, domain,
    CAST(coalesce(sum(gap) FILTER (gap <= 1800000000), 0) // 1000000 AS BIGINT) AS total_seconds,
    count(*) FILTER (gap IS NULL OR gap > 1800000000) AS session_count FROM (
    SELECT client_ip, domain, epoch_us("timestamp")
      - lag(epoch_us("timestamp")) OVER (PARTITION BY client_ip, domain ORDER BY "timestamp") AS gap
    FROM access_events WHERE domain IS NOT NULL) g GROUP BY 1, 2)"""


@query("time_spent", with_sql("SELECT * FROM spent", SPENT_SQL))
def _(d: Data) -> DataFrame:
    return sessions.time_spent(d.events, SINCE, UNTIL)


@query(
    "time_spent_category",
    with_sql(
        """SELECT client_ip, category, CAST(sum(total_seconds) AS BIGINT) AS total_seconds, CAST(sum(session_count) AS BIGINT) AS session_count
        FROM spent JOIN categories USING (domain) GROUP BY 1, 2""",
        SPENT_SQL,
        fx.CATEGORIES_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    return sessions.time_spent_by_category(sessions.time_spent(d.events, SINCE, UNTIL), d.rules)


ACTIVE_SQL = """active AS (
  SELECT branch, client_ip, count(DISTINCT date_trunc('minute', "timestamp")) AS minutes
  FROM access_events JOIN categories USING (domain) WHERE category NOT IN ('work_tools', 'uncategorized') GROUP BY 1, 2)"""


@query("active_minutes", with_sql("SELECT * FROM active", fx.CATEGORIES_SQL, ACTIVE_SQL))
def _(d: Data) -> DataFrame:
    return monitors.active_minutes(rollup.client_category_minute(d.events, d.rules), SINCE)


# ----- anomalies -----------------------------------------------------------

WINDOW_SQL = """win AS (SELECT * FROM access_events WHERE "timestamp" >= TIMESTAMP '2024-01-01 23:00:00'),
bounds AS (SELECT branch, max("timestamp") AS generated_at,
  greatest(min("timestamp"), max("timestamp") - INTERVAL 1 HOUR) AS window_start, count(*) AS current FROM win GROUP BY branch)"""


def _window(d: Data) -> DataFrame:
    return d.events.where(F.col("timestamp") >= ntz(LAST_HOUR))


def _flat(rows: DataFrame, *params: str) -> DataFrame:
    plain = ["generated_at", "kind", "severity", "client_ip", "domain", "branch"]
    return rows.select(*plain, *[F.col("params")[p].alias(p) for p in params])


@query(
    "traffic_spike",
    with_sql(
        """SELECT generated_at, 'traffic_spike' AS kind, 'high' AS severity, CAST(NULL AS VARCHAR) AS client_ip,
          CAST(NULL AS VARCHAR) AS domain, branch, CAST(current AS VARCHAR) AS current,
          CAST(CAST(round_even(baseline, 0) AS BIGINT) AS VARCHAR) AS baseline, CAST(windows AS VARCHAR) AS windows FROM (
          SELECT branch, generated_at, current, sum(total_requests) / count(*) AS baseline, count(*) AS windows FROM (
            SELECT m.branch, m.total_requests, b.generated_at, b.current,
              row_number() OVER (PARTITION BY m.branch ORDER BY m.bucket_ts DESC) AS age
            FROM minute_totals m JOIN bounds b USING (branch) WHERE m.bucket_ts + INTERVAL 1 MINUTE <= b.window_start) r
          WHERE age <= 10 GROUP BY branch, generated_at, current) t
        WHERE windows >= 5 AND baseline > 0 AND current > baseline * 3""",
        WINDOW_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    return _flat(anomalies.traffic_spike(_window(d), d.minutes), "current", "baseline", "windows")


EARLY_SQL = """win AS (SELECT * FROM access_events
  WHERE "timestamp" >= TIMESTAMP '2024-01-01 00:05:00' AND "timestamp" < TIMESTAMP '2024-01-01 00:35:00'),
bounds AS (SELECT branch, max("timestamp") AS generated_at,
  greatest(min("timestamp"), max("timestamp") - INTERVAL 1 HOUR) AS window_start FROM win GROUP BY branch)"""


def _early(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("timestamp") >= ntz(EARLY)) & (F.col("timestamp") < ntz(EARLY_END)))


@query(
    "new_blocked_domain",
    with_sql(
        """SELECT b.generated_at, 'new_blocked_domain' AS kind, 'medium' AS severity, CAST(NULL AS VARCHAR) AS client_ip,
          c.domain, c.branch FROM (SELECT DISTINCT branch, client_ip || '.' || domain AS domain FROM win WHERE blocked) c
        JOIN bounds b USING (branch) WHERE c.domain IS NOT NULL AND NOT EXISTS (SELECT 1 FROM access_events e
          WHERE e.branch = c.branch AND e.client_ip || '.' || e.domain = c.domain AND e."timestamp" < b.window_start)""",
        EARLY_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    # A name per client and domain, so that the table holds many first visits.
    named = d.events.withColumn("domain", F.concat("client_ip", F.lit("."), "domain"))
    return _flat(anomalies.new_blocked_domains(_early(named), named))


@query(
    "client_blocked_ratio",
    with_sql(
        """SELECT generated_at, 'client_blocked_ratio' AS kind, 'high' AS severity, client_ip, CAST(NULL AS VARCHAR) AS domain,
          branch, client_ip AS "clientIp", CAST(blocked AS VARCHAR) AS blocked, CAST(total AS VARCHAR) AS total,
          CAST(percent AS VARCHAR) AS ratio FROM blocked_alerts""",
        fx.ALERTS_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    return _flat(d.alerts, "clientIp", "blocked", "total", "ratio")


@query(
    "sensitive_visit",
    with_sql(
        """SELECT b.generated_at, 'sensitive_category_visit' AS kind, 'medium' AS severity, c.client_ip, c.domain, c.branch,
          c.category FROM (SELECT DISTINCT w.branch, w.client_ip, w.domain, k.category FROM win w JOIN categories k USING (domain)) c
        JOIN settings s USING (branch) JOIN bounds b USING (branch)
        WHERE contains(replace(s.sensitive, ' ', ''), c.category) AND NOT EXISTS (SELECT 1 FROM access_events e
          WHERE e.branch = c.branch AND e.client_ip = c.client_ip AND e.domain = c.domain AND e."timestamp" < b.window_start)""",
        EARLY_SQL,
        fx.CATEGORIES_SQL,
        fx.SETTINGS_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    return _flat(anomalies.sensitive_visits(_early(d.events), d.events, d.settings, d.rules), "category")


def _monitor_sql(kind: str, severity: str, keys: str, source: str, where: str, extra: str, days: str) -> str:
    on = " AND ".join(f"f.{k} = u.{k}" for k in keys.split())
    client = "u.client_ip" if "client_ip" in keys else "CAST(NULL AS VARCHAR)"
    domain = "u.domain" if "domain" in keys else "CAST(NULL AS VARCHAR)"
    return f"""SELECT TIMESTAMP '2024-01-02' AS generated_at, '{kind}' AS kind, {severity} AS severity, {client} AS client_ip,
      {domain} AS domain, u.branch, {extra} FROM ({source}) u LEFT JOIN settings s ON u.branch = s.branch
    WHERE {where} AND NOT EXISTS (SELECT 1 FROM flagged f WHERE f.kind = '{kind}' AND {on}
      AND f.generated_at >= TIMESTAMP '2024-01-02' - INTERVAL {days})"""


@query(
    "non_work_minutes",
    with_sql(
        _monitor_sql(
            "non_work_time", "'medium'", "branch client_ip", "SELECT * FROM active",
            "coalesce(s.non_work_minutes, 120) > 0 AND u.minutes >= coalesce(s.non_work_minutes, 120)",
            "CAST(u.minutes AS VARCHAR) AS minutes, CAST(coalesce(s.non_work_minutes, 120) AS VARCHAR) AS threshold", "24 HOURS",
        ),
        fx.CATEGORIES_SQL, ACTIVE_SQL, fx.SETTINGS_SQL, fx.FLAGGED_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    minutes = rollup.client_category_minute(d.events, d.rules)
    return _flat(monitors.non_work_time(minutes, d.settings, d.flagged, UNTIL), "minutes", "threshold")


@query(
    "byte_quota",
    with_sql(
        _monitor_sql(
            "byte_quota", "CASE WHEN u.used >= 2 * s.byte_quota THEN 'critical' ELSE 'high' END", "branch client_ip",
            "SELECT branch, client_ip, CAST(sum(bytes) AS BIGINT) AS used FROM access_events GROUP BY 1, 2",
            "s.byte_quota <> 0 AND u.used >= s.byte_quota",
            "CAST(u.used AS VARCHAR) AS bytes, CAST(s.byte_quota AS VARCHAR) AS quota", "24 HOURS",
        ),
        fx.SETTINGS_SQL, fx.FLAGGED_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    return _flat(monitors.byte_quota(d.client_minutes, d.settings, d.flagged, UNTIL), "bytes", "quota")


@query(
    "uncategorized_domains",
    with_sql(
        _monitor_sql(
            "uncategorized_domain", "'low'", "branch domain",
            """SELECT branch, domain, count(*) AS requests FROM access_events JOIN categories USING (domain)
            WHERE category = 'uncategorized' GROUP BY 1, 2
            QUALIFY row_number() OVER (PARTITION BY branch ORDER BY requests DESC, domain) <= 20""",
            "s.uncategorized_threshold > 0 AND u.requests >= s.uncategorized_threshold",
            "CAST(u.requests AS VARCHAR) AS requests, CAST(s.uncategorized_threshold AS VARCHAR) AS threshold", "7 DAYS",
        ),
        fx.CATEGORIES_SQL, fx.SETTINGS_SQL, fx.FLAGGED_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    found = monitors.uncategorized_domains(d.domain_minutes, d.settings, d.flagged, d.rules, UNTIL)
    return _flat(found, "requests", "threshold")


# Alerts of two kinds and severities over the whole table.
MIXED_SQL = f"""mixed AS (
  SELECT generated_at, '{fv.TITLES['client_blocked_ratio']}' AS title, 'high' AS severity, client_ip, branch FROM blocked_alerts
  UNION ALL SELECT TIMESTAMP '2024-01-02', '{fv.TITLES['non_work_time']}', 'medium', client_ip, branch FROM active WHERE minutes >= 120)"""


def _mixed(d: Data) -> DataFrame:
    none = d.spark.createDataFrame([], "branch string, non_work_minutes int")
    unflagged = d.flagged.where(F.col("generated_at") > ntz(UNTIL))
    minutes = rollup.client_category_minute(d.events, d.rules)
    return d.alerts.unionByName(monitors.non_work_time(minutes, none, unflagged, UNTIL))


@query(
    "alert_selection",
    with_sql(
        "SELECT generated_at, title, severity, client_ip, branch FROM mixed WHERE severity IN ('high', 'critical')",
        fx.ALERTS_SQL, fx.CATEGORIES_SQL, ACTIVE_SQL, MIXED_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    return anomalies.select_alerts(_mixed(d)).select("generated_at", "title", "severity", "client_ip", "branch")


@query(
    "recent_anomalies",
    with_sql(
        """SELECT generated_at, title, severity, client_ip, branch FROM mixed
        ORDER BY generated_at DESC, branch, title, client_ip LIMIT 50""",
        fx.ALERTS_SQL, fx.CATEGORIES_SQL, ACTIVE_SQL, MIXED_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    return anomalies.recent_anomalies(_mixed(d)).select("generated_at", "title", "severity", "client_ip", "branch")


@query(
    "anomaly_markers",
    with_sql(
        """SELECT bucket_ts, generated_at, title, severity FROM (
          SELECT *, row_number() OVER (PARTITION BY bucket_ts ORDER BY rank DESC, generated_at, title) AS pick FROM (
            SELECT p.bucket_ts, m.generated_at, m.title, m.severity, CASE m.severity WHEN 'high' THEN 2 ELSE 1 END AS rank,
              row_number() OVER (PARTITION BY m.generated_at, m.title, m.client_ip, m.branch
                ORDER BY abs(epoch_us(p.bucket_ts) - epoch_us(m.generated_at)), p.bucket_ts) AS near
            FROM mixed m JOIN (SELECT DISTINCT bucket_ts FROM minute_totals) p
              ON abs(epoch_us(p.bucket_ts) - epoch_us(m.generated_at)) <= 120000000) n WHERE near = 1) q WHERE pick = 1""",
        fx.ALERTS_SQL, fx.CATEGORIES_SQL, ACTIVE_SQL, MIXED_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    return markers.snap_to_series(_mixed(d), traffic.timeseries(d.minutes, SINCE, UNTIL))


@query(
    "alert_thresholds",
    with_sql(
        """SELECT b.branch, coalesce(CASE s.branch WHEN 'branch-a' THEN 'gambling,adult_content' ELSE s.sensitive END, '') AS sensitive,
          coalesce(s.non_work_minutes, 120) AS non_work_minutes, CAST(s.byte_quota AS VARCHAR) AS byte_quota,
          CAST(s.uncategorized_threshold AS VARCHAR) AS uncategorized_threshold
        FROM (SELECT DISTINCT branch FROM access_events) b LEFT JOIN settings s USING (branch)""",
        fx.SETTINGS_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    rows = dimensions.thresholds(d.branches, d.settings)
    return rows.select(
        "branch",
        F.array_join("sensitive_categories", ",").alias("sensitive"),
        "non_work_minutes",
        *[F.col(c).cast("string") for c in ("byte_quota", "uncategorized_threshold")],
    )


# ----- exports, archive, retention, branches -------------------------------

_ESCAPED = EXPORT_SQL
for _name in ('"user"', "url"):
    _ESCAPED = _ESCAPED.replace(
        _name, f"CASE WHEN {_name} SIMILAR TO '[-=+@].*' THEN chr(39) || {_name} ELSE {_name} END AS {_name}"
    )


@query("export_rows", with_sql(f"SELECT {_ESCAPED} FROM signed", """signed AS (SELECT * REPLACE (
  CASE WHEN method = 'POST' THEN '=' || "user" WHEN method = 'CONNECT' THEN '@' || "user" ELSE "user" END AS "user") FROM access_events)"""))
def _(d: Data) -> DataFrame:
    mark = F.when(F.col("method") == "POST", "=").when(F.col("method") == "CONNECT", "@").otherwise("")
    signed = d.events.withColumn("user", F.concat(mark, "user"))
    return export.csv_frame(export.export_rows(signed, SINCE, UNTIL))


@query(
    "export_columns",
    with_sql(
        """SELECT domain, bytes, id FROM access_events JOIN categories USING (domain)
        WHERE category = 'gambling' AND branch = 'branch-a'""",
        fx.CATEGORIES_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    rows = export.export_rows(d.events, SINCE, UNTIL, d.rules, category="gambling", branch="branch-a")
    return export.json_frame(rows, ["domain", "bytes", "id"])


@query("export_recent", with_sql(f"""SELECT {EXPORT_SQL} FROM access_events ORDER BY "timestamp" DESC, id DESC LIMIT 100000"""))
def _(d: Data) -> DataFrame:
    return export.json_frame(export.recent_rows(d.events, SINCE, UNTIL))


RUNS_SQL = """runs AS (SELECT branch, max("timestamp") AS archived_until FROM access_events
  WHERE branch <> 'default' AND blocked GROUP BY branch),
sites AS (SELECT DISTINCT branch FROM access_events)"""
NEXT_WEEK = dt.datetime(2024, 1, 8, 18)


@query(
    "archive_windows",
    with_sql(
        """SELECT branch, least(TIMESTAMP '2024-01-01 18:00:00', archived_until) AS since, TIMESTAMP '2024-01-08 18:00:00' AS until
        FROM sites LEFT JOIN runs USING (branch)""",
        RUNS_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    return archive.archive_windows(d.branches, d.archive_runs, NEXT_WEEK)


@query(
    "archive_rows",
    with_sql(
        f"""SELECT {EXPORT_SQL} FROM access_events JOIN (SELECT branch, least(TIMESTAMP '2024-01-01 18:00:00', archived_until) AS since
          FROM sites LEFT JOIN runs USING (branch)) w USING (branch) WHERE "timestamp" >= since""",
        RUNS_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    windows = archive.archive_windows(d.branches, d.archive_runs, NEXT_WEEK)
    return export.json_frame(archive.archive_rows(d.events, windows))


@query(
    "archive_advance",
    with_sql("SELECT branch, TIMESTAMP '2024-01-08 18:00:00' AS archived_until FROM sites", RUNS_SQL),
)
def _(d: Data) -> DataFrame:
    return archive.advance(d.branches, d.archive_runs, NEXT_WEEK)


@query(
    "archive_due",
    with_sql(
        """SELECT bool_or(archived_until IS NULL OR archived_until <= TIMESTAMP '2024-01-01 18:00:00') AS due
        FROM sites LEFT JOIN runs USING (branch)""",
        RUNS_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    return archive.is_due(d.branches, d.archive_runs, NEXT_WEEK)


@query(
    "unarchived_branches",
    with_sql(
        """SELECT branch FROM sites LEFT JOIN runs USING (branch)
        WHERE archived_until IS NULL OR archived_until < TIMESTAMP '2024-01-01 12:00:00'""",
        RUNS_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    return retention.unarchived_branches(d.branches, d.archive_runs, NOON)


@query(
    "watermark_merge",
    with_sql(
        """SELECT CASE branch WHEN 'branch-a' THEN 'branch-b' ELSE branch END AS branch, min(archived_until) AS archived_until
        FROM runs GROUP BY 1""",
        RUNS_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    return archive.merge_watermarks(d.archive_runs, "branch-a", "branch-b")


@query("raw_retention", with_sql(f"""SELECT {DETAIL_SQL} FROM access_events WHERE "timestamp" >= TIMESTAMP '2024-01-01 12:00:00'"""))
def _(d: Data) -> DataFrame:
    return events.event_detail(retention.kept(d.events, NOON, "timestamp"))


@query(
    "rollup_retention",
    with_sql("SELECT * FROM domain_minute WHERE bucket_ts >= TIMESTAMP '2024-01-01 12:00:00'"),
)
def _(d: Data) -> DataFrame:
    return retention.kept(d.domain_minutes, NOON, "bucket_ts")


@query(
    "branch_relabel_conflicts",
    with_sql(
        """SELECT a.bucket_ts, a.domain, CAST(1 AS BIGINT) AS source_rows, CAST(1 AS BIGINT) AS target_rows FROM domain_minute a
        JOIN domain_minute b ON a.bucket_ts = b.bucket_ts AND a.domain = b.domain
        WHERE a.branch = 'branch-a' AND b.branch = 'branch-b'"""
    ),
)
def _(d: Data) -> DataFrame:
    return branches.relabel_conflicts(d.domain_minutes, ["bucket_ts", "domain", "branch"], "branch-a", "branch-b")


@query(
    "branch_relabel_plan",
    with_sql(
        """SELECT 'client_minute' AS table_name, count(*) AS moving, count(*) FILTER (EXISTS (SELECT 1 FROM client_minute b
          WHERE b.branch = 'branch-b' AND b.bucket_ts = a.bucket_ts AND b.client_ip = a.client_ip
            AND b."user" IS NOT DISTINCT FROM a."user")) AS conflicts FROM client_minute a WHERE branch = 'branch-a'"""
    ),
)
def _(d: Data) -> DataFrame:
    keys = ["bucket_ts", "client_ip", "branch", "user"]
    return branches.relabel_plan(d.client_minutes, "client_minute", keys, "branch-a", "branch-b")


@query("branch_relabel", with_sql("SELECT * REPLACE (CASE branch WHEN 'branch-a' THEN 'head-office' ELSE branch END AS branch) FROM minute_totals"))
def _(d: Data) -> DataFrame:
    return branches.relabelled(d.minutes, "branch-a", "head-office")


# ----- stored tables and streaming -----------------------------------------


@query("stream_ingest", with_sql("SELECT * FROM minute_totals"))
def _(d: Data) -> DataFrame:
    """The events as log files, through the stream into a store, read back."""
    root = scratch_dir(d.spark, "stream-ingest")
    d.lines().write.partitionBy("branch").text(f"{root}/logs")
    store = LogStore(d.spark, f"{root}/store")
    lines = stream_lines(d.spark, f"{root}/logs")
    Ingest(store, d.rules).start(lines, f"{root}/checkpoint", available_now=True).awaitTermination()
    return store.rollup(MINUTE_TOTALS).drop("event_date")


@query("stream_new_checkpoint", with_sql("SELECT * FROM minute_totals"))
def _(d: Data) -> DataFrame:
    """Two streams with checkpoints of their own into one store, the first one started twice: nothing is lost or doubled."""
    root = scratch_dir(d.spark, "stream-again")
    store = LogStore(d.spark, f"{root}/store")
    for name, rows in (("one", "branch = 'branch-a'"), ("one", "false"), ("two", "branch != 'branch-a'")):
        d.lines().where(rows).write.mode("append").partitionBy("branch").text(f"{root}/logs-{name}")
        lines = stream_lines(d.spark, f"{root}/logs-{name}")
        Ingest(store, d.rules).start(lines, f"{root}/checkpoint-{name}", available_now=True).awaitTermination()
    return store.rollup(MINUTE_TOTALS).drop("event_date")


@query("stream_interleaved", with_sql("SELECT * FROM minute_totals"))
def _(d: Data) -> DataFrame:
    """Two ingests by turns into one store, upkeep, then the first one's last batch once more."""
    root = scratch_dir(d.spark, "interleaved")
    store = LogStore(d.spark, f"{root}/store")
    parts = (
        ("one", F.col("branch").eqNullSafe("branch-a") & (F.col("id") % 2 == 0)),
        ("two", ~F.col("branch").eqNullSafe("branch-a")),
        ("one", F.col("branch").eqNullSafe("branch-a") & (F.col("id") % 2 == 1)),
    )

    def run(name: str) -> None:
        lines = stream_lines(d.spark, f"{root}/logs-{name}")
        Ingest(store, d.rules).start(lines, f"{root}/checkpoint-{name}", available_now=True).awaitTermination()

    for name, part in parts:
        d.lines(part).write.mode("append").partitionBy("branch").text(f"{root}/logs-{name}")
        run(name)
    store.fold(MINUTE_TOTALS.name, store.dates(MINUTE_TOTALS.name))
    store.vacuum()
    # Without its last entry Spark repeats the stream's last batch.
    delete(d.spark, f"{root}/checkpoint-one/commits/1")
    run("one")
    return store.rollup(MINUTE_TOTALS).drop("event_date")


# Two batches of twelve hours, the second checked against the first.
STREAM_DETECT_SQL = f"""parsed AS (SELECT {PARSED_SQL} FROM access_events),
ev AS (SELECT *, date_part('hour', "timestamp") // 12 AS b FROM parsed),
batch_bounds AS (SELECT b, branch, max("timestamp") AS generated_at, count(*) AS current,
  greatest(min("timestamp"), max("timestamp") - INTERVAL 1 HOUR) AS window_start FROM ev GROUP BY b, branch),
minutes AS (SELECT b, branch, date_trunc('minute', "timestamp") AS bucket_ts, count(*) AS n FROM ev GROUP BY 1, 2, 3),
spikes AS (SELECT branch, generated_at FROM (
    SELECT w.*, m.n, row_number() OVER (PARTITION BY w.b, w.branch ORDER BY m.bucket_ts DESC) AS age FROM batch_bounds w
    JOIN minutes m ON m.branch = w.branch AND m.b < w.b AND m.bucket_ts + INTERVAL 1 MINUTE <= w.window_start) r
  WHERE age <= 10 GROUP BY b, branch, generated_at, current HAVING count(*) >= 5 AND current > 3 * sum(n) / count(*)),
blocked_new AS (SELECT DISTINCT e.branch, w.generated_at, e.domain FROM ev e JOIN batch_bounds w USING (b, branch)
  WHERE e.blocked AND e.domain <> '' AND NOT EXISTS (SELECT 1 FROM ev o
    WHERE o.b < e.b AND o.branch = e.branch AND o.domain = e.domain AND o."timestamp" < w.window_start)),
mostly_blocked AS (SELECT e.branch, w.generated_at, e.client_ip FROM ev e JOIN batch_bounds w USING (b, branch)
  GROUP BY e.b, e.branch, w.generated_at, e.client_ip HAVING count(*) >= 5 AND count(*) FILTER (e.blocked) / count(*) >= 0.5),
visits AS (SELECT DISTINCT e.branch, w.generated_at, e.client_ip, e.domain FROM ev e JOIN batch_bounds w USING (b, branch)
  JOIN settings s USING (branch) JOIN parsed_categories k ON k.domain = e.domain
  WHERE contains(replace(s.sensitive, ' ', ''), k.category) AND NOT EXISTS (SELECT 1 FROM ev o WHERE o.b < e.b
    AND o.branch = e.branch AND o.client_ip = e.client_ip AND o.domain = e.domain AND o."timestamp" < w.window_start))"""


@query(
    "stream_detect",
    with_sql(
        """SELECT 'traffic_spike' AS kind, branch, generated_at, CAST(NULL AS VARCHAR) AS client_ip, CAST(NULL AS VARCHAR) AS domain FROM spikes
        UNION ALL SELECT 'new_blocked_domain', branch, generated_at, NULL, domain FROM blocked_new
        UNION ALL SELECT 'client_blocked_ratio', branch, generated_at, client_ip, NULL FROM mostly_blocked
        UNION ALL SELECT 'sensitive_category_visit', branch, generated_at, client_ip, domain FROM visits""",
        STREAM_DETECT_SQL.replace("batch_bounds AS", fx.category_sql(
            "parsed_categories", "SELECT DISTINCT domain FROM ev WHERE domain <> ''", fx.OVERRIDES_SQL) + ", " + fx.SETTINGS_SQL + ", batch_bounds AS", 1),
    ),
)
def _(d: Data) -> DataFrame:
    """Anomalies that the ingest stores, batch by batch, from carried minutes and first visits."""
    root = scratch_dir(d.spark, "stream-detect")
    store = LogStore(d.spark, f"{root}/store")
    for half in range(2):
        rows = F.floor(F.hour("timestamp") / 12) == half
        d.lines(rows).write.mode("append").partitionBy("branch").text(f"{root}/logs")
        ingest = Ingest(store, d.rules, d.settings, "statistical")
        ingest.start(stream_lines(d.spark, f"{root}/logs"), f"{root}/checkpoint", available_now=True).awaitTermination()
    return store.anomalies().select("kind", "branch", "generated_at", "client_ip", "domain")


SPREAD_SQL = """spread AS (SELECT * REPLACE ("timestamp" + to_days(CAST(id % 5 AS INTEGER)) AS "timestamp") FROM access_events)"""


@query(
    "store_newest",
    with_sql(
        f"""SELECT {DETAIL_SQL} FROM spread WHERE branch = 'branch-b' AND blocked ORDER BY "timestamp" DESC, id DESC LIMIT 300""",
        SPREAD_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    """The newest blocked events of a branch, from the newest of five stored dates."""
    store = LogStore(d.spark, scratch_dir(d.spark, "newest"))
    moved = F.timestamp_add("DAY", F.col("id") % 5, F.col("timestamp"))
    store.write_events(0, d.events.withColumn("timestamp", moved))
    store.write_rollups(0, d.rules)
    store.commit(0)
    return events.newest_first(store.newest_events(300, branch="branch-b", blocked_only=True))


@query(
    "event_positions",
    with_sql(f"""SELECT {DETAIL_SQL} FROM access_events WHERE blocked ORDER BY "timestamp" DESC, id DESC LIMIT 40 OFFSET 80"""),
)
def _(d: Data) -> DataFrame:
    """The third page of forty, each found by the position at which the one before it ends."""
    rows = d.events.where("blocked")
    position = None
    for _page in range(2):
        position = events.next_position(events.events_after(rows, position, 40))
    return events.events_after(rows, position, 40)


@query("lag_signals", with_sql("SELECT count(*) AS input_rows, false AS at_risk FROM events GROUP BY event_id % 12"))
def _(d: Data) -> DataFrame:
    """Every batch of a stream in the lag table, as the listener was told of it."""
    root = scratch_dir(d.spark, "lag")
    rows = d.spark.read.parquet(f"{d.sf_dir}/events.parquet").select("event_id", (F.col("event_id") % 12).alias("file"))
    n_files = rows.select("file").distinct().count()
    rows.repartition(12, "file").write.partitionBy("file").parquet(f"{root}/in")
    progress_log = progress.ProgressLog(d.spark, f"{root}/progress")
    d.spark.streams.addListener(progress_log)
    try:
        stream = d.spark.readStream.schema("event_id bigint, file int").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        started = stream.writeStream.format("noop").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        started.awaitTermination()
        # Reports come a little later than the end.
        give_up = time.monotonic() + 60
        while progress_log.rows().where("input_rows > 0").count() < n_files and time.monotonic() < give_up:
            time.sleep(0.2)
    finally:
        d.spark.streams.removeListener(progress_log)
    signals = progress.lag_signals(progress_log.rows().where("input_rows > 0"), interval_ms=3_600_000)
    return signals.select("input_rows", "at_risk")


LONG_SINCE, LONG_UNTIL = dt.datetime(2024, 1, 3, 7, 23, 11), dt.datetime(2024, 2, 11, 18, 41, 5)
LONG_SQL = """long_events AS (SELECT * REPLACE ("timestamp" + to_days(CAST(id % 45 AS INTEGER)) AS "timestamp") FROM access_events),
long_range AS (SELECT * FROM long_events WHERE domain IS NOT NULL AND date_trunc('minute', "timestamp")
  BETWEEN TIMESTAMP '2024-01-03 07:23:11' AND TIMESTAMP '2024-02-11 18:41:05')"""


def _long_store(d: Data) -> LogStore:
    """Domain minutes of 45 days, 43 of them folded with their longer sums; a late batch touches all."""
    store = LogStore(d.spark, scratch_dir(d.spark, "long"))
    events_ = d.events.withColumn("timestamp", F.timestamp_add("DAY", F.col("id") % 45, F.col("timestamp")))
    for batch, part in enumerate((F.col("id") % 10 != 0, F.col("id") % 10 == 0)):
        store.write_partials(batch, DOMAIN_MINUTE, rollup.domain_minute(events_.where(part)))
        store.commit(batch)
        if batch == 0:
            store.fold_levels(DOMAIN_MINUTE, store.dates(DOMAIN_MINUTE.name)[:-2])
            store.vacuum()
    return store


@query(
    "top_domains_long",
    with_sql(
        """SELECT domain, count(*) AS request_count, count(*) FILTER (blocked) AS blocked_count, CAST(sum(bytes) AS BIGINT) AS total_bytes
        FROM long_range WHERE branch = 'branch-a' GROUP BY domain ORDER BY request_count DESC, domain LIMIT 10""",
        LONG_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    """Six weeks with odd ends, from sums over minutes, hours, days and 16 days."""
    rows = _long_store(d).rollup_range(DOMAIN_MINUTE, LONG_SINCE, LONG_UNTIL)
    found = domains.top_domains(rows, LONG_SINCE, LONG_UNTIL, d.rules, limit=10, branch="branch-a")
    return found.select("domain", "request_count", "blocked_count", "total_bytes")


@query(
    "usage_by_category_long",
    with_sql(
        """SELECT category, count(*) AS request_count, count(*) FILTER (blocked) AS blocked_count, CAST(sum(bytes) AS BIGINT) AS total_bytes
        FROM long_range JOIN categories USING (domain) GROUP BY category""",
        LONG_SQL,
        fx.CATEGORIES_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    rows = _long_store(d).rollup_range(DOMAIN_MINUTE, LONG_SINCE, LONG_UNTIL)
    return domains.usage_by_category(rows, LONG_SINCE, LONG_UNTIL, d.rules).select(
        "category", "request_count", "blocked_count", "total_bytes"
    )


@query(
    "active_clients_long",
    with_sql(
        """SELECT 'client' AS kind, count(DISTINCT client_ip) AS n FROM long_minutes
        UNION ALL SELECT 'user', count(DISTINCT "user") FROM long_minutes""",
        LONG_SQL,
        """long_minutes AS (SELECT * FROM long_events WHERE date_trunc('minute', "timestamp")
          BETWEEN TIMESTAMP '2024-01-03 07:23:11' AND TIMESTAMP '2024-02-11 18:41:05')""",
    ),
)
def _(d: Data) -> DataFrame:
    """Distinct clients and users of six weeks from bitmaps per hour; odd ends and late rows from client minutes."""
    store = LogStore(d.spark, scratch_dir(d.spark, "long-clients"))
    events_ = d.events.withColumn("timestamp", F.timestamp_add("DAY", F.col("id") % 45, F.col("timestamp")))
    for batch, part in enumerate((F.col("id") % 10 != 0, F.col("id") % 10 == 0)):
        store.write_partials(batch, CLIENT_MINUTE, rollup.client_minute(events_.where(part)))
        store.commit(batch)
        if batch == 0:
            store.fold_clients(store.dates(CLIENT_MINUTE.name)[:-2])
    return store.active_counts(LONG_SINCE, LONG_UNTIL)


RENAMED = "CASE branch WHEN 'branch-a' THEN 'head-office' ELSE branch END"


@query(
    "relabel_store",
    with_sql(
        f"""SELECT 'events' AS part, {RENAMED} AS branch, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS total FROM access_events GROUP BY ALL
        UNION ALL SELECT 'domains', {RENAMED}, count(*), CAST(sum(total_bytes) AS BIGINT) FROM domain_minute GROUP BY ALL
        UNION ALL SELECT 'clients', {RENAMED}, count(*), CAST(sum(total_bytes) AS BIGINT) FROM client_minute GROUP BY ALL
        UNION ALL SELECT 'visits', {RENAMED}, count(*), 0 FROM (SELECT DISTINCT branch, client_ip, domain FROM access_events
          WHERE domain IS NOT NULL) v GROUP BY ALL"""
    ),
)
def _(d: Data) -> DataFrame:
    """A branch renamed in a store of two batches, one of them folded; no data file changes."""
    store = LogStore(d.spark, scratch_dir(d.spark, "relabel"))
    for batch, part in enumerate((F.col("id") % 2 == 0, F.col("id") % 2 == 1)):
        store.write_events(batch, d.events.where(part))
        store.write_rollups(batch, d.rules)
        store.commit(batch)
        if batch == 0:
            store.fold(DOMAIN_MINUTE.name, store.dates(DOMAIN_MINUTE.name))
    branches.relabel_branch(store, "branch-a", "head-office", dry_run=False)
    visits = store.first_visits(CLIENT_DOMAIN_SEEN).select("branch", "client_ip", "domain").distinct()
    parts = {
        "events": (store.events(), F.sum("bytes")),
        "domains": (store.rollup(DOMAIN_MINUTE), F.sum("total_bytes")),
        "clients": (store.rollup(CLIENT_MINUTE), F.sum("total_bytes")),
        "visits": (visits, F.lit(0).cast("long")),
    }
    counted = [
        rows.groupBy("branch").agg(F.count(F.lit(1)).alias("n"), total.alias("total")).withColumn("part", F.lit(name))
        for name, (rows, total) in parts.items()
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])


@query(
    "feed_batches",
    with_sql(
        """SELECT branch, CAST(200 AS INTEGER) AS n, total // 200 AS batches, true AS in_order FROM
          (SELECT branch, count(*) AS total FROM access_events GROUP BY branch) t WHERE total >= 200
        UNION ALL SELECT branch, CAST(total % 200 AS INTEGER), 1, true FROM
          (SELECT branch, count(*) AS total FROM access_events GROUP BY branch) t WHERE total % 200 > 0"""
    ),
)
def _(d: Data) -> DataFrame:
    """The events as a live feed: full batches at once, the rest of each branch when its time is up."""
    root = scratch_dir(d.spark, "feed")
    d.lines().write.partitionBy("branch").text(f"{root}/logs")
    total = d.events.count()
    batches = feed.feed_batches(parse.parse_access_log(stream_lines(d.spark, f"{root}/logs"))[0])
    writer = batches.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
    started = writer.trigger(processingTime="0.2 seconds").start()
    out = read_or_empty(d.spark, f"{root}/out", batches.schema)
    while out.count() < total:
        if not started.isActive:
            raise started.exception() or RuntimeError("the feed has stopped before its end")
        time.sleep(0.3)
        out = read_or_empty(d.spark, f"{root}/out", batches.schema)
    started.stop()
    per_batch = out.groupBy("branch", "lane", "batch").agg(
        F.max("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.count_distinct("position").alias("places"), F.max("position").alias("last")
    )
    whole = (F.col("rows") == F.col("n")) & (F.col("places") == F.col("n")) & (F.col("last") == F.col("n"))
    return per_batch.groupBy("branch", "n").agg(F.count(F.lit(1)).alias("batches"), F.bool_and(whole).alias("in_order"))


@query("export_json_files", with_sql("SELECT id, branch, url, domain, bytes, blocked FROM access_events"))
def _(d: Data) -> DataFrame:
    """A JSON export written and read back; values are untouched."""
    path = scratch_dir(d.spark, "export-json")
    export.write_json(d.events, path, ["id", "branch", "url", "domain", "bytes", "blocked"])
    return d.spark.read.schema("id bigint, branch string, url string, domain string, bytes bigint, blocked boolean").json(path)


@query("export_manifest", with_sql("SELECT count(*) AS row_count, true AS all_sized, true AS all_hashed FROM access_events"))
def _(d: Data) -> DataFrame:
    """Rows as counted while writing, and every part with its size and checksum."""
    path = scratch_dir(d.spark, "export-manifest")
    written = export.write_csv_with_manifest(d.events, path, ["id", "domain"])
    parts = export.manifest(d.spark, path)
    sums = [F.sum("size_bytes").alias("total"), F.count(F.lit(1)).alias("n")]
    sizes = parts.agg(*sums, F.bool_and(F.length("checksum_sha256") == 64).alias("hashed")).first()
    same = (F.col("size_bytes") == sizes["total"]) & (F.col("part_count") == sizes["n"])
    return written.select("row_count", same.alias("all_sized"), F.lit(sizes["hashed"]).alias("all_hashed"))


@query("override_round_trip", f"WITH {fx.HOST_SQL} {fx.PAGE_OVERRIDES_SQL}")
def _(d: Data) -> DataFrame:
    """Overrides written as CSV and read again by the import."""
    path = scratch_dir(d.spark, "overrides-out")
    export.write_overrides(d.page_rules.overrides, path)
    return dimensions.load_overrides(d.spark, path)[0]


@query("blocklist_files", f"WITH {fx.HOST_SQL} SELECT domain, label, CAST(priority AS INTEGER) AS priority FROM ({fx.PAGE_BLOCKLIST_SQL}) b")
def _(d: Data) -> DataFrame:
    """A blocklist in folders of categories, with repeats, blank lines and a folder that no label has."""
    root = scratch_dir(d.spark, "blocklist")
    folders = {label: folder for folder, label in reversed(fv.BLOCKLIST_FOLDERS)}
    rows = d.page_rules.blocklist
    for label, folder in folders.items():
        own = rows.where(F.col("label") == label).select("domain")
        own.unionAll(own).unionAll(own.select(F.lit(" ").alias("domain"))).write.text(f"{root}/{folder}/domains")
    rows.select("domain").write.text(f"{root}/no-such-folder/domains")
    return dimensions.load_blocklist(d.spark, root)


@query(
    "log_file_lines",
    with_sql("""SELECT branch, coalesce(domain, '') || chr(13) || CAST(id AS VARCHAR) AS value FROM access_events"""),
)
def _(d: Data) -> DataFrame:
    """Lines with a bare carriage return inside, which ends none; files older than a start are skipped."""
    root = scratch_dir(d.spark, "lines")
    lines = d.events.select(F.concat(F.coalesce("domain", F.lit("")), F.lit("\r"), F.col("id").cast("string")).alias("value"), "branch")
    lines.write.partitionBy("branch").text(f"{root}/logs")
    found = read_lines(d.spark, f"{root}/logs", dt.datetime(2000, 1, 1))
    none = read_lines(d.spark, f"{root}/logs", dt.datetime(2200, 1, 1))
    return found.unionByName(none).select("branch", "value")


@query(
    "parse_odd_fields",
    with_sql(
        f"""SELECT CASE WHEN bytes % 3 = 0 THEN 0 ELSE bytes END AS bytes, left(coalesce("user", '-') || repeat('u', 300), 255) AS "user",
          count(*) AS n FROM access_events GROUP BY 1, 2"""
    ),
)
def _(d: Data) -> DataFrame:
    """Numbers that are none count as 0, and long fields are cut at their widths."""
    fields = F.transform(
        F.split("value", " +"),
        lambda t, i: F.when((i == 4) & (t.cast("long") % 3 == 0), F.concat(t, F.lit("x")))
        .when(i == 7, F.concat(t, F.lit("u" * 300)))
        .otherwise(t),
    )
    lines = d.lines().select(F.array_join(fields, " ").alias("value"), "branch")
    good, _rejects = parse.parse_access_log(lines)
    return good.groupBy("bytes", "user").agg(F.count(F.lit(1)).alias("n"))


@query(
    "range_presets",
    with_sql(
        """SELECT '1h' AS preset, count(*) AS n FROM access_events WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-01 23:00:00' AND TIMESTAMP '2024-01-02'
        UNION ALL SELECT '24h', count(*) FROM access_events WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-02'
        UNION ALL SELECT 'custom', count(*) FROM access_events
          WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-01 10:00:00' AND TIMESTAMP '2024-01-01 12:30:00'"""
    ),
)
def _(d: Data) -> DataFrame:
    """Events of preset ranges that end now, and of a range given with another time zone."""
    berlin = dt.timezone(dt.timedelta(hours=1))
    ranges = {
        "1h": resolve_range("1h", now=UNTIL),
        "24h": resolve_range(now=UNTIL),
        "custom": resolve_range(from_ts=dt.datetime(2024, 1, 1, 11, tzinfo=berlin), to_ts=dt.datetime(2024, 1, 1, 12, 30)),
    }
    counts = [
        filters.total_of(filters.in_time_range(d.events, r.since, r.until)).select(F.lit(name).alias("preset"), F.col("total").alias("n"))
        for name, r in ranges.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("archive_pruned", with_sql("SELECT id, '2024-01-02' AS run_date FROM access_events WHERE branch = 'branch-b'"))
def _(d: Data) -> DataFrame:
    """Two archive runs weeks apart, the older one pruned."""
    path = scratch_dir(d.spark, "archive-pruned")
    runs = d.spark.createDataFrame([("branch-a", SINCE), ("branch-b", SINCE)], "branch string, archived_until timestamp_ntz")
    for branch, now in (("branch-a", SINCE - dt.timedelta(days=20)), ("branch-b", UNTIL)):
        one = d.spark.createDataFrame([(branch,)], "branch string")
        archive.run_archive(d.events.withColumn("timestamp", F.least("timestamp", ntz(now))), one, runs, now, path)
    archive.prune_archives(d.spark, path, 14, UNTIL)
    files = d.spark.read.option("header", True).option("escape", '"').csv(path)
    return files.select(F.col("id").cast("long").alias("id"), F.col("run_date").cast("string").alias("run_date"))


@query(
    "period_report",
    with_sql(
        """SELECT category, CAST(sum(request_count) AS BIGINT) AS request_count, CAST(sum(blocked_count) AS BIGINT) AS blocked_count,
          CAST(sum(total_bytes) AS BIGINT) AS total_bytes FROM domain_minute JOIN categories USING (domain) WHERE branch = 'branch-b' GROUP BY 1""",
        fx.CATEGORIES_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    """The categories of one branch's daily report, over the window that is due."""
    since, until = report.report_window("daily", UNTIL)
    parts = report.period_report(d.minutes, d.domain_minutes, d.client_minutes, None, d.alerts, d.rules, since, until, "branch-b")
    return parts["by_category"].select("category", "request_count", "blocked_count", "total_bytes")


@query("store_retention", with_sql("SELECT * FROM domain_minute WHERE bucket_ts >= TIMESTAMP '2024-01-01 12:00:00'"))
def _(d: Data) -> DataFrame:
    """Domain minutes stored, aged out up to noon by the retention job, read back."""
    store = LogStore(d.spark, scratch_dir(d.spark, "retention"))
    store.write_partials(0, DOMAIN_MINUTE, d.domain_minutes)
    store.write_partials(0, CLIENT_MINUTE, d.client_minutes)
    store.commit(0)
    branches_ = d.spark.createDataFrame([("default",)], "branch string")
    runs = d.spark.createDataFrame([], "branch string, archived_until timestamp_ntz")
    retention.run_retention(store, branches_, runs, NOON + dt.timedelta(days=10), rollup_days=10)
    return store.rollup(DOMAIN_MINUTE).drop("event_date")


@query(
    "export_csv_files",
    with_sql("SELECT id, branch, method, domain, CAST(status_code AS INTEGER) AS status_code FROM access_events"),
)
def _(d: Data) -> DataFrame:
    """A CSV export written and read back."""
    path = scratch_dir(d.spark, "export-csv")
    export.write_csv(d.events, path, ["id", "branch", "method", "domain", "status_code"])
    schema = "id bigint, branch string, method string, domain string, status_code int"
    return d.spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


@query(
    "archive_files",
    with_sql("SELECT id, branch, method, domain FROM access_events WHERE branch = 'branch-a'"),
)
def _(d: Data) -> DataFrame:
    """A gzip archive of one branch, written and read back."""
    path = scratch_dir(d.spark, "archive")
    one = d.spark.createDataFrame([("branch-a",)], "branch string")
    runs = d.spark.createDataFrame([("branch-a", SINCE)], "branch string, archived_until timestamp_ntz")
    archive.run_archive(d.events, one, runs, UNTIL, path)
    files = d.spark.read.option("header", True).option("escape", '"').csv(path)
    return files.select(F.col("id").cast("long").alias("id"), "branch", "method", "domain")


@query("store_two_grains", with_sql("SELECT * FROM client_rows", TWO_GRAINS_SQL))
def _(d: Data) -> DataFrame:
    """Client minutes stored, those before noon rolled up to hours, both read back."""
    store = LogStore(d.spark, scratch_dir(d.spark, "two-grains"))
    store.write_partials(0, CLIENT_MINUTE, d.client_minutes)
    store.commit(0)
    store.roll_up_hours(NOON)
    return clients.client_bucket_rows(store.rollup(CLIENT_MINUTE), store.rollup(CLIENT_HOURLY), SINCE, UNTIL)


@query("store_compacted", with_sql("SELECT * FROM domain_minute"))
def _(d: Data) -> DataFrame:
    """Domain minutes stored as two batches and folded."""
    store = LogStore(d.spark, scratch_dir(d.spark, "compacted"))
    for batch, rows in enumerate((d.events.where("blocked"), d.events.where("NOT blocked"))):
        store.write_partials(batch, DOMAIN_MINUTE, rollup.domain_minute(rows))
        store.commit(batch)
    store.fold(DOMAIN_MINUTE.name, store.dates(DOMAIN_MINUTE.name))
    return store.rollup(DOMAIN_MINUTE).drop("event_date")


# ----- reports, one per branch in one pass ---------------------------------


def _report(d: Data) -> dict[str, DataFrame]:
    return report.branch_reports(
        d.minutes, d.domain_minutes, d.client_minutes, None, d.alerts, d.rules, SINCE, UNTIL
    )


@query(
    "report_summary",
    with_sql(
        """SELECT branch, count(*) AS total_requests, count(*) FILTER (blocked) AS blocked_requests,
          count(*) FILTER (NOT blocked) AS allowed_requests, count(DISTINCT client_ip) AS active_client_count,
          count(DISTINCT "user") AS active_user_count FROM access_events GROUP BY branch"""
    ),
)
def _(d: Data) -> DataFrame:
    return _report(d)["summary"]


def _branch_top_sql(order: str, having: str) -> str:
    return with_sql(
        f"""SELECT branch, domain, request_count, blocked_count, total_bytes, CAST(rank AS INTEGER) AS rank, category FROM (
          SELECT *, row_number() OVER (PARTITION BY branch ORDER BY {order} DESC, domain) AS rank FROM (
            SELECT branch, {DOMAIN_SUMS_SQL[7:]} GROUP BY branch, domain {having}) s) t
        JOIN categories USING (domain) WHERE rank <= 10""",
        fx.CATEGORIES_SQL,
    )


@query("report_top_domains", _branch_top_sql("request_count", ""))
def _(d: Data) -> DataFrame:
    return _report(d)["top_domains"]


@query("report_top_blocked", _branch_top_sql("blocked_count", "HAVING sum(blocked_count) > 0"))
def _(d: Data) -> DataFrame:
    return _report(d)["top_blocked"]


@query(
    "report_by_category",
    with_sql(
        """SELECT branch, category, CAST(sum(request_count) AS BIGINT) AS request_count, CAST(sum(blocked_count) AS BIGINT) AS blocked_count,
          CAST(sum(total_bytes) AS BIGINT) AS total_bytes FROM domain_minute JOIN categories USING (domain) GROUP BY 1, 2""",
        fx.CATEGORIES_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    return _report(d)["by_category"]


@query(
    "report_anomalies",
    with_sql(
        """SELECT generated_at, client_ip, branch, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (
          PARTITION BY branch ORDER BY generated_at DESC, client_ip) AS rank FROM blocked_alerts) t WHERE rank <= 20""",
        fx.ALERTS_SQL,
    ),
)
def _(d: Data) -> DataFrame:
    return _report(d)["anomalies"].select("generated_at", "client_ip", "branch", "rank")
