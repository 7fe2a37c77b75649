"""The access-event view over the ``events`` table, in Spark and in SQL, and small dimensions."""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficloom import fixed_values as fv
from trafficloom.functions.network import add_domain, last_labels
from trafficloom.operators.anomalies import client_blocked_ratio
from trafficloom.operators.categorize import CategoryRules
from trafficloom.operators.rollup import client_hourly, client_minute, domain_minute, minute_totals
from trafficloom.functions.timeparts import hour_of

SINCE = dt.datetime(2024, 1, 1)
UNTIL = dt.datetime(2024, 1, 2)
NOON = dt.datetime(2024, 1, 1, 12)
LAST_HOUR = dt.datetime(2024, 1, 1, 23)
# The window of the first-time checks, with a little history before it.
EARLY = dt.datetime(2024, 1, 1, 0, 5)
EARLY_END = dt.datetime(2024, 1, 1, 0, 35)

# The 30 days of the table are squeezed into one, so that minutes and sessions
# hold several events.
_VIEW_BODY = """
  CAST(event_id * 37 % 797 + 2 AS BIGINT) AS duration_ms,
  concat('10.', CAST(16 + user_id % 4 AS {text}), '.0.', CAST(user_id % 40 + 1 AS {text})) AS client_ip,
  CASE user_id % 3 WHEN 0 THEN 'branch-a' WHEN 1 THEN 'branch-b' ELSE 'default' END AS branch,
  CASE event_type WHEN 'error' THEN 'TCP_DENIED' WHEN 'view' THEN 'TCP_MEM_HIT' WHEN 'click' THEN 'TCP_MISS'
                  WHEN 'signup' THEN 'TCP_TUNNEL' ELSE 'TCP_REFRESH_MODIFIED' END AS action,
  CASE event_type WHEN 'error' THEN 403 ELSE 200 END AS status_code,
  CAST(floor(value * 1000) AS BIGINT) AS bytes,
  CASE event_type WHEN 'signup' THEN 'CONNECT' WHEN 'purchase' THEN 'POST' ELSE 'GET' END AS method,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE
    CASE (user_id * 7 + event_id % 3) % 12
      WHEN 0 THEN 'www.youtube.com' WHEN 1 THEN 'aws.amazon.com' WHEN 2 THEN 'amazon.com'
      WHEN 3 THEN 'gambling-paradise.bet' WHEN 4 THEN 'github.com' WHEN 5 THEN 'intranet.local'
      WHEN 6 THEN 'adult-content-site.xxx' WHEN 7 THEN 'music.yandex.ru' WHEN 8 THEN 'notyoutube.com'
      WHEN 9 THEN 'my-online-casino.com' WHEN 10 THEN 'Slack.com' ELSE 'cdn.example.net' END END AS domain,
  CASE WHEN user_id % 4 = 0 THEN NULL ELSE concat('user', CAST(user_id AS {text})) END AS {user},
  event_type = 'error' AS blocked,
  CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'HIER_DIRECT' WHEN 2 THEN 'HIER_NONE' ELSE 'FIRSTUP_PARENT' END AS hierarchy,
  CASE event_id % 4 WHEN 1 THEN '10.9.8.7' WHEN 3 THEN 'cache-1' ELSE NULL END AS peer,
  CASE event_id % 5 WHEN 0 THEN 'text/html; charset=UTF-8' WHEN 1 THEN NULL WHEN 2 THEN 'image/png'
                    WHEN 3 THEN 'application/json' ELSE 'text/css' END AS content_type
"""
_URL = """
  CASE WHEN method = 'CONNECT' THEN coalesce(domain || ':443', '-')
       ELSE concat('http://', coalesce(domain, ''), '/item?id=', CAST(id AS {text})) END AS url
"""
# A log line in the 10-field form, times in milliseconds, the duration padded.
_LINE = """concat_ws(' ', concat(CAST({ms} {div} 1000 AS {text}), '.', lpad(CAST({ms} % 1000 AS {text}), 3, '0')),
  lpad(CAST(duration_ms AS {text}), 6, ' '), {ip}, {status}, CAST(bytes AS {text}), method, url,
  coalesce({user}, '-'), coalesce(hierarchy || '/' || coalesce(peer, '-'), '-'), coalesce(content_type, '-'))"""

# How the lines of the damaged view differ from the good ones, by event.
DAMAGE = ("short", "bad_time", "bad_ip", "open_shape", "blank", "ipv6", "mapped_ipv6", "bad_ipv6", "tabs", "good", "good")


def _damaged(text: str, user: str, ms: str, div: str) -> tuple[str, str]:
    """Two steps: the line with odd addresses and tags, then what else is odd about it."""
    kind = f"id % {len(DAMAGE)}"
    ip = f"""CASE {kind} WHEN 2 THEN client_ip || '9.1' WHEN 5 THEN '2001:db8::' || CAST(id % 9999 AS {text})
      WHEN 6 THEN '::ffff:' || client_ip WHEN 7 THEN '1::2::3' ELSE client_ip END"""
    status = f"CASE {kind} WHEN 3 THEN action ELSE action || '/' || CAST(status_code AS {text}) END"
    line = _LINE.format(text=text, user=user, ms=ms, div=div, ip=ip, status=status)
    value = f"""CASE {kind} WHEN 0 THEN concat_ws(' ', '1704067200.000', client_ip, action) WHEN 1 THEN 'x' || line
      WHEN 3 THEN line || ' tail' WHEN 4 THEN '  ' WHEN 8 THEN replace(line, ' ', chr(9)) ELSE line END"""
    return line, value


def spark_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    body = _VIEW_BODY.format(text="STRING", user="`user`")
    timed = spark.sql(
        f"""SELECT event_id AS id,
          timestampadd(MICROSECOND,
            timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div 30,
            timestamp_ntz'2024-01-01 00:00:00') AS timestamp, {body} FROM {{events}}""",
        events=events,
    )
    return timed.selectExpr("*", _URL.format(text="STRING"))


SQL_VIEW = f"""access_base AS (
  SELECT event_id AS id,
    make_timestamp(epoch_us(TIMESTAMP '2024-01-01') + (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 30) AS "timestamp",
    {_VIEW_BODY.format(text="VARCHAR", user='"user"')} FROM events),
access_events AS (SELECT *, {_URL.format(text="VARCHAR")} FROM access_base)"""

OVERRIDES = (("cdn.example.net", "other"), ("slack.com", "gaming"), ("intranet.local", "uncategorized"))
SETTINGS = (
    ("branch-a", "gambling, adult_content, no_such_label", 40, 900_000, 10),
    ("branch-b", "shopping", 0, None, None),
)
# Earlier alerts that silence a repeat: title key, generated_at, client, domain, branch.
FLAGGED = (
    ("byte_quota", "2024-01-01 20:00:00", "10.16.0.1", None, "branch-a"),
    ("byte_quota", "2023-12-31 20:00:00", "10.17.0.10", None, "branch-a"),
    ("non_work_time", "2024-01-01 06:30:00", "10.18.0.3", None, "default"),
    ("uncategorized_domain", "2023-12-28 00:00:00", None, "notyoutube.com", "branch-a"),
)


def sql_values(rows: tuple, types: tuple[str, ...]) -> str:
    def literal(value, as_type: str) -> str:
        if value is None:
            return f"CAST(NULL AS {as_type})"
        quoted = str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"
        return f"CAST({quoted} AS {as_type})"

    return "(VALUES " + ", ".join("(" + ", ".join(literal(v, t) for v, t in zip(row, types)) + ")" for row in rows) + ")"


_MINUTES_SQL = """minute_totals AS (
  SELECT date_trunc('minute', "timestamp") AS bucket_ts, branch, count(*) AS total_requests,
    count(*) FILTER (blocked) AS blocked_requests, count(*) FILTER (NOT blocked) AS allowed_requests,
    CAST(sum(bytes) AS BIGINT) AS total_bytes, count(*) FILTER (action LIKE '%HIT%') AS hit_requests,
    count(*) FILTER (action NOT LIKE '%HIT%' AND action LIKE '%MISS%') AS miss_requests
  FROM access_events GROUP BY 1, 2),
domain_minute AS (
  SELECT date_trunc('minute', "timestamp") AS bucket_ts, domain, branch, count(*) AS request_count,
    count(*) FILTER (blocked) AS blocked_count, CAST(sum(bytes) AS BIGINT) AS total_bytes
  FROM access_events WHERE domain IS NOT NULL GROUP BY 1, 2, 3),
client_minute AS (
  SELECT date_trunc('minute', "timestamp") AS bucket_ts, client_ip, branch, "user", count(*) AS request_count,
    count(*) FILTER (blocked) AS blocked_count, CAST(sum(bytes) AS BIGINT) AS total_bytes
  FROM access_events GROUP BY 1, 2, 3, 4)"""


def category_sql(name: str, domains: str, overrides: str, blocklist: str | None = None) -> str:
    """A CTE ``name`` (domain, category) over the distinct domains of a query."""
    tlds = " ".join(f"WHEN ends_with(lower(d.domain), '{t}') THEN '{c}'" for t, c in fv.TLD_CATEGORIES)
    words = " ".join(f"WHEN contains(lower(d.domain), '{k}') THEN '{c}'" for k, c in fv.KEYWORD_CATEGORIES)
    hosts = sql_values(fv.STARTER_HOSTNAMES, ("VARCHAR", "VARCHAR"))
    listed = "NULL"
    if blocklist is not None:
        listed = f"""(SELECT arg_min(b.label, b.priority) FROM ({blocklist}) b
          WHERE lower(d.domain) = b.domain OR ends_with(lower(d.domain), '.' || b.domain))"""
    return f"""{name} AS (
      SELECT d.domain, coalesce(
        (SELECT max(o.category) FROM ({overrides}) o WHERE o.domain = d.domain),
        (SELECT arg_max(h.category, length(h.hostname)) FROM {hosts} h(hostname, category)
          WHERE lower(d.domain) = h.hostname OR ends_with(lower(d.domain), '.' || h.hostname)),
        {listed}, CASE {tlds} {words} END, 'uncategorized') AS category
      FROM ({domains}) d)"""


OVERRIDES_SQL = f"SELECT * FROM {sql_values(OVERRIDES, ('VARCHAR', 'VARCHAR'))} o(domain, category)"
SETTINGS_SQL = f"""settings AS (SELECT * FROM {sql_values(SETTINGS, ('VARCHAR', 'VARCHAR', 'INTEGER', 'BIGINT', 'INTEGER'))}
  s(branch, sensitive, non_work_minutes, byte_quota, uncategorized_threshold))"""
FLAGGED_SQL = f"""flagged AS (SELECT * FROM {sql_values(FLAGGED, ('VARCHAR', 'TIMESTAMP', 'VARCHAR', 'VARCHAR', 'VARCHAR'))}
  f(kind, generated_at, client_ip, domain, branch))"""
CATEGORIES_SQL = category_sql(
    "categories", "SELECT DISTINCT domain FROM access_events WHERE domain IS NOT NULL", OVERRIDES_SQL
)
# Hourly windows in which at least half of a client's requests were blocked.
ALERTS_SQL = """alert_rows AS (
  SELECT branch, client_ip, date_trunc('hour', "timestamp") AS hour, count(*) AS total,
    count(*) FILTER (blocked) AS blocked FROM access_events GROUP BY 1, 2, 3),
hour_bounds AS (SELECT branch, date_trunc('hour', "timestamp") AS hour, max("timestamp") AS generated_at
  FROM access_events GROUP BY 1, 2),
blocked_alerts AS (
  SELECT b.generated_at, a.branch, a.client_ip, a.total, a.blocked,
    CAST(round_even(a.blocked / a.total * 100, 0) AS BIGINT) AS percent
  FROM alert_rows a JOIN hour_bounds b USING (branch, hour)
  WHERE a.total >= 5 AND a.blocked / a.total >= 0.5)"""
HOST_SQL = r"""page_hosts AS (
  SELECT page_id, url, lower(split_part(regexp_replace(
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':', 1)) AS domain FROM pages)"""
# A blocklist derived from the pages: parents of hosts served over plain http.
PAGE_BLOCKLIST_SQL = f"""SELECT DISTINCT parent AS domain, label, priority FROM (
    SELECT coalesce(nullif(regexp_extract(domain, '[^.]+[.][^.]+[.][^.]+$'), ''), domain) AS parent, url FROM page_hosts) p
  JOIN {sql_values(tuple(enumerate(fv.BLOCKLIST_PRIORITY)), ('INTEGER', 'VARCHAR'))} l(priority, label)
    ON length(p.parent) % 8 = l.priority
  WHERE url LIKE 'http://%'"""
PAGE_OVERRIDES_SQL = "SELECT DISTINCT domain, 'work_tools' AS category FROM page_hosts WHERE domain LIKE 'm.%'"


def with_sql(body: str, *ctes: str) -> str:
    return f"WITH {', '.join([SQL_VIEW, _MINUTES_SQL, *ctes])} {body}"


def damaged_lines_sql() -> str:
    line, value = _damaged("VARCHAR", '"user"', '(epoch_us("timestamp") // 1000)', "//")
    return f"""damaged AS (SELECT id, branch, {value} AS value FROM (
      SELECT id, branch, client_ip, action, {line} AS line FROM access_events) l)"""


class Data:
    """Frames over one scale-factor folder, built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def events(self) -> DataFrame:
        return spark_view(self.spark, self.sf_dir)

    def lines(self, rows: Column | None = None, damaged: bool = False) -> DataFrame:
        """The events, or some of them, as raw log lines; damaged in fixed ways on request."""
        ms = "(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', timestamp) div 1000)"
        events = self.events if rows is None else self.events.where(rows)
        if damaged:
            line, value = _damaged("STRING", "`user`", ms, "div")
            lines = events.selectExpr("id", "branch", "client_ip", "action", f"{line} AS line")
            return self._built(lines.selectExpr(f"{value} AS value", "branch"))
        status = "action || '/' || CAST(status_code AS STRING)"
        text = _LINE.format(text="STRING", user="`user`", ms=ms, div="div", ip="client_ip", status=status)
        return self._built(events.selectExpr(f"{text} AS value", "branch"))

    @staticmethod
    def _built(lines: DataFrame) -> DataFrame:
        """Lines as they would come from a file: put together once, not again in every use."""
        return lines.select(F.explode(F.array("value")).alias("value"), "branch")

    @cached_property
    def minutes(self) -> DataFrame:
        return minute_totals(self.events)

    @cached_property
    def domain_minutes(self) -> DataFrame:
        return domain_minute(self.events)

    @cached_property
    def client_minutes(self) -> DataFrame:
        return client_minute(self.events)

    def two_grains(self) -> tuple[DataFrame, DataFrame]:
        """Client minutes from noon on, and hours before it."""
        cut = F.lit(NOON).cast("timestamp_ntz")
        rows = self.client_minutes
        return rows.where(F.col("bucket_ts") >= cut), client_hourly(rows.where(F.col("bucket_ts") < cut))

    @cached_property
    def overrides(self) -> DataFrame:
        return self.spark.createDataFrame(list(OVERRIDES), "domain string, category string")

    @cached_property
    def rules(self) -> CategoryRules:
        return CategoryRules(overrides=self.overrides)

    @cached_property
    def settings(self) -> DataFrame:
        from trafficloom.sources.dimensions import parse_sensitive

        raw = self.spark.createDataFrame(
            list(SETTINGS),
            "branch string, sensitive string, non_work_minutes int, byte_quota bigint, uncategorized_threshold int",
        )
        return raw.withColumn("sensitive_categories", parse_sensitive(F.col("sensitive"))).drop("sensitive")

    @cached_property
    def flagged(self) -> DataFrame:
        rows = [(fv.TITLES[k], t, c, d, b) for k, t, c, d, b in FLAGGED]
        raw = self.spark.createDataFrame(
            rows, "title string, generated_at string, client_ip string, domain string, branch string"
        )
        return raw.withColumn("generated_at", F.col("generated_at").cast("timestamp_ntz"))

    @cached_property
    def branches(self) -> DataFrame:
        return self.events.select("branch").distinct()

    @cached_property
    def archive_runs(self) -> DataFrame:
        """Watermarks derived from the events: two branches at their last blocked event."""
        done = self.events.where((F.col("branch") != "default") & F.col("blocked"))
        return done.groupBy("branch").agg(F.max("timestamp").alias("archived_until"))

    @cached_property
    def alerts(self) -> DataFrame:
        """Anomalies over hourly windows of the whole table."""
        return client_blocked_ratio(self.events.withColumn("hour", hour_of(F.col("timestamp"))), "hour")

    @cached_property
    def page_hosts(self) -> DataFrame:
        pages = self.spark.read.parquet(f"{self.sf_dir}/pages.parquet").select("page_id", "url")
        return add_domain(pages.withColumn("method", F.lit("GET")), "url", "method").drop("method")

    @cached_property
    def page_rules(self) -> CategoryRules:
        labels = self.spark.createDataFrame(list(enumerate(fv.BLOCKLIST_PRIORITY)), "priority int, label string")
        parents = self.page_hosts.where(F.col("url").startswith("http://")).select(
            last_labels(F.col("domain"), 3).alias("domain")
        )
        blocklist = (
            parents.distinct()
            .withColumn("priority", F.length("domain") % 8)
            .join(F.broadcast(labels), "priority")
            .select("domain", "label", "priority")
        )
        overrides = (
            self.page_hosts.where(F.col("domain").startswith("m."))
            .select("domain", F.lit("work_tools").alias("category"))
            .distinct()
        )
        return CategoryRules(overrides=overrides, blocklist=blocklist)
