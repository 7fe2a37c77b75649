"""Table schemas, keys and measures.

Timestamps are TIMESTAMP_NTZ holding UTC wall time. Sessions must run in UTC,
which ``build_session`` sets and ``LogStore`` checks: time arithmetic goes
through the session time zone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("timestamp", T.TimestampNTZType(), False),
        T.StructField("duration_ms", T.LongType(), False),
        T.StructField("client_ip", T.StringType(), False),
        T.StructField("branch", T.StringType(), False),
        T.StructField("action", T.StringType(), False),
        T.StructField("status_code", T.IntegerType(), False),
        T.StructField("bytes", T.LongType(), False),
        T.StructField("method", T.StringType(), False),
        T.StructField("url", T.StringType(), False),
        T.StructField("domain", T.StringType(), True),
        T.StructField("user", T.StringType(), True),
        T.StructField("hierarchy", T.StringType(), True),
        T.StructField("peer", T.StringType(), True),
        T.StructField("content_type", T.StringType(), True),
        T.StructField("blocked", T.BooleanType(), False),
    ]
)

ANOMALY = T.StructType(
    [
        T.StructField("generated_at", T.TimestampNTZType()),
        T.StructField("kind", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("client_ip", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("branch", T.StringType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    ]
)


@dataclass(frozen=True)
class RollupSpec:
    """A table of mergeable measures: rows with equal keys may be merged freely.

    Measures are sums, or minima of ``time`` where ``merge`` says so.
    """

    name: str
    keys: tuple[str, ...]
    measures: tuple[str, ...]
    merge: str = "sum"
    time: str = "bucket_ts"

    def merged(self) -> list[Column]:
        combine = {"sum": F.sum, "min": F.min}[self.merge]
        return [combine(m).alias(m) for m in self.measures]


MINUTE_TOTALS = RollupSpec(
    "minute_totals",
    ("bucket_ts", "branch"),
    (
        "total_requests",
        "blocked_requests",
        "allowed_requests",
        "total_bytes",
        "hit_requests",
        "miss_requests",
    ),
)
DOMAIN_MINUTE = RollupSpec(
    "domain_minute",
    ("bucket_ts", "domain", "branch"),
    ("request_count", "blocked_count", "total_bytes"),
)
CLIENT_MINUTE = RollupSpec(
    "client_minute",
    ("bucket_ts", "client_ip", "branch", "user"),
    ("request_count", "blocked_count", "total_bytes"),
)
CLIENT_HOURLY = RollupSpec("client_hourly", CLIENT_MINUTE.keys, CLIENT_MINUTE.measures)
CLIENT_CATEGORY_MINUTE = RollupSpec(
    "client_category_minute",
    ("bucket_ts", "client_ip", "category", "branch"),
    ("request_count", "total_bytes"),
)

# Which client opened which domain, and when first; and the same for anyone of a branch.
CLIENT_DOMAIN_SEEN = RollupSpec(
    "client_domain_seen", ("client_ip", "branch", "domain"), ("first_seen",), merge="min", time="first_seen"
)
DOMAIN_SEEN = RollupSpec("domain_seen", ("branch", "domain"), ("first_seen",), merge="min", time="first_seen")

RAW_EVENTS = "raw_events"
ANOMALIES = "anomalies"
FLUSHED_ROLLUPS = (MINUTE_TOTALS, DOMAIN_MINUTE, CLIENT_MINUTE, CLIENT_CATEGORY_MINUTE, CLIENT_DOMAIN_SEEN, DOMAIN_SEEN)
ALL_ROLLUPS = (*FLUSHED_ROLLUPS, CLIENT_HOURLY)
# Kept in buckets, and merged by number of batch.
SEEN_ROLLUPS = (CLIENT_DOMAIN_SEEN, DOMAIN_SEEN)
