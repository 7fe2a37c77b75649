"""Names, limits and word lists that results depend on.

Everything here must keep its exact spelling; nothing here is logic.
"""

from __future__ import annotations

import pkgutil

# Category labels.
CATEGORIES = (
    "uncategorized",
    "social_media",
    "video_streaming",
    "music_streaming",
    "gaming",
    "work_tools",
    "shopping",
    "news",
    "gambling",
    "adult_content",
    "other",
)
UNCATEGORIZED = "uncategorized"
NON_WORK_EXEMPT = ("work_tools", "uncategorized")

# Severities, lowest first.
SEVERITIES = ("low", "medium", "high", "critical")

# Top-level domains that imply a category.
TLD_CATEGORIES = (
    (".bet", "gambling"),
    (".casino", "gambling"),
    (".poker", "gambling"),
    (".xxx", "adult_content"),
)

# Keywords that imply a category, first match wins.
KEYWORD_CATEGORIES = (
    ("gambl", "gambling"),
    ("casino", "gambling"),
    ("poker", "gambling"),
    ("porn", "adult_content"),
    ("xxx", "adult_content"),
    ("adult", "adult_content"),
    ("music", "music_streaming"),
    ("game", "gaming"),
    ("stream", "video_streaming"),
    ("video", "video_streaming"),
    ("social", "social_media"),
    ("shop", "shopping"),
    ("store", "shopping"),
    ("news", "news"),
)

# Blocklist folder name -> category label.
BLOCKLIST_FOLDERS = (
    ("adult", "adult_content"),
    ("gambling", "gambling"),
    ("arjel", "gambling"),
    ("games", "gaming"),
    ("social_networks", "social_media"),
    ("shopping", "shopping"),
    ("press", "news"),
    ("audio-video", "video_streaming"),
    ("radio", "music_streaming"),
)

# Label order that decides when a domain is on several blocklists.
BLOCKLIST_PRIORITY = (
    "adult_content",
    "gambling",
    "gaming",
    "social_media",
    "music_streaming",
    "video_streaming",
    "shopping",
    "news",
)

# Well-known hosts, all that the reference knows, from known_hosts.csv.
# A deployment may pass its own list (a hostname,category CSV, see sources.dimensions).
STARTER_HOSTNAMES = tuple(
    tuple(line.split(",")) for line in pkgutil.get_data("trafficloom", "known_hosts.csv").decode().splitlines()[1:]
)

# Column widths of stored events.
MAX_LENGTHS = {
    "action": 64,
    "method": 16,
    "domain": 255,
    "user": 255,
    "hierarchy": 64,
    "peer": 64,
    "content_type": 128,
}
DENIED_PREFIX = "TCP_DENIED"
DENIED_STATUSES = (403, 407)
DEFAULT_BRANCH = "default"

# Columns an export may carry, in their canonical order.
EXPORT_COLUMNS = (
    "id",
    "timestamp",
    "client_ip",
    "branch",
    "user",
    "method",
    "url",
    "domain",
    "action",
    "status_code",
    "bytes",
    "blocked",
)
RECENT_EXPORT_ROWS = 100_000
FEED_ROWS = 200
FEED_WAIT_MS = 200
# Lanes over which a branch's full batches are dealt.
FEED_LANES = 64

# Detector thresholds.
SESSION_GAP_MINUTES = 30
SPIKE_MULTIPLIER = 3.0
SPIKE_BASELINE_MINUTES = 10
SPIKE_MIN_MINUTES = 5
BLOCKED_RATIO = 0.5
BLOCKED_MIN_REQUESTS = 5
MAX_WINDOW_SPREAD_SECONDS = 3600
DEFAULT_NON_WORK_MINUTES = 120
QUOTA_CRITICAL_MULTIPLE = 2
UNCATEGORIZED_CANDIDATES = 20
UNCATEGORIZED_COOLDOWN_DAYS = 7
MONITOR_LOOKBACK_HOURS = 24
PARSE_FAILURE_ALARM = 0.5
LAG_RISK_RATIO = 0.8

# Retention, roll-up and archive periods.
RAW_RETENTION_DAYS = 30
ROLLUP_RETENTION_DAYS = 400
HOURLY_AFTER_HOURS = 48
ARCHIVE_DAYS = 7

# Anomaly kinds and titles (titles key the repeat suppression).
TITLES = {
    "traffic_spike": "Traffic spike detected",
    "new_blocked_domain": "New blocked domain observed",
    "client_blocked_ratio": "Client mostly blocked",
    "sensitive_category_visit": "Sensitive category visited",
    "non_work_time": "Excessive non-work category time",
    "byte_quota": "Client exceeded daily data quota",
    "uncategorized_domain": "High-traffic domain uncategorized",
}

# Report sizes.
REPORT_TOP_DOMAINS = 10
REPORT_ANOMALIES = 20
