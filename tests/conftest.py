import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trafficloom import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


EVENT_COLUMNS = (
    "id bigint, timestamp timestamp_ntz, duration_ms bigint, client_ip string, branch string, action string, "
    "status_code int, bytes bigint, method string, url string, domain string, user string, hierarchy string, "
    "peer string, content_type string, blocked boolean"
)


@pytest.fixture
def make_events(spark):
    """Events from short dicts; everything not given has a default."""

    def build(rows):
        full = []
        for number, row in enumerate(rows):
            blocked = row.get("blocked", False)
            domain = row.get("domain", "example.org")
            full.append(
                (
                    row.get("id", number),
                    row["timestamp"],
                    5,
                    row.get("client_ip", "10.0.0.1"),
                    row.get("branch", "default"),
                    row.get("action", "TCP_DENIED" if blocked else "TCP_MISS"),
                    403 if blocked else 200,
                    row.get("bytes", 100),
                    "GET",
                    row.get("url", f"http://{domain}/"),
                    domain,
                    row.get("user"),
                    None,
                    None,
                    None,
                    blocked,
                )
            )
        return spark.createDataFrame(full, EVENT_COLUMNS)

    return build
