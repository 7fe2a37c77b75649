"""Session settings the engine relies on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# AQE coalesces small shuffle partitions, splits skewed ones and switches to
# broadcast when a materialised side turns out small.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.compression.codec": "zstd",
    # Lists of names up to this long are tested against Parquet's statistics and Bloom filters.
    "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
}

UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")


def build_session(app_name: str = "trafficloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def require_utc(spark: SparkSession) -> None:
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in UTC_NAMES:
        raise ValueError(f"the session time zone must be UTC, not {zone}")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location.

    ``spark.checkpoint.dir`` names storage every executor can reach. Where it
    is unset, a session that runs inside one process takes a local temporary
    folder; on a cluster rows written there would be lost, so that is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="trafficloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
