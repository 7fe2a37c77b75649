"""Anomalies placed on the points of a time series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficloom.functions.timeparts import epoch_micros, floor_to
from trafficloom.operators.anomalies import severity_rank

# Fixed value: how many bucket widths (of at least a minute) a marker may move.
SNAP_BUCKETS = 2


def snap_to_series(anomalies: DataFrame, points: DataFrame, bucket_seconds: int = 60) -> DataFrame:
    """The most severe anomaly of every series point, each anomaly on its nearest point.

    ``points`` has one row per ``bucket_ts``. Points lie on the bucket grid, so
    only a fixed handful of grid times can be near an anomaly: the nearest-point
    join is an equi-join on those times. Ties go to the earlier point, and
    among equally severe anomalies to the earlier one, then by title.
    """
    snap_seconds = SNAP_BUCKETS * max(bucket_seconds, 60)
    reach = snap_seconds // bucket_seconds
    own = floor_to(F.col("generated_at"), bucket_seconds)
    offsets = F.explode(F.array(*[F.lit(k * bucket_seconds) for k in range(-reach, reach + 1)]))
    # Anomalies of one instant share a point, so only the most severe of them goes on.
    leading = F.min(F.struct((-severity_rank(F.col("severity"))).alias("order"), "title", "severity"))
    instants = anomalies.groupBy("generated_at").agg(leading.alias("lead"))
    near = (
        instants.withColumn("offset", offsets)
        .withColumn("bucket_ts", F.timestamp_add("SECOND", F.col("offset"), own))
        .join(points.select("bucket_ts"), "bucket_ts")
        .withColumn("distance", F.abs(epoch_micros(F.col("bucket_ts")) - epoch_micros(F.col("generated_at"))))
        .where(F.col("distance") <= snap_seconds * 1_000_000)
    )
    nearest = near.groupBy("generated_at").agg(
        F.min(F.struct("distance", "bucket_ts")).alias("point"), F.first("lead").alias("lead")
    )
    picked = nearest.select(
        F.col("point.bucket_ts").alias("bucket_ts"),
        F.struct(F.col("lead.order"), "generated_at", F.col("lead.title"), F.col("lead.severity")).alias("mark"),
    )
    return (
        picked.groupBy("bucket_ts")
        .agg(F.min("mark").alias("mark"))
        .select("bucket_ts", "mark.generated_at", "mark.title", "mark.severity")
    )
