"""Lag signals from the progress of streaming queries.

A query keeps its last 100 progress reports. ``ProgressLog`` is told of every
one and keeps them all in a table, from which the lag of any time can be read.
"""

from __future__ import annotations

from collections.abc import Iterable

import datetime as dt
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener

from trafficloom.fixed_values import LAG_RISK_RATIO
from trafficloom.functions.timeparts import ntz
from trafficloom.plans.files import delete, overwrite_partitions, partitions, read_or_empty

log = logging.getLogger(__name__)

PROGRESS = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("input_rows", T.LongType()),
        T.StructField("input_rows_per_second", T.DoubleType()),
        T.StructField("processed_rows_per_second", T.DoubleType()),
        T.StructField("duration_ms", T.LongType()),
    ]
)


LOGGED = T.StructType(
    [
        *PROGRESS.fields[1:],
        T.StructField("reported_at", T.TimestampNTZType()),
        T.StructField("query_id", T.StringType()),
        T.StructField("batch_id", T.LongType()),
    ]
)


class ProgressLog(StreamingQueryListener):
    """Adds every progress report of the session's streaming queries to a table.

    One folder per query and batch: a report that comes again, as after a
    restart, replaces itself. A report that cannot be written is logged and
    never disturbs the query.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        try:
            p = event.progress
            at = dt.datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")).replace(tzinfo=None)
            took = int(dict(p.durationMs).get("triggerExecution", 0))
            rates = (float(p.inputRowsPerSecond or 0.0), float(p.processedRowsPerSecond or 0.0))
            row = (int(p.numInputRows), *rates, took, at, str(p.id), int(p.batchId))
            overwrite_partitions(self.spark.createDataFrame([row], LOGGED).coalesce(1), self.path, "query_id", "batch_id")
        except Exception:
            log.exception("a progress report was not written")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def rows(self) -> DataFrame:
        return read_or_empty(self.spark, self.path, LOGGED)

    def drop_before(self, time: dt.datetime) -> int:
        """Delete reports that are older than a time."""
        old = self.rows().where(F.col("reported_at") < ntz(time)).select("query_id", F.col("batch_id").cast("string").alias("b"))
        # One row per batch that is old.
        gone = {(r["query_id"], r["b"]) for r in old.collect()}
        found = [p for p in partitions(self.spark, self.path, "query_id", "batch_id") if (p["query_id"], p["batch_id"]) in gone]
        for p in found:
            delete(self.spark, p["path"])
        return len(found)


def progress_rows(spark: SparkSession, recent: Iterable) -> DataFrame:
    """``query.recentProgress`` (at most 100 entries) as rows for a metrics table."""
    rows = [
        (
            int(p["batchId"]),
            int(p["numInputRows"]),
            float(p["inputRowsPerSecond"] or 0.0),
            float(p["processedRowsPerSecond"] or 0.0),
            int(p["durationMs"].get("triggerExecution", 0)),
        )
        for p in recent
    ]
    return spark.createDataFrame(rows, PROGRESS)


def lag_signals(progress: DataFrame, interval_ms: int = 60_000) -> DataFrame:
    """How much of the flush interval each batch used, and whether it risks falling behind."""
    used = F.col("duration_ms") / F.lit(interval_ms)
    return progress.select(
        "batch_id", "input_rows", used.alias("backlog_ratio"), (used >= LAG_RISK_RATIO).alias("at_risk")
    )
