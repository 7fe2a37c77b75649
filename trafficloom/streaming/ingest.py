"""Log files to stored tables, one micro-batch at a time."""

from __future__ import annotations

import datetime as dt
import json
import logging
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trafficloom import schema
from trafficloom.operators.anomalies import DetectionInput, carried_minutes, detector, outside_carried
from trafficloom.operators.categorize import CategoryRules
from trafficloom.operators.parse import parse_lines
from trafficloom.plans.store import MAIN, LogStore
from trafficloom.schema import ANOMALIES, CLIENT_DOMAIN_SEEN, DOMAIN_SEEN, MINUTE_TOTALS

log = logging.getLogger(__name__)


class Ingest:
    """Writes each micro-batch of lines to a store.

    All tables of a batch are keyed by the ingest and the batch id, and the
    batch counts only once its marker is written. A batch that fails half-way
    is repeated without doubling anything; one that is committed is not written
    again. Any number of ingests may write to one store at the same time.
    Started on a checkpoint, an ingest is known by the id that Spark keeps
    there, so that a new checkpoint, whose batches begin at 0, is a new ingest;
    a name given for ``ingest`` must stay with one checkpoint.
    """

    def __init__(
        self,
        store: LogStore,
        rules: CategoryRules | None = None,
        settings: DataFrame | None = None,
        detector_name: str = "noop",
        ingest: str | None = None,
    ) -> None:
        self.store = store
        self.rules = rules or CategoryRules()
        self.settings = settings
        self.detects = detector_name != "noop"
        self.detect = detector(detector_name)
        self.ingest = ingest

    def flush(self, lines: DataFrame, batch_id: int, ingest: str | None = None) -> None:
        """Parse once, store events, rejects, roll-ups and running values, look for anomalies, commit."""
        ingest = self.ingest or ingest or MAIN
        mark = self.store.mark(ingest)
        if batch_id <= mark:
            return
        parsed = parse_lines(lines).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            good = F.col("reject_reason").isNull()
            self.store.write_events(batch_id, parsed.where(good).select(*schema.EVENT.names), ingest)
            # A batch has a few dates.
            days = parsed.where(good).select(F.to_date("timestamp").alias("d")).distinct().collect()
            received = F.current_timestamp().cast("timestamp_ntz").alias("received")
            rejects = parsed.where(~good).select("branch", "reject_reason", "line", received)
            self.store.write_rows("rejects", batch_id, rejects, ingest)
            quality = parsed.groupBy("branch").agg(
                F.count(F.lit(1)).alias("lines_seen"), F.count_if(good).alias("lines_parsed")
            )
            before = self.store.carried("quality", ingest, mark).select(*quality.columns)
            sums = [F.sum(c).alias(c) for c in ("lines_seen", "lines_parsed")]
            self.store.write_rows("quality", batch_id, quality.unionByName(before).groupBy("branch").agg(*sums), ingest)
        finally:
            parsed.unpersist()
        # From here on the stored rows are the input: narrow columnar scans that
        # do not depend on cached blocks of executors that may be gone.
        dates = sorted(r["d"] for r in days)
        self.store.write_rollups(batch_id, self.rules, ingest, dates)
        columns = ["branch", "bucket_ts", "total_requests"]
        minutes = self.store.batch_rollup(batch_id, MINUTE_TOTALS, ingest, dates).select(*columns)
        known = self.store.carried("baseline", ingest, mark).select(*columns)
        self.store.write_rows("baseline", batch_id, carried_minutes(minutes.unionByName(known)), ingest)
        self._detect(batch_id, ingest, dates)
        self.store.merge_skipped(mark, batch_id, ingest)
        self.store.merge_seen(batch_id, ingest)
        self.store.commit(batch_id, ingest)

    def _detect(self, batch_id: int, ingest: str, dates: list[dt.date]) -> None:
        """Detectors never break the flush: a failure is logged and the window skipped."""
        try:
            window = self.store.batch_events(batch_id, ingest, dates)
            found = self.detect(
                DetectionInput(
                    window=window,
                    minutes=self._minutes(window) if self.detects else self.store.carried("baseline"),
                    domain_history=lambda some: self.store.first_visits(DOMAIN_SEEN, some),
                    visit_history=lambda some: self.store.first_visits(CLIENT_DOMAIN_SEEN, some),
                    settings=self._settings(),
                    rules=self.rules,
                )
            )
            self.store.write_rows(ANOMALIES, batch_id, found, ingest)
        except Exception:
            log.exception("anomaly detection failed for batch %d", batch_id)

    def _minutes(self, window: DataFrame) -> DataFrame:
        """The carried minutes of all ingests; stored minute totals are scanned only for branches
        whose window is older than what is carried, as when old files arrive late."""
        carried = self.store.carried("baseline").groupBy("branch", "bucket_ts").agg(F.sum("total_requests").alias("total_requests"))
        late = outside_carried(window, carried)
        branches = [r["branch"] for r in late.limit(1_001).collect()]
        if not branches:
            return carried
        stored = self.store.rollup(MINUTE_TOTALS).select(*carried.columns)
        if len(branches) > 1_000:
            return stored
        old = F.col("branch").isin(branches)
        return carried.where(~old).unionByName(stored.where(old))

    def _settings(self) -> DataFrame:
        if self.settings is not None:
            return self.settings
        return self.store.spark.createDataFrame([], "branch string, sensitive_categories array<string>")

    def start(
        self, lines: DataFrame, checkpoint: str, every: str = "60 seconds", available_now: bool = False
    ) -> StreamingQuery:
        """Run over a stream of lines. ``available_now`` stops after what is there."""
        writer = lines.writeStream.foreachBatch(self._flush_hook(checkpoint)).option("checkpointLocation", checkpoint)
        trigger = {"availableNow": True} if available_now else {"processingTime": every}
        return writer.trigger(**trigger).start()

    def _flush_hook(self, checkpoint: str) -> Callable[[DataFrame, int], None]:
        known: list[str] = []

        def hook(lines: DataFrame, batch_id: int) -> None:
            if not known:
                # One line that Spark writes before the first batch.
                about = self.store.spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()
                known.append(json.loads(about["value"])["id"])
            self.flush(lines, batch_id, known[0])

        return hook
