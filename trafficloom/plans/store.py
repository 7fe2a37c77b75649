"""Partitioned Parquet tables of events and additive partial sums, for any number of ingests.

Every row is stored under the ingest and the number of the micro-batch that
wrote it, so writing a batch again replaces just its own folders. Batches of an
ingest commit in order: the newest commit marker of an ingest, its mark, says
which of its rows count. Ingests need not know of each other, and upkeep keeps
the newest marker of each, so a replayed batch stays committed for ever.

Upkeep folds dates: their rows are merged and written under the reserved
ingest ``folded``, and one small state table, written last, says which run of a
date counts and which batches it replaces. What is visible depends on the
partition columns alone, so readers are plain scans with partition filters.
"""

from __future__ import annotations

import datetime as dt
import re
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficloom import schema
from trafficloom.functions.timeparts import floor_to, ntz
from trafficloom.operators.categorize import CategoryRules
from trafficloom.operators.distinct import count_sets, id_sets, number_new
from trafficloom.operators.events import newest
from trafficloom.operators.filters import buckets_in_range, hours_overlapping, in_branch
from trafficloom.operators.rollup import all_rollups, client_hourly, merge_partials, seen_bucket, seen_bucket_of
from trafficloom.plans.files import delete, exists, glob, overwrite_partitions, partitions, read_or_empty
from trafficloom.schema import (
    ALL_ROLLUPS,
    ANOMALIES,
    CLIENT_HOURLY,
    CLIENT_MINUTE,
    MINUTE_TOTALS,
    RAW_EVENTS,
    SEEN_ROLLUPS,
    RollupSpec,
)
from trafficloom.session import require_utc

MAIN = "main"
FOLDED = "folded"
FOLDS = "name string, event_date date, ingest string, upto bigint"
RENAMES = "number int, name string, source string, target string, ingest string, upto bigint"
REJECTS = "branch string, reject_reason string, line string, received timestamp_ntz, ingest string, batch_id bigint"
QUALITY = "branch string, lines_seen bigint, lines_parsed bigint, ingest string, batch_id bigint"
BASELINE = "branch string, bucket_ts timestamp_ntz, total_requests bigint, ingest string, batch_id bigint"
CLIENT_SETS = "client_sets"
SETS = "bucket_ts timestamp_ntz, branch string, kind string, chunk bigint, ids binary, bucket int, event_date date, ingest string, batch_id bigint"
CLIENT_IDS = "value string, id bigint, kind string, run bigint"
ID_RUNS = "run bigint, kind string, n bigint"
CARRIED = {"quality": QUALITY, "baseline": BASELINE}
MONITOR_ANOMALIES = "monitor_anomalies"
# Seconds that the sums of a roll-up span.
MINUTE, HOUR, DAY = 60, 3_600, 86_400
BLOCK = 16 * DAY
DELETES_AT_ONCE = 16
# First visits are merged over so many batches, then over as many of those, and so on.
SEEN_FANOUT = 16
SEEN_LEVELS = 4
# Parquet writes a Bloom filter of the domains, as large as their number needs.
BLOOM = {"parquet.bloom.filter.enabled#domain": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
_SPECS = {spec.name: spec for spec in ALL_ROLLUPS}
_TEXT_KEYS = {"branch", "domain", "client_ip", "user", "category"}
_BATCH = [T.StructField("ingest", T.StringType()), T.StructField("batch_id", T.LongType())]


def table_schema(name: str) -> T.StructType:
    """Columns of a stored table, with its partition columns last."""
    date = T.StructField("event_date", T.DateType())
    if name == RAW_EVENTS:
        fields = [f for f in schema.EVENT.fields if f.name != "branch"]
        return T.StructType([*fields, date, T.StructField("branch", T.StringType()), *_BATCH])
    spec = _SPECS[name]
    keys = [T.StructField(k, T.StringType() if k in _TEXT_KEYS else T.TimestampNTZType()) for k in spec.keys]
    measure = T.LongType() if spec.merge == "sum" else T.TimestampNTZType()
    fields = keys + [T.StructField(m, measure) for m in spec.measures]
    return T.StructType([*fields, T.StructField("bucket", T.IntegerType()), date, *_BATCH])


def level_table(name: str, seconds: int) -> str:
    """Where the sums of a roll-up over longer spans are; a minute is the roll-up itself."""
    return name if seconds == MINUTE else f"{name}_{seconds}"


def seen_table(name: str, level: int) -> str:
    """Where the first visits merged over SEEN_FANOUT ** level batches are; level 0 is the roll-up itself."""
    return name if level == 0 else f"{name}_{level}"


class LogStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        require_utc(spark)
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        """The folder of a table; roll-ups are grains of one that is written at once."""
        base = re.sub(r"_\d+$", "", name)
        return f"{self.root}/rollups/grain={name}" if base in _SPECS else f"{self.root}/{name}"

    # ----- writing a batch -------------------------------------------------

    def write_events(self, batch_id: int, events: DataFrame, ingest: str = MAIN) -> None:
        """Append a batch of events. No shuffle: log files are already per branch."""
        rows = events.select(*schema.EVENT.names, F.to_date("timestamp").alias("event_date"), *self._stamp(ingest, batch_id))
        overwrite_partitions(rows, self.path(RAW_EVENTS), *self._layout(RAW_EVENTS))

    @staticmethod
    def _stamp(ingest: str, batch_id: int) -> list[Column]:
        if not re.fullmatch(r"[\w.-]+", ingest):
            raise ValueError(f"{ingest!r} cannot name an ingest: letters, digits, '.', '-' and '_' only")
        return [F.lit(ingest).alias("ingest"), F.lit(batch_id).cast("long").alias("batch_id")]

    @staticmethod
    def _layout(name: str) -> list[str]:
        return ["event_date", "branch" if name == RAW_EVENTS else "bucket", "ingest", "batch_id"]

    def batch_events(self, batch_id: int, ingest: str = MAIN, dates: list[dt.date] | None = None) -> DataFrame:
        """The stored events of one batch, committed or not.

        With the batch's dates only its own folders are listed, so the cost
        does not grow with the number of batches or days stored.
        """
        path = self.path(RAW_EVENTS)
        own = f"branch=*/ingest={ingest}/batch_id={batch_id}"
        folders = [f"{path}/event_date={d}/{own}" for d in (dates if dates is not None else ["*"])]
        folders = [f for f in folders if glob(self.spark, f)]
        if not folders:
            return self.spark.createDataFrame([], schema.EVENT)
        reader = self.spark.read.schema(table_schema(RAW_EVENTS)).option("basePath", path)
        return reader.parquet(*folders).select(*schema.EVENT.names)

    def batch_rollup(self, batch_id: int, spec: RollupSpec, ingest: str = MAIN, dates: list[dt.date] | None = None) -> DataFrame:
        """The partial sums of one batch, committed or not."""
        rows = self._scan(spec.name, spec, dates)
        return rows.where((F.col("ingest") == ingest) & (F.col("batch_id") == batch_id)).select(*spec.keys, *spec.measures)

    def write_partials(self, batch_id: int, spec: RollupSpec, sums: DataFrame, ingest: str = MAIN) -> None:
        """The partial sums of a batch for one roll-up."""
        self._write_grain(spec.name, spec, sums, ingest, batch_id)

    def _write_grain(self, name: str, spec: RollupSpec, rows: DataFrame, ingest: str, batch_id: int, **options: str) -> None:
        bucket = seen_bucket(F.col("domain")) if spec in SEEN_ROLLUPS else F.lit(0)
        stamped = rows.select(
            *spec.keys, *spec.measures, bucket.alias("bucket"), F.to_date(spec.time).alias("event_date"), *self._stamp(ingest, batch_id)
        )
        overwrite_partitions(stamped, self.path(name), *self._layout(name), **options)

    def write_rollups(
        self, batch_id: int, rules: CategoryRules, ingest: str = MAIN, dates: list[dt.date] | None = None
    ) -> None:
        """All flushed roll-ups of a batch, from one scan of its stored events and by one write."""
        wide = all_rollups(self.batch_events(batch_id, ingest, dates), rules)
        date = F.to_date(F.coalesce("bucket_ts", "first_seen")).alias("event_date")
        rows = wide.select("*", date, *self._stamp(ingest, batch_id))
        overwrite_partitions(rows, f"{self.root}/rollups", "grain", "event_date", "bucket", "ingest", "batch_id")

    def merge_seen(self, batch_id: int, ingest: str = MAIN) -> None:
        """Merge the first visits of the last batches, where a level of them is full.

        Every SEEN_FANOUT batches their first visits become one, every
        SEEN_FANOUT of those one again: a reader of n batches opens about
        SEEN_FANOUT * log(n) files of a bucket, and each row is merged as often
        as there are levels. Which merges there are follows from the batch
        number alone, so a repeated batch makes the same ones again.
        """
        for level in range(1, SEEN_LEVELS):
            width = SEEN_FANOUT**level
            if (batch_id + 1) % width:
                return
            for spec in SEEN_ROLLUPS:
                below = seen_table(spec.name, level - 1)
                first = batch_id - width + 1
                rows = self._scan(below, spec).where(
                    (F.col("ingest") == ingest) & F.col("batch_id").between(first, batch_id)
                )
                merged = merge_partials(rows, spec, "event_date").sortWithinPartitions("domain")
                self._write_grain(seen_table(spec.name, level), spec, merged, ingest, batch_id, **BLOOM)

    def merge_skipped(self, mark: int, batch_id: int, ingest: str = MAIN) -> None:
        """Merge what batches between the mark and the next one would have: their numbers need not follow each other."""
        for level in range(1, SEEN_LEVELS):
            last = (mark // SEEN_FANOUT**level + 1) * SEEN_FANOUT**level - 1
            if 0 <= mark < last < batch_id:
                self.merge_seen(last, ingest)

    def write_rows(self, name: str, batch_id: int, rows: DataFrame, ingest: str = MAIN) -> None:
        """Rows of a batch for a table that is only partitioned by batch."""
        overwrite_partitions(rows.select("*", *self._stamp(ingest, batch_id)), self.path(name), "ingest", "batch_id")

    def commit(self, batch_id: int, ingest: str = MAIN) -> None:
        """Make a batch visible. A batch at or below the ingest's mark already is."""
        marker = self.spark.range(1).select(F.current_timestamp().alias("at"), *self._stamp(ingest, batch_id))
        overwrite_partitions(marker, self.path("_commits"), "ingest", "batch_id")

    def marks(self) -> dict[str, int]:
        """The newest committed batch of every ingest."""
        newest: dict[str, int] = {}
        for p in partitions(self.spark, self.path("_commits"), "ingest", "batch_id"):
            newest[p["ingest"]] = max(int(p["batch_id"]), newest.get(p["ingest"], -1))
        return newest

    def mark(self, ingest: str = MAIN) -> int:
        """The newest committed batch of an ingest, -1 before the first."""
        found = partitions(self.spark, f"{self.path('_commits')}/ingest={ingest}", "batch_id")
        return max((int(p["batch_id"]) for p in found), default=-1)

    # ----- reading ---------------------------------------------------------

    def _scan(self, name: str, spec: RollupSpec | None = None, dates: Iterable[dt.date] | None = None) -> DataFrame:
        """All rows of a table, or those of some dates, of which only the folders are listed."""
        full = SETS if name == CLIENT_SETS else table_schema(RAW_EVENTS if spec is None else spec.name)
        path = self.path(name)
        if dates is None:
            return read_or_empty(self.spark, path, full)
        folders = [f for f in (f"{path}/event_date={d}" for d in sorted(set(dates))) if exists(self.spark, f)]
        if not folders:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", path).parquet(*folders)

    def _committed(self) -> Column:
        """Whether a row's batch is committed; a test of partition columns only."""
        return F.col("batch_id") <= _lookup(self.marks(), F.col("ingest"))

    def _visible(self, name: str, spec: RollupSpec | None = None, dates: Iterable[dt.date] | None = None) -> DataFrame:
        """Committed rows that no fold has replaced, and the rows of the folds that count."""
        return self._renamed(name, self._counting(name, self._scan(name, spec, dates)))

    def _counting(self, name: str, rows: DataFrame) -> DataFrame:
        folds = self._folds(name)
        if not folds:
            return rows.where(self._committed())
        runs = {str(d): upto for d, ingest, upto in folds if ingest == FOLDED}
        replaced = {f"{d}/{ingest}": upto for d, ingest, upto in folds if ingest != FOLDED}
        day = F.col("event_date").cast("string")
        counts = F.col("batch_id") == _lookup(runs, day)
        kept = self._committed() & (F.col("batch_id") > _lookup(replaced, F.concat_ws("/", day, F.col("ingest"))))
        return rows.where(F.when(F.col("ingest") == FOLDED, counts).otherwise(kept))

    def _renamed(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows with the names that their branches have now.

        A renaming holds for the batches that were stored by then, which the
        partition columns tell: a test of the new name prunes folders.
        """
        steps: dict[int, list] = {}
        for r in self.state("_renames", RENAMES).where(F.col("name") == name).collect():
            steps.setdefault(r["number"], []).append(r)
        branch = F.col("branch")
        for _, found in sorted(steps.items()):
            stored = F.col("batch_id") <= _lookup({r["ingest"]: r["upto"] for r in found}, F.col("ingest"))
            branch = F.when((branch == found[0]["source"]) & stored, F.lit(found[0]["target"])).otherwise(branch)
        return rows.withColumn("branch", branch) if steps else rows

    def rename_branch(self, names: list[str], source: str, target: str) -> None:
        """Give all stored rows of a branch in some tables another name; no data is written.

        Rows that come later under the old name keep it. When a date is folded
        its rows are written with their new names.
        """
        old = [tuple(r) for r in self.state("_renames", RENAMES).collect()]
        number = 1 + max((r[0] for r in old), default=-1)
        marks = {**self.marks(), FOLDED: time.time_ns() // 1_000}
        tables = [level_table(n, seconds) for n in names for seconds in (MINUTE, HOUR, DAY, BLOCK) if n in _SPECS or seconds == MINUTE]
        new = [(number, name, source, target, ingest, upto) for name in tables for ingest, upto in marks.items()]
        self.save_state("_renames", self.spark.createDataFrame(old + new, RENAMES))

    def _folds(self, name: str) -> list[tuple[dt.date, str, int]]:
        """A few rows per folded date."""
        rows = self.state("_folds", FOLDS).where(F.col("name") == name).collect()
        return [(r["event_date"], r["ingest"], r["upto"]) for r in rows]

    def events(self, dates: Iterable[dt.date] | None = None) -> DataFrame:
        """Stored events with ``event_date``."""
        return self._visible(RAW_EVENTS, None, dates).select(*schema.EVENT.names, "event_date")

    def rollup_range(self, spec: RollupSpec, since: dt.datetime, until: dt.datetime) -> DataFrame:
        """Rows whose sums are those of a roll-up's minutes from ``since`` to ``until``, both inclusive.

        Folded dates have sums over hours, days and 16 days beside their
        minutes. Of these the range takes the longest that fit, so it reads
        minutes and hours only near its ends and for dates that are not folded.
        Minutes that came after the fold are added. ``bucket_ts`` is where a
        span begins.
        """
        folded = {d for d, ingest, _ in self._folds(level_table(spec.name, DAY)) if ingest == FOLDED}
        days = [since.date() + dt.timedelta(days=k) for k in range((until.date() - since.date()).days + 1)]
        plain = [d for d in days if d not in folded]
        bucket = F.col("bucket_ts")
        inside = bucket.between(ntz(since), ntz(until))
        columns = [*spec.keys, "event_date", *spec.measures]
        parts = [self._visible(spec.name, spec, plain).where(inside).select(*columns)]
        closed = [d for d in days if d in folded]
        if closed:
            late = self._visible(spec.name, spec, closed).where(inside & (F.col("ingest") != FOLDED))
            parts.append(late.select(*columns))
            blocks = {d for d, ingest, _ in self._folds(level_table(spec.name, BLOCK)) if ingest == FOLDED}
            for seconds, first, last, dates in cut_range(since, until, closed, blocks):
                rows = self._visible(level_table(spec.name, seconds), spec, dates)
                if seconds == MINUTE:
                    rows = rows.where(F.col("ingest") == FOLDED)
                parts.append(rows.where((bucket >= ntz(first)) & (bucket < ntz(last))).select(*columns))
        return reduce(DataFrame.unionByName, parts)

    def newest_events(self, n: int, branch: str | None = None, blocked_only: bool = False) -> DataFrame:
        """The ``n`` newest events, in no order, of the newest dates only.

        Dates are walked from the newest, twice as many at each step, until
        their minute totals hold enough events; the totals also tell the minute
        of the n-th, so events are read once and only from there on.
        """
        dates = self.dates(RAW_EVENTS)[::-1]
        count = F.col("blocked_requests" if blocked_only else "total_requests")
        taken = 1
        while True:
            walked = dates[:taken]
            totals = in_branch(self.rollup(MINUTE_TOTALS, merge=False, dates=walked), branch)
            counts = totals.select("bucket_ts", count.alias("n"))
            if taken >= len(dates) or (counts.agg(F.sum("n")).first()[0] or 0) >= n:
                break
            taken *= 2
        rows = in_branch(self.events(walked), branch)
        return newest(rows.where("blocked") if blocked_only else rows, n, counts)

    def rollup(self, spec: RollupSpec, merge: bool = True, dates: Iterable[dt.date] | None = None) -> DataFrame:
        """A roll-up with ``event_date``, one row per key.

        ``merge=False`` leaves the partial sums as they are: queries that only
        sum measures or count distinct keys need no shuffle on the full key.
        """
        rows = self.first_visits(spec) if spec in SEEN_ROLLUPS else self._visible(spec.name, spec, dates)
        rows = rows.select(*spec.keys, "event_date", *spec.measures)
        if spec in SEEN_ROLLUPS and dates is not None:
            rows = rows.where(F.col("event_date").isin(list(dates)))
        return merge_partials(rows, spec, "event_date") if merge else rows

    def first_visits(self, spec: RollupSpec, candidates: DataFrame | None = None) -> DataFrame:
        """First visits per key and date, from as few files as the levels allow.

        With ``candidates`` of up to 1,000 domains only the buckets of these
        are read, and their names go to the Parquet reader, which skips row
        groups by statistics and by the Bloom filters that merged files have;
        the join with the candidates stays the caller's.
        """
        marks = self.marks()
        mark = _lookup(marks, F.col("ingest"))
        wanted = F.lit(True)
        if candidates is not None:
            names = [r["domain"] for r in candidates.select("domain").distinct().limit(1_001).collect()]
            if len(names) <= 1_000:
                wanted = F.col("bucket").isin(sorted({seen_bucket_of(n) for n in names})) & F.col("domain").isin(names)
        parts = []
        for level in range(SEEN_LEVELS):
            rows = self._scan(seen_table(spec.name, level), spec).where(wanted & (F.col("batch_id") <= mark))
            if level + 1 < SEEN_LEVELS:
                # Not where the next level has it.
                width = SEEN_FANOUT ** (level + 1)
                rows = rows.where(F.expr(f"(batch_id div {width} + 1) * {width} - 1") > mark)
            parts.append(self._renamed(spec.name, rows).select(*spec.keys, "event_date", "first_seen"))
        return reduce(DataFrame.unionByName, parts)

    def carried(self, name: str, ingest: str | None = None, batch_id: int | None = None) -> DataFrame:
        """Running values that every batch writes anew: those of the newest batch of each ingest, or of one batch."""
        rows = read_or_empty(self.spark, self.path(name), CARRIED[name])
        if ingest is not None:
            rows = rows.where((F.col("ingest") == ingest) & (F.col("batch_id") == batch_id))
        else:
            rows = rows.where(F.col("batch_id") == _lookup(self.marks(), F.col("ingest")))
        return self._renamed(name, rows)

    def rejects(self) -> DataFrame:
        return read_or_empty(self.spark, self.path("rejects"), REJECTS).where(self._committed())

    def quality(self) -> DataFrame:
        """Lines seen and parsed per branch over all batches: the running totals of every ingest."""
        rows = self.carried("quality")
        return rows.groupBy("branch").agg(F.sum("lines_seen").alias("lines_seen"), F.sum("lines_parsed").alias("lines_parsed"))

    # ----- anomalies -------------------------------------------------------

    def anomalies(self, without_run: str | None = None) -> DataFrame:
        """Stored anomalies of batches and of periodic checks, but for one run of those."""
        rows = read_or_empty(self.spark, self.path(ANOMALIES), T.StructType([*schema.ANOMALY.fields, *_BATCH]))
        tagged = T.StructType([*schema.ANOMALY.fields, T.StructField("run", T.StringType())])
        monitored = read_or_empty(self.spark, self.path(MONITOR_ANOMALIES), tagged)
        if without_run is not None:
            monitored = monitored.where(F.col("run") != without_run)
        found = rows.where(self._committed()).select(*schema.ANOMALY.names)
        return found.unionByName(monitored.select(*schema.ANOMALY.names))

    def write_monitor_run(self, monitor: str, now: dt.datetime, rows: DataFrame) -> None:
        """Anomalies of one periodic check; a repeated run replaces itself."""
        tagged = rows.select(*schema.ANOMALY.names, F.lit(self.run_name(monitor, now)).alias("run"))
        overwrite_partitions(tagged, self.path(MONITOR_ANOMALIES), "run")

    @staticmethod
    def run_name(monitor: str, now: dt.datetime) -> str:
        return f"{monitor}-{now:%Y%m%dT%H%M%S}"

    def relabel_anomalies(self, source: str, target: str) -> None:
        """Rename a branch in stored anomalies; only batches and runs that name it are rewritten.

        Where partitions are overwritten dynamically, Spark writes to a staging
        folder first, so a table may be read and replaced by one job.
        """
        for name, keys in ((ANOMALIES, _BATCH), (MONITOR_ANOMALIES, [T.StructField("run", T.StringType())])):
            if not exists(self.spark, self.path(name)):
                continue
            rows = self.spark.read.schema(T.StructType([*schema.ANOMALY.fields, *keys])).parquet(self.path(name))
            columns = [k.name for k in keys]
            hit = rows.where(F.col("branch") == source).select(*columns).distinct()
            moved = rows.join(hit, columns).select(*rows.columns)
            moved = moved.withColumn("branch", F.when(F.col("branch") == source, F.lit(target)).otherwise(F.col("branch")))
            overwrite_partitions(moved, self.path(name), *columns)

    # ----- small state tables ----------------------------------------------

    def state(self, name: str, columns: str) -> DataFrame:
        """The newest version of a small table, without rows before the first."""
        versions = self._versions(name)
        path = f"{self.path(name)}/version={versions[-1]}" if versions else f"{self.path(name)}/none"
        return read_or_empty(self.spark, path, columns)

    def save_state(self, name: str, rows: DataFrame) -> None:
        """Write a new version beside the old one, which may be the input of ``rows``."""
        version = 1 + max(self._versions(name), default=-1)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path(name)}/version={version}")

    def _versions(self, name: str) -> list[int]:
        found = partitions(self.spark, self.path(name), "version")
        return sorted(int(p["version"]) for p in found if exists(self.spark, f"{p['path']}/_SUCCESS"))

    # ----- folding ---------------------------------------------------------
    # One upkeep job at a time; ingests go on meanwhile.

    def fold(self, name: str, dates: list[dt.date], change: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Rewrite whole dates of a table: partial sums added up, small files joined.

        ``change`` may filter or relabel rows on the way.
        """
        if not dates:
            return
        if name == CLIENT_MINUTE.name:
            self._refresh_sets(dates)
        spec = None if name == RAW_EVENTS else _SPECS[name]
        if spec is not None and {d for d, _, _ in self._folds(level_table(name, DAY))}.intersection(dates):
            self.fold_levels(spec, dates, change)
            return
        before = self._batches_of(name, dates)
        rows = self._visible(name, spec, dates)
        if change is not None:
            rows = change(rows)
        self._save_folds({name: (dates, self._write_folded(name, spec, rows), before)})

    def fold_levels(
        self, spec: RollupSpec, dates: list[dt.date], change: Callable[[DataFrame], DataFrame] | None = None
    ) -> None:
        """Fold dates of a roll-up and write their sums over hours, days and, where all 16 dates are folded, 16 days.

        Everything counts from the same moment, so the sums never disagree with
        the minutes. Client minutes have hours of their own and are refused.
        """
        if not dates:
            return
        if spec.merge != "sum" or spec in (CLIENT_MINUTE, CLIENT_HOURLY):
            raise ValueError(f"{spec.name} has no sums over longer spans")
        before = self._batches_of(spec.name, dates)
        minutes = self._visible(spec.name, spec, dates)
        if change is not None:
            minutes = change(minutes)
        done = {spec.name: (dates, self._write_folded(spec.name, spec, minutes), before)}
        rows = self._scan(spec.name, spec, dates).where((F.col("ingest") == FOLDED) & (F.col("batch_id") == done[spec.name][1]))
        for seconds in (HOUR, DAY):
            name = level_table(spec.name, seconds)
            done[name] = (dates, self._write_folded(name, spec, _longer(rows, spec, seconds)), {})
            rows = self._scan(name, spec, dates).where(F.col("batch_id") == done[name][1])
        day_table, block_table = level_table(spec.name, DAY), level_table(spec.name, BLOCK)
        ready = {d for d, ingest, _ in self._folds(day_table) if ingest == FOLDED} | set(dates)
        blocks = sorted({block_of(d) for d in dates if all(x in ready for x in block_dates(block_of(d)))})
        if blocks:
            # The days of the blocks, as they are once this fold counts.
            wanted = [x for b in blocks for x in block_dates(b)]
            others = self._visible(day_table, spec, [x for x in wanted if x not in dates])
            every = rows.where(F.col("event_date").isin(wanted)).unionByName(others)
            done[block_table] = (blocks, self._write_folded(block_table, spec, _longer(every, spec, BLOCK)), {})
        self._save_folds(done)

    def _write_folded(self, name: str, spec: RollupSpec | None, rows: DataFrame) -> int:
        """Write rows of a fold that does not count yet; returns its run, a number never used before."""
        run = time.time_ns() // 1_000
        if spec is not None:
            self._write_grain(name, spec, merge_partials(rows, spec, "event_date"), FOLDED, run)
            return run
        # Rebalance splits a branch that is too big for one task and joins small ones.
        rows = rows.select(*schema.EVENT.names, "event_date").hint("rebalance", "event_date", "branch")
        # Row groups ordered by client let single-client reads skip most of them.
        rows = rows.select("*", *self._stamp(FOLDED, run)).sortWithinPartitions(*self._layout(RAW_EVENTS), "client_ip", "timestamp")
        overwrite_partitions(rows, self.path(name), *self._layout(name))
        return run

    def _batches_of(self, name: str, dates: Iterable[dt.date]) -> dict[tuple[dt.date, str], int]:
        """Per date, the newest committed batch of every ingest that has a folder there."""
        marks = self.marks()
        _, second, *_ = self._layout(name)
        found: dict[tuple[dt.date, str], int] = {}
        for date in dates:
            for p in partitions(self.spark, f"{self.path(name)}/event_date={date}", second, "ingest"):
                if p["ingest"] in marks:
                    found[date, p["ingest"]] = marks[p["ingest"]]
        return found

    def _save_folds(self, done: dict[str, tuple[list[dt.date], int, dict[tuple[dt.date, str], int]]]) -> None:
        """Make folds count, all of them at once. The state has a few rows per table and date."""
        rows = [r for r in self.state("_folds", FOLDS).collect()]
        rows = [tuple(r) for r in rows if r["name"] not in done or r["event_date"] not in done[r["name"]][0]]
        for name, (dates, run, before) in done.items():
            rows += [(name, d, FOLDED, run) for d in dates]
            rows += [(name, d, ingest, upto) for (d, ingest), upto in before.items()]
        self.save_state("_folds", self.spark.createDataFrame(rows, FOLDS))

    def roll_up_hours(self, cutoff: dt.datetime) -> None:
        """Move client minutes before ``cutoff`` into hours.

        Only dates that still have such minutes are touched: their hours are
        written with the old ones added, their later minutes by themselves, and
        both count from the same moment. Minutes that arrive late belong to a
        newer batch and stay visible until the next run.
        """
        dates = [d for d in self.dates(CLIENT_MINUTE.name) if d <= cutoff.date()]
        old = F.col("bucket_ts") < ntz(cutoff)
        waiting = self._visible(CLIENT_MINUTE.name, CLIENT_MINUTE, dates)
        dates = sorted(r["event_date"] for r in waiting.where(old).select("event_date").distinct().collect())
        if not dates:
            return
        self._refresh_sets(dates)
        before = self._batches_of(CLIENT_MINUTE.name, dates)
        hours_before = self._batches_of(CLIENT_HOURLY.name, dates)
        minutes = self._visible(CLIENT_MINUTE.name, CLIENT_MINUTE, dates)
        columns = [*CLIENT_HOURLY.keys, "event_date", *CLIENT_HOURLY.measures]
        hours = client_hourly(minutes.where(old)).withColumn("event_date", F.to_date("bucket_ts")).select(*columns)
        hours = hours.unionByName(self._visible(CLIENT_HOURLY.name, CLIENT_HOURLY, dates).select(*columns))
        moved = self._write_folded(CLIENT_HOURLY.name, CLIENT_HOURLY, hours)
        kept = self._write_folded(CLIENT_MINUTE.name, CLIENT_MINUTE, minutes.where(~old))
        self._save_folds({CLIENT_HOURLY.name: (dates, moved, hours_before), CLIENT_MINUTE.name: (dates, kept, before)})

    # ----- distinct clients --------------------------------------------------

    def client_ids(self) -> DataFrame:
        """(kind, value, id) of all clients and users that sets may hold."""
        runs = [r["run"] for r in self.state("_id_runs", ID_RUNS).collect()]
        rows = read_or_empty(self.spark, self.path("client_ids"), CLIENT_IDS)
        return rows.where(F.col("run").isin(runs)).select("kind", "value", "id")

    def _add_clients(self, values: DataFrame) -> None:
        """Number the values (kind, value) that have no number yet; a run that fails half-way does not count."""
        state = self.state("_id_runs", ID_RUNS).collect()
        taken: dict[str, int] = {}
        for r in state:
            taken[r["kind"]] = taken.get(r["kind"], 0) + r["n"]
        run = time.time_ns() // 1_000
        new = number_new(values, self.client_ids(), taken).select("value", "id", "kind", F.lit(run).cast("long").alias("run"))
        overwrite_partitions(new, self.path("client_ids"), "kind", "run")
        added = read_or_empty(self.spark, self.path("client_ids"), CLIENT_IDS).where(F.col("run") == run)
        # One row per kind.
        added = added.groupBy("run", "kind").agg(F.count(F.lit(1)).alias("n")).collect()
        self.save_state("_id_runs", self.spark.createDataFrame([tuple(r) for r in [*state, *added]], ID_RUNS))

    @staticmethod
    def _clients(rows: DataFrame) -> DataFrame:
        """(event_date, bucket_ts, branch, kind, value): which clients and users were active in which hour."""
        both = F.explode(F.array(
            F.struct(F.lit("client").alias("kind"), F.col("client_ip").alias("value")),
            F.struct(F.lit("user").alias("kind"), F.col("user").alias("value")),
        )).alias("who")
        hours = rows.select("event_date", floor_to(F.col("bucket_ts"), HOUR).alias("bucket_ts"), "branch", both)
        return hours.select("event_date", "bucket_ts", "branch", "who.kind", "who.value").where("value is not null").distinct()

    def fold_clients(self, dates: list[dt.date]) -> None:
        """Write the sets of clients and users of every hour and branch of some dates."""
        if not dates:
            return
        before = self._batches_of(CLIENT_MINUTE.name, dates)
        minutes = self._visible(CLIENT_MINUTE.name, CLIENT_MINUTE, dates)
        hours = self._visible(CLIENT_HOURLY.name, CLIENT_HOURLY, dates)
        columns = ["event_date", "bucket_ts", "branch", "client_ip", "user"]
        active = self._clients(minutes.select(*columns).unionByName(hours.select(*columns)))
        self._add_clients(active.select("kind", "value"))
        sets = id_sets(active.join(self.client_ids(), ["kind", "value"]), "event_date", "bucket_ts", "branch", "kind")
        run = time.time_ns() // 1_000
        rows = sets.select("bucket_ts", "branch", "kind", "chunk", "ids", F.lit(0).alias("bucket"), "event_date", *self._stamp(FOLDED, run))
        overwrite_partitions(rows, self.path(CLIENT_SETS), *self._layout(CLIENT_SETS))
        self._save_folds({CLIENT_SETS: (dates, run, before)})

    def _refresh_sets(self, dates: list[dt.date]) -> None:
        """Before client minutes of dates with sets are folded: what came late gets into the sets."""
        have = {d for d, _, _ in self._folds(CLIENT_SETS)}
        self.fold_clients([d for d in dates if d in have])

    def active_counts(self, since: dt.datetime, until: dt.datetime, branch: str | None = None) -> DataFrame:
        """(kind, n): distinct clients and users with traffic from ``since`` to ``until``, exact.

        Whole hours of dates with sets are read as bitmaps. Client rows are
        read for the ends of the range, for other dates and for batches that
        came after the sets were written.
        """
        folds = self._folds(CLIENT_SETS)
        have = sorted({d for d, ingest, _ in folds if ingest == FOLDED})
        replaced = {f"{d}/{ingest}": upto for d, ingest, upto in folds if ingest != FOLDED}
        first = since.replace(minute=0, second=0, microsecond=0)
        first = first if first == since else first + dt.timedelta(hours=1)
        last = (until + dt.timedelta(minutes=1)).replace(minute=0, second=0, microsecond=0)
        dates = [since.date() + dt.timedelta(days=k) for k in range((until.date() - since.date()).days + 1)]
        hour = floor_to(F.col("bucket_ts"), HOUR)
        whole = (hour >= ntz(first)) & (hour < ntz(last))
        sets = in_branch(self._visible(CLIENT_SETS, None, [d for d in dates if d in set(have)]).where(whole), branch)
        day = F.col("event_date").cast("string")
        late = (F.col("ingest") != FOLDED) & (F.col("batch_id") > _lookup(replaced, F.concat_ws("/", day, F.col("ingest"))))
        by_row = ~(whole & F.col("event_date").isin(have)) if have else F.lit(True)
        minutes = buckets_in_range(self._visible(CLIENT_MINUTE.name, CLIENT_MINUTE, dates), since, until, branch).where(by_row | late)
        hours = hours_overlapping(self._visible(CLIENT_HOURLY.name, CLIENT_HOURLY, dates), since, until, branch).where(by_row)
        columns = ["event_date", "bucket_ts", "branch", "client_ip", "user"]
        rest = self._clients(minutes.select(*columns).unionByName(hours.select(*columns))).select("kind", "value").distinct()
        rest = rest.join(self.client_ids(), ["kind", "value"], "left")
        known = sets.select("kind", "chunk", "ids").unionByName(id_sets(rest.where("id is not null"), "kind"))
        unknown = rest.where("id is null").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
        every = count_sets(known, "kind").unionByName(unknown).groupBy("kind").agg(F.sum("n").alias("n"))
        kinds = self.spark.createDataFrame([("client",), ("user",)], "kind string")
        return kinds.join(every, "kind", "left").na.fill(0, ["n"])

    def dates(self, name: str) -> list[dt.date]:
        """Dates a table has folders for."""
        return sorted({dt.date.fromisoformat(p["event_date"]) for p in partitions(self.spark, self.path(name), "event_date")})

    def drop_batches(self, name: str, column: str, before: dt.datetime) -> int:
        """Delete the folders of batches (or runs) all of whose rows are before a time."""
        keys = ["run"] if name == MONITOR_ANOMALIES else ["ingest", "batch_id"]
        if not exists(self.spark, self.path(name)):
            return 0
        rows = self.spark.read.parquet(self.path(name))
        old = rows.groupBy(*[F.col(k).cast("string").alias(k) for k in keys]).agg(F.max(column).alias("newest"))
        # One row per batch that has anomalies or rejects and is old.
        gone = {tuple(r[k] for k in keys) for r in old.where(F.col("newest") < ntz(before)).collect()}
        found = [p for p in partitions(self.spark, self.path(name), *keys) if tuple(p[k] for k in keys) in gone]
        for p in found:
            delete(self.spark, p["path"])
        return len(found)

    def drop_dates(self, name: str, before: dt.date) -> list[dt.date]:
        """Delete the folders of all dates before one."""
        if name in {s.name for s in SEEN_ROLLUPS}:
            tables = [seen_table(name, level) for level in range(SEEN_LEVELS)]
        elif name in (RAW_EVENTS, CLIENT_SETS):
            tables = [name]
        else:
            tables = [level_table(name, seconds) for seconds in (MINUTE, HOUR, DAY)]
            # A block goes with its last date; until then days stand in for it.
            block_table = level_table(name, BLOCK)
            broken = [d for d in self.dates(block_table) if d < before]
            if broken:
                kept = self.state("_folds", FOLDS).where(~((F.col("name") == block_table) & F.col("event_date").isin(broken)))
                self.save_state("_folds", kept)
            for d in broken:
                delete(self.spark, f"{self.path(block_table)}/event_date={d}")
        dropped = sorted({d for table in tables for d in self.dates(table) if d < before})
        for d in dropped:
            for table in tables:
                if exists(self.spark, f"{self.path(table)}/event_date={d}"):
                    delete(self.spark, f"{self.path(table)}/event_date={d}")
        return dropped

    def vacuum(self) -> int:
        """Delete folders no reader needs any more: what folds and merges have replaced, all but the newest marker.

        To be run when no query that started before the last fold is active.
        """
        marks = self.marks()
        state = [tuple(r) for r in self.state("_folds", FOLDS).collect()]
        upto = {(name, str(d), ingest): n for name, d, ingest, n in state}

        def gone(name: str, p: dict[str, str]) -> bool:
            limit = upto.get((name, p["event_date"], p["ingest"]), -1)
            return int(p["batch_id"]) < limit if p["ingest"] == FOLDED else int(p["batch_id"]) <= limit

        paths = []
        levels = [level_table(s.name, n) for s in ALL_ROLLUPS if s.merge == "sum" for n in (HOUR, DAY, BLOCK)]
        for name in [RAW_EVENTS, *_SPECS, *levels, CLIENT_SETS]:
            paths += [p["path"] for p in partitions(self.spark, self.path(name), *self._layout(name)) if gone(name, p)]
        for spec in SEEN_ROLLUPS:
            for level in range(SEEN_LEVELS - 1):
                name, width = seen_table(spec.name, level), SEEN_FANOUT ** (level + 1)
                for p in partitions(self.spark, self.path(name), *self._layout(name)):
                    if (int(p["batch_id"]) // width + 1) * width - 1 <= marks.get(p["ingest"], -1):
                        paths.append(p["path"])
        for name in ("_commits", *CARRIED):
            for p in partitions(self.spark, self.path(name), "ingest", "batch_id"):
                if int(p["batch_id"]) < marks.get(p["ingest"], -1):
                    paths.append(p["path"])
        # Batch by batch: an ingest may be writing beside them, in any folder above.
        with ThreadPoolExecutor(DELETES_AT_ONCE) as pool:
            list(pool.map(lambda path: delete(self.spark, path), paths))
        # No folder is left that the other rows would hide; those of the sets tell what the sets hold.
        kept = [r for r in state if r[2] == FOLDED or r[0] == CLIENT_SETS]
        if len(kept) < len(state):
            self.save_state("_folds", self.spark.createDataFrame(kept, FOLDS))
        return len(paths)


def _longer(rows: DataFrame, spec: RollupSpec, seconds: int) -> DataFrame:
    """Sums over longer spans, dated by where these begin."""
    start = floor_to(F.col("bucket_ts"), seconds)
    keys = [start.alias("bucket_ts") if k == "bucket_ts" else F.col(k) for k in spec.keys]
    sums = rows.groupBy(*keys).agg(*spec.merged())
    return sums.withColumn("event_date", F.to_date("bucket_ts"))


def block_of(date: dt.date) -> dt.date:
    """The first of the 16 dates, counted from 1970, that a date is one of."""
    return date - dt.timedelta(days=(date - dt.date(1970, 1, 1)).days % 16)


def block_dates(first: dt.date) -> list[dt.date]:
    return [first + dt.timedelta(days=k) for k in range(16)]


def cut_range(
    since: dt.datetime, until: dt.datetime, closed: list[dt.date], blocks: set[dt.date]
) -> list[tuple[int, dt.datetime, dt.datetime, list[dt.date]]]:
    """Spans of a range on dates that have longer sums: (length of a sum, from, to, dates to read).

    Whole dates count as days, sixteen of a block as one. At each end of the
    range the date is cut into hours and minutes. ``until`` is inclusive and
    ``to`` is not.
    """
    midnight = dt.time()
    end = until.replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
    begin = since.replace(second=0, microsecond=0)
    if begin < since:
        begin += dt.timedelta(minutes=1)
    days = set(closed)
    whole = {d for d in days if begin <= dt.datetime.combine(d, midnight) and dt.datetime.combine(d, midnight) + dt.timedelta(days=1) <= end}
    spans = []
    for block in sorted({block_of(d) for d in whole} & blocks):
        if whole.issuperset(block_dates(block)):
            whole -= set(block_dates(block))
            start = dt.datetime.combine(block, midnight)
            spans.append((BLOCK, start, start + dt.timedelta(days=16), [block]))
            days -= set(block_dates(block))
    if whole:
        last = dt.datetime.combine(max(whole), midnight) + dt.timedelta(days=1)
        spans.append((DAY, dt.datetime.combine(min(whole), midnight), last, sorted(whole)))
    for date in sorted(days - whole):
        low = max(begin, dt.datetime.combine(date, midnight))
        high = min(end, dt.datetime.combine(date, midnight) + dt.timedelta(days=1))
        first_hour = low if low.minute == 0 else low.replace(minute=0) + dt.timedelta(hours=1)
        last_hour = high.replace(minute=0)
        if first_hour < last_hour:
            spans.append((HOUR, first_hour, last_hour, [date]))
            spans += [(MINUTE, a, b, [date]) for a, b in ((low, first_hour), (last_hour, high)) if a < b]
        elif low < high:
            spans.append((MINUTE, low, high, [date]))
    return spans


def _lookup(values: dict[str, int], key: Column) -> Column:
    """The value of a key in a small table, -1 without one; folded to a literal, so that it prunes partitions."""
    if not values:
        return F.lit(-1).cast("long")
    pairs = [c for k, v in values.items() for c in (F.lit(k), F.lit(v).cast("long"))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(-1).cast("long"))
