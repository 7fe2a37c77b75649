"""A live feed of events, and a pure streaming aggregate with a watermark."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trafficloom.fixed_values import FEED_LANES, FEED_ROWS, FEED_WAIT_MS
from trafficloom.operators.events import event_detail
from trafficloom.operators.filters import in_branch
from trafficloom.operators.parse import parse_access_log


def live_events(lines: DataFrame, branch: str | None = None) -> DataFrame:
    """Parsed events of a stream of lines, in listing form."""
    events, _ = parse_access_log(in_branch(lines, branch))
    return event_detail(events)


def start_feed(lines: DataFrame, path: str, checkpoint: str, branch: str | None = None, every: str = "1 second",
               available_now: bool = False) -> StreamingQuery:
    """Append live events as Parquet in short micro-batches.

    Limit the batch size at the source (``max_files_per_trigger``).
    """
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    writer = live_events(lines, branch).writeStream.format("parquet").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


_WAITING = "number bigint, deadline bigint, rows binary"


def _as_bytes(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _from_bytes(raw: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(raw).read_all().to_pandas()


def _batcher(max_rows: int, max_wait_ms: int) -> Callable:
    def step(key: tuple, arrived: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Closes batches that are full or have waited; the rest waits in the state, fewer than ``max_rows`` rows."""
        number, deadline, raw = state.get if state.exists else (0, 0, b"")
        waiting = _from_bytes(raw) if raw else None

        def closed(rows: pd.DataFrame) -> pd.DataFrame:
            nonlocal number
            number += 1
            return rows.assign(batch=number, position=range(1, len(rows) + 1), n=len(rows))

        now = int(time.time() * 1000)
        if waiting is not None and (state.hasTimedOut or now >= deadline):
            yield closed(waiting)
            waiting = None
        if not state.hasTimedOut:
            for rows in arrived:
                if not len(rows):
                    continue
                if waiting is None:
                    deadline = now + max_wait_ms
                rows = rows if waiting is None else pd.concat([waiting, rows], ignore_index=True)
                whole = len(rows) // max_rows * max_rows
                for first in range(0, whole, max_rows):
                    yield closed(rows.iloc[first : first + max_rows])
                    deadline = now + max_wait_ms
                waiting = rows.iloc[whole:] if whole < len(rows) else None
        state.update((number, deadline, b"" if waiting is None else _as_bytes(waiting)))
        if waiting is not None:
            state.setTimeoutDuration(max(1, deadline - now))

    return step


def _dealer(max_rows: int, lanes: int) -> Callable:
    def deal(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their lane: each ``max_rows`` of a branch go to the next lane, and what is left of it in this task to lane 0."""
        task = TaskContext.get().partitionId()
        full: dict[str | None, int] = {}
        waiting: pa.Table | None = None

        def with_lane(rows: pa.Table, lane: np.ndarray) -> list[pa.RecordBatch]:
            return rows.append_column("lane", pa.array(lane, pa.int32())).to_batches()

        for batch in arrived:
            rows = pa.Table.from_batches([batch])
            rows = rows if waiting is None else pa.concat_tables([waiting, rows])
            codes = rows["branch"].combine_chunks().dictionary_encode(null_encoding="encode")
            codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
            branches, code = codes.dictionary.to_pylist(), codes.indices.to_numpy()
            lane = np.full(len(code), -1, np.int32)
            for i, branch in enumerate(branches):
                places = np.flatnonzero(code == i)
                places = places[: len(places) // max_rows * max_rows]
                done = full.get(branch, 0)
                lane[places] = 1 + (task + done + np.arange(len(places)) // max_rows) % lanes
                full[branch] = done + len(places) // max_rows
            whole = lane >= 0
            waiting = rows.filter(pa.array(~whole)).combine_chunks()
            if whole.any():
                yield from with_lane(rows.filter(pa.array(whole)), lane[whole])
        if waiting is not None and len(waiting):
            yield from with_lane(waiting, np.zeros(len(waiting), np.int32))

    return deal


def feed_batches(events: DataFrame, max_rows: int = FEED_ROWS, max_wait_ms: int = FEED_WAIT_MS, lanes: int = FEED_LANES) -> DataFrame:
    """Events of a stream in batches per branch: (lane, batch, position, n) and the columns of a listing.

    A batch is closed when it has ``max_rows`` events or ``max_wait_ms`` after
    its first one came, whichever is earlier; between micro-batches the open
    one is kept as state, and a timer closes it when nothing else arrives.
    Whole batches are made where the events are read and dealt over ``lanes``
    lanes from 1, each numbered by itself, so no task reads a whole branch.
    Lane 0 has what is left of each branch in each of those tasks, fewer than
    ``max_rows`` events of it a task, and is the only one in which events wait.
    """
    rows = event_detail(events)
    schema = T.StructType([*rows.schema.fields, T.StructField("lane", T.IntegerType())])
    rows = rows.mapInArrow(_dealer(max_rows, lanes), schema)
    rows = rows.withColumn("key_branch", F.col("branch")).withColumn("key_lane", F.col("lane"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = rows.groupBy("key_branch", "key_lane").applyInPandasWithState(
        _batcher(max_rows, max_wait_ms),
        f"{fields}, batch bigint, position int, n int",
        _WAITING,
        "append",
        GroupStateTimeout.ProcessingTimeTimeout,
    )
    return out.drop("key_branch", "key_lane")


def watermarked_minutes(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Minute totals of an event stream for append sinks.

    Unlike the stored partial sums, which take late events at any age, this
    drops events later than ``lateness``. Watermarks need a zoned timestamp, so
    the session time zone must be UTC.
    """
    timed = events.withColumn("event_time", F.col("timestamp").cast("timestamp"))
    return (
        timed.withWatermark("event_time", lateness)
        .groupBy(F.window("event_time", "1 minute"), "branch")
        .agg(F.count(F.lit(1)).alias("total_requests"), F.count_if("blocked").alias("blocked_requests"), F.sum("bytes").alias("total_bytes"))
        .select(F.col("window.start").cast("timestamp_ntz").alias("bucket_ts"), "branch", "total_requests", "blocked_requests", "total_bytes")
    )
