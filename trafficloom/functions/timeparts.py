"""Time bucketing and range resolution."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "1970-01-01 00:00:00"
PRESETS = {
    "1h": dt.timedelta(hours=1),
    "24h": dt.timedelta(hours=24),
    "7d": dt.timedelta(days=7),
}
DEFAULT_PRESET = "24h"


def ntz(value: str | dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal from text or a datetime (aware ones go to UTC)."""
    if isinstance(value, dt.datetime):
        value = _utc_naive(value).isoformat(sep=" ")
    return F.lit(value).cast("timestamp_ntz")


def from_epoch_micros(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, ntz(EPOCH))


def epoch_micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", ntz(EPOCH), ts)


def floor_to(ts: Column, seconds: int) -> Column:
    """Start of the ``seconds``-wide bucket that holds ``ts``."""
    return F.timestamp_add("MICROSECOND", -F.pmod(epoch_micros(ts), F.lit(seconds * 1_000_000)), ts)


def minute_of(ts: Column) -> Column:
    return floor_to(ts, 60)


def hour_of(ts: Column) -> Column:
    return floor_to(ts, 3600)


def shift(ts: Column, seconds: int) -> Column:
    return F.timestamp_add("SECOND", F.lit(seconds), ts)


def _utc_naive(value: dt.datetime) -> dt.datetime:
    if value.tzinfo is None:
        return value
    return value.astimezone(dt.timezone.utc).replace(tzinfo=None)


@dataclass(frozen=True)
class TimeRange:
    """Both ends are inclusive."""

    since: dt.datetime
    until: dt.datetime
    preset: str | None = None

    def previous(self) -> TimeRange:
        """The equally long range that ends where this one starts."""
        return TimeRange(self.since - (self.until - self.since), self.since)


def resolve_range(
    preset: str | None = None,
    from_ts: dt.datetime | None = None,
    to_ts: dt.datetime | None = None,
    now: dt.datetime | None = None,
) -> TimeRange:
    """A custom range when both ends are given, else a preset that ends at ``now``."""
    if (from_ts is None) != (to_ts is None):
        raise ValueError("give both ends of a custom range or neither")
    if from_ts is not None and to_ts is not None:
        since, until = _utc_naive(from_ts), _utc_naive(to_ts)
        if since >= until:
            raise ValueError("a range must start before it ends")
        return TimeRange(since, until)
    chosen = preset or DEFAULT_PRESET
    if chosen not in PRESETS:
        raise ValueError(f"unknown range {chosen!r}, expected one of {', '.join(PRESETS)}")
    end = _utc_naive(now) if now is not None else dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    return TimeRange(end - PRESETS[chosen], end, chosen)
