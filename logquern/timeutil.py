"""Durations, half-open windows and inclusive hour ranges."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from .model import EngineError

UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def parse_duration(text: str) -> timedelta:
    m = re.fullmatch(r"(\d+)([smhd])", text.strip())
    if not m or not int(m[1]):
        raise EngineError(f"not a duration (like 15m, 24h, 7d): {text!r}")
    return timedelta(seconds=int(m[1]) * UNITS[m[2]])


def parse_time(text: str) -> datetime:
    """An instant: RFC 3339 or ISO without a zone (UTC); shortened to the day, hour or minute if so given."""
    text = text.strip().replace(" ", "T")
    if re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d", text):
        text += ":00"
    try:
        at = datetime.fromisoformat(text)
    except ValueError:
        raise EngineError(f"not a time: {text!r}") from None
    return (at if at.tzinfo else at.replace(tzinfo=UTC)).astimezone(UTC)


@dataclass(frozen=True)
class Window:
    """[start, end)"""

    start: datetime
    end: datetime

    @property
    def length(self) -> timedelta:
        return self.end - self.start

    def baseline(self) -> Window:
        """The window of equal length just before."""
        return Window(self.start - self.length, self.start)

    def lookback(self, length: timedelta) -> Window:
        return Window(self.end - length, self.end)

    def contains(self, time: Column) -> Column:
        return (time >= literal(self.start)) & (time < literal(self.end))

    def hours(self) -> tuple[datetime, datetime]:
        """First and last hour that the window touches."""
        return hour(self.start), hour(self.end - timedelta(microseconds=1))


def parse_window(text: str, now: datetime) -> Window:
    """A duration up to now, or start..end."""
    if ".." in text:
        start, end = map(parse_time, text.split("..", 1))
    else:
        start, end = now - parse_duration(text), now
    if start >= end:
        raise EngineError(f"an empty window: {text!r}")
    return Window(start, end)


def hour(at: datetime) -> datetime:
    return at.replace(minute=0, second=0, microsecond=0)


def literal(at: datetime) -> Column:
    """A zoneless UTC timestamp."""
    return F.lit(at.astimezone(UTC).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def hour_range(dt: Column, hh: Column, after: datetime | None = None, before: datetime | None = None) -> Column:
    """Partition predicate: hours from that of `after` to that of `before`, both included."""
    out = F.lit(True)
    if after is not None:
        a = hour(after)
        out &= (dt > F.lit(a.date())) | ((dt == F.lit(a.date())) & (hh >= a.hour))
    if before is not None:
        b = hour(before)
        out &= (dt < F.lit(b.date())) | ((dt == F.lit(b.date())) & (hh <= b.hour))
    return out


def series_bucket(time: Column, window: Window, width: timedelta) -> Column:
    """Number of the tumbling bucket, from 0, that a time of the window falls in."""
    seconds = F.timestamp_diff("SECOND", literal(window.start), time)
    return F.floor(seconds / int(width.total_seconds())).cast("long")


def series_length(window: Window, width: timedelta) -> int:
    return max(1, -(-int(window.length.total_seconds()) // int(width.total_seconds())))
