"""Time buckets, time parsing and time ranges."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import KEY_EXPIRY_DAYS, LAST_EPOCH_MS

GRAINS = ("minute", "hour", "day")
ISO_START = r"^\s*[0-9]{4}(-|$)"
DAY_MS = 24 * 60 * 60 * 1000


def time_bucket(ts: Column, grain: str = "hour") -> Column:
    """Start of the UTC minute, hour or day; unknown grains mean hour."""
    return F.date_trunc(grain if grain in GRAINS else "hour", ts)


def at(epoch_ms: int) -> Column:
    """Timestamp literal; folds to a constant, so filters on it are pushed to the scan."""
    return F.timestamp_millis(F.lit(int(epoch_ms)).cast("long"))


def instant_from_text(text: Column) -> Column:
    """ISO date or date-time; null when it is none."""
    return F.when(text.rlike(ISO_START), F.try_to_timestamp(text))


def instant_from_epoch_ms(ms: Column) -> Column:
    return F.when(F.abs(ms) <= LAST_EPOCH_MS, F.timestamp_millis(ms.cast("long")))


def key_expiry(expires_at: Column, created_at: Column, days: int = KEY_EXPIRY_DAYS) -> Column:
    """Keys without an expiry get one `days` after their creation."""
    return F.coalesce(expires_at, created_at + F.make_dt_interval(F.lit(days)))


def is_expired(expires_at: Column, now: Column) -> Column:
    """Strictly before `now`; no expiry never expires."""
    return F.coalesce(expires_at < now, F.lit(False))


@dataclass(frozen=True)
class TimeRange:
    """Bounds in epoch milliseconds; None means not given."""

    start: int | None = None
    end: int | None = None

    def last_day_if_open(self, now_ms: int) -> "TimeRange":
        """Missing (or zero) bounds become the 24 hours up to `now`."""
        return TimeRange(self.start or now_ms - DAY_MS, self.end or now_ms)


def epoch_ms(value: str | int | datetime | None) -> int | None:
    """Digits are epoch milliseconds, anything else an ISO date; zoneless times are UTC."""
    if value is None or value == "":
        return None
    if isinstance(value, datetime):
        parsed = value
    elif re.fullmatch(r"[0-9]+", str(value)):
        return int(value)
    else:
        try:
            parsed = datetime.fromisoformat(str(value))
        except ValueError:
            raise ValueError("Invalid time format") from None
    if parsed.tzinfo is None:
        parsed = parsed.replace(tzinfo=timezone.utc)
    return round(parsed.timestamp() * 1000)


def time_range(start: str | int | datetime | None = None, end: str | int | datetime | None = None) -> TimeRange:
    bounds = TimeRange(epoch_ms(start), epoch_ms(end))
    if bounds.start is not None and bounds.end is not None and bounds.start > bounds.end:
        raise ValueError("Invalid time range: start > end")
    return bounds
