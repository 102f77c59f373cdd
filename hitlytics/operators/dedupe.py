"""Each event once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import HIT
from .lookup import one_per


def first_copies(events: DataFrame) -> DataFrame:
    """First copy of each event by publish time, attempt, then content."""
    content = [F.col(c) for c in HIT.names if c != "event_id"]
    return one_per(events, ["event_id"], [F.col("publish_order"), *content])


#: So many days of a batch are read from the raw table one by one.
DAY_RANGES = 64


@dataclass(frozen=True)
class Span:
    """Where the hits of a batch lie: the first and last instant of each day (days since the epoch, microseconds), or, of
    many days, of all together."""

    days: tuple[tuple[int, int, int], ...] | None
    first: int
    last: int

    def covers(self) -> list[Column]:
        """Predicates on stored hits: one on the day, which prunes folders, one on the time, which prunes row groups.

        Together they keep every stored hit at an instant at which the batch may have one.
        """
        def between(low: int, high: int) -> str:
            return f"hit_ts BETWEEN timestamp_micros({low}L) AND timestamp_micros({high}L)"

        if self.days is None:
            return [F.expr(between(self.first, self.last))]
        days = ", ".join(f"date_from_unix_date({d})" for d, _, _ in self.days)
        return [F.expr(f"hit_date IN ({days})"), F.expr(" OR ".join(between(a, z) for _, a, z in self.days))]


def unseen(
    events: DataFrame, stored: DataFrame, same_day: bool = True, days_of: DataFrame | None = None, span: Span | None = None
) -> DataFrame:
    """Events whose id is not in the raw table yet.

    An id and its time are assigned together when the hit is admitted, so a copy lies at the same instant: only what
    `span` covers is read from the table or, without one, the days that occur in `events`. Pass `same_day=False` for
    sources that may repeat an id with another time; then all stored ids are compared. `days_of` is a cheaper frame with
    the same days.
    """
    known = stored
    if same_day and span is not None:
        known = reduce(DataFrame.where, span.covers(), known)
    known = known.select("event_id", "hit_date")
    if same_day and (span is None or span.days is None):
        days = (events if days_of is None else days_of).select(F.to_date("hit_ts").alias("hit_date"))
        # Usually a handful; broadcast by its size at run time, the list prunes the partitions of the raw table.
        known = known.join(days.distinct(), "hit_date", "left_semi")
    return events.join(known.select("event_id"), "event_id", "left_anti")
